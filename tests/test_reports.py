"""Figures of reports, and the advisor's replies."""

import pytest
from pyspark.sql import functions as F

from tessera.errors import InputValidationError
from tessera.operators import quality as qc
from tessera.plans import agent
from tessera.plans import explain as xp
from tessera.plans.config import Settings


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(float(i), float(i * i % 17), "a<b" if i % 3 else None, i % 2) for i in range(60)], "x double, z double, c string, y int")


def test_figures_of_a_table(frame, tmp_path):
    f = xp.figures(frame)
    assert {"Missing", "Boxes", "Histogram of x", "Values of c", "Correlations"} <= f.keys()
    assert f["Histogram of x"].svg.count("<rect") == 30 and "a&lt;b" in f["Values of c"].svg and "a<b" not in f["Values of c"].svg
    path = xp.ReportBuilder().build(qc.analyze_dataset(frame, "y"), str(tmp_path / "r.html"), frame)
    assert open(path).read().count("<svg") == len(f)
    assert xp.draw_bars([]).svg.startswith("<svg") and xp.draw_histogram([]).svg.startswith("<svg") and xp.draw_correlations([]).svg.startswith("<svg")


def test_replies_of_a_client(frame):
    fp = qc.fingerprint(frame, "y")
    asked = []

    def client(request):
        asked.append(request)
        return "no idea" if len(asked) == 1 else 'Use {"winsorize": true, "unknown": 1} here.'

    s = agent.Advisor(client).strategy(fp, Settings())
    assert s.overrides == {"winsorize": True} and len(asked) == 2 and asked[0]["table"]["n_rows"] == 60
    assert agent.Advisor(lambda r: {"winsorize": True})(frame, "y", Settings()).winsorize is True
    with pytest.raises(InputValidationError):
        agent.Advisor(lambda r: "nothing").strategy(fp, Settings())
    assert agent.Advisor(lambda r: 1 / 0, fall_back=True).strategy(fp, Settings()).name == "heuristic"
    assert agent.Advisor().strategy(fp, Settings()).name == "heuristic"


def test_hooks_need_a_backend(frame):
    from tessera.errors import MissingBackendError
    from tessera.operators import text as tx

    with pytest.raises(MissingBackendError):
        tx.NERFeatureExtractor(["c"]).fit_transform(frame)
    out = tx.NERFeatureExtractor(["c"], without_backend="zeros").fit_transform(frame)
    assert out.agg(F.sum("c_entity_count")).first()[0] == 0
