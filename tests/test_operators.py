"""Edge frames: nulls, NaN, ties, constants, unseen keys; fit and transform apart; save and load; plans."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.errors import ConfigurationError, InputValidationError, PipelineNotFittedError, SecurityError, TesseraError
from tessera.operators import aggregate as ag
from tessera.operators import cleaning as cl
from tessera.operators import encoders as en
from tessera.operators import numeric as nu
from tessera.operators import quality as qc
from tessera.operators import selection as se
from tessera.operators import statistical as st
from tessera.operators import windows as wn
from tessera.operators.base import FittedModel, Registry
from tessera.plans import config as cfg
from tessera.plans.auto import AutoFeatureEngineer
from tessera.sources.readers import ArtifactStore, read_frame, read_reference, read_word_vectors, sample_df


@pytest.fixture(scope="module")
def frame(spark):
    r = [(i, float(i % 5) if i % 7 else None, "ab"[i % 2] if i % 5 else None, i % 2) for i in range(40)]
    return spark.createDataFrame(r, "id long, x double, c string, y int")


@pytest.fixture(scope="module")
def unseen(spark):
    return spark.createDataFrame([(100, None, "zz", 1), (101, float("nan"), None, 0), (102, 3.0, "a", 1)], "id long, x double, c string, y int")


@pytest.mark.parametrize("op, column, default", [
    (en.FrequencyEncoder(cols=["c"]), "c_freq", 0.0),
    (en.CountEncoder(cols=["c"], unseen_value=-1), "c_count", -1.0),
    (en.OrdinalEncoder(cols=["c"]), "c_ord", -1.0),
    (en.WoEEncoder(cols=["c"]), "c_woe", 0.0),
    (en.KFoldTargetEncoder(cols=["c"]), "c_te", 0.5),
])
def test_unseen_and_null_keys(frame, unseen, op, column, default):
    got = {r.id: r[column] for r in op.fit(frame).transform(unseen).collect()}
    assert got[100] == pytest.approx(default)
    assert all(v is not None for v in got.values())


def test_rare_groups_and_nulls(frame, unseen):
    got = {r.id: r.c for r in en.RareCategoryGrouper(cols=["c"]).fit(frame).transform(unseen).collect()}
    assert got == {100: "Other", 101: None, 102: "a"}


def test_out_of_fold_never_uses_own_fold(frame):
    op = en.OutOfFoldTargetEncoder(cols=["c"], fold_col="id", row_id="id", n_splits=4, smoothing=0.0)
    rows = op.fit_transform(frame).collect()
    for r in rows:
        rest = [x.y for x in rows if x.c == r.c and x.id % 4 != r.id % 4]
        assert r.c_te == pytest.approx(sum(rest) / len(rest))


def test_ordered_statistics_ignore_later_rows(spark, frame):
    op = en.CatBoostEncoder(cols=["c"], order_col="id", positive_class="1")
    a = {r.id: r.c_te for r in op.fit_transform(frame).collect()}
    first = [r for r in frame.collect() if r.c == "a"][0]
    assert a[first.id] == pytest.approx(0.5)
    b = {r.id: r.c_te for r in en.CatBoostEncoder(cols=["c"], order_col="id", buckets=5).fit_transform(frame).collect()}
    assert a == pytest.approx(b)


def test_imputers_fill_all(frame):
    for op in (cl.MedianImputer(["x"]), cl.KNNImputer(["x", "y"]), cl.IterativeImputer(["x", "y"])):
        assert op.fit_transform(frame).filter("x IS NULL OR isnan(x)").count() == 0
    assert cl.CategoricalImputer(["c"]).fit(frame).state["fill"]["c"] == "a"


def test_scalers_on_constants_and_back(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (1.0, None)], "k double, v double")
    for cls in cl.SCALERS.values():
        m = cls(["k", "v"]).fit(d)
        t = m.transform(d)
        assert all(math.isfinite(r.k) for r in t.collect())
        assert [r.v for r in m.inverse_transform(t).collect()] == pytest.approx([2.0, 4.0, None])


def test_bins_of_infinities_and_nulls(spark):
    d = spark.createDataFrame([(0.0,), (10.0,), (float("inf"),), (None,), (float("nan"),), (5.0,)], "x double")
    got = [r.x_binned for r in nu.BinningTransformer(["x"], n_bins=2).fit_transform(d).collect()]
    assert got == [0, 1, None, None, None, 1]


def test_domains_raise(spark):
    d = spark.createDataFrame([(-1.0,)], "x double")
    for op in (nu.LogTransformer(["x"]), nu.Log1pTransformer(["x"]), nu.BoxCoxTransformer(["x"]), nu.SqrtTransformer(["x"], "error")):
        with pytest.raises(TesseraError):
            op.fit(d)
    with pytest.raises(ConfigurationError):
        nu.BinningTransformer(strategy="quantile")


def test_rows_of_nulls(spark):
    d = spark.createDataFrame([(None, None), (1.0, None), (1.0, 3.0)], "a double, b double")
    r = st.RowStatisticsTransformer(("mean", "std", "sum", "median", "skew", "kurtosis")).fit_transform(d).collect()
    assert r[0].row_mean is None and r[0].row_sum == 0 and r[1].row_std is None and r[2].row_mean == 2 and r[2].row_null_count == 0


def test_windows_need_an_order(frame):
    with pytest.raises(InputValidationError):
        wn.LagFeaturesTransformer(["x"]).fit_transform(frame)
    r = wn.LagFeaturesTransformer(["id"], group_by="c", order_by="id").fit_transform(frame)
    assert r.filter("c IS NULL AND id_lag_1 IS NOT NULL").count() == 0


def test_ema_across_batches(spark):
    d = spark.range(5000).select("id", F.lit("g").alias("g"), (F.col("id") % 7).cast("double").alias("v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    got = [r.e for r in wn.ema(d, "v", "e", 9, ["id"], ["g"]).orderBy("id").collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    e = None
    for i, x in enumerate(got):
        e = float(i % 7) if e is None else 0.2 * (i % 7) + 0.8 * e
        assert x == pytest.approx(e)


def test_save_and_load(spark, frame, unseen, tmp_path):
    m = en.WoEEncoder(cols=["c"]).fit(frame)
    m.save(str(tmp_path / "m"))
    a = m.transform(unseen).drop("x").orderBy("id").collect()
    assert FittedModel.load(spark, str(tmp_path / "m")).transform(unseen).drop("x").orderBy("id").collect() == a
    (tmp_path / "m" / "model.json").write_text("{}")
    with pytest.raises(SecurityError):
        FittedModel.load(spark, str(tmp_path / "m"))


def test_auto_fit_transform_export(spark, frame, tmp_path):
    eng = AutoFeatureEngineer(row_id="id", estimator_family="linear", row_statistics=True, transform_strategy="none")
    with pytest.raises(PipelineNotFittedError):
        eng.transform(frame)
    made = eng.fit_transform(frame, "y")
    assert made.count() == 40 and eng.explanation().decisions
    eng.export(str(tmp_path / "p"))
    new = frame.drop("y")
    a = eng.transform(new).orderBy("id")
    b = AutoFeatureEngineer.load(spark, str(tmp_path / "p")).transform(new).orderBy("id")
    assert a.columns == b.columns and a.collect() == b.collect()
    with pytest.raises(InputValidationError):
        eng.transform(new.drop("x"))


def test_schema_checks(frame):
    v = qc.SchemaValidator(strict=True).fit(frame)
    assert v.violations(frame) == {}
    found = v.violations(frame.withColumn("x", F.lit(1e9)).withColumn("c", F.lit("new")))
    assert set(found) == {"x: range", "c: category"}


def test_selectors(frame, spark):
    assert se.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-6)
    d = frame.withColumn("z", F.col("y") * 2.0 + 1).fillna(0.0)
    m = se.MutualInfoSelector(k=1, label_col="y", columns=["x", "z"]).fit(d)
    assert m.state["selected"] == ["z"] and "x" not in m.transform(d).columns
    assert se.compute_vif_drop(d.withColumn("w", F.col("x") + F.col("z")), columns=["x", "z", "w"])


def test_drift_of_equal_and_moved(spark):
    a = spark.range(1000).select((F.col("id") % 50).cast("double").alias("x"), F.lit("k").alias("c"))
    assert qc.ks_numeric(a, a, "x") == 0 and qc.compute_psi(a, a, "x") == 0
    b = a.withColumn("x", F.col("x") + 50)
    assert qc.ks_numeric(a, b, "x") == 1
    assert {r["column"]: r.severity for r in qc.DriftDetector().detect(a, b).collect()} == {"x": "CRITICAL", "c": "OK"}


def test_smote_balances(spark):
    d = spark.createDataFrame([(float(i), 1 if i < 10 else 0) for i in range(100)], "x double, y int")
    n = {r.y: r["count"] for r in qc.SMOTE("y").resample(d).groupBy("y").count().collect()}
    assert n[0] == 90 and 70 <= n[1] <= 110


def test_config_sources(tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text('{"binning_n_bins": 7, "te_smoothing": 1}')
    monkeypatch.setenv("TESSERA__TE_SMOOTHING", "2")
    s = cfg.load_config(str(tmp_path / "c.json"), ["te_smoothing=3.5"], {"binning_n_bins": 4})
    assert s.binning_n_bins == 7 and s.te_smoothing == 3.5
    with pytest.raises(ConfigurationError):
        cfg.load_config(api_kwargs={"nope": 1}, use_env=False)
    assert cfg.infer_type("[1, 2]") == [1, 2] and cfg.infer_type("TRUE") is True


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    assert read_frame(spark, str(tmp_path / "t.csv")).count() == 2
    with pytest.raises(ValueError):
        read_frame(spark, "t.txt")
    with pytest.raises(SecurityError):
        read_reference(spark, "/etc/passwd.csv")
    (tmp_path / "v.txt").write_text("cat 1 2\ndog 3\n")
    assert [tuple(r) for r in read_word_vectors(spark, str(tmp_path / "v.txt"), 2).collect()] == [("cat", [1.0, 2.0])]
    d = spark.range(1000)
    assert sample_df(d, n=10).count() == 10 and 0 < sample_df(d, frac=0.1).count() < 300
    with pytest.raises(SecurityError):
        ArtifactStore(str(tmp_path / "s")).save("../x.json", {})


def test_registry():
    r = Registry()
    r.register("a", 1)
    assert r.get("a") == 1 and r.available() == ["a"]
    with pytest.raises(KeyError):
        r.get("b")


def test_lookups_broadcast_and_expressions_stay_in_the_jvm(frame):
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    p = plan(en.FrequencyEncoder(cols=["c"]).fit(frame).transform(frame))
    assert "BroadcastHashJoin" in p and "CartesianProduct" not in p and "Python" not in p
    p = plan(wn.LagFeaturesTransformer(["x"], [1, 2, 3], "c", "id").fit_transform(frame))
    assert p.count("Exchange") == 1 and p.count("Sort [") <= 1


def test_group_statistics_of_unknown_groups(spark, frame):
    m = ag.GroupByStatsTransformer("c", ["x"], ["mean", "nunique"]).fit(frame)
    r = m.transform(spark.createDataFrame([Row(c="q"), Row(c=None)], "c string")).collect()
    assert all(x.x_mean == 0.0 and x.c_count == 0 for x in r)
