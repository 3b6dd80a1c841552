"""Primitives that must hold on large or skewed tables: numbering, exact quantiles, neighbours, components, clusters, running means."""

import math
import random
from collections import Counter
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import cleaning as cl
from tessera.operators import domain as do
from tessera.operators import numeric as nu
from tessera.operators import quality as qc
from tessera.operators import reduce as rd
from tessera.operators import selection as se
from tessera.operators import text as tx
from tessera.operators import windows as wn
from tessera.operators.base import FittedModel
from tessera.operators import graph
from tessera.operators.graph import connected_components
from tessera.operators.order import exact_quantiles, numbered
from tessera.plans import explain as xp


@pytest.mark.parametrize("parts", [3, 17])
def test_numbers_of_a_large_wide_table_are_each_used_once(spark, parts):
    n = 1_500_000
    d = spark.range(0, n, 1, 9).select(F.xxhash64("id").alias("h"), *[(F.col("id") * k).alias(f"c{k}") for k in range(6)])
    out = numbered(d, ["h"], "r", parts)
    got = out.agg(F.count(F.lit(1)), F.count_distinct("r"), F.min("r"), F.max("r")).first()
    assert tuple(got) == (n, n, 1, n)
    edge = out.select("h", "r").filter("r IN (1, 2, 3)").orderBy("r").collect()
    assert [x.h for x in edge] == sorted(x.h for x in edge) and edge[0].h == d.agg(F.min("h")).first()[0]


def test_ranks_of_a_large_column(spark):
    n = 400_000
    d = spark.range(0, n, 1, 7).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003))).cast("double").alias("x"))
    got = nu.with_ranks(d, "x", "r", 11).toPandas()
    want = got.x.rank(method="average")
    assert np.array_equal(got.r.to_numpy(), want.to_numpy())


@pytest.mark.parametrize("accuracy,bracket", [(10_000, 50_000), (20, 3)])
def test_quantiles_are_exact(spark, accuracy, bracket):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"a": rng.normal(size=3000), "b": rng.integers(0, 4, 3000).astype(float), "c": np.where(rng.random(3000) < 0.6, 7.0, rng.random(3000)), "d": np.nan})
    frame.loc[::11, "a"] = np.nan
    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    d = spark.createDataFrame(frame).replace(float("nan"), None)
    got = exact_quantiles(d, {c: (F.col(c), qs) for c in "abcd"}, accuracy, bracket)
    for c in "abc":
        assert got[c] == pytest.approx(np.quantile(frame[c].dropna(), qs).tolist(), rel=1e-12)
    assert got["d"] is None and exact_quantiles(d.limit(0), {"a": (F.col("a"), [0.5])}) == {"a": None}


def test_components_of_a_star_and_a_path(spark):
    e = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1600)] + [(5000, i) for i in range(4000, 4300)] + [(100, 101), (101, 100), (5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(e, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1600)}, **{i: 4000 for i in [*range(4000, 4300), 5000]}, 100: 100, 101: 100}


@pytest.mark.parametrize("kind", ["long", "binary", "string"])
def test_components_in_one_task_equal_those_of_rounds(spark, monkeypatch, kind):
    """Few edges are one staged table and one task, not a dozen tables dealt over all partitions."""
    r = random.Random(6)
    pairs = [(r.randrange(700), r.randrange(700)) for _ in range(420)] + [(5, 5), (800 + 1, 800), (900, None)] + [(i, i + 1) for i in range(1000, 1200)]
    e = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    e = e.select(*[(F.unhex(F.lpad(F.hex(c), 4, "0")) if kind == "binary" else F.col(c).cast(kind)).alias(c) for c in "ab"])
    names, stage = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, name: names.append(name) or stage(df, name))
    one = sorted(tuple(x) for x in graph.connected_components(e, "a", "b").collect())
    assert len(names) == 1
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    assert one == sorted(tuple(x) for x in graph.connected_components(e, "a", "b").collect()) and len(names) > 4
    assert len({root for _, root in one}) > 50 and len(one) == len({node for node, _ in one})
    assert graph.connected_components(e.limit(0), "a", "b").collect() == []


def test_nearest_donors_among_all_rows(spark):
    r = random.Random(1)
    rows = [[None if r.random() < 0.2 else float(r.randint(0, 30)) for _ in range(3)] for _ in range(400)] + [[None] * 3, [1.0, None, 2.0]]
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id long, a double, b double, c double")
    got = {x.id: x for x in cl.KNNImputer(["a", "b", "c"], n_neighbors=3).fit_transform(d).collect()}

    def wanted(x, j):
        found = []
        for y in rows:
            if y[j] is not None:
                both = [k for k in range(3) if x[k] is not None and y[k] is not None]
                found.append((sum((x[k] - y[k]) ** 2 for k in both) * 3 / len(both) if both else float("inf"), y[j]))
        return statistics.fmean(v for _, v in sorted(found)[:3])

    for i, x in enumerate(rows):
        for j, c in enumerate("abc"):
            assert got[i][c] == pytest.approx(x[j] if x[j] is not None else wanted(x, j))


def test_smote_takes_the_nearest_and_repeated_rows_differ(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(40, 2)), np.repeat(rng.normal(size=(1, 2)), 6, axis=0)])
    rows = [(float(a), float(b), 1) for a, b in x] + [(0.0, 0.0, 0)] * 300
    s = qc.SMOTE("y", k_neighbors=3)
    d = spark.createDataFrame(rows, "a double, b double, y int")
    part = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "id long, x array<double>")
    z = x / x.std(axis=0)
    for r in s.nearest(part, len(x), ["a", "b"], 3).groupBy("id").agg(F.collect_set("near").alias("near")).collect():
        dist = ((z - z[r.id]) ** 2).sum(axis=1)
        want = sorted((i for i in range(len(x)) if i != r.id), key=lambda i: (round(dist[i], 12), i))[:3]
        assert set(r.near) == set(want)
    new = s.resample(d).filter("y = 1").toPandas()
    assert abs(len(new) - 300) < 25
    made = new[["a", "b"]].to_numpy()[len(x) :]
    assert len(np.unique(made.round(12), axis=0)) > 0.85 * len(made)


@pytest.mark.parametrize("width", [2, 5])
def test_density_and_single_linkage_clusters(spark, width):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, width)) * 30
    x = np.concatenate([c + rng.normal(size=(70, width)) * 0.4 for c in centres] + [rng.uniform(200, 400, size=(5, width))])
    cols = [f"x{i}" for i in range(width)]
    d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in cols))
    eps, least = 1.0, 5
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps

    def parts(members):
        left, out = set(members), []
        while left:
            front = {left.pop()}
            group = set(front)
            while front:
                front = {j for i in front for j in list(left) if near[i, j]}
                left -= front
                group |= front
            out.append(frozenset(group))
        return set(out)

    core = {i for i in range(len(x)) if near[i].sum() >= least}
    got = rd.ClusteringFeatureExtractor(cols, "dbscan", eps=eps, min_samples=least, scale_features=False).fit_transform(d).toPandas().set_index("id")
    found = {frozenset(i for i in g.index if i in core) for c, g in got[got.cluster_id >= 0].groupby("cluster_id")}
    assert found == parts(core)
    assert set(got.index[got.cluster_id < 0]) == {i for i in range(len(x)) if not any(near[i, j] for j in core)}
    got = rd.ClusteringFeatureExtractor(cols, "hierarchical", distance_threshold=eps, scale_features=False).fit_transform(d).toPandas()
    assert {frozenset(g.id) for _, g in got.groupby("cluster_id")} == parts(range(len(x)))


def test_nearest_rows_are_sought_where_they_are(spark, monkeypatch):
    from tessera.operators import neighbors as nb

    monkeypatch.setattr(nb, "CELL_ROWS", 60)
    monkeypatch.setattr(nb, "LEAF", 8)
    r, k = random.Random(14), 4
    rows = [[r.choice([r.randint(0, 40), r.random() * 40]) * 1.0 for _ in range(4)] for _ in range(500)]
    rows = [[None if r.random() < (0.3 if c == 3 else 0.02) else v for c, v in enumerate(x)] for x in rows]
    rows += rows[:100] + [[None, None, None, float(i)] for i in range(3)] + [[5.0, None, None, None]] * 2
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id long, a double, b double, c double, e double")
    sent = []
    route = nb.Cells.route
    monkeypatch.setattr(nb.Cells, "route", lambda self, *a: sent.append((route(self, *a), self)) or sent[-1][0])
    got = {x.id: x[1:] for x in cl.KNNImputer(["a", "b", "c", "e"], n_neighbors=k).fit_transform(d).collect()}
    for i, x in enumerate(rows):
        for j in (j for j in range(4) if x[j] is None):
            near = []
            for y in rows:
                both = [c for c in range(4) if x[c] is not None and y[c] is not None]
                if y[j] is not None:
                    near.append((sum((y[c] - x[c]) ** 2 for c in both) * 4 / len(both) if both else math.inf, y[j]))
            assert got[i][j] == pytest.approx(statistics.fmean(v for _, v in sorted(near)[:k]))
    (home, cells), (others, _) = sent
    plain = others.filter("c3 IS NULL AND c0 IS NOT NULL AND c1 IS NOT NULL AND c2 IS NOT NULL")
    assert cells.cells > 5 and plain.filter(~F.col("cell").isin(cells.mixed)).count() < 0.6 * cells.cells * plain.select("id").distinct().count()


def test_blocks_of_a_table_meet_once(spark, monkeypatch):
    from tessera.operators import neighbors as nb

    monkeypatch.setattr(nb, "QUERY_ROWS", 20)
    d = spark.range(200)
    seen = nb.in_pairs(d, 200, lambda a, b: pd.DataFrame({"u": np.repeat(a["id"], len(b if b is not None else a)), "v": np.tile(a["id"] if b is None else b["id"], len(a))}), "u long, v long").collect()
    pairs = Counter(frozenset((r.u, r.v)) for r in seen if r.u != r.v)
    assert len(pairs) == 200 * 199 // 2
    assert sum(r.u == r.v for r in seen) == 200
    assert len(seen) < 0.6 * 200 * 200  # as pairs of one order, but within blocks


def test_distances_at_the_reach_are_measured():
    from tessera.operators.neighbors import within

    rng = np.random.default_rng(13)
    for size, far in ((1.0, 0.0), (1.0, 1e5), (1e-4, 3.0), (1e154, 0.0)):
        x = rng.normal(size=(700, 6)) * size + far
        x[300:600] = x[:300]
        x[5, 2], x[6, 1] = np.nan, np.inf
        d = np.zeros((len(x), len(x)))
        with np.errstate(invalid="ignore", over="ignore"):
            for k in range(6):
                d += (x[:, k, None] - x[None, :, k]) ** 2
            d = np.sqrt(d)
        reach = float(np.nanquantile(d[np.isfinite(d)], 0.05, method="lower"))  # some distance itself
        want = {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= reach))}
        with np.errstate(over="ignore"):
            got = [(int(a), int(b)) for i, j, _ in within(x, x, reach) for a, b in zip(i, j)]
            near = [(int(a), int(b), float(c)) for i, j, e in within(x, x, reach, closest=True) for a, b, c in zip(i, j, e)]
        assert len(got) == len(set(got)) and set(got) == want
        assert all((a, b) in want and c == d[a, b] for a, b, c in near)
        assert {a for a, _ in want} == {a for a, _, c in near if c == np.nanmin(d[a])}


def test_wide_components_are_those_of_the_matrix(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 24)) @ rng.normal(size=(24, 24))
    cols = [f"x{i}" for i in range(24)]
    d = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols))
    got = rd.DimensionalityReducer(columns=cols, n_components=3, keep_original=False).fit_transform(d).toPandas().to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    assert np.abs(got.T @ got) == pytest.approx(np.diag(s[:3] ** 2), abs=1e-6 * s[0] ** 2)
    assert np.abs((u[:, :3] * s[:3]).T @ got).diagonal() == pytest.approx(s[:3] ** 2)


def test_a_running_mean_without_groups(spark):
    r = random.Random(6)
    values = [None if r.random() < 0.2 or i < 3 else r.random() * 100 for i in range(2000)]
    d = spark.createDataFrame(list(enumerate(values)), "t long, x double")
    got = [x.e for x in wn.ema(d, "x", "e", 9, "t").orderBy("t").collect()]
    last, a = None, 0.2
    for g, x in zip(got, values):
        last = last if x is None else x if last is None else a * x + (1 - a) * last
        assert g == pytest.approx(last) if last is not None else g is None


def test_inflation_of_dependent_columns(spark):
    rng = np.random.default_rng(7)
    a, b, c = rng.normal(size=(3, 500))
    d = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": c, "total": a + b, "twice": 2 * c + 1}))
    assert len(se.compute_vif_drop(d)) == 2 and not se.compute_vif_drop(d.select("a", "b", "c"))
    r = np.corrcoef(np.stack([a, b, c]))
    for k in range(3):
        o = [i for i in range(3) if i != k]
        assert se.variance_inflation(r, k) == pytest.approx(np.linalg.inv(r)[k, k])


def test_scores_of_customers_follow_sorted_places(spark):
    r = random.Random(8)
    rows = [(i % 997, f"2024-01-{1 + r.randint(0, 27):02d}", r.random() * 50) for i in range(5000)]
    d = spark.createDataFrame(rows, "k long, day string, v double").withColumn("day", F.to_date("day"))
    op = do.EcommerceRFM(customer_col="k", date_col="day", monetary_col="v")
    t = op.fit(d).tables["rfm"].toPandas()
    order = t.sort_values(["monetary_total", "k"]).reset_index(drop=True)
    want = [max(1, -(-i * 5 // (len(order) - 1))) for i in range(len(order))]
    assert order.monetary_score.tolist() == want


def test_a_saved_topic_model_transforms(spark, tmp_path):
    d = spark.createDataFrame([(i, "stars planets moon orbit" if i % 2 else "bread butter flour oven") for i in range(40)], "id long, t string")
    m = tx.TopicModelingFeatures("t", 2, 50, 5).fit(d)
    m.save(str(tmp_path / "m"))
    again = FittedModel.load(spark, str(tmp_path / "m"))
    want, got = ([[r.t_topic_0, r.t_topic_1] for r in x.transform(d).orderBy("id").collect()] for x in (m, again))
    assert np.array(got) == pytest.approx(np.array(want), abs=1e-9)


def test_text_svd_is_that_of_the_matrix(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice("sun moon star sea land tree bird fish".split()) for _ in range(12)) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    (_, v), (_, s) = tx.build_text_pipeline("t", svd_components=3, ngram_range=(1, 1))
    rows = v.fit_transform(d)
    got = s.fit_transform(rows).orderBy("id").toPandas()
    terms = sorted({k for x in got.t_tfidf for k in x})
    x = np.array([[m.get(k, 0.0) for k in terms] for m in got.t_tfidf])
    y = got[[f"t_tfidf_svd_{i}" for i in range(3)]].to_numpy()
    want = np.linalg.svd(x)[1][:3]
    assert np.sqrt((y**2).sum(axis=0)) == pytest.approx(want, rel=1e-4)


def test_shapley_values_add_up(spark):
    rng = np.random.default_rng(10)
    d = spark.createDataFrame(pd.DataFrame({"id": range(50), "a": rng.normal(size=50), "b": rng.normal(size=50), "c": rng.normal(size=50)}))

    class Linear:
        def transform(self, df):
            return df.withColumn("prediction", 2 * F.col("a") - F.col("b") + 1)

    got = xp.shapley_values(Linear(), d, ["a", "b", "c"], "id", permutations=6).join(d, "id").toPandas()
    base = got.shap_base.iloc[0]
    assert (got.shap_a + got.shap_b + got.shap_c + base).to_numpy() == pytest.approx((2 * got.a - got.b + 1).to_numpy())
    assert np.ptp((got.shap_a - 2 * got.a).to_numpy()) == pytest.approx(0, abs=1e-9) and got.shap_c.abs().max() == pytest.approx(0, abs=1e-9)


def test_neighbour_embedding_keeps_groups_apart(spark):
    rng = np.random.default_rng(12)
    group = rng.integers(0, 3, 180)
    x = (rng.normal(size=(3, 6)) * 12)[group] + rng.normal(size=(180, 6))
    cols = [f"x{i}" for i in range(6)]
    d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in cols))
    m = rd.DimensionalityReducer(columns=cols, method="tsne", sample_rows=120, keep_original=False).fit(d)
    y = m.transform(d).orderBy("id").toPandas()[["reduced_0", "reduced_1"]].to_numpy()
    nearest = np.array([np.argsort(((y - p) ** 2).sum(1))[1] for p in y])
    assert (group[nearest] == group).mean() > 0.95
    p = rd.affinities(((x[:, None] - x[None]) ** 2).sum(-1), 10.0)
    assert np.exp(-(p * np.log(np.maximum(p, 1e-300))).sum(1)) == pytest.approx(10.0, rel=1e-3)


def test_formulas_of_functions(spark):
    from tessera.operators import interactions as it

    out = it.FormulaFeatures(formulas={"a": "id + 1", "b": lambda df: df["id"] * 2}).fit_transform(spark.range(3)).collect()
    assert [(r.a, r.b) for r in out] == [(1, 0), (2, 2), (3, 4)]


def test_word_vectors_are_trained_side_by_side(spark, monkeypatch):
    from pyspark.ml.feature import Word2Vec

    parts, fit = [], Word2Vec.fit
    monkeypatch.setattr(Word2Vec, "fit", lambda self, d: parts.append(self.getNumPartitions()) or fit(self, d))
    monkeypatch.setattr(tx, "WORDS_A_TASK", 150)
    d = spark.createDataFrame([(i, f"stars planets moon w{i}" if i % 2 else f"bread butter oven w{i}") for i in range(100)], "id long, t string")
    m = tx.WordEmbeddingFeatures("t", dims=4, train=True).fit(d)
    assert parts == [3]  # 400 words
    assert {r.word for r in m.tables["vectors"].collect()} == {w for r in d.collect() for w in r.t.split()}
    monkeypatch.setattr(tx, "WORDS_A_TASK", 1000)
    tx.WordEmbeddingFeatures("t", dims=4, train=True).fit(d)
    assert parts == [3, 1]


def test_topics_are_fitted_on_counts_made_once(spark, monkeypatch):
    from pyspark.ml.clustering import LDA

    held, fit = [], LDA.fit
    monkeypatch.setattr(LDA, "fit", lambda self, d: held.append((d.columns, d.storageLevel.useDisk)) or fit(self, d))
    d = spark.createDataFrame([(i, "stars planets moon orbit" if i % 2 else "bread butter flour oven") for i in range(40)], "id long, t string")
    tx.TopicModelingFeatures("t", 2, 50, 5).fit(d)
    assert held == [(["features"], True)]
