"""Values of registered queries that have no SQL, against numpy on the same tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.plans.registry import NUMS

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack(d.embedding.to_numpy()).astype(float)
    return d, (x - x.mean(0)) / x.std(0), x


def result(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).orderBy("vec_id").toPandas()


def test_components(spark, sf_dir, vectors):
    _, z, x = vectors
    got = result(spark, sf_dir, "pca").drop(columns="vec_id").to_numpy()
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    assert np.abs((u[:, :3] * s[:3]).T @ got).diagonal() == pytest.approx(s[:3] ** 2, rel=1e-4)
    got = result(spark, sf_dir, "svd").drop(columns="vec_id").to_numpy()
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.abs((u[:, :3] * s[:3]).T @ got).diagonal() == pytest.approx(s[:3] ** 2, rel=1e-4)


def test_discriminants_separate_best(spark, sf_dir, vectors):
    d, z, _ = vectors
    got = result(spark, sf_dir, "lda_reduce").drop(columns=["vec_id", "label"], errors="ignore").to_numpy()[:, :1]
    y = d.label.to_numpy()

    def ratio(v):
        means = np.stack([v[y == c].mean(0) for c in np.unique(y)])
        counts = np.array([(y == c).sum() for c in np.unique(y)])
        between = (counts[:, None] * (means - v.mean(0)) ** 2).sum(0)
        return between / sum(((v[y == c] - v[y == c].mean(0)) ** 2).sum(0) for c in np.unique(y))

    assert ratio(got)[0] >= ratio(z).max() and ratio(got)[0] >= ratio(z @ np.random.default_rng(0).normal(size=(64, 50))).max()


def test_clusters_are_nearest_centres(spark, sf_dir):
    got = result(spark, sf_dir, "kmeans")
    d = got[[f"cluster_distance_to_{i}" for i in range(4)]].to_numpy()
    assert (got.cluster_id == d.argmin(1)).all() and got.cluster_distance.to_numpy() == pytest.approx(d.min(1), abs=1e-6)
    got = result(spark, sf_dir, "gmm")
    p = got[[c for c in got if c.startswith("cluster_prob_")]].to_numpy()
    assert p.sum(1) == pytest.approx(1.0, abs=1e-4) and got.cluster_max_prob.to_numpy() == pytest.approx(p.max(1), abs=1e-6) and (p[np.arange(len(p)), got.cluster_id] >= p.max(1) - 1e-6).all()


def test_density_query(spark, sf_dir, vectors):
    _, z, _ = vectors
    near = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1)) <= 6.0
    core = near.sum(1) >= 5
    got = result(spark, sf_dir, "dbscan")
    assert ((got.cluster_id >= 0) == (near & core[None]).any(1)).all()
    linked = result(spark, sf_dir, "single_linkage").cluster_id.to_numpy()
    assert ((linked[:, None] == linked[None]) >= near).all()


def test_imputed_and_flagged_rows(spark, sf_dir):
    whole = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", *NUMS).toPandas().set_index(["l_orderkey", "l_linenumber"]).sort_index()
    got = QUERIES["iterative_impute"](spark, sf_dir).toPandas().set_index(["l_orderkey", "l_linenumber"]).sort_index()
    known = whole.l_tax != 0
    assert not got[NUMS].isna().any().any() and got.l_tax[known].to_numpy() == pytest.approx(whole.l_tax[known].to_numpy().astype(float))
    x = np.column_stack([np.ones(known.sum()), whole.loc[known, NUMS[:3]].astype(float)])
    w = np.linalg.lstsq(x, whole.l_tax[known].to_numpy().astype(float), rcond=None)[0]
    fit = np.column_stack([np.ones((~known).sum()), whole.loc[~known, NUMS[:3]].astype(float)]) @ w
    assert got.l_tax[~known].to_numpy() == pytest.approx(fit, abs=2e-3)
    flagged = QUERIES["outlier_forest"](spark, sf_dir)
    flag = next(c for c in flagged.columns if c.endswith("outlier"))
    assert flagged.agg(F.avg(flag)).first()[0] == pytest.approx(0.1, abs=0.03)


def test_new_minority_rows_lie_between_old_ones(spark, sf_dir):
    got = QUERIES["smote"](spark, sf_dir).toPandas()
    n = got.y.value_counts()
    assert n.min() > 0.8 * n.max()
    old = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").toPandas()
    few = old.quality.value_counts().idxmin()
    assert got[got.y == few].n_chars.between(old[old.quality == few].n_chars.min(), old[old.quality == few].n_chars.max()).all()
