"""Each query with SQL against DuckDB over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.operators import selection as se

QUERIES, SQL = entry.queries(), entry.oracle_sql()
OWN = sorted(k for k in SQL if not k.startswith("op") and k != "pipeline")


def rows(values, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
        return x.isoformat() if hasattr(x, "isoformat") else str(x)

    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = duck.execute(SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(got.fetchall(), columns)


@pytest.mark.parametrize("name", ["entity_embeddings", "numeric_yeo_johnson", "bin_decision_tree", "outlier_forest", "knn_impute", "iterative_impute", "pca", "lda_reduce", "svd", "kmeans", "gmm", "dbscan", "smote", "auto_features", "finance_macd", "drift_report", "vif_drop", "leakage_risk"])
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_boruta_runs_enough_rounds_to_decide(spark, sf_dir, monkeypatch):
    fitted = []
    fit = se.BorutaSelector.fit
    monkeypatch.setattr(se.BorutaSelector, "fit", lambda self, df: fitted.append(fit(self, df)) or fitted[-1])
    assert QUERIES["boruta"](spark, sf_dir).count() > 0
    assert set(fitted[0].state["status"].values()) & {"confirmed", "rejected"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
