"""Readers, writers, sampling and artifact folders."""

from __future__ import annotations

import json
import os
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import InputValidationError, SecurityError
from tessera.operators.base import FittedModel


def read_frame(spark: SparkSession, path: str) -> DataFrame:
    """CSV (with a header, types inferred) or Parquet, by extension."""
    name = path.rstrip("/").lower()
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith((".csv", ".csv.gz")):
        return spark.read.csv(path, header=True, inferSchema=True)
    raise ValueError(f"{path}: not .csv or .parquet")


def read_reference(spark: SparkSession, path: str, allowed: list[str] | None = None) -> DataFrame:
    """As read_frame, but local paths must lie under the working folder, /tmp or an allowed root; other schemes must be allowed by prefix."""
    roots = [os.getcwd(), "/tmp", *(allowed or [])]
    u = urlparse(path)
    if u.scheme and u.scheme != "file":
        if not any(path.startswith(r) for r in (allowed or [])):
            raise SecurityError("path outside of allowed roots", path=path)
    else:
        real = os.path.realpath(u.path if u.scheme else path)
        if not any(os.path.commonpath([real, os.path.realpath(r)]) == os.path.realpath(r) for r in roots if "://" not in r):
            raise SecurityError("path outside of allowed roots", path=path)
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def read_word_vectors(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(word, vector) from lines `word v1 ... vd`; lines of another width are left out."""
    parts = F.split(F.col("value"), " ")
    d = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") == dims + 1)
    return d.select(F.col("p")[0].alias("word"), F.slice("p", 2, dims).cast("array<double>").alias("vector"))


def sample_df(df: DataFrame, n: int | None = None, frac: float | None = None, stratify_by: str | None = None, random_state: int = 42) -> DataFrame:
    """A uniform or stratified sample; n rows exactly by least hash, a share by hash threshold; never empty for a table that isn't."""
    if n is None and frac is None:
        return df
    h = F.xxhash64(*df.columns, F.lit(random_state))
    if n is not None and not stratify_by:
        return df.orderBy(h).limit(max(1, n))
    if frac is None:
        frac = min(1.0, n / max(1, df.count()))
    frac = min(1.0, max(0.0, frac))
    if stratify_by:
        if stratify_by not in df.columns:
            raise InputValidationError("no such column", column=stratify_by)
        strata = [r[0] for r in df.select(stratify_by).distinct().limit(10_001).collect()]
        if len(strata) <= 10_000 and None not in strata:
            out = df.sampleBy(stratify_by, {s: frac for s in strata}, seed=random_state)
            return out if not out.isEmpty() else df.orderBy(h).limit(1)
    out = df.filter(F.pmod(h, F.lit(1_000_000)) < int(frac * 1_000_000))
    return out if not out.isEmpty() else df.orderBy(h).limit(1)


class ArtifactStore:
    """A folder of JSON, text and models for a run."""

    def __init__(self, root: str):
        self.root = root
        os.makedirs(root, exist_ok=True)

    def path(self, name: str) -> str:
        p = os.path.realpath(os.path.join(self.root, name))
        if os.path.commonpath([p, os.path.realpath(self.root)]) != os.path.realpath(self.root):
            raise SecurityError("path outside of the store", path=name)
        return p

    def save(self, name: str, value) -> str:
        p = self.path(name)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as f:
            f.write(value if isinstance(value, str) else json.dumps(value, indent=2, default=str))
        return p

    def save_model(self, name: str, model: FittedModel) -> str:
        model.save(self.path(name))
        return self.path(name)

    def load(self, name: str):
        with open(self.path(name)) as f:
            s = f.read()
        return json.loads(s) if name.endswith(".json") else s

    def load_model(self, spark: SparkSession, name: str) -> FittedModel:
        return FittedModel.load(spark, self.path(name))
