"""The contract of operators: `fit` aggregates to a small state, `transform` is a lazy plan on it.

A state is numbers (a dict) and tables (DataFrames). Tables stay tables: they are
joined, by broadcast only if they were counted and found small, and never
collected. Operators are pyspark.ml estimators, so they compose in a Pipeline.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import InputValidationError, SecurityError, TesseraError
from tessera.sources.files import read_text, write_text

#: State tables up to this many rows are broadcast.
BROADCAST_ROWS = 100_000
#: Columns added per select, so that no single projection grows without bound.
SELECT_CHUNK = 400


class Registry:
    """Named classes or functions; the extension surface."""

    def __init__(self):
        self._items: dict[str, object] = {}

    def register(self, name: str, item: object) -> object:
        if name in self._items and self._items[name] is not item:
            raise ValueError(f"{name} is registered")
        self._items[name] = item
        return item

    def get(self, name: str) -> object:
        if name not in self._items:
            raise KeyError(f"{name}; available: {', '.join(self.available())}")
        return self._items[name]

    def available(self) -> list[str]:
        return sorted(self._items)


OPERATORS = Registry()


class Operator(Estimator):
    """Subclasses list parameters in `defaults` and define `learn` and `apply`."""

    defaults: dict[str, object] = {}

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        OPERATORS.register(cls.__name__, cls)

    def __init__(self, *args, **kw):
        super().__init__()
        names = list(self.defaults)
        if len(args) > len(names):
            raise TypeError(f"{type(self).__name__} takes at most {len(names)} parameters")
        given = dict(zip(names, args), **kw)
        if unknown := set(given) - set(names):
            raise TypeError(f"{type(self).__name__} has no parameter {', '.join(sorted(unknown))}")
        for k, v in {**self.defaults, **given}.items():
            setattr(self, k, v)
        self.check()

    def check(self) -> None:
        """Raise on wrong parameters."""

    def params_dict(self) -> dict:
        return {k: getattr(self, k) for k in self.defaults}

    def learn(self, df: DataFrame) -> tuple[dict, dict[str, DataFrame]]:
        return {}, {}

    def apply(self, df: DataFrame, state: dict, tables: dict[str, DataFrame]) -> DataFrame:
        raise NotImplementedError

    def inverse(self, df: DataFrame, state: dict) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} has no inverse")

    def _fit(self, df: DataFrame) -> FittedModel:
        state, tables = self.learn(df)
        return FittedModel(self, state, tables)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class FittedModel(Model):
    def __init__(self, operator: Operator, state: dict, tables: dict[str, DataFrame]):
        super().__init__()
        self.operator, self.state, self.tables = operator, state, tables

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.operator.apply(df, self.state, self.tables)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self.operator.inverse(df, self.state)

    def feature_names(self, df: DataFrame) -> list[str]:
        """Columns that the model adds or keeps; known without running anything."""
        out = self.transform(df.limit(0)).columns
        return [c for c in out if c not in df.columns] or out

    def save(self, path: str) -> None:
        """Tables as Parquet, fitted MLlib pipelines in their own format, numbers as JSON beside a checksum of it: no pickles."""
        spark = SparkSession.active()
        tables = [n for n, t in self.tables.items() if isinstance(t, DataFrame)]
        for name, t in self.tables.items():
            if name in tables:
                t.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
            else:
                t.write().overwrite().save(f"{path}/{name}.pipeline")
        body = json.dumps({"operator": type(self.operator).__name__, "params": self.operator.params_dict(), "state": self.state, "tables": sorted(tables), "pipelines": sorted(set(self.tables) - set(tables))}, sort_keys=True, default=str)
        write_text(spark, f"{path}/model.json", body)
        write_text(spark, f"{path}/model.json.sha256", hashlib.sha256(body.encode()).hexdigest())

    @staticmethod
    def load(spark: SparkSession, path: str, verify_checksum: bool = True) -> FittedModel:
        body = read_text(spark, f"{path}/model.json")
        if verify_checksum:
            try:
                wanted = read_text(spark, f"{path}/model.json.sha256").strip()
            except FileNotFoundError as e:
                raise SecurityError("no checksum", path=path) from e
            if hashlib.sha256(body.encode()).hexdigest() != wanted:
                raise SecurityError("checksum differs", path=path)
        d = json.loads(body)
        cls = OPERATORS.get(d["operator"])
        tables = {n: spark.read.parquet(f"{path}/{n}.parquet") for n in d["tables"]}
        pipelines = {n: PipelineModel.load(f"{path}/{n}.pipeline") for n in d.get("pipelines", [])}
        return FittedModel(cls(**d["params"]), d["state"], {**tables, **pipelines})


# --- helpers ---------------------------------------------------------------

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NUMERIC)


def is_datetime(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, TEMPORAL)


def is_string(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.StringType, T.VarcharType, T.CharType))


def numeric_columns(df: DataFrame, without: list[str] | None = None) -> list[str]:
    return [c for c in df.columns if is_numeric(df, c) and not isinstance(df.schema[c].dataType, T.BooleanType) and c not in (without or [])]


def string_columns(df: DataFrame, without: list[str] | None = None) -> list[str]:
    return [c for c in df.columns if is_string(df, c) and c not in (without or [])]


def chosen(df: DataFrame, columns: list[str] | None, default: list[str]) -> list[str]:
    """The named columns (which must exist) or the default."""
    if columns is None:
        return default
    if missing := [c for c in columns if c not in df.columns]:
        raise InputValidationError("missing columns", columns=missing)
    return list(columns)


def number(c: str | Column) -> Column:
    """A double, with NaN as null."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def finite(c: str | Column) -> Column:
    x = number(c)
    return F.when(F.abs(x) == float("inf"), F.lit(None).cast("double")).otherwise(x)


def key(c: str) -> Column:
    """A category as text; null is the category `nan`."""
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def scalars(df: DataFrame, exprs: dict[str, Column]) -> dict:
    """Values of many aggregates, in one job."""
    if not exprs:
        return {}
    row = df.agg(*[e.alias(f"a{i}") for i, e in enumerate(exprs.values())]).first()
    return dict(zip(exprs, row))


def add(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Columns added (or replaced) in projections of bounded size."""
    items = list(new.items())
    for i in range(0, len(items), SELECT_CHUNK):
        df = df.withColumns(dict(items[i : i + SELECT_CHUNK]))
    return df


def lookup(df: DataFrame, table: DataFrame, keys: list[str] | dict[str, Column], values: dict[str, object], rows: int | None = None, null_safe: bool = True) -> DataFrame:
    """Left join of a state table, with defaults for unknown keys. keys: names in the table, from equal names or expressions of df."""
    keys = {k: F.col(k) for k in keys} if isinstance(keys, list) else keys
    right = table.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(v).alias(f"__v{i}") for i, v in enumerate(values)])
    if rows is not None and rows <= BROADCAST_ROWS:
        right = F.broadcast(right)
    left = df.withColumns({f"__l{i}": e for i, e in enumerate(keys.values())})
    cond = None
    for i in range(len(keys)):
        c = left[f"__l{i}"].eqNullSafe(right[f"__k{i}"]) if null_safe else left[f"__l{i}"] == right[f"__k{i}"]
        cond = c if cond is None else cond & c
    out = left.join(right, cond, "left")
    made = {v: (F.coalesce(F.col(f"__v{i}"), F.lit(d).cast(table.schema[v].dataType)) if d is not None else F.col(f"__v{i}")) for i, (v, d) in enumerate(values.items())}
    return out.select(*[F.col(c) for c in df.columns if c not in made], *[e.alias(v) for v, e in made.items()])


def skew_kurtosis(n: Column, skew: Column, kurt: Column) -> tuple[Column, Column]:
    """Bias-corrected skewness and excess kurtosis from Spark's population moments."""
    n = n.cast("double")
    g1 = F.when(n > 2, F.try_divide(skew * F.sqrt(n * (n - 1)), n - 2))
    g2 = F.when(n > 3, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * kurt + 6))
    return g1, g2


def require(ok: bool, message: str, **context) -> None:
    if not ok:
        raise TesseraError(message, **context)
