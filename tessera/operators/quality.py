"""Profiles, issues, schema checks, drift and class imbalance."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import DataQualityError, InputValidationError, SchemaValidationError
from tessera.operators.aggregate import correlation_matrix, value_counts
from tessera.operators.base import is_datetime, is_numeric, is_string, number, numeric_columns, scalars, skew_kurtosis, string_columns
from tessera.operators.neighbors import in_cells
from tessera.operators.order import before, exact_quantiles, in_ranges
from tessera.sources.staging import stage

LEAK_NAMES = ("target", "label", "outcome", "result")


def validate_input_frame(df: DataFrame, target: str | None = None) -> None:
    names = df.columns
    if len({n.lower() for n in names}) < len(names):
        raise InputValidationError("repeated column names", columns=names)
    if target is not None and target not in names:
        raise InputValidationError("no target column", target=target)
    if not names or df.isEmpty():
        raise InputValidationError("empty table")


def leak_prone_columns(df: DataFrame, target: str) -> list[str]:
    return [c for c in df.columns if c != target and c.lower() in (target.lower(), *LEAK_NAMES)]


def ensure_no_target(df: DataFrame, inputs: list[str], label: str) -> None:
    if label in inputs:
        raise InputValidationError("the target is an input of transform", label=label)


def detect_task(df: DataFrame, target: str, most_classes: int = 15) -> str:
    if not is_numeric(df, target):
        return "classification"
    return "regression" if df.select(target).filter(F.col(target).isNotNull()).distinct().limit(most_classes + 1).count() > most_classes else "classification"


def column_roles(df: DataFrame, target: str | None = None, low: int = 10, mid: int = 50, text_length: int = 15) -> dict[str, str]:
    """datetime, numeric, text, or low / mid / high (categories), from one aggregate over all text columns."""
    cols = [c for c in df.columns if c != target]
    roles = {c: "datetime" if is_datetime(df, c) else "numeric" for c in cols if is_datetime(df, c) or is_numeric(df, c)}
    rest = [c for c in cols if c not in roles]
    v = scalars(df, {k: e for c in rest for k, e in {
        (c, "n"): F.count(c),
        (c, "num"): F.count(F.expr(f"try_cast(`{c}` AS double)")) if is_string(df, c) else F.lit(0),
        (c, "len"): F.avg(F.length(F.col(c).cast("string"))),
        (c, "k"): F.count_distinct(F.col(c).cast("string")),
        (c, "all"): F.count(F.lit(1)),
    }.items()})
    for c in rest:
        if v[c, "n"] and v[c, "num"] == v[c, "n"] and v[c, "n"] > 0.5 * v[c, "all"]:
            roles[c] = "numeric"
        elif (v[c, "len"] or 0) >= text_length:
            roles[c] = "text"
        else:
            roles[c] = "low" if v[c, "k"] <= low else "mid" if v[c, "k"] <= mid else "high"
    return {c: roles[c] for c in cols}


@dataclasses.dataclass
class ColumnProfile:
    name: str
    dtype: str
    role: str
    missing_rate: float
    cardinality: int | None = None
    skewness: float | None = None
    kurtosis: float | None = None
    outlier_share: float | None = None
    mean: float | None = None
    std: float | None = None
    min: float | None = None
    max: float | None = None


def profile_columns(df: DataFrame, target: str | None = None) -> list[ColumnProfile]:
    """One aggregate for all statistics, two for quartiles, and one for what lies outside of the fences that they give."""
    roles = column_roles(df, target)
    exprs: dict = {"n": F.count(F.lit(1))}
    nums = [c for c, r in roles.items() if r == "numeric"]
    x = {c: number(c) if is_numeric(df, c) else number(F.expr(f"try_cast(`{c}` AS double)")) for c in nums}
    for c, r in roles.items():
        exprs[c, "null"] = F.count(F.when(x[c].isNull() if c in x else F.col(c).isNull(), 1))
        if c in x:
            g1, g2 = skew_kurtosis(F.count(x[c]), F.skewness(x[c]), F.kurtosis(x[c]))
            exprs |= {(c, "skew"): g1, (c, "kurt"): g2, (c, "mean"): F.avg(x[c]), (c, "std"): F.stddev_samp(x[c]), (c, "min"): F.min(x[c]), (c, "max"): F.max(x[c])}
        elif r != "datetime":
            exprs[c, "k"] = F.count_distinct(F.col(c).cast("string"))
    v = scalars(df, exprs)
    n = max(v["n"], 1)
    quartiles = exact_quantiles(df, {c: (x[c], [0.25, 0.75]) for c in nums})
    fence = {c: (q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0])) for c, q in quartiles.items() if q and q[1] > q[0]}
    out = scalars(df, {c: F.count(F.when((x[c] < a) | (x[c] > b), 1)) for c, (a, b) in fence.items()})
    get = lambda c, k: v.get((c, k))
    return [
        ColumnProfile(c, df.schema[c].dataType.simpleString(), r, v[c, "null"] / n, get(c, "k"), get(c, "skew"), get(c, "kurt"), out.get(c, 0) / max(n - v[c, "null"], 1) if c in x else None, get(c, "mean"), get(c, "std"), get(c, "min"), get(c, "max"))
        for c, r in roles.items()
    ]


@dataclasses.dataclass
class Issue:
    code: str
    severity: str
    column: str | None
    message: str


def summarize_issues(profiles: list[ColumnProfile], balance: dict | None = None, outlier_share: float = 0.05) -> list[Issue]:
    out = []
    for p in profiles:
        if p.missing_rate > 0.3:
            out.append(Issue("HIGH_NULL", "WARN", p.name, f"{p.missing_rate:.1%} missing"))
        elif p.missing_rate > 0:
            out.append(Issue("NULLS", "INFO", p.name, f"{p.missing_rate:.1%} missing"))
        if p.cardinality is not None and p.cardinality > 50 and p.role != "text":
            out.append(Issue("HIGH_CARD", "INFO", p.name, f"{p.cardinality} values"))
        if (p.outlier_share or 0) > outlier_share:
            out.append(Issue("OUTLIERS", "INFO", p.name, f"{p.outlier_share:.1%} outside of the fences"))
    if balance and min(balance.values()) < 0.2:
        out.append(Issue("IMBALANCE", "WARN", None, f"smallest class {min(balance.values()):.1%}"))
    return out


def class_balance(df: DataFrame, target: str, max_classes: int = 10_000) -> dict:
    """The share of each class, largest first; over max_classes is an error, as that is no classification."""
    rows = value_counts(df, target).orderBy(F.desc("n"), "value").limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise InputValidationError("too many classes", target=target, classes=max_classes)
    return {r.value: r.share for r in rows}


@dataclasses.dataclass
class DatasetInsights:
    n_rows: int
    task: str
    profiles: list[ColumnProfile]
    balance: dict | None
    issues: list[Issue]
    correlations: list[tuple]


def analyze_dataset(df: DataFrame, target: str) -> DatasetInsights:
    validate_input_frame(df, target)
    task = detect_task(df, target)
    profiles = profile_columns(df, target)
    balance = class_balance(df, target) if task == "classification" else None
    r = [tuple(x) for x in correlation_matrix(df.drop(target)).collect()]
    return DatasetInsights(df.count(), task, profiles, balance, summarize_issues(profiles, balance), r)


class SchemaValidator:
    """Types, nullability, ranges (10 % wider) and categories of a fitted table; violations of a new one are counted in one aggregate."""

    def __init__(self, enabled: bool = True, strict: bool = False, check_column_order: bool = False, max_categories_for_checks: int = 100, padding: float = 0.1):
        self.enabled, self.strict, self.check_column_order, self.max_categories, self.padding = enabled, strict, check_column_order, max_categories_for_checks, padding
        self.columns: dict[str, dict] = {}

    def fit(self, df: DataFrame) -> SchemaValidator:
        nums, texts = numeric_columns(df), string_columns(df)
        v = scalars(df, {**{(c, "null"): F.count(F.when(F.col(c).isNull(), 1)) for c in df.columns}, **{(c, "min"): F.min(number(c)) for c in nums}, **{(c, "max"): F.max(number(c)) for c in nums}, **{(c, "k"): F.count_distinct(c) for c in texts}})
        self.columns = {}
        for c in df.columns:
            s: dict = {"type": df.schema[c].dataType.simpleString(), "nullable": v[c, "null"] > 0}
            if c in nums and v[c, "min"] is not None:
                pad = self.padding * (v[c, "max"] - v[c, "min"])
                s |= {"min": v[c, "min"] - pad, "max": v[c, "max"] + pad}
            if c in texts and v[c, "k"] <= self.max_categories:
                s["values"] = sorted(r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().collect())
            self.columns[c] = s
        return self

    def violations(self, df: DataFrame) -> dict[str, int]:
        out = {f"{c}: missing": 1 for c in self.columns if c not in df.columns}
        out |= {f"{c}: type": 1 for c, s in self.columns.items() if c in df.columns and df.schema[c].dataType.simpleString() != s["type"]}
        if self.check_column_order and [c for c in df.columns if c in self.columns] != [c for c in self.columns if c in df.columns]:
            out["column order"] = 1
        exprs = {}
        for c, s in self.columns.items():
            if c not in df.columns or f"{c}: type" in out:
                continue
            if not s["nullable"]:
                exprs[f"{c}: null"] = F.count(F.when(F.col(c).isNull(), 1))
            if "min" in s:
                exprs[f"{c}: range"] = F.count(F.when((number(c) < s["min"]) | (number(c) > s["max"]), 1))
            if "values" in s:
                exprs[f"{c}: category"] = F.count(F.when(~F.col(c).isin(s["values"]), 1)) if s["values"] else F.count(c)
        return out | {k: n for k, n in scalars(df, exprs).items() if n}

    def validate(self, df: DataFrame) -> DataFrame:
        if self.enabled and (found := self.violations(df)):
            if self.strict:
                raise SchemaValidationError("schema violations", violations=found)
            from tessera.errors import get_logger

            get_logger().warning("schema violations: %s", found)
        return df

    def export_schema(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(self.columns, f, indent=2)

    @staticmethod
    def load_schema(path: str, **kw) -> SchemaValidator:
        v = SchemaValidator(**kw)
        with open(path) as f:
            v.columns = json.load(f)
        return v


def check_data_quality(df: DataFrame, target: str) -> list[Issue]:
    v = scalars(df, {"__n": F.count(F.lit(1)), **{c: F.count(c) for c in df.columns}})
    if not v["__n"]:
        return [Issue("EMPTY_DATA", "ERROR", None, "no rows")]
    out = [] if v[target] else [Issue("TARGET_ALL_MISSING", "ERROR", target, "no target values")]
    return out + [Issue("VERY_HIGH_MISSING", "WARN", c, f"{1 - v[c] / v['__n']:.1%} missing") for c in df.columns if c != target and v[c] < 0.05 * v["__n"]]


def estimate_leakage_risk(df: DataFrame, target: str) -> float:
    """0.5 for a correlation over 0.99, 0.3 for a telling name, 0.2 for a near-unique column, at most 1."""
    nums = numeric_columns(df, [target])
    y = number(target) if is_numeric(df, target) else None
    others = [c for c in df.columns if c != target]
    v = scalars(df, {**({("r", c): F.corr(number(c), y) for c in nums} if y is not None else {}), **{("k", c): F.approx_count_distinct(c, 0.02) for c in others}, "n": F.count(F.lit(1))})
    risk = 0.5 * any(abs(v["r", c] or 0.0) > 0.99 for c in nums if y is not None) + 0.3 * bool(leak_prone_columns(df, target)) + 0.2 * any(v["k", c] > 0.9 * max(v["n"], 1) for c in others)
    return min(1.0, risk)


def duplicate_columns(df: DataFrame) -> list[tuple[str, str]]:
    """Pairs of equal columns (nulls equal): equal sums of hashes first, then a comparison of those pairs only."""
    h = scalars(df, {c: F.sum(F.xxhash64(F.col(c).cast("string")).cast("decimal(38,0)")) for c in df.columns})
    same = [(a, b) for i, a in enumerate(df.columns) for b in df.columns[i + 1 :] if h[a] == h[b] and df.schema[a].dataType == df.schema[b].dataType]
    v = scalars(df, {p: F.count(F.when(~F.col(p[0]).eqNullSafe(F.col(p[1])), 1)) for p in same})
    return [p for p in same if not v[p]]


def estimate_memory_mb(n_rows: int, n_features: int) -> float:
    return 8.0 * n_rows * n_features * 3 / 1e6


def estimate_features(roles: dict[str, str], cardinality: dict[str, int] | None = None) -> int:
    k = cardinality or {}
    return sum({"low": k.get(c, 5), "text": 5}.get(r, 1) for c, r in roles.items())


@dataclasses.dataclass
class DatasetFingerprint:
    n_rows: int
    n_columns: int
    task: str
    roles: dict
    missing_rate: dict
    constant: list
    duplicates: list
    cardinality: dict
    skewed: list
    outlier_heavy: list
    low_variance: list
    target_stats: dict
    correlated_pairs: list
    target_correlations: list
    low_information: list
    entities: list
    time_columns: list
    text_columns: list
    leakage_risk: float
    memory_mb: float
    estimated_features: int


def fingerprint(df: DataFrame, target: str) -> DatasetFingerprint:
    """Everything that the planner reads: a few wide aggregates."""
    from tessera.operators.selection import MutualInfoSelector

    validate_input_frame(df, target)
    n, task = df.count(), detect_task(df, target)
    p = {x.name: x for x in profile_columns(df, target)}
    nums = [c for c, x in p.items() if x.role == "numeric" and is_numeric(df, c)]
    card = scalars(df, {c: F.approx_count_distinct(c, 0.02) for c in df.columns})
    repeated = {c: x for c, x in p.items() if x.cardinality is not None and 10 < x.cardinality < 0.5 * n}
    y = number(target) if is_numeric(df, target) else None
    r = scalars(df, {c: F.corr(number(c), y) for c in nums}) if y is not None else {}
    pairs = [(x.a, x.b) for x in correlation_matrix(df.select(*nums)).filter(F.abs("r") > 0.95).collect()] if len(nums) > 1 else []
    mi = MutualInfoSelector(label_col=target, task=task).scores(df, nums) if nums else {}
    stats = {k: v for k, v in scalars(df, {"mean": F.avg(y), "std": F.stddev_samp(y), "min": F.min(y), "max": F.max(y)}).items()} if y is not None else class_balance(df, target)
    roles = {c: x.role for c, x in p.items()}
    return DatasetFingerprint(
        n, len(df.columns), task, roles, {c: x.missing_rate for c, x in p.items()}, [c for c, k in card.items() if k <= 1], duplicate_columns(df), dict(card),
        [c for c in nums if abs(p[c].skewness or 0) > 1.5], [c for c in nums if (p[c].outlier_share or 0) > 0.05], [c for c in nums if (p[c].std or 0) ** 2 < 1e-4], stats, pairs,
        sorted(((c, v) for c, v in r.items() if v is not None), key=lambda t: -abs(t[1]))[:10], [c for c, v in mi.items() if v < 0.01], sorted(repeated), [c for c, x in roles.items() if x == "datetime"], [c for c, x in roles.items() if x == "text"],
        estimate_leakage_risk(df, target), estimate_memory_mb(n, len(df.columns)), estimate_features(roles, {c: x.cardinality or 1 for c, x in p.items()}),
    )


# --- drift ------------------------------------------------------------------


def psi_table(reference: DataFrame, current: DataFrame, key_of) -> DataFrame:
    """(bin, r, c): counts of both sides over all bins of either."""
    a = reference.select(key_of.alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("r"))
    b = current.select(key_of.alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("c"))
    return a.join(b, "bin", "full").select("bin", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("c", F.lit(0)).alias("c"))


def psi_of(table: DataFrame) -> DataFrame:
    """One row: the population stability index of a table of counts; 0 if a side is empty."""
    t = table.join(F.broadcast(table.agg(F.sum("r").alias("tr"), F.sum("c").alias("tc"))))  # one row
    share = lambda x, n: F.greatest(F.try_divide(F.col(x), F.col(n)), F.lit(1e-10))
    r, c = share("r", "tr"), share("c", "tc")
    return t.agg(F.abs(F.coalesce(F.sum(F.when((F.col("tr") > 0) & (F.col("tc") > 0), (c - r) * F.ln(c / r)).otherwise(0.0)), F.lit(0.0))).alias("psi"))


def psi_categorical(reference: DataFrame, current: DataFrame, column: str) -> float:
    return psi_of(psi_table(reference, current, F.col(column).cast("string"))).first()[0]


def compute_psi(reference: DataFrame, current: DataFrame, column: str, buckets: int = 10) -> float:
    from tessera.operators.numeric import right_closed

    both = reference.select(number(column).alias("x")).unionByName(current.select(number(column).alias("x")))
    v = scalars(both, {"lo": F.min("x"), "hi": F.max("x")})
    if v["lo"] is None or v["hi"] == v["lo"]:
        return 0.0
    edges = [v["lo"] + (v["hi"] - v["lo"]) * i / buckets for i in range(buckets)] + [v["hi"]]
    return psi_of(psi_table(reference, current, right_closed(number(column), edges))).first()[0]


def ks_table(reference: DataFrame, current: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """One row: the largest distance of the two distribution functions. Value counts are written in ranges; offsets close the seams."""
    tag = lambda d, a, b: d.select(number(column).alias("x"), F.lit(a).alias("a"), F.lit(b).alias("b")).filter("x IS NOT NULL")
    counts = tag(reference, 1, 0).unionByName(tag(current, 0, 1)).groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = in_ranges(counts, ["x"], "p", parts)
    sums = counts.groupBy("p").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"))
    whole = Window.partitionBy(F.lit(1))  # one row per range
    offs = before(sums, "p", {"pa": "oa", "pb": "ob"}).join(sums.select("p", F.sum("pa").over(whole).alias("na"), F.sum("pb").over(whole).alias("nb")), "p")
    own = Window.partitionBy("p").orderBy("x")
    f = counts.join(F.broadcast(offs), "p").select("na", "nb", F.abs(F.try_divide(F.col("oa") + F.sum("a").over(own), F.col("na")) - F.try_divide(F.col("ob") + F.sum("b").over(own), F.col("nb"))).alias("d"))
    return f.agg(F.coalesce(F.max(F.when((F.col("na") >= 2) & (F.col("nb") >= 2), F.col("d"))), F.lit(0.0)).alias("ks"))


def ks_numeric(reference: DataFrame, current: DataFrame, column: str) -> float:
    return ks_table(reference, current, column).first()[0]


class DriftDetector:
    def __init__(self, psi_threshold: float = 0.25, ks_threshold: float = 0.10):
        self.psi_threshold, self.ks_threshold = psi_threshold, ks_threshold

    def detect(self, reference: DataFrame, current: DataFrame) -> DataFrame:
        """(column, metric, value, severity), one row per column that both tables have with values."""
        spark, parts = reference.sparkSession, None
        both = [c for c in reference.columns if c in current.columns]
        a, b = (scalars(d, {c: F.count(c) for c in both}) for d in (reference, current))
        for c in both:
            if not a[c] or not b[c]:
                continue
            numeric = is_numeric(reference, c)
            t = ks_table(reference, current, c) if numeric else psi_of(psi_table(reference, current, F.col(c).cast("string")))
            low, high = (0.05, self.ks_threshold) if numeric else (0.1, self.psi_threshold)
            v = F.col("ks" if numeric else "psi")
            t = t.select(F.lit(c).alias("column"), F.lit("ks" if numeric else "psi").alias("metric"), v.alias("value"), F.when(v < low, "OK").when(v < high, "WARN").otherwise("CRITICAL").alias("severity"))
            parts = t if parts is None else parts.unionByName(t)
        return parts if parts is not None else spark.createDataFrame([], "column string, metric string, value double, severity string")


def summarize_drift_report(report: DataFrame) -> dict:
    rows = report.collect()  # one row per column
    return {"n": len(rows), **{s: [r["column"] for r in rows if r.severity == s] for s in ("OK", "WARN", "CRITICAL")}}


# --- imbalance --------------------------------------------------------------


def detect_minority_ratio(df: DataFrame, target: str) -> float:
    t = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n")).agg((F.min("n") / F.sum("n")).alias("r")).first()
    return t[0] if t[0] is not None else 1.0


def class_weight_advisory(ratio: float, threshold: float = 0.20) -> str | None:
    return f"The smallest class is {ratio:.1%} of the rows; consider class weights." if ratio < threshold else None


class SMOTE:
    """New minority rows between a minority row and one of its k nearest, sought among all rows of its class.

    Distances are over columns divided by their deviations, with 0 for null; of equally near rows those of smaller row
    numbers come first. A row's partner and the place between them are hashes of its number, so that repeated rows get
    different new ones.
    """

    def __init__(self, label_col: str, columns: list[str] | None = None, k_neighbors: int = 5, sampling_strategy: float | str = "auto", random_state: int = 42, max_classes: int = 1000):
        self.label_col, self.columns, self.k, self.strategy, self.seed, self.max_classes = label_col, columns, k_neighbors, sampling_strategy, random_state, max_classes

    def nearest(self, part: DataFrame, n: int, cols: list[str], k: int) -> DataFrame:
        """(id, rank, near): the k nearest other rows of part (id, x) for each."""
        import numpy as np
        import pandas as pd

        v = part.agg(*[F.stddev_pop(F.col("x")[i]) for i in range(len(cols))]).first()
        spread = np.array([s if s else 1.0 for s in v])

        def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            a, b = left["id"].to_numpy(), right["id"].to_numpy()
            x, ref = (np.stack(d["x"].to_numpy()) / spread if len(d) else np.zeros((0, len(cols))) for d in (left, right))
            out = []
            for lo in range(0, len(a) if len(b) else 0, 64):
                d = np.zeros((len(x[lo : lo + 64]), len(b)))
                for j in range(len(cols)):
                    d += (x[lo : lo + 64, j, None] - ref[None, :, j]) ** 2
                d[a[lo : lo + 64, None] == b[None, :]] = np.inf
                for i, row in enumerate(d):
                    at = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1]) if len(b) > k else np.arange(len(b))
                    at = at[np.isfinite(row[at])]
                    at = at[np.lexsort((b[at], row[at]))[:k]]
                    out += [(a[lo + i], row[p], b[p]) for p in at]
            return pd.DataFrame(out, columns=["id", "d", "near"]).astype({"id": "int64", "d": "float64", "near": "int64"})

        found = in_cells(part.select("id", "x"), part.select("id", "x"), n, n, kernel, "id long, d double, near long")
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d", "near"))).filter(F.col("rank") <= k).select("id", "rank", "near")

    def resample(self, df: DataFrame) -> DataFrame:
        cols = self.columns or numeric_columns(df, [self.label_col])
        classes = df.filter(F.col(self.label_col).isNotNull()).groupBy(self.label_col).agg(F.count(F.lit(1)).alias("n"))
        counts = [(r[0], r.n) for r in classes.orderBy("n", self.label_col).limit(self.max_classes + 1).collect()]
        if len(counts) > self.max_classes:
            raise InputValidationError("too many classes to resample", label=self.label_col, classes=self.max_classes)
        if len(counts) < 2:
            return df
        top = counts[-1][1] * (1.0 if self.strategy == "auto" else float(self.strategy))
        out = df.withColumns({c: number(c) for c in cols})
        unit = lambda *k: F.pmod(F.xxhash64(*k, F.lit(self.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        for value, n in counts[:-1]:
            k = min(self.k, n - 1)
            if k < 1 or n >= top:
                continue
            typed = df.filter(F.col(self.label_col) == value).withColumns({c: number(c) for c in cols})
            part = stage(typed.select(F.monotonically_increasing_id().alias("id"), F.struct(*typed.columns).alias("row"), F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in cols]).alias("x")), "smote")
            near = stage(self.nearest(part, n, cols, k).join(part.select(F.col("id").alias("near"), F.col("x").alias("y")), "near"), "smote-near")
            times = (top - n) / n
            new = F.lit(int(times)) + (unit("id", F.lit(1)) < times - int(times)).cast("int")
            each = part.withColumn("i", F.explode(F.when(new > 0, F.sequence(F.lit(1), new)).otherwise(F.array().cast("array<int>"))))
            each = each.withColumn("rank", (F.pmod(F.xxhash64("id", "i", F.lit(self.seed)), F.lit(k)) + 1).cast("int")).withColumn("u", unit("i", "id"))
            made = each.join(near, ["id", "rank"]).select("row", *[(F.col("x")[j] + F.col("u") * (F.col("y")[j] - F.col("x")[j])).alias(f"v{j}") for j in range(len(cols))])
            out = out.unionByName(made.select(*[F.col(f"v{cols.index(c)}").alias(c) if c in cols else F.col(f"row.{c}").alias(c) for c in df.columns]))
        return out


def auto_resampler(df: DataFrame, target: str, threshold: float = 0.10, enabled: bool = True, **kw) -> SMOTE | None:
    return SMOTE(target, **kw) if enabled and detect_minority_ratio(df, target) < threshold else None


def smote_inside_cv(df: DataFrame, target: str, fold_col: str, n_folds: int, fit_and_score, **kw) -> list[float]:
    """Scores of fit_and_score(train, test), where only training folds are resampled."""
    fold = F.pmod(F.col(fold_col).cast("long"), F.lit(n_folds))
    return [fit_and_score(SMOTE(target, **kw).resample(df.filter(fold != k)), df.filter(fold == k)) for k in range(n_folds)]


def require_quality(issues: list[Issue]) -> None:
    if bad := [i for i in issues if i.severity == "ERROR"]:
        raise DataQualityError("data cannot be used", issues=[i.code for i in bad])


PROFILE_SCHEMA = T.StructType([T.StructField("name", T.StringType()), T.StructField("dtype", T.StringType()), T.StructField("role", T.StringType()), T.StructField("missing_rate", T.DoubleType()), T.StructField("cardinality", T.LongType()), *[T.StructField(k, T.DoubleType()) for k in ("skewness", "kurtosis", "outlier_share", "mean", "std", "min", "max")]])


def profile_frame(df: DataFrame, target: str | None = None) -> DataFrame:
    rows = [tuple(float(v) if isinstance(v, float) else v for v in dataclasses.astuple(p)) for p in profile_columns(df, target)]
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)
