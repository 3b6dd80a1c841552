"""Orders of whole tables without one sorted task: row numbers, and exact quantiles.

Row numbers come from a table that is written once in ranges of its order, so
that every later read sees the same rows in the same range. Quantiles are
bracketed by a mergeable sketch with a bound on its rank error, and the few
values within a bracket settle them exactly; no buffer grows with the number of
distinct values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.staging import stage

#: Accuracy of the sketch: ranks are off by at most rows / ACCURACY.
ACCURACY = 10_000
#: Most values of a bracket that are collected; a larger bracket is narrowed again.
BRACKET = 50_000
#: Aggregates in one job.
JOB_EXPRESSIONS = 400


def range_parts(df: DataFrame) -> int:
    """As many ranges as the session has shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def in_ranges(df: DataFrame, by: list[str], part: str, parts: int | None = None) -> DataFrame:
    """df, written in ranges of `by`, with the range of each row; equal keys share one."""
    return stage(df.repartitionByRange(parts or range_parts(df), *by).withColumn(part, F.spark_partition_id()), "ranges")


def before(totals: DataFrame, part: str, sums: dict[str, str]) -> DataFrame:
    """(part, ...): for each range, sums over the ranges before it. totals has one row per range."""
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(out) for c, out in sums.items()])


def numbered(df: DataFrame, by: list[str], out: str, parts: int | None = None) -> DataFrame:
    """Number rows 1, 2, ... in an order: within ranges, after the counts of those before. Rows of equal keys are numbered in any order."""
    d = in_ranges(df, by, "__p", parts)
    first = before(d.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")), "__p", {"__n": "__o"})
    own = Window.partitionBy("__p").orderBy(*by)
    return d.withColumn(out, F.row_number().over(own)).join(F.broadcast(first), "__p").withColumn(out, F.col(out) + F.col("__o")).drop("__p", "__o")


class _Bracket:
    """Where the values of ranks `low` and `low + 1` lie: between a and b, after `passed` values below a."""

    def __init__(self, q: float, n: int):
        self.position = q * (n - 1)
        self.low, self.high = math.floor(self.position), math.ceil(self.position)
        self.a, self.b = -math.inf, math.inf
        self.passed, self.inside = 0, n


def _aggregate(df: DataFrame, exprs: dict) -> dict:
    out, items = {}, list(exprs.items())
    for lo in range(0, len(items), JOB_EXPRESSIONS):
        part = items[lo : lo + JOB_EXPRESSIONS]
        out |= dict(zip([k for k, _ in part], df.agg(*[e.alias(f"a{i}") for i, (_, e) in enumerate(part)]).first()))
    return out


def exact_quantiles(df: DataFrame, wanted: dict[object, tuple[Column, list[float]]], accuracy: int = ACCURACY, bracket: int = BRACKET) -> dict[object, list[float] | None]:
    """For each name, the quantiles (interpolated between neighbours) of a double expression, nulls left out; None without values.

    Two passes for tables of up to bracket * accuracy / 4 rows, one more for each further factor of accuracy / 4.
    """
    if not wanted:
        return {}
    d = df.select(*[x.alias(f"x{i}") for i, (x, _) in enumerate(wanted.values())])
    margin = 2.0 / accuracy
    column = [F.col(f"x{i}") for i in range(len(wanted))]

    def around(x: Column, shares: list[float]) -> Column:
        both = [min(1.0, max(0.0, s + e)) for s in shares for e in (-margin, margin)]
        return F.percentile_approx(x, F.array(*[F.lit(b) for b in both]), accuracy)

    asked = [qs for _, qs in wanted.values()]
    first = _aggregate(d, {**{("n", i): F.count(x) for i, x in enumerate(column)}, **{("s", i): around(x, asked[i]) for i, x in enumerate(column)}})
    open_: dict[tuple[int, int], _Bracket] = {}
    sketch: dict[tuple[int, int], tuple[float, float]] = {}
    for i, qs in enumerate(asked):
        for j, q in enumerate(qs):
            if first["n", i]:
                open_[i, j] = _Bracket(q, first["n", i])
                sketch[i, j] = (first["s", i][2 * j], first["s", i][2 * j + 1])
    found: dict[tuple[int, int], float] = {}
    while open_:
        exprs = {}
        for (i, j), k in open_.items():
            x, (a, b) = column[i], sketch[i, j]
            inside = (x > a) & (x < b)
            exprs |= {(i, j, "below"): F.count_if(x < a), (i, j, "a"): F.count_if(x == a), (i, j, "b"): F.count_if(x == b) if b > a else F.lit(0), (i, j, "n"): F.count_if(inside)}
            if 4 * k.inside / accuracy + 1 <= bracket:
                exprs[i, j, "list"] = F.collect_list(F.when(inside, x))
        v = _aggregate(d, exprs)
        again = {}
        for (i, j), k in open_.items():
            (a, b), below, at_a, at_b, n = sketch[i, j], *[v[i, j, s] for s in ("below", "a", "b", "n")]
            values = sorted(v[i, j, "list"]) if (i, j, "list") in v else None

            def value(rank: int) -> float | None:
                rank -= below
                if rank < 0 or rank >= at_a + n + at_b:
                    return None
                if rank < at_a:
                    return a
                if rank >= at_a + n:
                    return b
                return values[rank - at_a] if values is not None else None

            lo, hi = value(k.low), value(k.high)
            if lo is not None and hi is not None:
                found[i, j] = lo if lo == hi else (k.high - k.position) * lo + (k.position - k.low) * hi
            elif below <= k.low and k.high < below + at_a + n + at_b:
                k.a, k.b, k.passed, k.inside = a, b, below, at_a + n + at_b
                again[i, j] = k
            else:  # outside of what the sketch promised: start from the whole range
                k.a, k.b, k.passed, k.inside = -math.inf, math.inf, 0, first["n", i]
                again[i, j] = k
        open_ = again
        if open_:
            shares = lambda k: [(k.low - k.passed) / max(1, k.inside - 1), (k.high - k.passed) / max(1, k.inside - 1)]
            s = _aggregate(d, {(i, j): around(F.when((column[i] >= k.a) & (column[i] <= k.b), column[i]), shares(k)) for (i, j), k in open_.items()})
            sketch = {key: (min(x), max(x)) for key, x in s.items()}
    return {name: [found[i, j] for j in range(len(asked[i]))] if first["n", i] else None for i, name in enumerate(wanted)}


def medians(df: DataFrame, columns: dict[object, Column]) -> dict[object, float | None]:
    return {k: v[0] if v else None for k, v in exact_quantiles(df, {k: (x, [0.5]) for k, x in columns.items()}).items()}
