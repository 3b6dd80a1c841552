"""Rolling, expanding, lag and rank features as windows over a group in an explicit order.

A window without a group would sort all rows in one task; for these, pass group_by.
Rows with a null group key get nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.errors import InputValidationError
from tessera.operators.aggregate import statistic
from tessera.operators.base import Operator, add, chosen, number, numeric_columns
from tessera.operators.order import in_ranges, medians
from tessera.sources.staging import stage


def _list(x) -> list:
    return [] if x is None else [x] if isinstance(x, (str, int)) else list(x)


def ordered(group_by, order_by) -> WindowSpec:
    if not _list(order_by):
        raise InputValidationError("rows of a table have no order: pass order_by")
    return Window.partitionBy(*[F.col(c) for c in _list(group_by)]).orderBy(*[F.col(c) for c in _list(order_by)])


def grouped_only(group_by, x: Column) -> Column:
    for c in _list(group_by):
        x = F.when(F.col(c).isNotNull(), x)
    return x


def over(fn: str, x: Column, frame: WindowSpec) -> Column:
    from tessera.operators.base import skew_kurtosis

    if fn in ("skew", "kurt"):
        g = skew_kurtosis(F.count(x).over(frame), F.skewness(x).over(frame), F.kurtosis(x).over(frame))
        return g[fn == "kurt"]
    if fn == "sum":
        return F.sum(x).over(frame)
    return statistic(fn, x).over(frame)


class RollingWindowTransformer(Operator):
    """Values `shift` rows back, over a window of w rows ending there (or around the row, if centred)."""

    defaults = {"columns": None, "window_sizes": 7, "agg_functions": "mean", "group_by": None, "order_by": None, "min_periods": None, "center": False, "shift": 1}

    def apply(self, df, state, tables):
        cols = chosen(df, _list(self.columns) or None, numeric_columns(df, _list(self.group_by)))
        w = ordered(self.group_by, self.order_by)
        df = add(df, {f"__s_{c}": F.lag(number(c), self.shift).over(w) if self.shift else number(c) for c in cols})
        made = {}
        for c in cols:
            for size in _list(self.window_sizes):
                ahead = (size - 1) // 2 if self.center else 0
                frame = w.rowsBetween(ahead - size + 1, ahead)
                enough = F.count(f"__s_{c}").over(frame) >= (size if self.min_periods is None else self.min_periods)
                made |= {f"{c}_roll_{size}_{fn}": grouped_only(self.group_by, F.when(enough, over(fn, F.col(f"__s_{c}"), frame))) for fn in _list(self.agg_functions)}
        return add(df, made).drop(*[f"__s_{c}" for c in cols])


class ExpandingWindowTransformer(Operator):
    defaults = {"columns": None, "agg_functions": "sum", "group_by": None, "order_by": None, "min_periods": 1, "shift": 1}

    def apply(self, df, state, tables):
        cols = chosen(df, _list(self.columns) or None, numeric_columns(df, _list(self.group_by)))
        w = ordered(self.group_by, self.order_by)
        frame = w.rowsBetween(Window.unboundedPreceding, -self.shift)
        made = {}
        for c in cols:
            for fn in _list(self.agg_functions):
                if fn == "count":
                    x = (F.row_number().over(w) - 1).cast("long")
                else:
                    x = F.when(F.count(number(c)).over(frame) >= self.min_periods, over(fn, number(c), frame))
                made[f"{c}_expanding_{fn}"] = grouped_only(self.group_by, x)
        return add(df, made)


class LagFeaturesTransformer(Operator):
    defaults = {"columns": None, "lags": 1, "group_by": None, "order_by": None, "fill_value": None}

    def apply(self, df, state, tables):
        cols = chosen(df, _list(self.columns) or None, numeric_columns(df, _list(self.group_by)))
        w = ordered(self.group_by, self.order_by)
        made = {}
        for c in cols:
            for n in _list(self.lags):
                x = grouped_only(self.group_by, F.lag(F.col(c), n).over(w))
                made[f"{c}_lag_{n}"] = x if self.fill_value is None else F.coalesce(x, F.lit(self.fill_value))
        return add(df, made)


def rank(c: str, group_by, method: str, ascending: bool = True, pct: bool = False) -> Column:
    """Ranks of non-null values; ties by method. Average and max ranks add the ties of a value to its least rank."""
    x = number(c)
    g = [F.col(k) for k in _list(group_by)]
    w = Window.partitionBy(*g, x.isNull()).orderBy(x.asc() if ascending else x.desc())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*g, x))
    least = F.rank().over(w)
    r = {"min": least, "max": least + ties - 1, "average": least + (ties - 1) / 2, "percent": least + (ties - 1) / 2, "dense": F.dense_rank().over(w)}[method].cast("double")
    if pct or method == "percent":
        whole = Window.partitionBy(*g)
        r = r / (F.count(x).over(whole) if method != "dense" else F.max(F.when(x.isNotNull(), F.dense_rank().over(w))).over(whole)) if method != "dense" else r
    return grouped_only(group_by, F.when(x.isNotNull(), r))


class RankFeaturesTransformer(Operator):
    """Ranks within groups. Without a group, rank values of one column over the whole table: see with_ranks for that at scale."""

    defaults = {"columns": None, "group_by": None, "method": "percent", "ascending": True, "pct": False}

    def apply(self, df, state, tables):
        cols = chosen(df, _list(self.columns) or None, numeric_columns(df, _list(self.group_by)))
        tail = "_in_" + "_".join(_list(self.group_by)) if self.group_by else ""
        pct = self.pct or self.method == "percent"
        made = {f"{c}_{'pct_rank' if pct else 'rank'}{tail}": rank(c, self.group_by, self.method, self.ascending, pct) for c in cols}
        out = add(df, made)
        if self.method == "dense" and pct:
            whole = Window.partitionBy(*[F.col(k) for k in _list(self.group_by)])
            out = add(out, {k: F.col(k) / F.max(k).over(whole) for k in made})
        return out


class PercentileRankTransformer(Operator):
    """Average ranks within the batch, in percent; ranks come from range-partitioned value counts, not from one sorted task."""

    defaults = {"columns": None, "method": "average", "suffix": "_pct_rank", "pct": True}

    def apply(self, df, state, tables):
        from tessera.operators.numeric import with_ranks

        cols = chosen(df, _list(self.columns) or None, numeric_columns(df))
        n = df.agg(*[F.count(number(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first() if cols else []
        for i, c in enumerate(cols):
            d = df.withColumn("__x", number(c))
            ranked = with_ranks(d.filter("__x IS NOT NULL"), "__x", "__r").unionByName(d.filter("__x IS NULL").withColumn("__r", F.lit(None).cast("double")))
            df = ranked.withColumn(f"{c}{self.suffix}", F.col("__r") / n[i] * 100 if self.pct else F.col("__r")).drop("__x", "__r")
        return df


def make_lags(df: DataFrame, cols: list[str], lags: list[int], order_by, group_by=None) -> DataFrame:
    w = ordered(group_by, order_by)
    return add(df, {f"{c}_lag{n}": F.lag(c, n).over(w) for c in cols for n in lags})


def make_rolling(df: DataFrame, cols: list[str], windows: list[int], order_by, group_by=None, funcs=("mean", "std", "min", "max")) -> DataFrame:
    """Windows of up to w rows with the current one, and their counts."""
    w = ordered(group_by, order_by)
    return add(df, {f"{c}_roll{n}_{fn}": over(fn, number(c), w.rowsBetween(-(n - 1), 0)) for c in cols for n in windows for fn in dict.fromkeys([*funcs, "count"])})


def ema(df: DataFrame, value: str, out: str, span: int, order_by, group_by=None) -> DataFrame:
    """Recursive exponential mean, e = a x + (1 - a) e: one streaming pass over each sorted group, with state carried across batches."""
    import pandas as pd
    from pyspark.sql import types as T

    group, order = _list(group_by), _list(order_by)
    alpha = 2.0 / (span + 1)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(parts):
        seen, last = None, None
        for pdf in parts:
            values = pdf[value].astype(float).tolist()
            groups = list(zip(*[pdf[g].tolist() for g in group])) if group else [()] * len(values)
            made = []
            for g, x in zip(groups, values):
                if g != seen:
                    seen, last = g, None
                if x == x:
                    last = x if last is None else alpha * x + (1 - alpha) * last
                made.append(last)
            yield pdf.assign(**{out: pd.Series(made, index=pdf.index, dtype="float64")})

    if not group:
        return _ema_of_one(df, value, out, alpha, order)
    rows = df.repartition(*group)
    return rows.sortWithinPartitions(*group, *order).mapInPandas(run, schema)


def _ema_of_one(df: DataFrame, value: str, out: str, alpha: float, order: list[str]) -> DataFrame:
    """The mean over one whole table: rows are written in ranges of the order, each range runs from nothing, and what came before fades in.

    With a value count m in a range so far, e = own + (1 - alpha)^m * (e before the range), where own starts at 0. The
    e before a range follows from one pair (own, m) for each range.
    """
    import pandas as pd
    from pyspark.sql import types as T

    d = in_ranges(df, order, "__p")
    schema = T.StructType([*d.schema.fields, T.StructField("__own", T.DoubleType()), T.StructField("__m", T.LongType())])

    def run(parts):
        seen, own, m = None, 0.0, 0
        for pdf in parts:
            made, counts = [], []
            for p, x in zip(pdf["__p"].tolist(), pdf[value].astype(float).tolist()):
                if p != seen:
                    seen, own, m = p, 0.0, 0
                if x == x:
                    own, m = alpha * x + (1 - alpha) * own, m + 1
                made.append(own)
                counts.append(m)
            yield pdf.assign(__own=made, __m=counts)

    runs = stage(d.repartition("__p").sortWithinPartitions("__p", *order).mapInPandas(run, schema), "ema")
    known = number(value).isNotNull()
    ends = runs.groupBy("__p").agg(F.max_by("__own", "__m").alias("own"), F.max("__m").alias("m")).orderBy("__p").collect()  # one row per range
    first = runs.filter(known).agg(F.min("__p")).first()[0]
    start = runs.filter((F.col("__p") == first) & known).orderBy(*order).select(number(value)).first() if first is not None else None
    carried, rows = start[0] if start else 0.0, []
    for r in ends:  # the first value counts as the mean before it
        rows.append((r["__p"], carried))
        carried = r.own + (1 - alpha) ** r.m * carried
    table = df.sparkSession.createDataFrame(rows or [(0, 0.0)], "__p int, __before double")
    before_any = (F.col("__p") < F.lit(first)) | ((F.col("__p") == F.lit(first)) & (F.col("__m") == 0)) if first is not None else F.lit(True)
    value_ = F.when(~before_any, F.col("__own") + F.pow(F.lit(1 - alpha), F.col("__m").cast("double")) * F.col("__before"))
    return runs.join(F.broadcast(table), "__p").withColumn(out, value_).select(*df.columns, out)


def time_gaps(df: DataFrame, time_col: str, parts: int | None = None) -> dict:
    """Median, mean and largest gap in seconds, and whether gaps are regular. Times are written in ranges; first and last of each range close the seams."""
    t = in_ranges(df.select((F.unix_micros(F.col(time_col).cast("timestamp")) / 1e6).alias("t")).filter("t IS NOT NULL"), ["t"], "p", parts)
    inner = t.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("p").orderBy("t"))).filter("gap IS NOT NULL").select("gap")
    ends = t.groupBy("p").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    seams = ends.withColumn("gap", F.col("a") - F.lag("b").over(Window.orderBy("a"))).filter("gap IS NOT NULL").select("gap")  # one row per part
    gaps = stage(inner.unionByName(seams), "gaps")
    r = gaps.agg(F.avg("gap"), F.max("gap"), F.stddev_samp("gap")).first()
    return {"median": medians(gaps, {"gap": F.col("gap")})["gap"], "mean": r[0], "max": r[1], "regular": bool(r[0]) and (r[2] or 0.0) < 0.1 * r[0]}
