"""Group statistics: one aggregate at fit, a left join at transform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InputValidationError
from tessera.operators.base import Operator, add, chosen, key, lookup, number, numeric_columns, scalars, skew_kurtosis, string_columns
from tessera.operators.encoders import binary_target
from tessera.operators.order import medians

FUNCTIONS = {
    "mean": F.avg,
    "sum": lambda x: F.coalesce(F.sum(x), F.lit(0.0)),
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "median": lambda x: F.percentile(x, F.lit(0.5)),
    "count": F.count,
    "nunique": F.count_distinct,
    "var": F.var_samp,
    "skew": lambda x: skew_kurtosis(F.count(x), F.skewness(x), F.kurtosis(x))[0],
    "kurt": lambda x: skew_kurtosis(F.count(x), F.skewness(x), F.kurtosis(x))[1],
}


def statistic(fn: str, x: Column) -> Column:
    if fn not in FUNCTIONS:
        raise InputValidationError("unknown aggregate", function=fn, known=sorted(FUNCTIONS))
    return FUNCTIONS[fn](x)


def group_stats(df: DataFrame, keys: list[str], columns: list[str], functions: list[str], count_name: str | None = None, prefix: str = "") -> DataFrame:
    aggs = [statistic(f, number(c)).alias(f"{prefix}{c}_{f}") for c in columns for f in functions]
    return df.groupBy(*keys).agg(*aggs, *([F.count(F.lit(1)).alias(count_name)] if count_name else []))


class GroupByStatsTransformer(Operator):
    defaults = {"group_cols": None, "agg_cols": None, "agg_functions": "mean", "add_count": True, "prefix": None, "suffix": None, "dropna": True, "fill_missing_groups": True, "missing_fill_value": 0.0}

    def _names(self) -> tuple[list[str], list[str]]:
        one = lambda x: [x] if isinstance(x, str) else list(x)
        return one(self.group_cols), one(self.agg_functions)

    def learn(self, df):
        keys, fns = self._names()
        cols = chosen(df, [self.agg_cols] if isinstance(self.agg_cols, str) else self.agg_cols, numeric_columns(df, keys))
        rows = df.dropna(subset=keys) if self.dropna else df
        t = group_stats(rows, keys, cols, fns, "_".join(keys) + "_count" if self.add_count else None)
        t = t.select(*keys, *[F.col(c).alias(f"{self.prefix or ''}{c}{self.suffix or ''}") for c in t.columns if c not in keys])
        return {"rows": t.count()}, {"stats": t}

    def apply(self, df, state, tables):
        keys, _ = self._names()
        t = tables["stats"]
        fill = float(self.missing_fill_value) if self.fill_missing_groups else None
        return lookup(df, t, keys, {c: fill for c in t.columns if c not in keys}, state["rows"], null_safe=not self.dropna)


class RelationalAggregate(Operator):
    """Statistics of a child table per parent key, joined to the parent."""

    defaults = {"child": None, "parent_key": None, "child_key": None, "columns": None, "functions": ("min", "max", "mean", "sum"), "prefix": "CHILD_"}

    def params_dict(self):
        return {k: v for k, v in super().params_dict().items() if k != "child"}

    def learn(self, df):
        k = self.child_key or self.parent_key
        t = group_stats(self.child, [k], chosen(self.child, self.columns, numeric_columns(self.child, [k])), list(self.functions), prefix=self.prefix)
        return {"rows": None}, {"stats": t}

    def apply(self, df, state, tables):
        k, t = self.child_key or self.parent_key, tables["stats"]
        return lookup(df, t, {k: F.col(self.parent_key)}, {c: None for c in t.columns if c != k}, state["rows"], null_safe=False)


class CategoricalNumericInteractions(Operator):
    """Statistics of numbers per category, and each row's deviation and difference from its category's mean."""

    defaults = {"strategy": "both", "max_pairs": 20, "specific_pairs": None}

    def learn(self, df):
        cats, nums = string_columns(df), numeric_columns(df)
        pairs = list(self.specific_pairs or [(a, b) for a in cats for b in nums])[: self.max_pairs]
        tables, rows = {}, {}
        for c in dict.fromkeys(a for a, _ in pairs):
            own = [b for a, b in pairs if a == c]
            t = df.select(key(c).alias("k"), *[number(b).alias(b) for b in own])
            t = group_stats(t, ["k"], own, ["mean", "std", "min", "max"])
            tables[c], rows[c] = t, t.count()
        return {"pairs": [list(p) for p in pairs], "rows": rows}, tables

    def apply(self, df, state, tables):
        for c, t in tables.items():
            own = [b for a, b in state["pairs"] if a == c]
            stats = {f"{b}_{f}": None for b in own for f in ("mean", "std", "min", "max")}
            named = t.select("k", *[F.col(s).alias(f"{c}_{s}") for s in stats])
            df = lookup(df, named, {"k": key(c)}, {f"{c}_{s}": None for s in stats}, state["rows"][c], null_safe=False)
            made = {}
            for b in own:
                mean, std = F.col(f"{c}_{b}_mean"), F.col(f"{c}_{b}_std")
                if self.strategy in ("both", "deviation"):
                    made[f"{c}_{b}_deviation"] = (number(b) - mean) / F.when(std.isNull() | (std == 0), 1.0).otherwise(std)
                    made[f"{c}_{b}_diff"] = number(b) - mean
            df = add(df, made)
            if self.strategy == "deviation":
                df = df.drop(*[f"{c}_{s}" for s in stats])
        return df


class TargetBasedFeaturesTransformer(Operator):
    """Statistics of the target per category; out of fold for training rows (fit_transform). `rank` ranks categories by their mean."""

    defaults = {"columns": None, "label_col": "y", "statistics": ("mean", "std", "count"), "n_folds": 5, "row_id": None, "fold_col": None, "random_state": 42, "smooth": 0.0, "min_samples_leaf": 1}

    def _table(self, d: DataFrame, c: str, extra: list[str]) -> DataFrame:
        t = d.groupBy(key(c).alias("k"), *extra).agg(*[statistic(s, F.col("__y")).alias(s) for s in ("mean", "std", "count", "median", "min", "max")])
        return t

    def learn(self, df):
        cols = chosen(df, self.columns, string_columns(df, [self.label_col]))
        y, _ = binary_target(df, self.label_col)
        d = df.withColumn("__y", y)
        whole = scalars(d, {s: statistic(s, F.col("__y")) for s in ("mean", "std", "median", "min", "max")})
        default = {s: 0 if s == "count" else float(whole.get(s) or 0.0) for s in ("mean", "std", "count", "median", "min", "max")}
        tables, rows = {}, {}
        for c in cols:
            t = self._table(d, c, [])
            m = self.smooth
            t = t.withColumn("mean", (F.col("mean") * F.col("count") + m * default["mean"]) / (F.col("count") + m) if m else F.col("mean"))
            t = t.withColumn("mean", F.when(F.col("count") >= self.min_samples_leaf, F.col("mean")).otherwise(default["mean"]))
            if {"rank", "percentile"} & set(self.statistics):
                from pyspark.sql import Window

                order = Window.orderBy("mean")  # over categories; their number is checked by the caller's choice of statistic
                t = t.withColumn("rank", F.dense_rank().over(order).cast("double")).withColumn("percentile", F.percent_rank().over(order))
            tables[c], rows[c] = t, t.count()
        return {"columns": cols, "default": default | {"rank": 0.0, "percentile": 0.5}, "rows": rows}, tables

    def apply(self, df, state, tables):
        for c in state["columns"]:
            t = tables[c].select("k", *[F.col(s).alias(f"{c}_target_{s}") for s in self.statistics])
            df = lookup(df, t, {"k": key(c)}, {f"{c}_target_{s}": state["default"][s] for s in self.statistics}, state["rows"][c], null_safe=False)
        return df

    def fit_transform(self, df):
        model = self.fit(df)
        y, _ = binary_target(df, self.label_col)
        fold = F.pmod(F.col(self.fold_col).cast("long"), F.lit(self.n_folds)) if self.fold_col else F.pmod(F.xxhash64(self.row_id, F.lit(self.random_state)), F.lit(self.n_folds))
        d = df.withColumns({"__y": y, "__f": fold})
        default = model.state["default"]
        for c in model.state["columns"]:
            # a row of fold f counts in the statistics of every other fold: n_folds - 1 partial rows, merged before the shuffle
            others = d.select(key(c).alias(c), "__y", F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(self.n_folds - 1)), F.col("__f").cast("int"))).alias("g"))
            t = self._table(others, c, ["g"]).select("k", "g", *[F.col(s).alias(f"{c}_target_{s}") for s in self.statistics if s not in ("rank", "percentile")])
            d = lookup(d, t, {"k": key(c), "g": F.col("__f").cast("int")}, {f"{c}_target_{s}": default[s] for s in self.statistics if s not in ("rank", "percentile")}, model.state["rows"][c] * self.n_folds, null_safe=False)
        return d.drop("__y", "__f")


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """(value, n, share), nulls left out of both."""
    n = df.filter(F.col(c).isNotNull()).count()
    return df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / max(n, 1))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, max_features: int = 60) -> DataFrame:
    """(a, b, r) for a < b in column order, of the columns of most variance, medians for nulls: two jobs."""
    cols = chosen(df, columns, numeric_columns(df))
    v = {**{("m", c): x for c, x in medians(df, {c: number(c) for c in cols}).items()}, **{("v", c): x for c, x in scalars(df, {c: F.var_samp(number(c)) for c in cols}).items()}}
    top = set(sorted(cols, key=lambda c: -(v["v", c] or 0.0))[:max_features])
    cols = [c for c in cols if c in top]
    x = {c: F.coalesce(number(c), F.lit(v["m", c])) for c in cols}
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    r = scalars(df, {p: F.corr(x[p[0]], x[p[1]]) for p in pairs})
    return df.sparkSession.createDataFrame([(a, b, r[a, b]) for a, b in pairs], "a string, b string, r double")
