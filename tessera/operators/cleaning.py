"""Casting, cleaning, imputation and scaling."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tessera.errors import FeatureEngineeringError, InputValidationError
from tessera.operators.base import Operator, add, chosen, is_numeric, number, lookup, numeric_columns, scalars, string_columns
from tessera.operators.neighbors import Cells
from tessera.operators.order import exact_quantiles, medians
from tessera.sources.staging import stage

MISSING = "__MISSING__"


class NumericConverter(Operator):
    """Numbers from text; what doesn't parse is null."""

    defaults = {"columns": None}

    def apply(self, df, state, tables):
        cols = chosen(df, self.columns, df.columns)
        return add(df, {c: number(F.col(c)) if is_numeric(df, c) else number(F.expr(f"try_cast(`{c}` AS double)")) for c in cols})


class CategoricalCleaner(Operator):
    """Trim, lower-case, and null for empty text and the words nan, none and null."""

    defaults = {"columns": None, "lowercase": True, "strip_whitespace": True, "replace_empty": True}

    def apply(self, df, state, tables):
        out = {}
        for c in chosen(df, self.columns, string_columns(df)):
            x = F.col(c).cast("string")
            x = F.trim(x) if self.strip_whitespace else x
            x = F.lower(x) if self.lowercase else x
            out[c] = F.when(~F.lower(x).isin("", "nan", "none", "null"), x) if self.replace_empty else x
        return add(df, out)


class CategoricalMissingIndicator(Operator):
    defaults = {"columns": None}

    def apply(self, df, state, tables):
        return add(df, {f"{c}_missing": F.col(c).isNull().cast("int") for c in chosen(df, self.columns, string_columns(df))})


class EnsureNumericOutput(Operator):
    """Numbers pass; text is parsed; anything else is an error before any job runs."""

    defaults = {}

    def apply(self, df, state, tables):
        out = {}
        for c in df.columns:
            if is_numeric(df, c):
                continue
            if c not in string_columns(df):
                raise FeatureEngineeringError("column cannot become a number", column=c, type=df.schema[c].dataType.simpleString())
            out[c] = F.expr(f"try_cast(`{c}` AS double)")
        return add(df, out)


class TextColumnSelector(Operator):
    defaults = {"column": None}

    def apply(self, df, state, tables):
        return df.select(F.coalesce(F.col(self.column).cast("string"), F.lit("")).alias(self.column))


class ColumnPruner(Operator):
    """Only the named columns; the scan reads no others."""

    defaults = {"columns": None}

    def apply(self, df, state, tables):
        return df.select(*chosen(df, self.columns, df.columns))


class WinsorizerTransformer(Operator):
    """Clip to quantiles of the fitted data."""

    defaults = {"percentiles": (0.01, 0.99), "columns": None}

    def check(self):
        lo, hi = self.percentiles
        if not 0 <= lo < hi <= 1:
            raise InputValidationError("percentiles must rise within 0..1", percentiles=self.percentiles)

    def learn(self, df):
        cols = chosen(df, self.columns, numeric_columns(df))
        return {"bounds": {c: v for c, v in exact_quantiles(df, {c: (number(c), list(self.percentiles)) for c in cols}).items() if v}}, {}

    def apply(self, df, state, tables):
        clip = lambda c, lo, hi: F.when(number(c).isNotNull(), F.least(F.greatest(number(c), F.lit(lo)), F.lit(hi)))
        return add(df, {c: clip(c, *b) for c, b in state["bounds"].items()})


def choose_numeric_imputer(missing_rate: float, n_features: int, n_rows: int, simple_max: float = 0.05, advanced_max: float = 0.30, knn_features: int = 100, knn_rows: int = 200_000) -> str:
    """median, knn or iterative, by how much is missing and how large the table is."""
    if missing_rate <= simple_max or missing_rate > advanced_max:
        return "median"
    return "knn" if n_features <= knn_features and n_rows <= knn_rows else "iterative"


class MedianImputer(Operator):
    """Exact medians; indicators for columns that had nulls in the fitted data."""

    defaults = {"columns": None, "add_indicators": True}

    def learn(self, df):
        cols = chosen(df, self.columns, numeric_columns(df))
        nulls = scalars(df, {c: F.count(F.when(number(c).isNull(), 1)) for c in cols})
        return {"medians": medians(df, {c: number(c) for c in cols}), "nulls": [c for c in cols if nulls[c]]}, {}

    def apply(self, df, state, tables):
        flags = {f"{c}_missing": number(c).isNull().cast("int") for c in state["nulls"]} if self.add_indicators else {}
        return add(add(df, flags), {c: F.coalesce(number(c), F.lit(m)) for c, m in state["medians"].items() if m is not None})


class CategoricalImputer(Operator):
    """The most frequent value (the least of several), or a constant."""

    defaults = {"columns": None, "strategy": "most_frequent", "fill_value": MISSING}

    def learn(self, df):
        cols = chosen(df, self.columns, string_columns(df))
        if self.strategy != "most_frequent" or not cols:
            return {"fill": {c: self.fill_value for c in cols}}, {}
        pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])).alias("x")).select("x.*")
        top = pairs.filter("v IS NOT NULL").groupBy("c", "v").count().groupBy("c").agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("v"))
        found = {r.c: r.v for r in top.collect()}  # one row per column
        return {"fill": {c: found.get(c, self.fill_value) for c in cols}}, {}

    def apply(self, df, state, tables):
        return add(df, {c: F.coalesce(F.col(c), F.lit(v)) for c, v in state["fill"].items()})


class KNNImputer(Operator):
    """The mean of the k nearest fitted rows that have the value, among all of them; distance over columns both rows have, scaled up to all.

    Distinct rows with gaps are the queries; they meet the distinct fitted rows of their place, and of others that may hold nearer ones. Fitted rows that share no
    column with a row come last, and of equally near ones those of smaller values first.
    """

    defaults = {"columns": None, "n_neighbors": 5}

    def learn(self, df):
        cols = chosen(df, self.columns, numeric_columns(df))
        some = F.lit(False)
        for c in cols:
            some = some | number(c).isNotNull()
        names = [f"c{i}" for i in range(len(cols))]
        fitted = stage(df.filter(some).select(*[number(c).alias(x) for c, x in zip(cols, names)]).groupBy(*names).agg(F.count(F.lit(1)).alias("w")), "knn")
        return {"columns": cols, "rows": fitted.count()}, {"fitted": fitted}

    def apply(self, df, state, tables):
        cols, k, n = state["columns"], self.n_neighbors, len(state["columns"])
        names = [f"c{i}" for i in range(n)]
        typed = add(df, {c: number(c) for c in cols})
        gap = F.lit(False)
        for c in cols:
            gap = gap | F.col(c).isNull()
        asked = typed.select(*[F.col(c).alias(x) for c, x in zip(cols, names)], gap.alias("gap")).filter("gap").drop("gap").distinct()
        asked = stage(asked.withColumn("id", F.monotonically_increasing_id()), "knn-asked")
        gaps = asked.select("id", *names, F.explode(F.array_compact(F.array(*[F.when(F.col(x).isNull(), F.lit(i)) for i, x in enumerate(names)]))).alias("j"))
        cells = Cells(tables["fitted"], names, stage)
        # the cell at a row's place gives k rows, so that no farther ones are sought in the others
        home = stage(cells.seek(cells.route(gaps.withColumns({"bound": F.lit(float("inf")), "home": F.lit(-1)}), k, True), k), "knn-home")
        order = Window.partitionBy("id", "j").orderBy("d", "v")
        before = F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        reached = home.withColumn("all", before + F.col("w")).groupBy("id", "j").agg(F.min(F.when(F.col("all") >= k, F.col("d"))).alias("bound"), F.min("cell").alias("home"))
        gaps = gaps.join(reached, ["id", "j"], "left").withColumns({"bound": F.coalesce("bound", F.lit(float("inf"))), "home": F.coalesce("home", F.lit(-1))})
        found = home.unionByName(cells.seek(cells.route(gaps, k, False), k)).select("id", "j", "d", "v", "w").unionByName(self._far(asked, tables["fitted"], names, k))
        best = found.withColumn("n", F.least(F.col("w"), k - before)).filter("n > 0")
        means = best.groupBy("id").agg(*[(F.sum(F.when(F.col("j") == i, F.col("v") * F.col("n"))) / F.sum(F.when(F.col("j") == i, F.col("n")))).alias(f"f{i}") for i in range(n)])
        fills = asked.join(means, "id").drop("id")
        out = lookup(typed, fills, {x: F.col(c) for c, x in zip(cols, names)}, {f"f{i}": None for i in range(n)})
        return add(out, {c: F.coalesce(F.col(c), F.col(f"f{i}")) for i, c in enumerate(cols)}).select(*df.columns)

    @staticmethod
    def _far(asked: DataFrame, fitted: DataFrame, names: list[str], k: int) -> DataFrame:
        """Rows that share no column with an asked one: the k of least value for each pattern of columns, at infinite distance."""
        has = F.array(*[F.col(x).isNotNull() for x in names])
        each = fitted.select(has.alias("q"), "w", F.posexplode(F.array(*names)).alias("j", "v")).filter("v IS NOT NULL").groupBy("q", "j", "v").agg(F.sum("w").alias("w"))
        least = each.withColumn("r", F.row_number().over(Window.partitionBy("q", "j").orderBy("v"))).filter(F.col("r") <= k).drop("r")
        mine = asked.select("id", has.alias("p"))
        pairs = mine.select("p").distinct().crossJoin(least).filter(~F.col("p")[F.col("j")] & ~F.exists(F.zip_with("p", "q", lambda a, b: a & b), lambda x: x))
        kept = pairs.withColumn("r", F.row_number().over(Window.partitionBy("p", "j").orderBy("v"))).filter(F.col("r") <= k)
        return mine.join(kept, "p").select("id", "j", F.lit(float("inf")).alias("d"), "v", "w")


class IterativeImputer(Operator):
    """Each column regressed on the others, in rounds; regressions are solved from one aggregate of products per round."""

    defaults = {"columns": None, "max_iter": 10, "ridge": 1e-6}

    def learn(self, df):
        import numpy as np

        cols = chosen(df, self.columns, numeric_columns(df))
        n = len(cols)
        start = scalars(df, {**{f"m:{c}": F.avg(number(c)) for c in cols}, **{f"s:{c}": F.stddev_pop(number(c)) for c in cols}})
        mean = [start[f"m:{c}"] or 0.0 for c in cols]
        scale = [start[f"s:{c}"] or 1.0 for c in cols]
        weights: list[list[list[float]]] = []  # per round and column: coefficients on standardised others, with the intercept last
        for _ in range(self.max_iter):
            z = self._filled(cols, mean, scale, weights)
            d = df.select(*[e.alias(f"z{i}") for i, e in enumerate(z)], *[number(c).isNotNull().alias(f"h{i}") for i, c in enumerate(cols)])
            one = lambda i: F.col(f"z{i}") if i < n else F.lit(1.0)
            sums = scalars(d, {(t, i, j): F.sum(F.when(F.col(f"h{t}"), one(i) * one(j))) for t in range(n) for i in range(n + 1) for j in range(i, n + 1)})
            got = []
            for t in range(n):
                g = np.array([[sums[t, min(i, j), max(i, j)] or 0.0 for j in range(n + 1)] for i in range(n + 1)])
                use = [i for i in range(n + 1) if i != t]
                a = g[np.ix_(use, use)] + self.ridge * np.eye(n) * max(1.0, g[n, n])
                w = np.zeros(n + 1)
                w[use] = np.linalg.solve(a, g[use, t]) if g[n, n] > 0 else 0.0
                got.append(w.tolist())
            change = max((abs(a - b) for x, y in zip(got, weights[-1] if weights else [[1e9] * (n + 1)] * n) for a, b in zip(x, y)), default=0.0)
            weights.append(got)
            if change < 1e-3:
                break
        return {"columns": cols, "mean": mean, "scale": scale, "weights": weights[-1:]}, {}

    def _filled(self, cols, mean, scale, weights) -> list[Column]:
        n = len(cols)
        z = [(number(c) - mean[i]) / (scale[i] or 1.0) for i, c in enumerate(cols)]
        full = [F.coalesce(x, F.lit(0.0)) for x in z]
        for w in weights[-1:]:
            guess = []
            for t in range(n):
                e = F.lit(w[t][n])
                for i in range(n):
                    if i != t:
                        e = e + full[i] * w[t][i]
                guess.append(e)
            full = [F.coalesce(z[i], guess[i]) for i in range(n)]
        return full

    def apply(self, df, state, tables):
        full = self._filled(state["columns"], state["mean"], state["scale"], state["weights"])
        return add(df, {c: full[i] * (state["scale"][i] or 1.0) + state["mean"][i] for i, c in enumerate(state["columns"])})


FAMILY_SCALERS = {"tree": "none", "linear": "standard", "svm": "standard", "knn": "minmax", "nn": "minmax"}


def choose_scaler(estimator_family: str, heavy_outliers: bool = False, robust_if_outliers: bool = True, families: dict[str, str] | None = None) -> str:
    if heavy_outliers and robust_if_outliers:
        return "robust"
    families = families or FAMILY_SCALERS
    return families.get(estimator_family, families["linear"])


class _Scaler(Operator):
    """(x - centre) / width, both fitted for all columns in one job; a width of 0 or null counts as 1."""

    defaults = {"columns": None}

    def parts(self, x: Column) -> tuple[Column, Column]:
        raise NotImplementedError

    def learn(self, df):
        cols = chosen(df, self.columns, numeric_columns(df))
        exprs = {}
        for c in cols:
            exprs[c, 0], exprs[c, 1] = self.parts(number(c))
        v = scalars(df, exprs)
        return {"scale": {c: [float(v[c, 0] or 0.0), float(v[c, 1] or 1.0)] for c in cols}}, {}

    def apply(self, df, state, tables):
        return add(df, {c: (number(c) - a) / b for c, (a, b) in state["scale"].items()})

    def inverse(self, df, state):
        return add(df, {c: number(c) * b + a for c, (a, b) in state["scale"].items()})


class StandardScaler(_Scaler):
    def parts(self, x):
        return F.avg(x), F.stddev_pop(x)


class MinMaxScaler(_Scaler):
    def parts(self, x):
        return F.min(x), F.max(x) - F.min(x)


class RobustScaler(_Scaler):
    def learn(self, df):
        cols = chosen(df, self.columns, numeric_columns(df))
        v = exact_quantiles(df, {c: (number(c), [0.25, 0.5, 0.75]) for c in cols})
        return {"scale": {c: [q[1], (q[2] - q[0]) or 1.0] if q else [0.0, 1.0] for c, q in v.items()}}, {}


class MaxAbsScaler(_Scaler):
    def parts(self, x):
        return F.lit(0.0), F.max(F.abs(x))


SCALERS = {"standard": StandardScaler, "minmax": MinMaxScaler, "robust": RobustScaler, "maxabs": MaxAbsScaler}
