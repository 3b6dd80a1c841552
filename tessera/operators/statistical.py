"""Row statistics, z-scores, outliers, quantile bins and missing-value patterns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import ConfigurationError
from tessera.operators.base import Operator, add, chosen, number, numeric_columns, scalars, skew_kurtosis
from tessera.operators.numeric import distinct_edges, right_closed
from tessera.operators.order import exact_quantiles, medians
from tessera.sources.staging import stage


def row_statistic(stat: str, xs: list[Column]) -> Column:
    """Sums, least and greatest over columns, which stay in generated code; only the median needs an array."""
    n = sum((x.isNotNull().cast("int") for x in xs), F.lit(0))
    total = sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0))
    mean = F.try_divide(total, n)
    least, greatest = (f(*xs) if len(xs) > 1 else xs[0] if xs else F.lit(None).cast("double") for f in (F.least, F.greatest))

    def power(k: int) -> Column:
        out = F.lit(0.0)
        for x in xs:
            d = x - mean
            p = d
            for _ in range(k - 1):
                p = p * d
            out = out + F.coalesce(p, F.lit(0.0))
        return out

    if stat == "mean":
        return mean
    if stat == "sum":
        return total
    if stat == "min":
        return least
    if stat == "max":
        return greatest
    if stat == "range":
        return greatest - least
    if stat == "std":
        return F.when(n > 1, F.sqrt(F.try_divide(power(2), n - 1)))
    if stat == "median":
        s = F.sort_array(F.array_compact(F.array(*xs)))
        lo, hi = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
        return F.when(n > 0, (lo + hi) / 2)
    m2 = F.try_divide(power(2), n)
    if stat == "skew":
        return F.when((n > 2) & (m2 > 0), skew_kurtosis(n, F.try_divide(F.try_divide(power(3), n), F.pow(m2, F.lit(1.5))), F.lit(0.0))[0])
    if stat in ("kurtosis", "kurt"):
        return F.when((n > 3) & (m2 > 0), skew_kurtosis(n, F.lit(0.0), F.try_divide(F.try_divide(power(4), n), m2 * m2) - 3)[1])
    raise ConfigurationError("unknown row statistic", statistic=stat)


class RowStatisticsTransformer(Operator):
    defaults = {"statistics": ("mean", "std", "min", "max"), "numeric_cols": None, "include_null_count": True, "prefix": "row", "skip_single_value_rows": False}

    def apply(self, df, state, tables):
        cols = chosen(df, self.numeric_cols, numeric_columns(df))
        xs = [number(c) for c in cols]
        filled = sum((x.isNotNull().cast("int") for x in xs), F.lit(0))
        made = {}
        for s in self.statistics:
            x = row_statistic(s, xs)
            made[f"{self.prefix}_{s}"] = F.when(filled > 1, x) if self.skip_single_value_rows else x
        if self.include_null_count:
            made[f"{self.prefix}_null_count"] = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
            made[f"{self.prefix}_non_null_count"] = F.lit(len(df.columns)) - made[f"{self.prefix}_null_count"]
        return add(df, made)


def centre_and_mad(df, cols: list[str]) -> dict[str, list[float]]:
    """Medians, then medians of distances from them."""
    m = medians(df, {c: number(c) for c in cols})
    d = medians(df, {c: F.abs(number(c) - F.lit(m[c])) for c in cols if m[c] is not None})
    return {c: [m[c], d[c] or 1.0] for c in cols if m[c] is not None}


class ZScoreTransformer(Operator):
    defaults = {"columns": None, "robust": False, "suffix": "_zscore", "clip": None}

    def learn(self, df):
        cols = chosen(df, self.columns, numeric_columns(df))
        if self.robust:
            return {"scale": centre_and_mad(df, cols)}, {}
        v = scalars(df, {**{(c, 0): F.avg(number(c)) for c in cols}, **{(c, 1): F.stddev_samp(number(c)) for c in cols}})
        return {"scale": {c: [v[c, 0], v[c, 1] or 1.0] for c in cols if v[c, 0] is not None}}, {}

    def apply(self, df, state, tables):
        made = {}
        for c, (a, b) in state["scale"].items():
            z = (number(c) - a) / b
            if self.clip is not None:
                z = F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(float(self.clip))), F.lit(-float(self.clip))))
            made[f"{c}{self.suffix}"] = z
        return add(df, made)


class OutlierDetector(Operator):
    """Flags or scores: iqr, zscore, modified_zscore, isolation_forest."""

    defaults = {"method": "iqr", "columns": None, "k": 1.5, "threshold": 3.0, "suffix": "_is_outlier", "return_scores": False, "contamination": 0.1, "random_state": 42, "n_trees": 50, "sample_rows": 256}

    def check(self):
        if self.method not in ("iqr", "zscore", "modified_zscore", "isolation_forest"):
            raise ConfigurationError("unknown method", method=self.method)

    def learn(self, df):
        cols = chosen(df, self.columns, numeric_columns(df))
        if self.method == "iqr":
            v = exact_quantiles(df, {c: (number(c), [0.25, 0.75]) for c in cols})
            return {"fit": {c: [q[0] - self.k * (q[1] - q[0]), q[1] + self.k * (q[1] - q[0])] for c, q in v.items() if q}}, {}
        if self.method == "isolation_forest":
            return self._forest(df, cols)
        if self.method == "modified_zscore":
            return {"fit": centre_and_mad(df, cols)}, {}
        return {"fit": ZScoreTransformer(columns=cols).learn(df)[0]["scale"]}, {}

    def _forest(self, df, cols):
        """Random trees on bounded samples; each is a nested expression, so scoring is one projection."""
        import numpy as np

        rng = np.random.default_rng(self.random_state)
        m = medians(df, {c: number(c) for c in cols})
        rows = df.select(*[F.coalesce(number(c), F.lit(m[c] or 0.0)).alias(c) for c in cols]).orderBy(F.xxhash64(*cols, F.lit(self.random_state)), *cols).limit(self.sample_rows * 8).collect()
        x = np.array([list(r) for r in rows], float).reshape(-1, len(cols))
        size = min(self.sample_rows, len(x))
        depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        norm = lambda n: 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

        def tree(part, d):
            if d >= depth or len(part) < 2:
                return d + norm(len(part))
            spread = [j for j in range(len(cols)) if part[:, j].max() > part[:, j].min()]
            if not spread:
                return d + norm(len(part))
            j = int(rng.choice(spread))
            cut = float(rng.uniform(part[:, j].min(), part[:, j].max()))
            return [j, cut, tree(part[part[:, j] < cut], d + 1), tree(part[part[:, j] >= cut], d + 1)]

        trees = [tree(x[rng.choice(len(x), size, replace=False)], 0) for _ in range(self.n_trees if size > 1 else 0)]
        state = {"columns": cols, "median": m, "trees": trees, "norm": float(norm(size) or 1.0)}
        cut = exact_quantiles(stage(df.select(self._forest_score(state).alias("s")), "forest-scores"), {"q": (F.col("s"), [1 - self.contamination])})["q"][0] if trees else 1.0
        return {**state, "cut": cut}, {}

    def _forest_score(self, state) -> Column:
        import numpy as np
        import pandas as pd

        trees = state["trees"]

        def paths(*series: pd.Series) -> pd.Series:
            x = np.stack([s.to_numpy(float) for s in series], axis=1)
            out = np.zeros(len(x))

            def walk(t, at):
                if isinstance(t, (int, float)):
                    out[at] += t
                    return
                j, cut, a, b = t
                low = x[at, j] < cut
                if low.any():
                    walk(a, at[low])
                if (~low).any():
                    walk(b, at[~low])

            for t in trees:
                walk(t, np.arange(len(x)))
            return pd.Series(np.exp2(-out / max(len(trees), 1) / state["norm"]))

        return F.pandas_udf(paths, "double")(*[F.coalesce(number(c), F.lit(state["median"][c] or 0.0)) for c in state["columns"]])

    def apply(self, df, state, tables):
        if self.method == "isolation_forest":
            s = self._forest_score(state)
            return df.withColumn(f"row{self.suffix}", s if self.return_scores else (s > state["cut"]).cast("int"))
        made = {}
        for c, (a, b) in state["fit"].items():
            x = number(c)
            if self.method == "iqr":
                score = F.greatest(F.lit(a) - x, x - F.lit(b), F.lit(0.0))
                flag = (x < a) | (x > b)
            else:
                score = F.abs(x - a) / b
                flag = score > self.threshold
            made[f"{c}{self.suffix}"] = F.when(x.isNotNull(), score) if self.return_scores else F.coalesce(flag, F.lit(False)).cast("int")
        return add(df, made)


class QuantileTransformer(Operator):
    defaults = {"columns": None, "n_quantiles": 4, "output_type": "label", "suffix": "_quantile"}

    def learn(self, df):
        cols = chosen(df, self.columns, numeric_columns(df))
        v = exact_quantiles(df, {c: (number(c), [i / self.n_quantiles for i in range(self.n_quantiles + 1)]) for c in cols})
        return {"edges": {c: distinct_edges(e) for c, e in v.items() if e}}, {}

    def apply(self, df, state, tables):
        made = {}
        for c, e in state["edges"].items():
            b = right_closed(number(c), e)
            if self.output_type in ("label", "both"):
                made[f"{c}{self.suffix}"] = b
            if self.output_type in ("onehot", "both"):
                made |= {f"{c}_q{i}": F.coalesce((b == i).cast("int"), F.lit(0)) for i in range(len(e) - 1)}
        return add(df, made)


class MissingValuePatternsTransformer(Operator):
    defaults = {"include_count": True, "include_ratio": True, "include_indicators": True, "include_clusters": False, "include_cooccurrence": False, "n_clusters": 3, "min_missing_rate": 0.01, "columns": None}

    def learn(self, df):
        cols = chosen(df, self.columns, df.columns)
        v = scalars(df, {"n": F.count(F.lit(1)), **{c: F.count(F.when(F.col(c).isNull(), 1)) for c in cols}})
        often = [c for c in cols if v[c] > self.min_missing_rate * max(v["n"], 1)]
        pairs, centres = [], []
        if self.include_cooccurrence:
            both = [(a, b) for i, a in enumerate(often) for b in often[i + 1 :]]
            s = scalars(df, {p: F.count(F.when(F.col(p[0]).isNull() & F.col(p[1]).isNull(), 1)) for p in both})
            pairs = [list(p) for p in both if s[p] > 0.5 * (v[p[0]] + v[p[1]] - s[p])]
        if self.include_clusters and often:
            from pyspark.ml.clustering import KMeans
            from pyspark.ml.feature import VectorAssembler

            nulls = df.select(*[F.col(c).isNull().cast("double").alias(c) for c in often])
            data = VectorAssembler(inputCols=often, outputCol="features").transform(nulls)
            centres = [[float(y) for y in x] for x in KMeans(k=max(2, self.n_clusters), seed=42).fit(data).clusterCenters()]
        return {"columns": cols, "often": often, "pairs": pairs, "centres": centres}, {}

    def apply(self, df, state, tables):
        cols, made = state["columns"], {}
        n = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
        if self.include_count:
            made["missing_count"] = n
        if self.include_ratio:
            made["missing_ratio"] = n / max(len(cols), 1)
        if self.include_indicators:
            made |= {f"{c}_is_missing": F.col(c).isNull().cast("int") for c in state["often"]}
        made |= {f"{a}_{b}_both_missing": (F.col(a).isNull() & F.col(b).isNull()).cast("int") for a, b in state["pairs"]}
        if state["centres"]:
            d = [sum((F.pow(F.col(c).isNull().cast("double") - x, F.lit(2.0)) for c, x in zip(state["often"], centre)), F.lit(0.0)) for centre in state["centres"]]
            made["missing_cluster"] = (F.array_position(F.array(*d), F.array_min(F.array(*d))) - 1).cast("int")
        return add(df, made)


def build_statistical_pipeline(include_row_stats: bool = True, include_percentile_rank: bool = False, include_zscore: bool = True, include_outlier_detection: bool = True, include_quantiles: bool = False) -> list[tuple[str, Operator]]:
    from tessera.operators.windows import PercentileRankTransformer

    parts = [("row_stats", RowStatisticsTransformer, include_row_stats), ("percentile_rank", PercentileRankTransformer, include_percentile_rank), ("zscore", ZScoreTransformer, include_zscore), ("outliers", OutlierDetector, include_outlier_detection), ("quantiles", QuantileTransformer, include_quantiles)]
    return [(name, cls()) for name, cls, on in parts if on]
