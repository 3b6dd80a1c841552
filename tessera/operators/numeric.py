"""Numeric transforms and binning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import ConfigurationError, FeatureEngineeringError, InputValidationError
from tessera.functions.power import best_power, box_cox, box_cox_inverse, yeo_johnson
from tessera.operators.base import Operator, add, chosen, finite, number, numeric_columns, scalars, skew_kurtosis
from tessera.operators.order import before, exact_quantiles, in_ranges


class SkewedPowerTransformer(Operator):
    """Yeo-Johnson of most likelihood, then standardised, on the masked columns."""

    defaults = {"columns": None, "skew_mask": None}

    def learn(self, df):
        cols = chosen(df, self.columns, numeric_columns(df))
        cols = [c for i, c in enumerate(cols) if self.skew_mask is None or self.skew_mask[i]]
        lam = best_power(df, {c: number(c) for c in cols})
        v = scalars(df, {**{(c, 0): F.avg(yeo_johnson(number(c), lam[c])) for c in cols}, **{(c, 1): F.stddev_pop(yeo_johnson(number(c), lam[c])) for c in cols}})
        return {"fit": {c: [lam[c], v[c, 0] or 0.0, v[c, 1] or 1.0] for c in cols}}, {}

    def apply(self, df, state, tables):
        return add(df, {c: (yeo_johnson(number(c), lam) - m) / s for c, (lam, m, s) in state["fit"].items()})


class _Simple(Operator):
    """Column-wise formula; `least` is the smallest value that fit allows (None: any)."""

    defaults = {"columns": None}

    def least(self) -> tuple[float, bool] | None:
        return None

    def learn(self, df):
        cols = chosen(df, self.columns, numeric_columns(df))
        if (bound := self.least()) is not None:
            for c, v in scalars(df, {c: F.min(number(c)) for c in cols}).items():
                if v is not None and (v < bound[0] or (v == bound[0] and not bound[1])):
                    raise FeatureEngineeringError("values outside of the transform's domain", column=c, least=v)
        return {"columns": cols}, {}

    def apply(self, df, state, tables):
        return add(df, {c: self.forward(number(c)) for c in state["columns"]})

    def inverse(self, df, state):
        return add(df, {c: self.backward(number(c)) for c in state["columns"]})


class LogTransformer(_Simple):
    defaults = {"columns": None, "shift": 1e-5, "base": "natural"}

    def least(self):
        return -self.shift, False

    def forward(self, x):
        return {"natural": F.ln, "10": F.log10, "log10": F.log10, "2": F.log2, "log2": F.log2}[str(self.base)](x + self.shift)

    def backward(self, y):
        base = {"natural": None, "10": 10.0, "log10": 10.0, "2": 2.0, "log2": 2.0}[str(self.base)]
        return (F.exp(y) if base is None else F.pow(F.lit(base), y)) - self.shift


class Log1pTransformer(_Simple):
    def least(self):
        return 0.0, True

    def forward(self, x):
        return F.log1p(x)

    def backward(self, y):
        return F.expm1(y)


class SqrtTransformer(_Simple):
    defaults = {"columns": None, "handle_negatives": "abs"}

    def check(self):
        if self.handle_negatives not in ("abs", "clip", "error"):
            raise ConfigurationError("handle_negatives is abs, clip or error", value=self.handle_negatives)

    def least(self):
        return (0.0, True) if self.handle_negatives == "error" else None

    def forward(self, x):
        return F.signum(x) * F.sqrt(F.abs(x)) if self.handle_negatives == "abs" else F.sqrt(F.greatest(x, F.lit(0.0)))

    def backward(self, y):
        return F.signum(y) * y * y if self.handle_negatives == "abs" else y * y


class ReciprocalTransformer(_Simple):
    defaults = {"columns": None, "epsilon": 1e-10}

    def forward(self, x):
        return F.try_divide(F.lit(1.0), x + self.epsilon)

    def backward(self, y):
        return F.try_divide(F.lit(1.0), y) - self.epsilon


class BoxCoxTransformer(_Simple):
    """With lambda_value, that power; else the one of most likelihood."""

    defaults = {"columns": None, "lambda_value": None}

    def least(self):
        return 0.0, False

    def learn(self, df):
        state, _ = super().learn(df)
        cols = state["columns"]
        lam = {c: self.lambda_value for c in cols} if self.lambda_value is not None else best_power(df, {c: number(c) for c in cols}, "box_cox")
        return {"columns": cols, "lambda": lam}, {}

    def apply(self, df, state, tables):
        return add(df, {c: box_cox(number(c), state["lambda"][c]) for c in state["columns"]})

    def inverse(self, df, state):
        return add(df, {c: box_cox_inverse(number(c), state["lambda"][c]) for c in state["columns"]})


class ExponentialTransformer(_Simple):
    defaults = {"columns": None, "transform_type": "square", "clip_max": None}

    def forward(self, x):
        if self.clip_max is not None:
            x = F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(self.clip_max))), F.lit(-float(self.clip_max))))
        return {"square": lambda: x * x, "cube": lambda: x * x * x, "exp": lambda: F.exp(x)}[self.transform_type]()


class MathematicalTransformer(Operator):
    """A transform per column by skewness, sign and zeros, decided on one aggregate of all columns."""

    defaults = {"columns": None, "strategy": "auto", "log_shift": 1e-5, "sqrt_handle_negatives": "abs", "reciprocal_epsilon": 1e-10, "exponential_type": "square", "boxcox_lambda": None, "skew_threshold": 1.0}

    @staticmethod
    def choose(s: dict, threshold: float = 1.0) -> str:
        skew, kurt = s["skew"] or 0.0, s["kurt"] or 0.0
        if s["min"] is None or abs(skew) < threshold:
            return "none"
        if s["min"] < 0:
            return "yeo_johnson"
        if s["whole"] and s["zeros"]:
            return "log1p"
        if s["min"] > 0:
            return "log" if abs(skew) > 3 else "box_cox"
        if s["min"] >= 0:
            return "log1p"
        return "reciprocal" if kurt > 10 and skew > 2 else "sqrt" if 1 <= skew < 3 else "yeo_johnson"

    def learn(self, df):
        cols = chosen(df, self.columns, numeric_columns(df))
        exprs = {}
        for c in cols:
            x = number(c)
            g1, g2 = skew_kurtosis(F.count(x), F.skewness(x), F.kurtosis(x))
            exprs |= {(c, "skew"): g1, (c, "kurt"): g2, (c, "min"): F.min(x), (c, "zeros"): F.count(F.when(x == 0, 1)), (c, "whole"): F.min((x == F.floor(x)).cast("int"))}
        v = scalars(df, exprs)
        stats = {c: {k: v[c, k] for k in ("skew", "kurt", "min", "zeros", "whole")} for c in cols}
        how = {c: self.choose(stats[c], self.skew_threshold) if self.strategy == "auto" else self.strategy for c in cols}
        powers = {}
        for kind in ("yeo_johnson", "box_cox"):
            own = [c for c in cols if how[c] == kind]
            if kind == "box_cox" and self.boxcox_lambda is not None:
                powers |= {c: float(self.boxcox_lambda) for c in own}
            elif own:
                powers |= best_power(df, {c: number(c) for c in own}, kind)
        return {"strategies": how, "stats": stats, "powers": powers}, {}

    def apply(self, df, state, tables):
        made = {}
        for c, how in state["strategies"].items():
            x = number(c)
            made[c] = {
                "none": lambda: x,
                "log": lambda: F.ln(x + self.log_shift),
                "log1p": lambda: F.log1p(x),
                "sqrt": lambda: SqrtTransformer(handle_negatives=self.sqrt_handle_negatives).forward(x),
                "reciprocal": lambda: F.try_divide(F.lit(1.0), x + self.reciprocal_epsilon),
                "box_cox": lambda: box_cox(x, state["powers"][c]),
                "yeo_johnson": lambda: yeo_johnson(x, state["powers"][c]),
                "exponential": lambda: ExponentialTransformer(transform_type=self.exponential_type).forward(x),
            }[how]()
        return add(df, made)


def left_closed(x: Column, edges: list[float]) -> Column:
    """The bin of x: edges belong to the bin on their right; values outside go to the nearest bin."""
    n = len(edges) - 1
    b = F.lit(-1)
    for e in edges:
        b = b + (x >= F.lit(float(e))).cast("int")
    return F.when(x.isNotNull(), F.greatest(F.lit(0), F.least(b, F.lit(n - 1))))


def right_closed(x: Column, edges: list[float]) -> Column:
    """The bin of x: edges belong to the bin on their left, the lowest to the first; null outside."""
    b = F.lit(0)
    for e in edges[1:-1]:
        b = b + (x > F.lit(float(e))).cast("int")
    return F.when((x >= float(edges[0])) & (x <= float(edges[-1])), b)


def distinct_edges(values: list[float]) -> list[float]:
    out: list[float] = []
    for v in values:
        if not out or v > out[-1]:
            out.append(v)
    return out if len(out) > 1 else [out[0] - 0.5, out[0] + 0.5]


class BinningTransformer(Operator):
    """Bins by equal width, equal frequency, one-dimensional k-means, a decision tree or given edges."""

    defaults = {"columns": None, "strategy": "equal_width", "n_bins": 5, "encode": "ordinal", "custom_bins": None, "label_col": None, "random_state": 42}

    def check(self):
        if self.strategy not in ("equal_width", "equal_frequency", "kmeans", "decision_tree", "custom"):
            raise ConfigurationError("unknown strategy", strategy=self.strategy)
        if self.strategy == "custom" and any(len(e) < 2 for e in (self.custom_bins or {}).values()):
            raise InputValidationError("custom bins need two edges")

    def learn(self, df):
        cols = chosen(df, self.columns, numeric_columns(df, [self.label_col]))
        if self.strategy == "custom":
            return {"edges": {c: sorted(map(float, e)) for c, e in (self.custom_bins or {}).items() if c in cols}}, {}
        n = self.n_bins
        if self.strategy == "equal_frequency":
            v = exact_quantiles(df, {c: (finite(c), [i / n for i in range(n + 1)]) for c in cols})
            return {"edges": {c: distinct_edges(e) for c, e in v.items() if e}}, {}
        lim = scalars(df, {**{(c, 0): F.min(finite(c)) for c in cols}, **{(c, 1): F.max(finite(c)) for c in cols}})
        wide = {c: [lim[c, 0] + (lim[c, 1] - lim[c, 0]) * i / n for i in range(n)] + [lim[c, 1]] if lim[c, 1] > lim[c, 0] else [lim[c, 0] - 0.5, lim[c, 0] + 0.5] for c in cols if lim[c, 0] is not None}
        if self.strategy == "equal_width":
            return {"edges": wide}, {}
        from pyspark.ml.feature import VectorAssembler

        edges = {}
        for c in wide:
            part = df.select(finite(c).alias("x"), *([F.col(self.label_col).alias("y")] if self.label_col else [])).filter("x IS NOT NULL")
            data = VectorAssembler(inputCols=["x"], outputCol="features").transform(part)
            if self.strategy == "kmeans":
                from pyspark.ml.clustering import KMeans

                k = min(n, part.distinct().limit(n).count())
                centres = sorted(float(x[0]) for x in KMeans(k=max(k, 2), seed=self.random_state).fit(data).clusterCenters()) if k > 1 else []
                inner = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
            else:
                inner = self._tree_edges(data)
            lo, hi = wide[c][0], wide[c][-1]
            edges[c] = distinct_edges([lo, *[e for e in sorted(inner) if lo < e < hi], hi]) if inner else distinct_edges([lo, (lo + hi) / 2, hi])
        return {"edges": edges}, {}

    def _tree_edges(self, data) -> list[float]:
        import math
        import re

        from pyspark.ml.classification import DecisionTreeClassifier
        from pyspark.ml.feature import StringIndexer
        from pyspark.ml.regression import DecisionTreeRegressor

        if not self.label_col:
            raise InputValidationError("decision_tree needs label_col")
        depth = max(1, math.ceil(math.log2(self.n_bins)))
        text = dict(data.dtypes)["y"] == "string"
        if text or data.select("y").distinct().limit(21).count() <= 20:
            data = StringIndexer(inputCol="y", outputCol="label").fit(data.withColumn("y", F.col("y").cast("string"))).transform(data.withColumn("y", F.col("y").cast("string")))
            tree = DecisionTreeClassifier(maxDepth=depth, seed=self.random_state).fit(data)
        else:
            tree = DecisionTreeRegressor(maxDepth=depth, seed=self.random_state).fit(data.withColumn("label", F.col("y").cast("double")))
        found = [float(x) for x in re.findall(r"<= (-?[\d.]+(?:E-?\d+)?)\)", tree.toDebugString)]
        return sorted(set(found))[: self.n_bins - 1]

    def apply(self, df, state, tables):
        made = {}
        for c, e in state["edges"].items():
            b = left_closed(finite(c), e)
            if self.encode == "ordinal":
                made[f"{c}_binned"] = b
            else:
                made |= {f"{c}_bin_{i}": F.coalesce((b == i).cast("int"), F.lit(0)) for i in range(len(e) - 1)}
                made[f"{c}_bin_nan"] = b.isNull().cast("int")
        return add(df, made)


class AutoBinningSelector(Operator):
    """Equal width for few rows; a tree if the target depends on the column (Spearman); equal frequency if skewed; else equal width."""

    defaults = {"columns": None, "n_bins": 5, "encode": "ordinal", "prefer_supervised": True, "skewness_threshold": 1.0, "label_col": None, "random_state": 42}

    def learn(self, df):
        import math

        cols = chosen(df, self.columns, numeric_columns(df, [self.label_col]))
        exprs = {}
        for c in cols:
            exprs[c] = skew_kurtosis(F.count(number(c)), F.skewness(number(c)), F.kurtosis(number(c)))[0]
        v = scalars(df, {**exprs, "__n": F.count(F.lit(1))})
        numeric_label = self.label_col and self.label_col in numeric_columns(df)
        how, edges = {}, {}
        for c in cols:
            kind = "equal_frequency" if abs(v[c] or 0.0) > self.skewness_threshold else "equal_width"
            if v["__n"] < 10:
                kind = "equal_width"
            elif numeric_label and self.prefer_supervised:
                r, n = spearman(df, c, self.label_col)
                t = abs(r) * math.sqrt(max(n - 2, 0) / max(1e-300, 1 - r * r)) if abs(r) < 1 else float("inf")
                if abs(r) > 0.3 and math.erfc(t / math.sqrt(2)) < 0.05:
                    kind = "decision_tree"
            how[c] = kind
            b = BinningTransformer(columns=[c], strategy=kind, n_bins=self.n_bins, label_col=self.label_col, random_state=self.random_state)
            edges |= b.learn(df)[0]["edges"]
        return {"edges": edges, "strategies": how}, {}

    apply = BinningTransformer.apply


def spearman(df, a: str, b: str) -> tuple[float, int]:
    """Rank correlation with average ranks, from counts of distinct values; ranks come from sums over value ranges, not from one sorted task."""
    rows = df.select(number(a).alias("a"), number(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    for c in ("a", "b"):
        rows = with_ranks(rows, c, f"r{c}")
    r = rows.agg(F.corr("ra", "rb"), F.count(F.lit(1))).first()
    return float(r[0] or 0.0), r[1]


def with_ranks(df, c: str, out: str, parts: int | None = None):
    """Average ranks of a column without a global window: value counts, written in ranges, and offsets of the ranges before."""
    from pyspark.sql import Window

    counts = in_ranges(df.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n")), ["v"], "p", parts)
    offsets = before(counts.groupBy("p").agg(F.sum("n").alias("t")), "p", {"t": "o"})
    own = Window.partitionBy("p").orderBy("v")
    ranks = counts.join(F.broadcast(offsets), "p").select("v", (F.col("o") + F.sum("n").over(own) - F.col("n") + (F.col("n") + 1) / 2).alias(out))
    return df.join(ranks, df[c].eqNullSafe(ranks["v"]), "left").drop("v")
