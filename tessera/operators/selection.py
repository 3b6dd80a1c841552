"""Feature selection. Scores come from aggregates; only scores reach the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import InputValidationError
from tessera.operators.aggregate import correlation_matrix
from tessera.operators.base import Operator, chosen, key, number, numeric_columns, scalars, string_columns
from tessera.operators.encoders import WoEEncoder, binary_target
from tessera.operators.numeric import distinct_edges, right_closed
from tessera.operators.order import exact_quantiles, numbered
from tessera.sources.staging import stage


def prune_correlated(df: DataFrame, threshold: float = 0.95, columns: list[str] | None = None) -> list[str]:
    """Columns to drop: those correlated over threshold with an earlier one."""
    r = correlation_matrix(df, columns, max_features=10_000).filter(F.abs("r") > threshold)
    order = {c: i for i, c in enumerate(df.columns)}
    return sorted({x.b for x in r.collect()}, key=order.__getitem__)


def correlations(df: DataFrame, cols: list[str]):
    import numpy as np

    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    z = {c: F.coalesce(number(c), F.lit(0.0)) for c in cols}
    v = scalars(df, {p: F.corr(z[p[0]], z[p[1]]) for p in pairs})
    m = np.eye(len(cols))
    for (a, b), r in v.items():
        i, j = cols.index(a), cols.index(b)
        m[i, j] = m[j, i] = 0.0 if r is None or r != r else r
    return m


def compute_vif_drop(df: DataFrame, threshold: float = 10.0, columns: list[str] | None = None) -> list[str]:
    """Drop the column of largest variance inflation until all are within threshold; one correlation matrix serves every step.

    Inflation is 1 / (1 - R2) of a regression on the other columns, with 1 - R2 at least 1e-6; of equals, the first goes.
    """
    import numpy as np

    cols = chosen(df, columns, numeric_columns(df))
    m, keep, dropped = correlations(df, cols), list(range(len(cols))), []
    while len(keep) > 1:
        vif = [variance_inflation(m[np.ix_(keep, keep)], k) for k in range(len(keep))]
        worst = int(np.argmax(np.round(vif, 4)))
        if vif[worst] <= threshold:
            break
        dropped.append(cols[keep.pop(worst)])
    return dropped


def variance_inflation(m, k: int) -> float:
    """Of variable k, from a correlation matrix. Directions without variance (up to 1e-10) are left out of the regression."""
    import numpy as np

    others = [i for i in range(len(m)) if i != k]
    r2 = float(m[k, others] @ np.linalg.pinv(m[np.ix_(others, others)], rcond=1e-10, hermitian=True) @ m[others, k])
    return 1.0 / max(1e-6, 1.0 - r2)


class _Selector(Operator):
    """Keeps chosen columns, the label and `passthrough`."""

    def scores(self, df: DataFrame, cols: list[str]) -> dict[str, float]:
        raise NotImplementedError

    def pick(self, scores: dict[str, float], order: list[str]) -> list[str]:
        top = sorted(order, key=lambda c: (-scores.get(c, 0.0), order.index(c)))[: self.k]
        return [c for c in order if c in top]

    def inputs(self, df):
        return chosen(df, self.columns, numeric_columns(df, [self.label_col]))

    def learn(self, df):
        cols = self.inputs(df)
        s = self.scores(df, cols)
        return {"selected": self.pick(s, cols), "scores": s, "considered": cols}, {}

    def apply(self, df, state, tables):
        drop = set(state["considered"]) - set(state["selected"])
        return df.select(*[c for c in df.columns if c not in drop])


class MutualInfoSelector(_Selector):
    """Plug-in mutual information on equal-frequency bins (a k-nearest-neighbour estimate would need all pairs of rows)."""

    defaults = {"k": 50, "label_col": "y", "columns": None, "n_bins": 10, "task": "classification", "random_state": 42}

    def scores(self, df, cols):
        y, task = binary_target(df, self.label_col, task=self.task) if self.task == "regression" else (F.col(self.label_col).cast("string"), self.task)
        lab = [self.label_col] if task == "regression" else []
        e = exact_quantiles(df, {c: (number(c), [i / self.n_bins for i in range(self.n_bins + 1)]) for c in [*cols, *lab]})
        bins = {c: right_closed(number(c), distinct_edges(e[c])) if e[c] else F.lit(0) for c in [*cols, *lab]}
        target = bins[self.label_col] if lab else y
        return mutual_information(df, {c: bins[c] for c in cols}, target)


def mutual_information(df: DataFrame, bins: dict, target) -> dict[str, float]:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(b, F.lit(-1)).alias("b")) for c, b in bins.items()])).alias("x")
    n = df.select(pairs, target.cast("string").alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n")).select("x.*", "y", "n")
    w = lambda *k: F.sum("n").over(Window.partitionBy("c", *k))  # noqa: E731  over bins, not rows
    t = n.select("c", "n", w().alias("all"), w("b").alias("nb"), w("y").alias("ny"))
    out = t.groupBy("c").agg(F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("nb") * F.col("ny")))).alias("mi"))
    return {r.c: max(0.0, r.mi) for r in out.collect()}


class WOEIVSelector(_Selector):
    """Columns of an information value of at least threshold; numbers are binned first."""

    defaults = {"threshold": 0.02, "smoothing": 0.5, "label_col": "y", "columns": None, "n_bins": 10, "random_state": 42}

    def inputs(self, df):
        return chosen(df, self.columns, [*string_columns(df, [self.label_col]), *numeric_columns(df, [self.label_col])])

    def scores(self, df, cols):
        if df.select(self.label_col).filter(F.col(self.label_col).isNotNull()).distinct().limit(3).count() != 2:
            raise InputValidationError("information values need a target of two values", label=self.label_col)
        nums = [c for c in cols if c in numeric_columns(df)]
        e = exact_quantiles(df, {c: (number(c), [i / self.n_bins for i in range(self.n_bins + 1)]) for c in nums})
        d = df.select(self.label_col, *[key(c).alias(c) for c in cols if c not in nums], *[F.coalesce(right_closed(number(c), distinct_edges(e[c])), F.lit(-1)).cast("string").alias(c) for c in nums if e[c]])
        return WoEEncoder(cols=[c for c in cols if c in d.columns], label_col=self.label_col, smoothing=self.smoothing).fit(d).state["iv"]

    def pick(self, scores, order):
        return [c for c in order if scores.get(c, 0.0) >= self.threshold]


def chi2_tail(x: float, k: int) -> float:
    """P(chi-squared with k degrees >= x), by the series or continued fraction of the incomplete gamma function."""
    a, x = k / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * front)
    b, c = x + 1 - a, 1e300
    d = h = 1.0 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * front


class Chi2Selector(_Selector):
    defaults = {"k": 50, "alpha": None, "label_col": "y", "columns": None}

    def scores(self, df, cols):
        x = {c: F.greatest(F.coalesce(number(c), F.lit(0.0)), F.lit(0.0)) for c in cols}
        t = df.groupBy(F.col(self.label_col).cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(f"s{i}") for i, e in enumerate(x.values())]).collect()  # one row per class
        n = sum(r.n for r in t)
        out = {}
        for i, c in enumerate(cols):
            total = sum(r[f"s{i}"] for r in t)
            out[c] = sum((r[f"s{i}"] - total * r.n / n) ** 2 / (total * r.n / n) for r in t) if total > 0 else 0.0
        self._degrees = max(1, len(t) - 1)
        return out

    def pick(self, scores, order):
        if self.alpha is not None:
            return [c for c in order if chi2_tail(scores[c], self._degrees) < self.alpha]
        return super().pick(scores, order)


def _vector(df: DataFrame, cols: list[str], label: str, task: str) -> DataFrame:
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    d = df.select(*[F.coalesce(number(c), F.lit(0.0)).alias(c) for c in cols], F.col(label).alias("__y")).filter("__y IS NOT NULL")
    if task == "classification":
        d = StringIndexer(inputCol="__y", outputCol="label", stringOrderType="alphabetAsc").fit(d.withColumn("__y", F.col("__y").cast("string"))).transform(d.withColumn("__y", F.col("__y").cast("string")))
    else:
        d = d.withColumn("label", F.col("__y").cast("double"))
    return VectorAssembler(inputCols=cols, outputCol="features").transform(d).select("features", "label")


def _linear(task: str, **kw):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import LinearRegression

    return LogisticRegression(maxIter=50, **kw) if task == "classification" else LinearRegression(maxIter=50, **kw)


def _weights(model, n: int) -> list[float]:
    import numpy as np

    m = model.coefficientMatrix.toArray() if hasattr(model, "coefficientMatrix") else np.atleast_2d(model.coefficients.toArray())
    return np.abs(m).mean(axis=0).tolist()


def _forest(task: str, **kw):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    return (RandomForestClassifier if task == "classification" else RandomForestRegressor)(**kw)


class RFESelector(_Selector):
    defaults = {"n_features_to_select": 50, "step": 1, "task": "classification", "label_col": "y", "columns": None}

    def learn(self, df):
        cols = self.inputs(df)
        left, ranking = list(cols), {}
        df = df.select(*cols, self.label_col).persist()
        while len(left) > self.n_features_to_select:
            w = _weights(_linear(self.task, standardization=True).fit(_vector(df, left, self.label_col, self.task)), len(left))
            out = sorted(left, key=lambda c: w[left.index(c)])[: min(self.step, len(left) - self.n_features_to_select)]
            for c in out:
                ranking[c] = len(left) - self.n_features_to_select + 1
            left = [c for c in left if c not in out]
        df.unpersist()
        return {"selected": left, "scores": {c: float(ranking.get(c, 1)) for c in cols}, "considered": cols}, {}


class SequentialFeatureSelector(_Selector):
    """Greedy additions (or removals) by cross-validated accuracy or negative squared error."""

    defaults = {"n_features_to_select": 5, "direction": "forward", "cv": 3, "task": "classification", "label_col": "y", "columns": None, "random_state": 42}

    def _score(self, df, cols):
        from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
        from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

        e = MulticlassClassificationEvaluator(metricName="accuracy") if self.task == "classification" else RegressionEvaluator(metricName="rmse")
        m = CrossValidator(estimator=_linear(self.task), estimatorParamMaps=ParamGridBuilder().build(), evaluator=e, numFolds=self.cv, seed=self.random_state, parallelism=2).fit(_vector(df, cols, self.label_col, self.task)).avgMetrics[0]
        return m if self.task == "classification" else -m

    def learn(self, df):
        cols = self.inputs(df)
        df = df.select(*cols, self.label_col).persist()
        want, scores = min(self.n_features_to_select, len(cols)), {}
        got = [] if self.direction == "forward" else list(cols)
        while len(got) != want:
            tries = {c: self._score(df, [*got, c] if self.direction == "forward" else [x for x in got if x != c]) for c in cols if (c in got) != (self.direction == "forward")}
            best = max(tries, key=tries.__getitem__)
            scores[best] = tries[best]
            got = [*got, best] if self.direction == "forward" else [x for x in got if x != best]
        df.unpersist()
        return {"selected": [c for c in cols if c in got], "scores": scores, "considered": cols}, {}


class LassoSelector(_Selector):
    defaults = {"alpha": "auto", "threshold": 1e-5, "task": "regression", "cv": 3, "label_col": "y", "columns": None, "random_state": 42}

    def scores(self, df, cols):
        data = _vector(df, cols, self.label_col, self.task).persist()
        lasso = _linear(self.task, elasticNetParam=1.0)
        if self.alpha == "auto":
            from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
            from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

            e = MulticlassClassificationEvaluator(metricName="logLoss") if self.task == "classification" else RegressionEvaluator(metricName="rmse")
            grid = ParamGridBuilder().addGrid(lasso.regParam, [1e-3, 1e-2, 1e-1]).build()
            model = CrossValidator(estimator=lasso, estimatorParamMaps=grid, evaluator=e, numFolds=self.cv, seed=self.random_state, parallelism=2).fit(data).bestModel
        else:
            model = lasso.setRegParam(float(self.alpha)).fit(data)
        data.unpersist()
        return dict(zip(cols, _weights(model, len(cols))))

    def pick(self, scores, order):
        return [c for c in order if scores[c] > self.threshold]


class TreeImportanceSelector(_Selector):
    defaults = {"threshold": "auto", "n_features": None, "task": "classification", "label_col": "y", "columns": None, "n_estimators": 50, "max_depth": 8, "random_state": 42}

    def scores(self, df, cols):
        m = _forest(self.task, numTrees=self.n_estimators, maxDepth=self.max_depth, seed=self.random_state).fit(_vector(df, cols, self.label_col, self.task))
        return dict(zip(cols, m.featureImportances.toArray().tolist()))

    def pick(self, scores, order):
        v = sorted(scores.values())
        mean = sum(v) / max(len(v), 1)
        cut = {"mean": mean, "median": v[len(v) // 2] if v else 0.0, "auto": 0.1 * mean}.get(self.threshold, self.threshold)
        got = [c for c in order if scores[c] >= cut]
        if self.n_features is not None:
            top = sorted(got, key=lambda c: -scores[c])[: self.n_features]
            got = [c for c in got if c in top]
        return got


class BorutaSelector(_Selector):
    """Columns that beat the best shadow more often than chance; shadows are the columns joined to themselves at shifted row numbers."""

    defaults = {"n_estimators": 30, "max_iter": 10, "alpha": 0.05, "task": "classification", "label_col": "y", "columns": None, "max_depth": 5, "random_state": 42}

    def learn(self, df):
        cols = self.inputs(df)
        d = df.select(*[F.coalesce(number(c), F.lit(0.0)).alias(c) for c in cols], F.col(self.label_col).alias("__y")).withColumn("__i", F.monotonically_increasing_id())
        hits, status = {c: 0 for c in cols}, {c: "tentative" for c in cols}
        d = base = stage(numbered(d, ["__i"], "__r"), "boruta")
        for k in range(1, self.max_iter + 1):
            live = [c for c in cols if status[c] != "rejected"]
            if not live or all(status[c] == "confirmed" for c in live):
                break
            mixed = numbered(d.select(*live, F.xxhash64("__r", F.lit(self.random_state + k)).alias("__h")), ["__h"], "__r").select(F.col("__r"), *[F.col(c).alias(f"shadow_{c}") for c in live])
            both = base.select(*live, "__y", "__r").join(mixed, "__r")
            names = [*live, *[f"shadow_{c}" for c in live]]
            m = _forest(self.task, numTrees=self.n_estimators, maxDepth=self.max_depth, seed=self.random_state + k).fit(_vector(both, names, "__y", self.task))
            imp = m.featureImportances.toArray().tolist()
            best = max(imp[len(live) :])
            for c, x in zip(live, imp):
                hits[c] += x > best
            for c in live:
                upper = sum(math.comb(k, j) for j in range(hits[c], k + 1)) / 2**k
                lower = sum(math.comb(k, j) for j in range(hits[c] + 1)) / 2**k
                if upper < self.alpha / 2 / len(cols):
                    status[c] = "confirmed"
                elif lower < self.alpha / 2 / len(cols):
                    status[c] = "rejected"
        return {"selected": [c for c in cols if status[c] != "rejected"], "scores": {c: float(h) for c, h in hits.items()}, "status": status, "considered": cols}, {}
