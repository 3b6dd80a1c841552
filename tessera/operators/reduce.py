"""Dimensionality reduction and clustering features on MLlib and small aggregates."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import ConfigurationError, MissingBackendError
from tessera.operators.base import Operator, add, chosen, number, numeric_columns, scalars
from tessera.operators.graph import _roots, connected_components
from tessera.operators.neighbors import CANDIDATE_ROWS, QUERY_ROWS, in_cells, in_pairs, within
from tessera.operators.order import numbered
from tessera.sources.staging import stage


def fitted_scale(df: DataFrame, cols: list[str], scale: bool) -> dict[str, list[float]]:
    v = scalars(df, {**{(c, 0): F.avg(number(c)) for c in cols}, **{(c, 1): F.stddev_pop(number(c)) for c in cols}})
    return {c: [v[c, 0] or 0.0, (v[c, 1] or 1.0) if scale else 1.0] for c in cols}


def scaled(cols: list[str], scale: dict, centre: bool = True) -> list[Column]:
    """Columns less their means (means for nulls), over their widths."""
    return [(F.coalesce(number(c), F.lit(scale[c][0])) - (scale[c][0] if centre else 0.0)) / scale[c][1] for c in cols]


def project(df: DataFrame, xs: list[Column], components: list[list[float]], prefix: str) -> DataFrame:
    """Products with fixed components, by array functions: no Python, and a plan whose size is that of the matrix."""
    df = df.withColumn("__x", F.array(*xs))
    dot = lambda w: F.aggregate(F.zip_with(F.col("__x"), F.array(*[F.lit(float(y)) for y in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return add(df, {f"{prefix}_{i}": dot(w) for i, w in enumerate(components)}).drop("__x")


#: Over this many columns, products are added up as matrices: an aggregate of so many sums isn't compiled.
WIDE = 16


def _wide_moments(df: DataFrame, xs: list[Column]):
    import numpy as np
    import pandas as pd

    n = len(xs)

    def run(parts):
        total, rows = np.zeros((n, n)), 0
        for pdf in parts:
            x = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, n))
            total, rows = total + x.T @ x, rows + len(x)
        yield pd.DataFrame({"i": np.append(np.repeat(np.arange(n), n), -1), "j": np.append(np.tile(np.arange(n), n), -1), "v": np.append(total.ravel(), rows)})

    m, rows = np.zeros((n, n)), 0
    for r in df.select(F.array(*xs).alias("x")).mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # the size of the matrix
        if r.i < 0:
            rows = int(r.v)
        else:
            m[r.i, r.j] = r.v
    return rows, (m + m.T) / 2


def second_moments(df: DataFrame, xs: list[Column]):
    """Rows and the matrix of mean products, from one aggregate (RowMatrix would shuffle vectors through Python)."""
    import numpy as np

    n = len(xs)
    if n > WIDE:
        return _wide_moments(df, xs)
    d = df.select(*[x.alias(f"x{i}") for i, x in enumerate(xs)])
    v = scalars(d, {"n": F.count(F.lit(1)), **{(i, j): F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(n) for j in range(i, n)}})
    m = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            m[i, j] = m[j, i] = v[i, j] or 0.0
    return v["n"], m


def affinities(d2, perplexity: float):
    """Rows of weights exp(-d2 / scale) that sum to 1, each with a scale that gives it this perplexity (by bisection)."""
    import numpy as np

    d2 = d2 - d2.min(axis=1, keepdims=True)
    lo, hi, beta = np.zeros(len(d2)), np.full(len(d2), np.inf), np.ones(len(d2))
    goal = np.log(perplexity)
    for _ in range(60):
        p = np.exp(-d2 * beta[:, None])
        total = p.sum(axis=1)
        entropy = np.log(total) + beta * (d2 * p).sum(axis=1) / total
        wide = entropy > goal
        lo, hi = np.where(wide, beta, lo), np.where(wide, hi, beta)
        beta = np.where(np.isinf(hi), beta * 2, (lo + hi) / 2)
    p = np.exp(-d2 * beta[:, None])
    return p / p.sum(axis=1, keepdims=True)


def embed_neighbours(x, n_components: int, perplexity: float, rounds: int = 500):
    """A t-distributed neighbour embedding of few rows: gradient descent on the divergence of all pairs' similarities, from the first principal components."""
    import numpy as np

    n = len(x)
    squares = lambda a: np.maximum(0.0, (a**2).sum(1)[:, None] + (a**2).sum(1)[None] - 2 * a @ a.T)
    d2 = squares(x)
    np.fill_diagonal(d2, np.inf)
    with np.errstate(invalid="ignore"):
        p = affinities(np.where(np.isinf(d2), d2[np.isfinite(d2)].max(initial=0.0) * 1e3 + 1e3, d2), perplexity)
    np.fill_diagonal(p, 0.0)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    y = np.zeros((n, n_components))
    k = min(n_components, len(s))
    y[:, :k] = u[:, :k] * s[:k]
    y *= 1e-4 / (y[:, 0].std() or 1.0)
    step, gain = np.zeros_like(y), np.ones_like(y)
    rate = max(50.0, n / 12)
    for r in range(rounds):
        q = 1.0 / (1.0 + squares(y))
        np.fill_diagonal(q, 0.0)
        w = (p * (12.0 if r < 125 else 1.0) - np.maximum(q / q.sum(), 1e-12)) * q
        grad = 4 * (w.sum(1)[:, None] * y - w @ y)
        gain = np.maximum(0.01, np.where(np.sign(grad) != np.sign(step), gain + 0.2, gain * 0.8))
        step = (0.5 if r < 125 else 0.8) * step - rate * gain * grad
        y = y + step
        y -= y.mean(0)
    return y


class DimensionalityReducer(Operator):
    """pca, svd (no centring) or lda (supervised) as projections; tsne; umap and autoencoder need a backend of their own.

    tsne embeds at most sample_rows rows (those of least hash), the documented bound of this method, whose cost is that of
    all pairs. The embedding is kept: rows are placed at the mean of the sampled rows near them, weighted as the method
    weights neighbours, at fit and later alike.
    """

    defaults = {"columns": None, "method": "pca", "n_components": None, "variance": None, "whiten": False, "keep_original": True, "scale_features": True, "label_col": None, "feature_prefix": "reduced", "backend": None, "perplexity": 30.0, "sample_rows": 2000, "random_state": 42}

    def check(self):
        if self.method not in ("pca", "svd", "lda", "tsne", "umap", "autoencoder"):
            raise ConfigurationError("unknown method", method=self.method)
        if self.method == "tsne" and (self.n_components or 2) > 3:
            raise ConfigurationError("tsne has three components at most", n_components=self.n_components)
        if self.method in ("umap", "autoencoder") and self.backend is None:
            raise MissingBackendError(f"{self.method} is not distributed; pass backend(df, columns, n_components)", method=self.method)

    def learn(self, df):
        import numpy as np

        cols = chosen(df, self.columns, numeric_columns(df, [self.label_col] if self.label_col else None))
        scale = fitted_scale(df, cols, self.scale_features)
        state = {"columns": cols, "scale": scale}
        if self.backend is not None:
            return state, {}
        want = self.n_components or min(10, max(1, len(cols) // 2))
        if self.method == "lda":
            return self._lda(df, state, want), {}
        if self.method == "tsne":
            rows = df.select(F.array(*scaled(cols, scale)).alias("x")).distinct().orderBy(F.xxhash64("x", F.lit(self.random_state)), "x").limit(self.sample_rows)
            x = np.array([r.x for r in rows.collect()], float).reshape(-1, len(cols))
            perplexity = max(1.0, min(self.perplexity, (len(x) - 1) / 3))
            y = embed_neighbours(x, self.n_components or 2, perplexity) if len(x) > 3 else np.zeros((len(x), self.n_components or 2))
            return {**state, "perplexity": perplexity, "n": y.shape[1]}, {"sample": df.sparkSession.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>")}
        n, m = second_moments(df, scaled(cols, scale, centre=self.method == "pca"))
        values, vectors = np.linalg.eigh(m / max(n - (self.method == "pca"), 1))
        order = np.argsort(-values)
        values, vectors = np.maximum(values[order], 0), vectors[:, order]
        share = values / max(values.sum(), 1e-300)
        if self.variance and not self.n_components:
            want = int(np.searchsorted(np.cumsum(share), self.variance - 1e-12) + 1)
        comp = vectors[:, : min(want, len(cols))].T
        comp *= np.sign(comp[np.arange(len(comp)), np.abs(comp).argmax(axis=1)])[:, None]
        if self.whiten:
            comp = comp / np.sqrt(np.maximum(values[: len(comp)], 1e-12))[:, None]
        return {**state, "components": comp.tolist(), "explained": share[: len(comp)].tolist()}, {}

    def _placed(self, df, state, sample):
        import numpy as np
        import pandas as pd

        rows = sample.collect()  # at most sample_rows
        x, y = np.array([r.x for r in rows], float), np.array([r.y for r in rows], float).reshape(len(rows), -1)
        perplexity = state["perplexity"]

        def place(points):
            out = []
            z = np.stack(points.to_numpy()) if len(points) else np.zeros((0, x.shape[1]))
            for lo in range(0, len(z), 256):
                d2 = np.maximum(0.0, (z[lo : lo + 256] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * z[lo : lo + 256] @ x.T)
                same = d2 <= 1e-9
                w = np.where(same.any(1, keepdims=True), same, affinities(d2, perplexity))
                out += list((w / w.sum(1, keepdims=True)) @ y)
            return pd.Series(out)

        place.__annotations__ = {"points": pd.Series, "return": pd.Series}  # real types: text annotations aren't resolved here
        placed = F.pandas_udf(place, "array<double>")(F.array(*scaled(state["columns"], state["scale"]))) if rows else F.array(*[F.lit(0.0)] * state["n"])
        d = df.withColumn("__y", placed)
        return add(d, {f"{self.feature_prefix}_{i}": F.col("__y")[i] for i in range(state["n"])}).drop("__y")

    def _lda(self, df, state, want):
        import numpy as np

        cols = state["columns"]
        xs = scaled(cols, state["scale"])
        d = df.select(F.col(self.label_col).cast("string").alias("y"), *[x.alias(f"x{i}") for i, x in enumerate(xs)]).filter("y IS NOT NULL")
        k = range(len(cols))
        rows = d.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in k]).collect()  # one row per class
        n, total = second_moments(d, [F.col(f"x{i}") for i in k])
        counts, means = np.array([r.n for r in rows], float), np.array([[r[f"m{i}"] for i in k] for r in rows])
        mean = (counts[:, None] * means).sum(0) / n
        within = total - (means * counts[:, None]).T @ means
        between = ((means - mean) * counts[:, None]).T @ (means - mean)
        values, vectors = np.linalg.eig(np.linalg.pinv(within + 1e-9 * np.eye(len(cols)) * n) @ between)
        order = np.argsort(-values.real)[: min(want, len(rows) - 1, len(cols))]
        comp = vectors.real[:, order].T
        comp *= np.sign(comp[np.arange(len(comp)), np.abs(comp).argmax(axis=1)])[:, None]
        top = values.real[order]
        return {**state, "components": comp.tolist(), "explained": (top / max(values.real.sum(), 1e-300)).tolist()}

    def apply(self, df, state, tables):
        cols = state["columns"]
        if self.backend is not None:
            out = self.backend(df, cols, self.n_components)
        elif self.method == "tsne":
            out = self._placed(df, state, tables["sample"])
        else:
            out = project(df, scaled(cols, state["scale"], centre=self.method != "svd"), state["components"], self.feature_prefix)
        return out if self.keep_original else out.drop(*cols)


class AdaptiveSVD(Operator):
    """Truncated SVD of the raw columns; passes the table through where there is no room for a component."""

    defaults = {"n_components": 100, "columns": None, "random_state": 42}

    def learn(self, df):
        cols = chosen(df, self.columns, numeric_columns(df))
        n = min(self.n_components, len(cols) - 1, df.limit(self.n_components + 2).count() - 1)
        if n < 1:
            return {"passthrough": True}, {}
        return DimensionalityReducer(columns=cols, method="svd", n_components=n, scale_features=False).learn(df)

    def apply(self, df, state, tables):
        return df if state.get("passthrough") else project(df, scaled(state["columns"], state["scale"], centre=False), state["components"], "svd")


class MultiMethodDimensionalityReducer(Operator):
    defaults = {"columns": None, "methods": ("pca", "svd"), "n_components": None, "label_col": None, "scale_features": True, "keep_original": True}

    def learn(self, df):
        cols = chosen(df, self.columns, numeric_columns(df, [self.label_col] if self.label_col else None))
        out, tables, skipped = {}, {}, {}
        for m in self.methods:
            try:
                out[m], t = DimensionalityReducer(columns=cols, method=m, n_components=self.n_components, label_col=self.label_col, scale_features=self.scale_features).learn(df)
                tables |= {f"{m}_{k}": v for k, v in t.items()}
            except MissingBackendError as e:
                skipped[m] = str(e)
        return {"columns": cols, "methods": out, "skipped": skipped}, tables

    def apply(self, df, state, tables):
        for m, s in state["methods"].items():
            if m == "tsne":
                df = DimensionalityReducer(method=m, n_components=s["n"], feature_prefix=m)._placed(df, s, tables["tsne_sample"])
                continue
            df = project(df, scaled(s["columns"], s["scale"], centre=m != "svd"), s["components"], m)
        return df if self.keep_original else df.drop(*state["columns"])


class AdaptiveDimensionalityReducer(Operator):
    defaults = {"columns": None, "prefer_method": "auto", "target_variance": 0.95, "max_components": None, "min_components": 2, "label_col": None, "scale_features": True, "keep_original": True}

    @staticmethod
    def choose(n_features: int, n_classes: int | None) -> str:
        return "lda" if n_classes is not None and 1 < n_classes <= 20 and n_classes < n_features else "pca"

    def learn(self, df):
        cols = chosen(df, self.columns, numeric_columns(df, [self.label_col] if self.label_col else None))
        classes = df.select(self.label_col).distinct().limit(21).count() if self.label_col else None
        method = self.choose(len(cols), classes) if self.prefer_method == "auto" else self.prefer_method
        r = DimensionalityReducer(columns=cols, method=method, variance=self.target_variance, label_col=self.label_col, scale_features=self.scale_features)
        state = r.learn(df)[0]
        if method == "pca":
            keep = max(self.min_components, min(len(state["components"]), self.max_components or len(cols)))
            if keep != len(state["components"]):
                state = DimensionalityReducer(columns=cols, method=method, n_components=min(keep, len(cols)), scale_features=self.scale_features).learn(df)[0]
        return {**state, "method": method}, {}

    def apply(self, df, state, tables):
        out = project(df, scaled(state["columns"], state["scale"], centre=state["method"] != "svd"), state["components"], "reduced")
        return out if self.keep_original else out.drop(*state["columns"])


def build_reducer(kind: str | None = None, n_components: int | None = None, variance: float | None = None, random_state: int = 42) -> Operator | None:
    return None if kind in (None, "none") else DimensionalityReducer(method=kind, n_components=n_components, variance=variance, random_state=random_state)


def build_dimensionality_reducer(method: str = "auto", **kw) -> Operator:
    return AdaptiveDimensionalityReducer(**kw) if method == "auto" else MultiMethodDimensionalityReducer(**kw) if method == "multi" else DimensionalityReducer(method=method, **kw)


# --- clustering -------------------------------------------------------------


def _points(rows):
    import numpy as np

    return np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, 1))


def _joined(part, held):
    """part (the least place of each place's set) after the sets of these pairs were joined."""
    import numpy as np

    if not held:
        return part
    u, v = (np.concatenate(x) for x in zip(*held))
    return _roots(u, v, len(part))[part]


class ClusteringFeatureExtractor(Operator):
    """Cluster numbers, distances, probabilities and outlier flags. State is fitted once: centres, mixtures or core points.

    `hierarchical` with a distance_threshold is agglomerative, of single linkage; without one it is divisive (bisecting
    k-means) and named so in `info`. Both agglomeration and `dbscan` seek neighbours in cells of bounded size and keep a
    spanning forest of the links, of which components are made.
    """

    defaults = {"columns": None, "method": "kmeans", "n_clusters": 5, "extract_cluster_id": True, "extract_distance": True, "extract_probabilities": False, "extract_outlier_flag": False, "scale_features": True, "eps": 0.5, "min_samples": 5, "distance_threshold": None, "random_state": 42, "feature_prefix": "cluster"}

    def check(self):
        if self.method not in ("kmeans", "gmm", "dbscan", "hierarchical"):
            raise ConfigurationError("unknown method", method=self.method)

    def learn(self, df):
        cols = chosen(df, self.columns, numeric_columns(df))
        scale = fitted_scale(df, cols, self.scale_features)
        state = {"columns": cols, "scale": scale}
        data = df.select(array_to_vector(F.array(*scaled(cols, scale))).alias("features"))
        if self.method == "dbscan":
            return self._dbscan(df, state)
        if self.method == "hierarchical" and self.distance_threshold is not None:
            return self._linkage(df, state)
        from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans

        if self.method == "gmm":
            m = GaussianMixture(k=self.n_clusters, seed=self.random_state).fit(data)
            return {**state, "weights": list(m.weights), "means": [g.mean.toArray().tolist() for g in m.gaussians], "covs": [g.cov.toArray().tolist() for g in m.gaussians]}, {}
        cls = KMeans if self.method == "kmeans" else BisectingKMeans
        return {**state, "centres": [x.tolist() for x in cls(k=self.n_clusters, seed=self.random_state).fit(data).clusterCenters()], "info": "k-means" if cls is KMeans else "divisive bisecting k-means"}, {}

    def _dbscan(self, df, state):
        """Equal points are one weighted point. Core points are those with min_samples rows within eps; those within eps of each other share a cluster."""
        d = len(state["columns"])
        xs = scaled(state["columns"], state["scale"])
        pts = df.select(F.array(*xs).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("w"))
        pts = stage(pts.withColumn("id", F.monotonically_increasing_id()), "points")
        n = pts.count()
        near = stage(self._cells(pts, None, n, n, d, self._counted, "id long, n long"), "near").groupBy("id").agg(F.sum("n").alias("n"))
        core = stage(pts.join(near.filter(F.col("n") >= self.min_samples).select("id"), "id"), "core")
        m = core.count()
        edges = self._cells(core, None, m, m, d, self._forest, "id long, other long")
        return state, {"core": self._numbered(core, edges)}

    def _linkage(self, df, state):
        """Agglomerative clusters of single linkage: points joined by steps of at most distance_threshold."""
        d = len(state["columns"])
        pts = stage(df.select(F.array(*scaled(state["columns"], state["scale"])).alias("x")).distinct().withColumn("id", F.monotonically_increasing_id()), "points")
        n = pts.count()
        return state, {"core": self._numbered(pts, self._cells(pts, None, n, n, d, self._forest, "id long, other long"))}

    def _numbered(self, core: DataFrame, edges: DataFrame) -> DataFrame:
        """(cluster, x) of core points (id, x): clusters are numbered by their least id."""
        roots = connected_components(edges, "id", "other")
        core = stage(core.join(roots, core["id"] == roots["node"], "left").select("x", F.coalesce("root", "id").alias("root")), "core")
        return stage(core.join(numbered(core.select("root").distinct(), ["root"], "k"), "root").select((F.col("k") - 1).cast("int").alias("cluster"), "x"), "core")

    def _cells(self, a: DataFrame, b: DataFrame | None, n_a: int, n_b: int, d: int, kernel, schema: str) -> DataFrame:
        """kernel over cells in which each point of a meets every point of b (None: of a) within eps: grid cells of width eps for up to three columns, else blocks of all points.

        Blocks of one table meet once, and kernel(left, right, True) is of both sides.
        """
        if d > 3 and b is None:
            return in_pairs(a, n_a, lambda left, right: kernel(left, left) if right is None else kernel(left, right, True), schema)
        if d > 3:
            return in_cells(a, b, n_a, n_b, lambda left, right: kernel(left, right), schema, query_rows=min(CANDIDATE_ROWS, max(QUERY_ROWS, n_a // 64)))
        b = a if b is None else b
        width = self._reach()
        cell = lambda i: F.floor(F.col("x")[i] / width).cast("long")
        left = a.withColumns({f"__c{i}": cell(i) for i in range(d)})
        right = b.withColumns({f"__c{i}": cell(i) for i in range(d)})
        for i in range(d):
            right = right.withColumn(f"__c{i}", F.explode(F.array(F.col(f"__c{i}") - 1, F.col(f"__c{i}"), F.col(f"__c{i}") + 1)))
        keys = [f"__c{i}" for i in range(d)]
        # a crowded cell is split: blocks of its points each meet all blocks of the others
        split = lambda f: f.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / 4096).cast("int").alias("__n"))
        left, right = stage(left, "grid-left"), stage(right, "grid-right")
        parts_a, parts_b = split(left).withColumnRenamed("__n", "__na"), split(right).withColumnRenamed("__n", "__nb")
        parts = stage(parts_a.join(parts_b, keys), "grid-parts")
        q = left.join(parts, keys).withColumn("__q", F.pmod(F.xxhash64("id"), F.col("__na")).cast("int")).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__nb") - 1)))
        c = right.join(parts.toDF(*parts.columns), keys).withColumn("__k", F.pmod(F.xxhash64("id"), F.col("__nb")).cast("int")).withColumn("__q", F.explode(F.sequence(F.lit(0), F.col("__na") - 1)))
        by = [*keys, "__q", "__k"]
        return q.groupBy(*by).cogroup(c.groupBy(*by)).applyInPandas(lambda left, right: kernel(left, right), schema)

    def _reach(self) -> float:
        return float(self.distance_threshold if self.method == "hierarchical" else self.eps)

    @property
    def _counted(self):
        """Per left point, the weight of right points within reach; of both sides, also the other way."""
        import numpy as np
        import pandas as pd

        reach = self._reach()

        def kernel(left, right, both=False):
            n, m = np.zeros(len(left)), np.zeros(len(right))
            of_left, of_right = left["w"].to_numpy(float), right["w"].to_numpy(float)
            for i, j, _ in within(_points(left), _points(right), reach):
                n += np.bincount(i, of_right[j], len(n))
                if both:
                    m += np.bincount(j, of_left[i], len(m))
            ids, n = (np.append(left["id"], right["id"]), np.append(n, m)) if both else (left["id"].to_numpy(), n)
            return pd.DataFrame({"id": ids[n > 0], "n": n[n > 0].astype("int64")})

        return kernel

    @property
    def _forest(self):
        """Links within reach between points of a cell, as edges to the least point of each linked set: one row per point at most, not one per pair."""
        import numpy as np
        import pandas as pd

        reach = self._reach()

        def kernel(left, right, both=False):
            ids = np.unique(np.concatenate([left["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64)]))
            part = np.arange(len(ids))
            a, b = np.searchsorted(ids, left["id"].to_numpy(np.int64)), np.searchsorted(ids, right["id"].to_numpy(np.int64))
            held, n = [], 0
            for i, j, _ in within(_points(left), _points(right), reach):
                u, v = part[a[i]], part[b[j]]
                new = u != v
                held.append((u[new], v[new]))
                n += len(held[-1][0])
                if n > 500_000:
                    part, held, n = _joined(part, held), [], 0
            part = _joined(part, held)
            at = np.flatnonzero(part != np.arange(len(part)))
            return pd.DataFrame({"id": ids[at], "other": ids[part[at]]})

        return kernel

    @property
    def _closest(self):
        """Per left point, its least distance to a right point within reach and the least cluster there."""
        import numpy as np
        import pandas as pd

        reach = self._reach()

        def kernel(left, right):
            found, cluster, ids = [], right["cluster"].to_numpy(), left["id"].to_numpy()
            for i, j, d in within(_points(left), _points(right), reach, closest=True):
                order = np.lexsort((cluster[j], d, i))
                first = order[np.unique(i[order], return_index=True)[1]]
                found.append(pd.DataFrame({"id": ids[i[first]], "d": d[first], "cluster": cluster[j[first]]}))
            out = pd.concat(found) if found else pd.DataFrame({"id": [], "d": [], "cluster": []})
            return out.astype({"id": "int64", "d": "float64", "cluster": "int32"})

        return kernel

    def apply(self, df, state, tables):
        p, cols = self.feature_prefix, state["columns"]
        xs = scaled(cols, state["scale"])
        made: dict[str, Column] = {}
        if "core" in tables:  # distinct points are matched, so that no row numbers are needed
            at = df.select(F.array(*xs).alias("x")).distinct()
            # a core point is its own nearest one: only the others are sought
            own = tables["core"].filter(F.forall("x", lambda v: F.abs(v) < float("inf"))).select("x", F.col("cluster").alias("own"))
            pts = stage(at.join(own, "x", "left").withColumn("id", F.monotonically_increasing_id()), "points")
            rest = pts.filter("own IS NULL").drop("own")
            core = tables["core"].withColumn("id", F.xxhash64("x"))
            best = self._cells(rest, core, rest.count(), core.count(), len(cols), self._closest, "id long, d double, cluster int").groupBy("id").agg(F.min(F.struct("d", "cluster")).alias("m"))
            best = rest.join(best, "id").select("x", F.col("m.cluster").alias("c"), F.col("m.d").alias("d"))
            best = best.unionByName(pts.filter("own IS NOT NULL").select("x", F.col("own").alias("c"), F.lit(0.0).alias("d"))).toDF("__x", "__c", "__d")
            out = df.withColumn("__x", F.array(*xs)).join(best, "__x", "left")
            return add(out, {f"{p}_id": F.coalesce("__c", F.lit(-1)), f"{p}_is_outlier": F.col("__c").isNull().cast("int"), f"{p}_distance": F.col("__d")}).drop("__x", "__c", "__d")
        df = df.withColumn("__x", F.array(*xs))
        dist = lambda centre: F.sqrt(F.aggregate(F.zip_with(F.col("__x"), F.array(*[F.lit(float(y)) for y in centre]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
        if self.method == "gmm":
            return self._gmm(df, state, p, dist)
        df = df.withColumn("__d", F.array(*[dist(c) for c in state["centres"]]))
        if self.extract_cluster_id:
            made[f"{p}_id"] = (F.array_position("__d", F.array_min("__d")) - 1).cast("int")
        if self.extract_distance:
            made[f"{p}_distance"] = F.array_min("__d")
            if self.method == "kmeans" and len(state["centres"]) <= 10:
                made |= {f"{p}_distance_to_{i}": F.col("__d")[i] for i in range(len(state["centres"]))}
        return add(df, made).drop("__x", "__d")

    def _gmm(self, df, state, p, dist):
        import numpy as np

        k = len(state["weights"])
        logs = []
        for w, m, c in zip(state["weights"], state["means"], state["covs"]):
            c = np.array(c) + 1e-9 * np.eye(len(m))
            root = np.linalg.inv(np.linalg.cholesky(c))
            rows = [F.aggregate(F.zip_with(F.col("__x"), F.array(*[F.lit(float(v)) for v in r]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) - F.lit(float(r @ np.array(m))) for r in root]
            logs.append(F.lit(math.log(max(w, 1e-300)) - 0.5 * (len(m) * math.log(2 * math.pi) + float(np.linalg.slogdet(c)[1]))) - 0.5 * sum((r * r for r in rows), F.lit(0.0)))
        df = df.withColumn("__l", F.array(*logs)).withColumn("__e", F.transform("__l", lambda x: F.exp(x - F.array_max("__l"))))
        df = df.withColumn("__p", F.transform("__e", lambda x: x / F.aggregate("__e", F.lit(0.0), lambda a, b: a + b)))
        made = {f"{p}_id": (F.array_position("__p", F.array_max("__p")) - 1).cast("int"), f"{p}_max_prob": F.array_max("__p")}
        made |= {f"{p}_prob_{i}": F.col("__p")[i] for i in range(k)}
        made[f"{p}_entropy"] = -F.aggregate("__p", F.lit(0.0), lambda a, x: a + x * F.ln(F.greatest(x, F.lit(1e-15))))
        made[f"{p}_distance"] = F.array_min(F.array(*[dist(m) for m in state["means"]]))
        return add(df, made).drop("__x", "__l", "__e", "__p")


class MultiMethodClusteringExtractor(Operator):
    """Several methods on the columns seen at fit, each with its name as prefix."""

    defaults = {"columns": None, "methods": ("kmeans", "gmm"), "n_clusters": 5, "eps": 0.5, "min_samples": 5, "random_state": 42}

    def _one(self, m, cols):
        return ClusteringFeatureExtractor(columns=cols, method=m, n_clusters=self.n_clusters, eps=self.eps, min_samples=self.min_samples, random_state=self.random_state, feature_prefix=m)

    def learn(self, df):
        cols = chosen(df, self.columns, numeric_columns(df))
        state, tables, skipped = {}, {}, {}
        for m in self.methods:
            try:
                state[m], t = self._one(m, cols).learn(df)
                tables |= {f"{m}_{k}": v for k, v in t.items()}
            except ConfigurationError as e:
                skipped[m] = str(e)
        return {"columns": cols, "fitted": state, "skipped": skipped}, tables

    def apply(self, df, state, tables):
        for m, s in state["fitted"].items():
            df = self._one(m, state["columns"]).apply(df, s, {k.split("_", 1)[1]: t for k, t in tables.items() if k.startswith(f"{m}_")})
        return df


class AdaptiveClusteringExtractor(Operator):
    defaults = {"columns": None, "prefer_method": "auto", "max_clusters": 10, "optimize_k": True, "scale_features": True, "random_state": 42}

    @staticmethod
    def choose(n: int, width: int, far_share: float) -> str:
        return "gmm" if n < 1000 else "kmeans" if width > 20 else "dbscan" if far_share > 0.05 and width <= 3 else "kmeans"

    def learn(self, df):
        cols = chosen(df, self.columns, numeric_columns(df))
        scale = fitted_scale(df, cols, self.scale_features)
        n = df.count()
        r = F.sqrt(sum((x * x for x in scaled(cols, scale)), F.lit(0.0)))
        s = scalars(df, {"m": F.avg(r), "s": F.stddev_pop(r)})
        far = scalars(df, {"f": F.avg((r > (s["m"] or 0) + 3 * (s["s"] or 0)).cast("double"))})["f"] or 0.0
        method = self.choose(n, len(cols), far) if self.prefer_method == "auto" else self.prefer_method
        k = 5
        if self.optimize_k and method != "dbscan":
            from pyspark.ml.clustering import KMeans
            from pyspark.ml.evaluation import ClusteringEvaluator

            data = df.select(array_to_vector(F.array(*scaled(cols, scale))).alias("features")).persist()
            fits = {}
            for c in range(2, max(3, min(self.max_clusters, max(n // 10 - 1, 2)) + 1)):
                fits[c] = ClusteringEvaluator().evaluate(KMeans(k=c, seed=self.random_state).fit(data).transform(data))
            data.unpersist()
            k = max(fits, key=fits.__getitem__)
        inner = ClusteringFeatureExtractor(columns=cols, method=method, n_clusters=k, scale_features=self.scale_features, random_state=self.random_state)
        state, tables = inner.learn(df)
        return {"method": method, "k": k, "inner": state}, tables

    def apply(self, df, state, tables):
        inner = ClusteringFeatureExtractor(columns=state["inner"]["columns"], method=state["method"], n_clusters=state["k"], scale_features=self.scale_features, random_state=self.random_state)
        return inner.apply(df, state["inner"], tables)


def build_clustering_pipeline(method: str = "auto", n_clusters: int = 5, extract_all: bool = True, **kw) -> Operator:
    if method == "auto":
        return AdaptiveClusteringExtractor(**kw)
    if method == "multi":
        return MultiMethodClusteringExtractor(n_clusters=n_clusters, **kw)
    return ClusteringFeatureExtractor(method=method, n_clusters=n_clusters, extract_probabilities=extract_all, extract_outlier_flag=extract_all, **kw)


