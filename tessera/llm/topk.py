"""Exact top-k inner products by best-first search in M-trees.

A vector v gets one more component, sqrt(M - |v|^2), with M the largest squared
norm. Then |q - v|^2 = |q|^2 + M - 2 q.v, so that the nearest neighbours of a
query (with 0 in that place) are those of largest inner product, and a metric
tree applies. The top page has at most REGIONS pivots, taken from a bounded
sample; a row belongs to the region of its nearest pivot, and a region has a
covering radius. A region is dealt into trees of about TREE_ROWS rows, by row,
so that no region, however crowded, gathers in one task. A tree is a table of
pages: an inner page holds pivots, covering radii, distances to the page's own
pivot, and child pages; a leaf holds vectors with their distances to its pivot.
The search opens pages in order of the least distance that they allow. By the
triangle inequality, stored distances exclude pivots and vectors without
computing theirs. Bounds carry a slack for rounding; scores are integers.

A query first searches one tree of its nearest region; its k-th score there
bounds what others must reach. Then it meets the trees of the regions that this
bound leaves, and starts in each with what it has. Trees meet queries in cells of
one tree and at most QUERY_BLOCK queries, so no task holds more than that. Each
cell returns its k best, and the k best of these per query are the result.

Components are scaled in double precision. Vectors with a component of HUGE or
more (or more than WIDE components), whose products long integers can't hold, stay out of the trees: they meet
all others in cells that multiply Python integers. Ranks follow the true scores;
a score outside of the range of long is shown as the nearest long.

Nulls and edge cases: rows with a null id, a null vector or any null or
non-finite component take no part; shorter vectors are padded with zeros; a
query's own id is no candidate, even on other rows; repeated query rows count
once; repeated candidate rows are all candidates; equal vectors, whatever their
number, share leaves of radius 0; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._common import staged

TREE_ROWS = 4096
REGIONS = 256
#: Rows from which the regions' pivots are taken, for each pivot.
PIVOT_SAMPLE = 8
#: Scaled components below this have products that a long holds, for up to WIDE components.
HUGE = 2.0**24
WIDE = 1 << 14
#: Stands for the score to beat where there is none.
ANY = -(2**63)
QUERY_BLOCK = 1024
LEAF = 256
FANOUT = 16
PAGE_SCHEMA = "tree int, page int, leaf boolean, children array<int>, radii array<double>, to_parent array<double>, ids array<long>, vectors binary"
EXACT = 2.0**52


def grow(vectors: np.ndarray, extra: np.ndarray, ids: np.ndarray) -> list[dict]:
    """Pages of one M-tree; page 0 is the root, whose entries have no parent pivot. vectors: integers; extra: the added component."""
    points = np.column_stack([vectors.astype(np.float64), extra])
    pages: list[dict] = []
    rng = np.random.default_rng(len(ids))

    def distances(at: np.ndarray, pivot: np.ndarray) -> np.ndarray:
        return np.sqrt(((points[at] - pivot) ** 2).sum(axis=1))

    def split(at: np.ndarray) -> list[np.ndarray]:
        """Nearest of pivots picked far apart from a sample; even parts if that leaves one part."""
        sample = at if len(at) <= 256 else at[rng.choice(len(at), 256, replace=False)]
        chosen = [sample[0]]
        nearest = distances(sample, points[chosen[0]])
        while len(chosen) < FANOUT and nearest.max() > 0:
            chosen.append(sample[int(nearest.argmax())])
            nearest = np.minimum(nearest, distances(sample, points[chosen[-1]]))
        d = np.stack([distances(at, points[c]) for c in chosen])
        part = d.argmin(axis=0)
        parts = [at[part == k] for k in range(len(chosen)) if (part == k).any()]
        return parts if len(parts) > 1 and max(map(len, parts)) < 0.95 * len(at) else np.array_split(at, min(FANOUT, len(at) // LEAF + 1))

    def build(at: np.ndarray, parent: np.ndarray | None) -> int:
        number = len(pages)
        pages.append({})
        if len(at) <= LEAF:
            to_parent = distances(at, parent) if parent is not None else np.zeros(len(at))
            pages[number] = {"page": number, "leaf": True, "children": [], "radii": [], "to_parent": to_parent.tolist(), "ids": ids[at].tolist(), "vectors": np.column_stack([vectors[at].astype(np.float64), extra[at]]).tobytes()}
            return number
        pivots, radii, children, to_parent = [], [], [], []
        for part in split(at):
            pivot = points[part].mean(axis=0)
            pivots.append(pivot)
            radii.append(float(distances(part, pivot).max()))
            to_parent.append(float(np.sqrt(((pivot - parent) ** 2).sum())) if parent is not None else 0.0)
            children.append(build(part, pivot))
        pages[number] = {"page": number, "leaf": False, "children": children, "radii": radii, "to_parent": to_parent, "ids": [], "vectors": np.array(pivots).tobytes()}
        return number

    if len(ids):
        build(np.arange(len(ids)), None)
    return pages


class Tree:
    def __init__(self, pages: pd.DataFrame, width: int):
        self.pages = {}
        for p in pages.itertuples(index=False):
            m = np.frombuffer(p.vectors, np.float64).reshape(-1, width)
            self.pages[p.page] = (p.leaf, m, np.asarray(p.to_parent, np.float64), np.asarray(p.radii, np.float64), np.asarray(p.children, np.int64), np.asarray(p.ids, np.int64))
        self.computed = 0

    def search(self, query: np.ndarray, own: int, k: int, top_norm: float, least_score: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) of the tree: larger scores first, then smaller ids. Scores below least_score may be left out."""
        q = np.append(query.astype(np.float64), 0.0)
        offset = float((q**2).sum()) + top_norm
        slack = 1e-6 * (1 + np.sqrt(offset))
        exact = query.astype(np.int64)
        fits = float(np.abs(q).max(initial=0)) * np.sqrt(top_norm) * len(q) < EXACT
        best: list[tuple[int, int]] = []  # a heap, the worst first: (score, -id)
        start = np.inf if least_score is None else np.sqrt(max(0.0, offset - 2.0 * least_score)) + slack
        reach = start  # the distance of the k-th best so far, with slack
        queue = [(0.0, 0, np.nan)]
        while queue:
            least, number, to_pivot = heapq.heappop(queue)
            if least > reach:
                break
            leaf, m, to_parent, radii, children, ids = self.pages[number]
            keep = np.ones(len(m), bool) if np.isnan(to_pivot) else np.abs(to_pivot - to_parent) - (0 if leaf else radii) <= reach
            if leaf:
                keep &= ids != own
            if not keep.any():
                continue
            self.computed += int(keep.sum())
            if leaf:
                part = m[keep, :-1]
                scores = (part @ q[:-1]).astype(np.int64) if fits else part.astype(np.int64) @ exact
                own_ids = ids[keep]
                if least_score is not None:
                    enough = scores >= least_score
                    scores, own_ids = scores[enough], own_ids[enough]
                if len(best) == k:  # equal scores stay: the smaller id wins
                    better = scores >= best[0][0]
                    scores, own_ids = scores[better], own_ids[better]
                for s, i in zip(scores.tolist(), own_ids.tolist()):
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
                if len(best) == k:
                    reach = min(start, np.sqrt(max(0.0, offset - 2.0 * best[0][0])) + slack)
            else:
                d = np.sqrt(((m[keep] - q) ** 2).sum(axis=1))
                near = np.maximum(0.0, d - radii[keep] - slack)
                for a, b, c in zip(near.tolist(), children[keep].tolist(), d.tolist()):
                    if a <= reach:
                        heapq.heappush(queue, (a, b, c))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def scaled_vectors(df: DataFrame, id_col: str, vector: str, scale: int = 1024) -> DataFrame:
    """id, x (components as doubles) and huge, for rows that take part."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = F.forall(F.col("x"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    d = df.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull() & finite)
    return d.withColumn("huge", F.exists("x", lambda c: F.abs(c) >= F.lit(HUGE / scale)) | (F.size("x") > WIDE))


def _whole(vectors: DataFrame, scale: int) -> DataFrame:
    """id and v, floor(scale * x) of each component, as longs."""
    return vectors.select("id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    m = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        m[i, : len(v)] = v
    return m


def _lifted(m: np.ndarray, top_norm: float) -> np.ndarray:
    """The vectors with their added component."""
    m = m.astype(np.float64)
    return np.column_stack([m, np.sqrt(np.maximum(0.0, top_norm - (m**2).sum(axis=1)))])


def pick_pivots(vectors: DataFrame, n: int, width: int, top_norm: float, regions: int) -> np.ndarray:
    """At most `regions` points, far apart, of a sample of PIVOT_SAMPLE times as many rows."""
    want = min(regions, max(1, -(-n // TREE_ROWS)))
    share = min(1.0, 2.0 * want * PIVOT_SAMPLE / max(n, 1))
    rows = vectors.filter(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < share * (1 << 30)).select("v").limit(want * PIVOT_SAMPLE).collect()  # bounded by REGIONS
    points = _lifted(_matrix(pd.Series([r.v for r in rows]), width), top_norm) if rows else np.zeros((0, width + 1))
    if not len(points):
        return points
    chosen = [0]
    nearest = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < want and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def in_regions(vectors: DataFrame, pivots: np.ndarray, width: int, top_norm: float) -> DataFrame:
    """(id, v, region, d): the nearest pivot of each row and the distance to it."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most REGIONS points

    def run(parts):
        for pdf in parts:
            x = _lifted(_matrix(pdf["v"], width), top_norm)
            region, d = np.zeros(len(x), np.int64), np.zeros(len(x))
            for lo in range(0, len(x), 256):
                all_d = np.sqrt(((x[lo : lo + 256, None, :] - shared.value[None, :, :]) ** 2).sum(axis=2))
                region[lo : lo + 256], d[lo : lo + 256] = all_d.argmin(axis=1), all_d.min(axis=1)
            yield pdf.assign(region=region.astype("int32"), d=d)

    return vectors.mapInPandas(run, "id long, v array<long>, region int, d double")


def build_pages(dealt: DataFrame, width: int, top_norm: float) -> DataFrame:
    """The pages of all trees of (tree, id, v)."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(pdf["v"], width)
        out = pd.DataFrame(grow(m, _lifted(m, top_norm)[:, -1], pdf["id"].to_numpy(np.int64)))
        out.insert(0, "tree", key[0])
        return out

    return dealt.groupBy("tree").applyInPandas(run, PAGE_SCHEMA)


def _search(pages: DataFrame, asked: DataFrame, width: int, k: int, top_norm: float, query_block: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each tree for the queries (id, v, tree, reach) that are to search it. reach: the score to beat, or ANY."""
    sizes = asked.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / query_block).cast("int")).drop("n")
    cells_q = asked.join(sizes, "tree").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int")).drop("blocks")
    cells_p = pages.join(sizes, "tree").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def run(pages_: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(pages_) and len(asked_):
            tree = Tree(pages_, width + 1)
            for query_id, q, reach in zip(asked_["id"].tolist(), _matrix(asked_["v"], width), asked_["reach"].tolist()):
                rows += [(query_id, i, s) for s, i in tree.search(q, query_id, k, top_norm, None if reach == ANY else reach)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    return cells_p.groupBy("tree", "block").cogroup(cells_q.groupBy("tree", "block")).applyInPandas(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _in_trees(vectors: DataFrame, asked: DataFrame, k: int, tree_rows: int, query_block: int, regions: int) -> DataFrame:
    """(query_id, vec_id, score) of the k best, for vectors and queries (id, v) without huge components."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    n, width, top_norm = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
    width = max(width or 0, asked.agg(F.max(F.size("v"))).first()[0] or 0)
    top_norm = float(top_norm or 0.0)
    pivots = pick_pivots(vectors, n, width, top_norm, regions)
    placed = in_regions(vectors, pivots, width, top_norm)
    placed = staged(placed.withColumn("row", F.monotonically_increasing_id()), "regions")
    parts = sorted(placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius")).collect())  # at most REGIONS rows
    trees, first, count = 0, {}, {}
    for r in parts:
        first[r.region], count[r.region] = trees, -(-r.n // tree_rows)
        trees += count[r.region]
    at = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("region"))
    if not parts:
        return vectors.limit(0).select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    dealt = placed.select("id", "v", (at(first) + F.pmod(F.xxhash64("row"), at(count))).cast("int").alias("tree"))
    pages = staged(build_pages(dealt, width, top_norm), "mtree-pages")
    table = [(pivots[r.region], r.radius, first[r.region], count[r.region]) for r in parts]
    shared = vectors.sparkSession.sparkContext.broadcast(table)

    def plan(df: DataFrame, nearest_only: bool) -> DataFrame:
        """Queries with the trees they are to search: one of the nearest region, or all but that of regions within reach."""

        def run(batches):
            centres = np.stack([t[0] for t in shared.value])
            radius, start, size = (np.array([t[j] for t in shared.value]) for j in (1, 2, 3))
            for pdf in batches:
                out = []
                for i, (query_id, q) in enumerate(zip(pdf["id"].tolist(), _matrix(pdf["v"], width))):
                    q1 = np.append(q.astype(np.float64), 0.0)
                    offset = float((q1**2).sum()) + top_norm
                    slack = 1e-6 * (1 + np.sqrt(offset))
                    least = np.maximum(0.0, np.sqrt(((centres - q1) ** 2).sum(axis=1)) - radius - slack)
                    near = int(least.argmin())
                    own = int(start[near] + query_id % size[near])
                    if nearest_only:
                        out.append((query_id, pdf["v"].iloc[i], own, ANY))
                        continue
                    reach = int(pdf["reach"].iloc[i])
                    limit = np.inf if reach == ANY else np.sqrt(max(0.0, offset - 2.0 * reach)) + slack
                    for r in np.flatnonzero(least <= limit):
                        out += [(query_id, pdf["v"].iloc[i], t, reach) for t in range(int(start[r]), int(start[r] + size[r])) if t != own]
                yield pd.DataFrame(out, columns=["id", "v", "tree", "reach"]).astype({"id": "int64", "tree": "int32", "reach": "int64"})

        return df.mapInPandas(run, "id long, v array<long>, tree int, reach long")

    opening = staged(_best(_search(pages, plan(asked, True), width, k, top_norm, query_block), k), "mtree-first")
    reached = opening.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("reach"))
    rest = plan(asked.join(reached, "id", "left").withColumn("reach", F.coalesce("reach", F.lit(ANY))), False)
    return opening.select("query_id", "vec_id", "score").unionByName(_search(pages, rest, width, k, top_norm, query_block))


def _whole_numbers(xs: list[float], scale: int) -> list[int]:
    return [math.floor(Fraction(x) * scale) for x in xs]


def _exactly(vectors: DataFrame, asked: DataFrame, k: int, scale: int, query_block: int, tree_rows: int) -> DataFrame:
    """(query_id, vec_id, score) with scores as decimal text: the k best of each cell, by Python integers. For pairs with a huge vector."""
    n_q, n_c = max(1, -(-asked.count() // query_block)), max(1, -(-vectors.count() // tree_rows))
    q = asked.withColumn("b", F.pmod(F.xxhash64("id", "x"), F.lit(n_q)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    c = vectors.withColumn("c", F.pmod(F.xxhash64("id", "x"), F.lit(n_c)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        others = [(i, _whole_numbers(x, scale), h) for i, x, h in zip(right["id"].tolist(), right["x"], right["huge"])]
        for query_id, x, h in zip(left["id"].tolist(), left["x"], left["huge"]):
            own = _whole_numbers(x, scale)
            scores = ((sum(a * b for a, b in zip(own, y)), -i) for i, y, g in others if i != query_id and (h or g))
            rows += [(query_id, -i, str(s)) for s, i in heapq.nlargest(k, scores)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "string"})

    return q.groupBy("b", "c").cogroup(c.groupBy("b", "c")).applyInPandas(run, "query_id long, vec_id long, score string")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best by true score; a score beyond long is shown as the nearest long."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        best = heapq.nlargest(k, ((int(s), -i) for s, i in zip(pdf["score"], pdf["vec_id"].tolist())))
        rows = [(int(pdf["query_id"].iloc[0]), n, -i, max(-(2**63), min(2**63 - 1, s))) for n, (s, i) in enumerate(best, 1)]
        return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])

    return found.groupBy("query_id").applyInPandas(run, "query_id long, rank int, vec_id long, score long")


def top_k(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024, tree_rows: int = TREE_ROWS, query_block: int = QUERY_BLOCK, regions: int = REGIONS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best candidates of each query."""
    vectors = scaled_vectors(df, id_col, vector, scale)
    asked = staged(scaled_vectors(queries, id_col, vector, scale).distinct(), "mtree-queries")
    huge = vectors.filter("huge").select("id").limit(1).count() + asked.filter("huge").limit(1).count()
    plain = staged(_whole(asked.filter("NOT huge"), scale), "mtree-asked")
    found = _in_trees(_whole(vectors.filter("NOT huge"), scale), plain, k, tree_rows, query_block, regions)
    if not huge:
        return _best(found, k).select("query_id", "rank", "vec_id", "score")
    exact = _exactly(vectors.filter("huge"), asked.filter("NOT huge"), k, scale, query_block, tree_rows).unionByName(_exactly(vectors, asked.filter("huge"), k, scale, query_block, tree_rows))
    return _merged(_best(found, k).select("query_id", "vec_id", F.col("score").cast("string").alias("score")).unionByName(exact), k)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best inner products for every vector whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
