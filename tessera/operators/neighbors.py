"""Nearest rows: a stated set of rows against all rows of a table, in cells of bounded size.

Queries and candidates are dealt into blocks by hash. A cell holds one block of
each, so a task holds no more than that whatever the tables' sizes; what cells
return per query is merged afterwards. Where a box of rows can tell that none of
them is near enough, rows are dealt by place (`Cells`), and a query goes only to
the cells it has to. Pairs of one table with itself are taken
once: a cell holds two of its blocks, in one order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY_ROWS = 1024
CANDIDATE_ROWS = 16_384
#: Rows of a block of a table that meets itself, and so many blocks if there are rows enough, so that all cores have pairs.
PAIR_ROWS, PAIR_BLOCKS = 32_768, 14


def in_cells(queries: DataFrame, candidates: DataFrame, n_queries: int, n_candidates: int, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """kernel(query rows, candidate rows) for every cell. Columns of both are dealt by hash of all their values."""
    nq, nc = max(1, -(-n_queries // query_rows)), max(1, -(-n_candidates // candidate_rows))
    block = lambda d, n: F.pmod(F.xxhash64(*[F.col(c) for c in d.columns], F.lit(9)), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("__q", block(queries, nq)).withColumn("__c", all_of(nc))
    c = candidates.withColumn("__c", block(candidates, nc)).withColumn("__q", all_of(nq))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return kernel(left.drop(columns=["__q", "__c"]), right.drop(columns=["__q", "__c"]))

    return q.groupBy("__q", "__c").cogroup(c.groupBy("__q", "__c")).applyInPandas(run, schema)


def in_pairs(points: DataFrame, n: int, kernel: Callable[[pd.DataFrame, pd.DataFrame | None], pd.DataFrame], schema: str) -> DataFrame:
    """kernel(rows, other rows) for every two blocks of a table with ids, once, and kernel(rows, None) for a block with itself.

    A row is sent once for each block: the rows that move are n x blocks, the memory that of two blocks.
    """
    blocks = max(1, -(-n // PAIR_ROWS), min(PAIR_BLOCKS, -(-n // QUERY_ROWS)))
    p = points.withColumn("__b", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(blocks)).cast("int")).withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    p = p.withColumn("__cell", F.least("__b", "__o") * blocks + F.greatest("__b", "__o"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first, last = divmod(int(rows["__cell"].iloc[0]), blocks)
        of = lambda b: rows[rows["__b"] == b].drop(columns=["__b", "__o", "__cell"]).reset_index(drop=True)
        return kernel(of(first), None if first == last else of(last))

    return p.groupBy("__cell").applyInPandas(run, schema)


def _distances(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    d = np.zeros(len(i))
    for k in range(x.shape[1]):
        d += (x[i, k] - y[j, k]) ** 2
    return np.sqrt(d)


def within(x: np.ndarray, y: np.ndarray, reach: float, closest: bool = False):
    """Pairs (rows of x, rows of y, distances or None) within reach, part by part; with `closest` at least each row's nearest ones of a part, with distances.

    Products of matrices tell most pairs apart; those nearer to the reach than the products' error are measured as they are.
    """
    fine_x, fine_y = np.flatnonzero(np.isfinite(x).all(1)), np.flatnonzero(np.isfinite(y).all(1))  # no others are within reach of anything
    x, y = x[fine_x], y[fine_y]
    x2, y2 = (x * x).sum(1), (y * y).sum(1)
    single = {}
    for ro in range(0, len(y), 8192):
        b, b2 = y[ro : ro + 8192], y2[ro : ro + 8192]
        for lo in range(0, len(x), 256):
            a, a2 = x[lo : lo + 256], x2[lo : lo + 256]
            top = a2.max() + b2.max()
            if not top < 1e300:
                i, j = np.divmod(np.arange(len(a) * len(b)), len(b))
                d = _distances(a, b, i, j)
                ok = d <= reach
                yield fine_x[lo + i[ok]], fine_y[ro + j[ok]], d[ok]
                continue
            error = (x.shape[1] + 6) * top * 2.0**-22
            kind = np.float32 if top < 1e30 and error < reach * reach / 8 else np.float64
            if kind is np.float64:
                error = (x.shape[1] + 6) * top * 2.0**-50
            if (kind, ro) not in single:
                single = {(kind, ro): np.column_stack([b, np.ones(len(b)), -b2 / 2]).astype(kind).T}
            near = np.column_stack([a, -a2 / 2, np.ones(len(a))]).astype(kind) @ single[kind, ro]  # less half the squared distance
            low = -(reach * reach) / 2 - error
            if closest:
                low = np.maximum(low, near.max(axis=1, keepdims=True) - 2 * error)
            at = np.flatnonzero(near >= low)
            if not len(at):
                continue
            i, j = np.divmod(at, len(b))
            if closest:
                d = _distances(a, b, i, j)
                ok = d <= reach
                yield fine_x[lo + i[ok]], fine_y[ro + j[ok]], d[ok]
                continue
            open_ = np.flatnonzero(near.ravel()[at] < -(reach * reach) / 2 + error)
            ok = np.ones(len(at), bool)
            ok[open_] = _distances(a, b, i[open_], j[open_]) <= reach
            yield fine_x[lo + i[ok]], fine_y[ro + j[ok]], None


# --- cells by place -----------------------------------------------------------

#: Rows of a cell, cells of a table at most (they grow beyond that), sampled rows a cell by which places are split, and queries of a task.
CELL_ROWS, MOST_CELLS, SAMPLED, TASK_QUERIES = 16_384, 4096, 40, 8192
#: Rows of a leaf within a task.
LEAF = 256


def split(x: np.ndarray, size: int) -> tuple[list, list[np.ndarray]]:
    """Halve rows at the median of their widest column until none has more than `size`: nodes (column, value, left, right; a negative child -k-1 is leaf k), leaves."""
    nodes, leaves = [], []

    def grow(at: np.ndarray) -> int:
        part = x[at]
        width = part.max(axis=0) - part.min(axis=0) if len(at) else np.zeros(1)
        if len(at) <= size or not width.max() > 0:
            leaves.append(at)
            return -len(leaves)
        k = int(width.argmax())
        v = part[:, k]
        cut = np.partition(v, len(v) // 2)[len(v) // 2]
        low = v < cut
        if not low.any():
            low = v <= cut
            cut = v[~low].min()
        me = len(nodes)
        nodes.append([k, float(cut), 0, 0])
        nodes[me][2] = grow(at[low])
        nodes[me][3] = grow(at[~low])
        return me

    grow(np.arange(len(x)))
    return nodes, leaves


def place(nodes: list, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at = np.zeros(len(x), np.int64) if nodes else np.full(len(x), -1)
    if nodes:
        k, cut, left, right = (np.array(c) for c in zip(*nodes))
        while (go := np.flatnonzero(at >= 0)).size:
            n = at[go]
            at[go] = np.where(x[go, k[n]] < cut[n], left[n], right[n])
    return -at - 1


def box_distances(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, cols: list[int]) -> np.ndarray:
    """Squared distances of rows from boxes over these columns, added up in the order in which those of rows are, so that rounding keeps them below."""
    d = np.zeros((len(x), len(lo)))
    for c in cols:
        d += np.maximum(np.maximum(lo[None, :, c] - x[:, c, None], x[:, c, None] - hi[None, :, c]), 0.0) ** 2
    return d


def first_k(q: np.ndarray, d: np.ndarray, v: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's first k by (distance, value), rows counting w times."""
    order = np.lexsort((v, d, q))
    q, w = q[order], w[order]
    start = np.unique(q, return_index=True)[1]
    before = np.cumsum(w) - w
    return order[before - np.repeat(before[start], np.diff(np.append(start, len(q)))) < k]


def nearest_of(x: np.ndarray, ref: np.ndarray, v: np.ndarray, w: np.ndarray, cols: list[int], k: int, factor: float, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, factor * squared distance) of the k nearest rows by (distance, value), and others within `bound`, by leaves of a tree."""
    leaves = [a for a in split(ref[:, cols], LEAF)[1] if len(a)]
    if not leaves or not len(x):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    lo, hi = (np.array([f(ref[a], axis=0) for a in leaves]) for f in (np.min, np.max))
    found = [], [], []

    def meet(qs: np.ndarray, a: np.ndarray, u: np.ndarray) -> None:
        for s in range(0, len(qs), 1024):
            p = qs[s : s + 1024]
            for t in range(0, len(a), 4096):
                b = a[t : t + 4096]
                d = np.zeros((len(p), len(b)))
                for c in cols:
                    d += (ref[None, b, c] - x[p, c, None]) ** 2
                d *= factor
                if len(b) > k:
                    d[d > np.partition(d, k - 1, axis=1)[:, k - 1, None]] = np.inf
                i, j = np.nonzero(d <= np.minimum(u[p], np.finfo(float).max)[:, None])
                keep = first_k(i, d[i, j], v[b[j]], w[b[j]], k)
                for out, values in zip(found, (p[i[keep]], b[j[keep]], d[i[keep], j[keep]])):
                    out.append(values)

    for s in range(0, len(x), 2048):
        part = np.arange(s, min(s + 2048, len(x)))
        near = box_distances(x[part], lo, hi, cols) * factor
        home, u = near.argmin(axis=1), bound.copy()
        kept = len(found[0])
        for n in np.unique(home):
            meet(part[home == n], leaves[n], u)
        q, r, d = (np.concatenate(f[kept:]) if len(f) > kept else np.zeros(0, int) for f in found)
        order = np.lexsort((d, q))
        q, r, d = q[order], r[order], d[order]
        total = np.cumsum(w[r])
        start = np.unique(q, return_index=True)[1]
        reached = total - np.repeat((total - w[r])[start], np.diff(np.append(start, len(q)))) >= k
        at = np.flatnonzero(reached)
        done, first = np.unique(q[at], return_index=True)
        u[done] = np.minimum(u[done], d[at[first]])
        go = near <= u[part, None]
        go[np.arange(len(part)), home] = False
        for n in np.flatnonzero(go.any(axis=0)):
            meet(part[go[:, n]], leaves[n], u)
    return tuple(np.concatenate(f) if f else np.zeros(0, int) for f in found)


class Cells:
    """Fitted rows (c0 .. c{n-1}, w times) dealt by place; rows of a cell have the same columns. Rows of rare patterns of columns lie in mixed cells that every query goes to."""

    def __init__(self, fitted: DataFrame, names: list[str], stage: Callable[[DataFrame, str], DataFrame]):
        self.names = names
        pattern = F.concat(*[F.col(c).isNotNull().cast("int").cast("string") for c in names])
        d = fitted.withColumn("__p", pattern)
        counts = {r["__p"]: r["count"] for r in d.groupBy("__p").count().orderBy(F.desc("count"), "__p").limit(64).collect()}
        rows = fitted.count()
        size = max(CELL_ROWS, -(-rows // MOST_CELLS))
        trees, self.cells = {}, 0
        for p, n in counts.items():
            if n * 8 < size and len(counts) > 8:
                continue
            has = [i for i, c in enumerate(p) if c == "1"]
            want = -(-n // size)
            # where places are split is free: rows are dealt by it, none is left out
            sample = d.filter(F.col("__p") == p).select(*[names[i] for i in has])
            x = sample.filter(F.pmod(F.xxhash64(*sample.columns), F.lit(1_000_000)) < int(1_000_000 * min(1.0, want * SAMPLED / n) + 1)).toPandas().to_numpy(float).reshape(-1, len(has)) if want > 1 else np.zeros((0, len(has)))
            nodes, leaves = split(x, max(1, -(-len(x) // want)))
            trees[p] = (has, nodes, self.cells)
            self.cells += len(leaves)
        rest, mixed = rows - sum(counts[p] for p in trees), self.cells
        self.mixed = list(range(mixed, mixed + -(-rest // size)))

        def dealt(parts):
            for pdf in parts:
                x = pdf[names].to_numpy(float)
                cell = np.full(len(x), -1)
                for p, at in pdf.groupby("__p").indices.items():
                    if p in trees:
                        has, nodes, first = trees[p]
                        cell[at] = first + place(nodes, x[at][:, has])
                    else:
                        cell[at] = mixed + np.arange(len(at)) % max(1, len(self_mixed))
                yield pdf.assign(cell=cell)

        self_mixed = self.mixed
        schema = ", ".join([*[f"{c} double" for c in names], "w long", "__p string", "cell int"])
        self.rows = stage(d.select(*names, "w", "__p").mapInPandas(dealt, schema), "cells")
        boxes = self.rows.filter(F.col("cell") < mixed).groupBy("cell").agg(F.first("__p").alias("p"), F.sum("w").alias("w"), *[f(c).alias(f"{k}{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))]).toPandas()  # at most MOST_CELLS and some
        self.ids, self.weights = boxes["cell"].to_numpy(), boxes["w"].to_numpy()
        self.has = np.array([[c == "1" for c in p] for p in boxes["p"]], bool).reshape(-1, len(names))
        self.lo, self.hi = (boxes[[f"{k}{c}" for c in names]].to_numpy(float).reshape(-1, len(names)) for k in ("lo", "hi"))

    def route(self, asked: DataFrame, k: int, first: bool) -> DataFrame:
        """Asked rows (id, j, c.., bound, home) with the cells to seek column j in: the nearest one with k rows, or the others within bound."""
        names, ids, has, lo, hi, weights, mixed = self.names, self.ids, self.has, self.lo, self.hi, self.weights, np.array(self.mixed, int)
        n = len(names)

        def run(parts):
            for pdf in parts:
                x, own = pdf[names].to_numpy(float), pdf[names].notna().to_numpy()
                code = np.column_stack([own, pdf["j"].to_numpy()])
                rows, cells = [], []
                for key in np.unique(code, axis=0):
                    j, mine = int(key[-1]), key[:-1].astype(bool)
                    at = np.flatnonzero((code == key).all(axis=1))
                    could = np.flatnonzero(has[:, j] & (has & mine).any(axis=1)) if len(has) else np.zeros(0, int)
                    for s in range(0, len(at), 1024):
                        part = at[s : s + 1024]
                        d = np.full((len(part), len(could)), np.inf)
                        for shared in np.unique(has[could] & mine, axis=0):
                            same = np.flatnonzero(((has[could] & mine) == shared).all(axis=1))
                            d[:, same] = box_distances(x[part], lo[could[same]], hi[could[same]], list(np.flatnonzero(shared))) * n / shared.sum()
                        if first:
                            if len(could):
                                best = np.where(weights[could] >= k, d, np.finfo(float).max).argmin(axis=1)
                                rows.append(part)
                                cells.append(ids[could[best]])
                            continue
                        go = (d <= pdf["bound"].to_numpy()[part, None]) & (ids[could][None] != pdf["home"].to_numpy()[part, None])
                        a, b = np.nonzero(go)
                        rows += [part[a], np.repeat(part, len(mixed))]
                        cells += [ids[could[b]], np.tile(mixed, len(part))]
                r, c = (np.concatenate(v) if v else np.zeros(0, int) for v in (rows, cells))
                yield pdf.drop(columns=["home"]).iloc[r].assign(cell=c)

        return asked.mapInPandas(run, ", ".join(["id long", "j int", *[f"{c} double" for c in names], "bound double", "cell int"]))

    def seek(self, routed: DataFrame, k: int) -> DataFrame:
        """(id, j, d, v, w, cell): what cells have for the queries sent there, at most k places each."""
        names = self.names
        n = len(names)
        blocks = routed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TASK_QUERIES).cast("int").alias("blocks"))  # a row a cell
        q = routed.join(F.broadcast(blocks), "cell").withColumn("__k", F.pmod(F.xxhash64("id", "j"), F.col("blocks")).cast("int")).drop("blocks")
        r = self.rows.join(F.broadcast(blocks), "cell").withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*names, "w", "cell", "__k")

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(left) and len(right):
                ref, w = right[names].to_numpy(float), right["w"].to_numpy()
                have, x = ~np.isnan(ref), left[names].to_numpy(float)
                kinds = [(p, np.flatnonzero((have == p).all(axis=1))) for p in np.unique(have, axis=0)]
                code = np.column_stack([~np.isnan(x), left["j"].to_numpy()])
                for key in np.unique(code, axis=0):
                    j, at = int(key[-1]), np.flatnonzero((code == key).all(axis=1))
                    for p, rows in kinds:
                        cols = [c for c in range(n) if p[c] and key[c]]
                        if p[j] and cols:
                            a, b, d = nearest_of(x[at], ref[rows], ref[rows, j], w[rows], cols, k, n / len(cols), left["bound"].to_numpy()[at])
                            out.append((at[a], d, ref[rows[b], j], w[rows[b]]))
            if not out:
                return pd.DataFrame({"id": [], "j": [], "d": [], "v": [], "w": [], "cell": []}).astype({"id": "int64", "j": "int32", "w": "int64", "cell": "int32"})
            a, d, v, w = (np.concatenate(c) for c in zip(*out))
            keep = first_k(a, d, v, w, k)
            a = a[keep]
            return pd.DataFrame({"id": left["id"].to_numpy()[a], "j": left["j"].to_numpy()[a], "d": d[keep], "v": v[keep], "w": w[keep], "cell": int(left["cell"].iloc[0])})

        return q.groupBy("cell", "__k").cogroup(r.groupBy("cell", "__k")).applyInPandas(run, "id long, j int, d double, v double, w long, cell int")
