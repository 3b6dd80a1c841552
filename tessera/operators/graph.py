"""Connected components of a table of edges, by alternating large-star and small-star rounds.

Up to ONE_TASK edges are a few megabytes, and one task joins them: a round is some
twenty stages of as many tasks as there are shuffle partitions, however few
edges there are. More edges go through rounds. Each round is two aggregations and two joins. The aggregates are written before
they are joined: both sides of a join are then plain shuffles, of which adaptive
execution splits the parts that hold a centre with very many neighbours. Edges
never leave the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.staging import stage

#: Most edges, with loops and repeats, that one task takes.
ONE_TASK = 300_000


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _ordered(e: DataFrame) -> DataFrame:
    """Distinct edges with u > v."""
    return e.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, nodes being 0 to n - 1: a root next to a smaller one goes below the smallest, until none is."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        open_ = a != b
        if not open_.any():
            return root
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        codes = pc.dictionary_encode(pa.chunked_array([b.column(k) for k in range(2) for b in held]).combine_chunks())
        order = pc.sort_indices(codes.dictionary)  # bytes and numbers, as Spark's least() has them
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        u, v = np.split(rank[codes.indices.to_numpy()], 2)
        nodes = codes.dictionary.take(order)
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(_roots(u, v, len(nodes))))], ["node", "root"])

    kind = edges.schema["u"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, root) for every node of an edge; the root is the component's least node. Loops and repeated edges count for nothing.

    The rounds end when no edge changes, after a number that grows with the logarithm of the components' sizes.
    """
    e = stage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v"), "all-edges")
    if e.count() <= ONE_TASK:
        return _in_one_task(e)
    e = stage(_ordered(e), "edges")
    seen, now = None, _signature(e)
    while now != seen:
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stage(_ordered(both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))), "large-star")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = stage(_ordered(small), "edges")
        now = _signature(e)
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
