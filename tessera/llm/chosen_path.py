"""N-gram Jaccard join by chosen paths.

Texts become sets of hashed shingles (five words, A-Z lower-cased; a shorter
text is one shingle of all its words), and sets a row of SIZE sampled tokens
(min-hashes). From the root, each run walks down a tree: a node's path picks a
position, and sets with the same token there share a child. START tokens are
taken at once. Small buckets are compared by brute force on the sampled tokens.
In a bucket over BUCKET sets, those close to its pivot are linked to it; if few
are left, or at MAX_DEPTH tokens, all pairs with one of those are compared, in
cells. Other large buckets are split further, with more than one child now and
then. The number of runs follows from the target recall at the threshold and
the chance that a pair stays together down to the deepest level reached; sets
of buckets that were split take part in as many more runs as that demands.

What the buckets find are candidate groups; their links are then verified on
the full sets, all pairs of a group in cells of bounded size, so that results
hold no false link. Exact copies are collapsed before all this, and links are
counted, not emitted. A group of n different near copies still takes about
n^2/2 comparisons, as counting its links demands; they are matrix products on
blocks, spread over cells.

Nulls and edge cases: a null text, or one without words, links with nothing and
is a class of its own; equal texts are linked; a class's id is its least
non-null doc_id (null if all are null); repeated rows count as copies; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import documents, slices, staged
from tessera.operators.graph import connected_components

WORDS = 5
THRESHOLD = 0.8
#: Chance that a pair at the threshold becomes a candidate.
RECALL = 0.99999
SIZE = 64
START = 2
STEP = 2
MAX_DEPTH = 8
BUCKET = 200
#: About as many sets of each side in a cell of a large bucket; with more that aren't near its pivot, it is split.
CELL_SETS = 1000
#: Most sets, and most shingles, of a block in verification.
BLOCK_SETS = 1000
BLOCK_SHINGLES = 1_000_000
BROADCAST_KEYS = 500_000

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _SHIFT)) * _MIX
        return x ^ (x >> _SHIFT)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    of = xxhash.xxh64_intdigest
    h = np.fromiter((of(w) for w in words), np.uint64, len(words))
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out = mix(out) + h[k : len(h) - n + 1 + k]
    return np.unique(mix(out))


_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 2**63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, SIZE, dtype=np.uint64)


def sampled(s: np.ndarray) -> np.ndarray:
    """SIZE sampled tokens of a set: for each of SIZE hashes, the least."""
    out = np.full(SIZE, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(s), 4096):
            part = s[k : k + 4096]
            out = np.minimum(out, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32)


def walk(paths: np.ndarray, tokens: np.ndarray, steps: int) -> np.ndarray:
    """Each row's path after `steps` more tokens; the path so far says which position comes next."""
    rows = np.arange(len(tokens))
    for _ in range(steps):
        with np.errstate(over="ignore"):
            at = (mix(paths) % np.uint64(SIZE)).astype(np.int64)
            paths = mix(paths * np.uint64(0x9E3779B97F4A7C15) + tokens[rows, at].astype(np.uint64) + (at.astype(np.uint64) << np.uint64(34)))
    return paths


def children(paths: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Paths STEP tokens longer, and the row of each; a path has a second child, along another position, with chance 1/threshold**STEP - 1."""
    with np.errstate(over="ignore"):
        fork = mix(paths + np.uint64(77))
    also = np.flatnonzero((fork >> np.uint64(11)).astype(np.float64) / 2**53 < min(1.0, threshold**-STEP - 1))
    return np.concatenate([walk(paths, tokens, STEP), walk(fork[also], tokens[also], STEP)]), np.concatenate([np.arange(len(tokens)), also])


def _agreements(threshold: float) -> list[float]:
    """Chances that 0 to SIZE sampled tokens of a pair at the threshold agree."""
    return [math.comb(SIZE, m) * threshold**m * (1 - threshold) ** (SIZE - m) for m in range(SIZE + 1)]


def candidate_matches(threshold: float, recall: float) -> int:
    """Sampled tokens in which a candidate pair agrees at least; a quarter of the allowed misses have fewer."""
    below = 0.0
    for m, x in enumerate(_agreements(threshold)):
        below += x
        if below > (1 - recall) / 4:
            return m
    return SIZE


def survival(agreement: float, threshold: float, depth: int) -> float:
    """Chance that a run keeps a pair with this share of equal tokens together on some path of `depth` tokens."""
    second, below, step = min(1.0, threshold**-STEP - 1), 1.0, agreement**STEP
    for _ in range(START, depth, STEP):
        below = 1 - (1 - step * below) * (1 - second * step * below)
    return agreement**START * below


def runs_for(threshold: float, recall: float, depth: int = START) -> int:
    """Runs after which a quarter of the allowed misses never met in a bucket of this depth, over all outcomes of the sampling."""
    least = candidate_matches(threshold, recall)
    each = [(x, survival(m / SIZE, threshold, depth)) for m, x in enumerate(_agreements(threshold)) if m >= least]
    return next(n for n in range(1, 100_000) if sum(x * (1 - p) ** n for x, p in each) <= (1 - recall) / 4)


def _sign(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, key (of the whole text), number of shingles and their sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                sets = [shingles(t) for t in part.column(2).to_pylist()]
                tokens = [sampled(s) if len(s) else None for s in sets]
                arrays = [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([None if t is None else t.tobytes() for t in tokens], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "key", "n", "tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("key"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, key binary, n long, tokens binary")


def _matrix(tokens: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(tokens.to_pylist()), np.uint32).reshape(-1, SIZE)


def _starts(reps: DataFrame, first: int, last: int, wanted: DataFrame | None = None) -> DataFrame:
    """(path, key) of START tokens in runs number first to last - 1; of a bounded table of wanted paths alone, (path, key, tokens)."""
    known = None
    if wanted is not None:
        paths = wanted.select("path").toArrow().column("path").to_numpy()
        known = reps.sparkSession.sparkContext.broadcast(np.sort(paths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1))
            for r in mix(np.arange(first + 1, last + 1, dtype=np.uint64)):
                path = walk(np.full(len(m), r), m, START)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column(0)], ["path", "key"])

    def on_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, have, paths, rows = _matrix(batch.column(1)), known.value, [], []
            for r in mix(np.arange(first + 1, last + 1, dtype=np.uint64)) if len(have) else ():
                path = walk(np.full(len(m), r), m, START).view(np.int64)
                at = np.flatnonzero(have[np.minimum(np.searchsorted(have, path), len(have) - 1)] == path)
                paths.append(path[at])
                rows.append(at)
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(paths)), batch.column(0).take(take), batch.column(1).take(take)], ["path", "key", "tokens"])

    if known is None:
        return reps.select("key", "tokens").mapInArrow(run, "path long, key binary")
    return reps.select("key", "tokens").mapInArrow(on_known, "path long, key binary, tokens binary")


def _deeper(rows: DataFrame, threshold: float) -> DataFrame:
    """(path, key, tokens) of the paths' children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_numpy().view(np.uint64)
            m = _matrix(batch.column(2))
            out, take = children(paths, m, threshold)
            take = pa.array(take)
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), batch.column(1).take(take), batch.column(2).take(take)], ["path", "key", "tokens"])

    return rows.select("path", "key", "tokens").mapInArrow(run, "path long, key binary, tokens binary")


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first n_keys columns, out of a sorted stream; several whole groups at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy() for k in range(n_keys)]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if held and all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in range(n_keys)):
            first = int(change[0]) if len(change) else batch.num_rows
            held.append(batch.slice(0, first))
            if first == batch.num_rows:
                continue
            yield pa.Table.from_batches(held)
            held, batch, change = [], batch.slice(first), change[1:] - first
        elif held:
            yield pa.Table.from_batches(held)
            held = []
        last = int(change[-1]) if len(change) else 0
        if last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _parts(linked: np.ndarray) -> np.ndarray:
    """The least index of each row's component, from a matrix of links."""
    root = np.arange(len(linked))
    left = np.ones(len(linked), bool)
    for i in range(len(linked)):
        if not left[i]:
            continue
        front = np.zeros(len(linked), bool)
        front[i] = True
        left[i] = False
        while front.any():
            front = linked[front].any(axis=0) & left
            root[front] = i
            left &= ~front
    return root


def _brute_force(rows: DataFrame, least: int) -> DataFrame:
    """Candidate edges (a, b) of buckets: pairs of close samples, as a spanning forest of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 1):
            path = table.column(0).to_numpy()
            keys = table.column(1).to_pylist()
            m = _matrix(table.column(2))
            start = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1, [len(path)]])
            size = np.diff(start)
            a: list[bytes] = []
            b: list[bytes] = []
            two = start[:-1][size == 2]
            for i in two[(m[two] == m[two + 1]).sum(axis=1) >= least].tolist():
                a.append(keys[i])
                b.append(keys[i + 1])
            for i, n in zip(start[:-1][size > 2].tolist(), size[size > 2].tolist()):
                part = m[i : i + n]
                same = np.zeros((n, n), np.int32)
                for k in range(SIZE):
                    same += part[:, k, None] == part[None, :, k]
                root = _parts(same >= least)
                for x in np.flatnonzero(root != np.arange(n)).tolist():
                    a.append(keys[i + x])
                    b.append(keys[i + root[x]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return rows.select("path", "key", "tokens").repartition("path").sortWithinPartitions("path", "key").mapInArrow(run, "a binary, b binary")


def _beside_pivot(large: DataFrame, least: int) -> DataFrame:
    """(path, key, tokens, size, pivot, near): whether the set is a candidate with its bucket's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_matrix(batch.column(2)) == _matrix(batch.column(5))).sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(near)], ["path", "key", "tokens", "size", "pivot", "near"])

    return large.select("path", "key", "tokens", "size", "pivot", "pivot_tokens").mapInArrow(run, "path long, key binary, tokens binary, size long, pivot binary, near boolean")


def _cells(rows: DataFrame) -> DataFrame:
    """(path, key, tokens) of cells in which every pair of a bucket meets, but for pairs near its pivot, which are linked by that."""
    blocks = lambda n: F.ceil(n / CELL_SETS).cast("int")
    rows = rows.withColumn("apart", blocks(F.col("rest"))).withColumn("near_blocks", blocks(F.col("size") - F.col("rest")))
    h = F.xxhash64("key", F.lit(3))
    rows = rows.withColumn("block", F.when(F.col("near"), F.col("apart") + F.pmod(h, F.col("near_blocks"))).otherwise(F.pmod(h, F.col("apart"))).cast("int"))
    all_blocks = F.col("apart") + F.col("near_blocks")
    others = F.when(F.col("near"), F.sequence(F.lit(0), F.col("apart") - 1)).otherwise(F.sequence(F.lit(0), all_blocks - 1))
    each = rows.withColumn("other", F.explode(others)).filter((F.col("other") != F.col("block")) | (all_blocks == 1))
    return each.select(F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other")).alias("path"), "key", "tokens")


def _round(reps: DataFrame, first: int, last: int, threshold: float, least: int) -> tuple[list[DataFrame], DataFrame | None, int]:
    """Edges from runs number first to last - 1; keys of buckets that had to be split, and the deepest level reached.

    A step that deals rows by a key costs as many tasks as there are partitions, however few the rows. So sizes are counted
    once a level, links to pivots are read off the rows beside them, and one step compares the buckets of all levels.
    """
    rows, edges, cells, split, depth = _starts(reps, first, last), [], [], None, START
    while True:
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("pivot")).filter("size > 1")
        sizes = staged(sizes, "sizes")
        small, large = sizes.filter(F.col("size") <= BUCKET).select("path"), sizes.filter(F.col("size") > BUCKET)
        few = depth == START and sizes.count() <= BROADCAST_KEYS  # where a set's tokens are, its paths are picked: nothing is dealt
        shared = _starts(reps, first, last, small) if few else rows.join(small, "path")
        shared = shared if "tokens" in shared.columns else shared.join(reps.select("key", "tokens"), "key")
        cells.append(shared.select("path", "key", "tokens"))
        if large.isEmpty():
            break
        pivots = reps.select(F.col("key").alias("pivot"), F.col("tokens").alias("pivot_tokens"))
        pivots = staged((F.broadcast(large) if few else large).join(pivots, "pivot"), "large")
        shared = (_starts(reps, first, last, large) if few else rows).join(pivots, "path")
        shared = shared if "tokens" in shared.columns else shared.join(reps.select("key", "tokens"), "key")
        shared = staged(_beside_pivot(shared, least), "beside-pivot")
        edges.append(shared.filter(F.col("near") & (F.col("key") != F.col("pivot"))).select(F.col("key").alias("a"), F.col("pivot").alias("b")))
        rest = shared.groupBy("path").agg(F.count(F.when(~F.col("near"), 1)).alias("rest"))
        shared = shared.join(staged(rest.filter("rest > 0"), "rest"), "path")
        done = F.lit(True) if depth >= MAX_DEPTH else F.col("rest") <= CELL_SETS
        cells.append(_cells(shared.filter(done)))
        if depth >= MAX_DEPTH:
            break
        larger = staged(_deeper(shared.filter(~done), threshold), "paths")  # a set is on a path once, as a path says which it came from
        if larger.isEmpty():
            break
        rows = larger
        split = rows.select("key") if split is None else split
        depth += STEP
    edges.append(staged(_brute_force(functools.reduce(DataFrame.unionByName, cells), least), "buckets"))
    return edges, split, depth


def candidate_edges(reps: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Edges between reps (key, tokens) that buckets bring together.

    A pair that a bucket of START tokens kept together is found, or both its sets were in buckets that were split: those
    sets alone need the runs of deeper levels.
    """
    least = candidate_matches(threshold, recall)
    done, goal = 0, runs_for(threshold, recall)
    edges, pool = [], reps
    while done < goal:
        found, split, depth = _round(pool, done, goal, threshold, least)
        edges += found
        done = goal
        if pool is reps and split is not None:
            pool = staged(reps.join(split, "key", "left_semi").select("key", "tokens"), "pool")
        goal = max(goal, runs_for(threshold, recall, depth))
    return functools.reduce(DataFrame.unionByName, edges)


def _shared_counts(sets: list[np.ndarray], rare: int = 16, width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all pairs."""
    n = len(sets)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    values, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), np.float32)
    order = np.argsort(col, kind="stable")
    doc, start = doc[order], np.concatenate([[0], np.cumsum(count)])
    for k in range(2, rare + 1):
        at = start[:-1][count == k]
        if len(at):
            members = doc[at[:, None] + np.arange(k)]
            for i in range(k):
                for j in range(k):
                    if i != j:
                        out += np.bincount(members[:, i] * n + members[:, j], minlength=n * n).reshape(n, n)
    often = np.flatnonzero(count > rare)
    for lo in range(0, len(often), width):
        cols = often[lo : lo + width]
        x = np.zeros((n, len(cols)), np.float32)
        for c, v in enumerate(cols):
            x[doc[start[v] : start[v + 1]], c] = 1
        out += x @ x.T
    return out


def _links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    size = np.array([len(s) for s in sets], np.float64)
    if len(sets) <= 8:
        shared = np.zeros((len(sets), len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                if min(size[i], size[j]) >= threshold * max(size[i], size[j]) - 1e-9:
                    shared[i, j] = shared[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        shared = _shared_counts(sets).astype(np.float64)
    linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def _sets(texts: DataFrame) -> DataFrame:
    """(key, s): the hashed shingles of each text (key, t), made once however many cells it goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["key", "s"])

    return texts.select("key", "t").mapInArrow(run, "key binary, s binary")


def _verify(cells: DataFrame, threshold: float) -> DataFrame:
    """For each set of a cell: the links it has there (counting copies), and a root within the cell for connectivity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            group, x, y = (table.column(k).to_numpy() for k in range(3))
            start = np.concatenate([[0], np.flatnonzero((group[1:] != group[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1, [len(group)]])
            block, keys, copies = table.column(3).to_numpy(), table.column(4).to_pylist(), table.column(5).to_numpy()
            sets = table.column(6)
            out_keys: list[bytes] = []
            out_links: list[int] = []
            out_roots: list[bytes] = []
            for lo, hi in zip(start[:-1].tolist(), start[1:].tolist()):
                if hi - lo < 2:
                    continue
                linked = _links([np.frombuffer(s.as_py(), np.uint64) for s in sets[lo:hi]], threshold)
                if x[lo] != y[lo]:  # two blocks: pairs within each are another cell's
                    linked &= block[lo:hi, None] != block[None, lo:hi]
                root = _parts(linked)
                own = keys[lo:hi]
                out_keys += own
                out_links += (linked @ copies[lo:hi].astype(np.int64)).tolist()
                out_roots += [own[r] for r in root.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(out_keys, pa.binary()), pa.array(out_links, pa.int64()), pa.array(out_roots, pa.binary())], ["key", "links", "root"])

    ordered = cells.select("group", "x", "y", "block", "key", "copies", "s").repartition("group", "x", "y").sortWithinPartitions("group", "x", "y", "key")
    return ordered.mapInArrow(run, "key binary, links long, root binary")


def join(df: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: id, key (of its text), class_key (null without words), class_id, n_links, n_copies and class_size."""
    signed = staged(_sign(df, id_col, text), "signed")
    reps = staged(signed.filter("tokens IS NOT NULL").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("tokens").alias("tokens")), "representatives")
    groups = staged(connected_components(candidate_edges(reps, threshold, recall), "a", "b"), "candidates").withColumnRenamed("node", "key").withColumnRenamed("root", "group_key")
    members = groups.join(reps.select("key", "copies", "n"), "key")
    blocks = members.groupBy("group_key").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = staged(members.join(blocks, "group_key").select("key", "copies", F.xxhash64("group_key").alias("group"), "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")), "members")
    texts = df.select(F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("key"), F.col(text).alias("t"))
    wanted = members.select("key")
    if wanted.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    texts = texts.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("t").alias("t"))
    cells = members.join(_sets(texts), "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    verified = staged(_verify(cells, threshold), "verified")
    links = verified.groupBy("key").agg(F.sum("links").alias("links"))
    classes = connected_components(verified.select("key", "root"), "key", "root").withColumnRenamed("node", "key")
    linked = staged(links.join(classes, "key").join(reps.select("key", "least", "copies"), "key"), "linked")  # texts with a link
    named = staged(linked.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size")), "classes")
    linked = linked.join(named, "root").select("key", "root", "class_id", "class_size", "links")
    info = reps.select("key", "least", "copies").join(linked, "key", "left")
    info = info.select("key", F.coalesce("root", "key").alias("root"), F.coalesce("class_id", F.when(F.col("root").isNull(), F.col("least"))).alias("class_id"), F.coalesce("class_size", "copies").alias("class_size"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    info = staged(info, "texts")  # a plain side of the next join, of which a text with very many copies is then split
    out = signed.select("id", "key", F.col("tokens").isNotNull().alias("live")).join(info, "key", "left")
    return out.select(
        F.col("id").alias(id_col),
        "key",
        F.col("root").alias("class_key"),
        F.when(F.col("live"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.when(F.col("live"), F.col("links") + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("live"), F.col("copies")).otherwise(1).cast("long").alias("n_copies"),
        F.when(F.col("live"), F.col("class_size")).otherwise(1).cast("long").alias("class_size"),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of df, of each class one: a row of its least id (if several rows have that, one of them). Rows without words all stay."""
    found = join(df, id_col=id_col, text=text, **options)
    own = found.filter(F.col("class_key").isNotNull() & F.col(id_col).eqNullSafe(F.col("class_id")))
    texts = own.groupBy("class_key", F.col("key").alias("__key")).agg(F.first("class_id").alias("__id"), F.count(F.lit(1)).alias("__rows"))
    first = texts.groupBy("class_key").agg(F.min(F.struct("__key", "__rows", "__id")).alias("x")).select("x.*")
    first = staged(first, "kept")
    if first.count() <= BROADCAST_KEYS:
        first = F.broadcast(first)
    wordless = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    whole = df.select(F.struct(*df.columns).alias("__r"), F.col(id_col).alias("__i"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("__k"), wordless.alias("__wordless"))
    rows = whole.filter(~F.col("__wordless")).join(first, F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__key")))
    single = rows.filter(F.col("__rows") == 1).select("__r.*")
    repeated = rows.filter(F.col("__rows") > 1).groupBy("__id", "__key").agg(F.first("__r").alias("__r")).select("__r.*")
    return single.unionByName(repeated).unionByName(whole.filter("__wordless").select("__r.*"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return join(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "n_copies")


SQL = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id, md5(coalesce(text, '')) AS key,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT rid, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM docs WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
common AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.rid <> b.rid GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE c >= 0.8 * (na.n + nb.n - c) - 1e-9),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
cls AS (SELECT a, min(doc_id) AS c FROM reach JOIN docs ON rid = b GROUP BY a),
cnt AS (SELECT a, count(*) AS n FROM link GROUP BY a),
cp AS (SELECT key, count(*) AS n FROM docs WHERE len(w) > 0 GROUP BY key)
SELECT doc_id, CASE WHEN len(w) = 0 THEN doc_id ELSE least(doc_id, coalesce(c, doc_id)) END AS class_id, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n_links,
    CAST(coalesce(cp.n, 1) AS BIGINT) AS n_copies
FROM docs LEFT JOIN cls ON cls.a = rid LEFT JOIN cnt ON cnt.a = rid LEFT JOIN cp ON cp.key = docs.key AND len(w) > 0
"""
