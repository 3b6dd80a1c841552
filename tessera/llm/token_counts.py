"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to frequencies.

One pass over the texts finds each document's pre-token frequencies. Frequent
pre-tokens (the head) are counted beforehand and joined from a dictionary of at
most HEAD_ENTRIES that is broadcast; all others (the tail) leave the pass as
(pre-token, frequency) lists, are dealt by pre-token in one shuffle, where the
sorted stream counts each distinct pre-token of the corpus once and gives the
product with each document's frequency, and are summed per document. Which
pre-tokens are in the head comes from one in HEAD_SAMPLE rows, copies of a text
included, and changes no result, only how many rows the shuffle carries: a
pre-token of the tail is rarer than each of HEAD_ENTRIES others, or was met once
at most in the sampled rows, so that no task gets a large share of them.

Nulls and edge cases: a null or empty text has 0 bytes and 0 tokens; a special
string of the vocabulary is one token; documents of any length are counted
whole; repeated ids and rows stay separate rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm._common import documents, most_frequent, slices, staged

HEAD_ENTRIES = 400_000
HEAD_SAMPLE = 8
FLUSH_ENTRIES = 200_000
UNIT_CACHE = 200_000
LIMIT = 512


def head_pretokens(df: DataFrame, text: str, path: str, sample: int, entries: int) -> list[str]:
    """The most frequent pre-tokens of one in `sample` rows: counted in tasks, then over tasks, and the top taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, seen = bpe.load(path), Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["k", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for t in batch.column(0).to_pylist():
                for segment in tokenizer.segments(t):
                    if segment not in tokenizer.special:
                        seen.update(tokenizer.pretokens(segment))
                if len(seen) > FLUSH_ENTRIES:
                    yield out()
        yield out()

    part = df.select(F.col(text).cast("string").alias("t")).filter(F.pmod(F.monotonically_increasing_id(), F.lit(sample)) == 0).filter(F.length("t") > 0)
    counted = part.mapInArrow(run, "k string, n long").groupBy("k").agg(F.sum("n").alias("n")).filter("n > 1")
    return [r.k for r in most_frequent(staged(counted, "head-counts"), "n", entries).select("k").collect()]


def count_pieces(tail: DataFrame, path: str) -> DataFrame:
    """(row, n) from (row, k, n): n times the pieces of k. Rows are dealt and sorted by k, so that each distinct k is counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe.load(path)
        last, pieces = None, 0
        for batch in batches:
            each = batch.column(1).dictionary_encode()
            sizes = []
            for k in each.dictionary.to_pylist():
                if k != last:
                    last, pieces = k, len(tokenizer.pieces(k))
                sizes.append(pieces)
            n = np.array(sizes, np.int64)[each.indices.to_numpy()] * batch.column(2).to_numpy() if len(sizes) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["row", "n"])

    return tail.select("row", "k", "n").repartition("k").sortWithinPartitions("k").mapInArrow(run, "row long, n long")


class _Units:
    """Per stretch between spaces: pieces from the head, and pre-tokens of the tail."""

    def __init__(self, tokenizer: bpe.RankedBPE, head: dict[str, int]):
        self.tokenizer, self.head, self.cache = tokenizer, head, {}

    def look_up(self, stretch: str) -> tuple[int, tuple[str, ...]]:
        n, tail = 0, []
        for x in self.tokenizer.pretokens(stretch):
            k = self.head.get(x)
            if k is None:
                tail.append(x)
            else:
                n += k
        if len(stretch) <= 64:
            if len(self.cache) >= UNIT_CACHE:
                self.cache.clear()
            self.cache[stretch] = (n, tuple(tail))
        return n, tuple(tail)

    def split(self, text: str) -> tuple[int, Counter]:
        n, tail, found = 0, Counter(), self.cache.get
        for segment in self.tokenizer.segments(text):
            if segment in self.tokenizer.special:
                n += 1
                continue
            for stretch, times in Counter(self.tokenizer.stretches(segment)).items():
                hit = found(stretch) or self.look_up(stretch)
                n += times * hit[0]
                for x in hit[1]:
                    tail[x] += times
        return n, tail


def count_tokens(df: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, head_entries: int = HEAD_ENTRIES, head_sample: int = HEAD_SAMPLE) -> DataFrame:
    """One row per row of df: id, n_bytes, n_tokens."""
    path = path or bpe.vocabulary_path()
    spark = df.sparkSession
    tokenizer = bpe.load(path)
    head = head_pretokens(df, text, path, head_sample, head_entries)
    head = spark.sparkContext.broadcast({k: len(tokenizer.pieces(k)) for k in head})  # each distinct head pre-token once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _Units(bpe.load(path), head.value)
        kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())]
        for batch in batches:
            for part in slices(batch, 1):
                n, keys, times = [], [], []
                for t in part.column(1).to_pylist():
                    k, tail = units.split(t or "") if t else (0, {})
                    n.append(k)
                    keys.append(list(tail))
                    times.append(list(tail.values()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *map(pa.array, (n, keys, times), kinds)], ["id", "n_bytes", "head", "keys", "times"])

    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    rows = rows.mapInArrow(run, f"id {id_type}, n_bytes long, head long, keys array<string>, times array<int>").withColumn("row", F.monotonically_increasing_id())
    rows = staged(rows, "token-frequencies")
    tail = rows.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("k"), F.col("x.times").alias("n"))
    sums = count_pieces(tail, path).groupBy("row").agg(F.sum("n").alias("tail"))
    out = rows.select("row", "id", "n_bytes", "head").join(sums, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", (F.col("head") + F.coalesce("tail", F.lit(0))).alias("n_tokens"))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether the tokens are over LIMIT."""
    return count_tokens(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > LIMIT)
