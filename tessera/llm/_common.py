"""Helpers shared by the text operators: inputs, staged tables and native word expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.staging import shared_dir  # noqa: F401  for the operators
from tessera.sources.staging import stage as staged  # noqa: F401

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Characters outside of lower-case words: ASCII but digits and lower-case letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only as far as ASCII words can tell: lower() maps one other character, the Kelvin sign, to an ASCII letter by itself."""
    kelvin = "\u212a"
    return F.when(F.contains(text, F.lit(kelvin)), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def split_words(text: Column, separator: str = SPACE) -> Column:
    """The words between separators, in order; none for an empty text."""
    return F.array_remove(F.split(text, separator), "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def most_frequent(counts: DataFrame, n: str, entries: int) -> DataFrame:
    """Rows of the largest n, at most `entries` of them: those over a bound read off a histogram of logarithms.

    A limit over a sort would have each task send that many rows to the driver.
    """
    step = lambda: F.floor(F.ln(F.col(n)) * 16).cast("int")
    left, bound = entries, None
    for r in sorted(counts.groupBy(step().alias("b")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True):  # a few hundred rows
        left -= r.k
        if left < 0:
            break
        bound = r.b
    return counts.filter(step() >= bound) if bound is not None else counts.limit(0)


def slices(batch, text_at: int, max_chars: int = 1_000_000):
    """Cut an Arrow batch into slices of about max_chars of text; a longer text is a slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(sizes):
        total = np.cumsum(sizes[start : start + 20_000])
        n = max(1, int(np.searchsorted(total, max_chars, side="right")))
        yield batch.slice(start, n)
        start += n
