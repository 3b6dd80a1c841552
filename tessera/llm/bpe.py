"""Byte-level BPE encoding and decoding by contiguous rank arrays.

A short word keeps its parts and, beside them, the rank of each pair of
adjacent parts. The least rank is found by scanning, its two parts made one,
and the two neighbouring ranks refreshed, until no pair can merge. Words over
SHORT_BYTES, where the scans would be quadratic, merge from a heap with linked
parts, to the same result.

Texts are cut at the vocabulary's special strings, then into pre-tokens. A
stretch between single spaces always pre-tokenizes alike, so encodings are
cached per stretch, and per pre-token for stretches not met before (together
bounded by CACHE_ENTRIES, each cleared when full).

Nulls and edge cases: a null or empty text has no ids and decodes to ''. Texts
of any length are encoded whole. Repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._common import documents, slices

VOCABULARY = "byte_bpe_50k.json"
SHORT_BYTES = 256
#: Both caches' entries, and those for stretches, which cost little to make from pre-tokens.
CACHE_ENTRIES = 300_000
STRETCH_ENTRIES = 100_000
#: The pattern of byte-level pre-tokenization (fixed value); white space is the Unicode property, which lacks U+001C to U+001F.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
NEVER = 1 << 60


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letter[b] for b in range(256)]


class _Cache(dict):
    """Encodings of short strings, made when first asked for."""

    def __init__(self, make: Callable[[str], bytes], entries: int):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, key: str) -> bytes:
        out = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.entries:
                self.clear()
            self[key] = out
        return out


class RankedBPE:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, letters = data["model"]["vocab"], byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.byte_id = [vocab[c] for c in letters]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for k, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = k
            self.merged.append(vocab[a + b])
        self.special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if all(c in to_byte for c in token):
                self.bytes_of[i] = bytes(to_byte[c] for c in token)
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.spelling = pa.array(self.bytes_of, pa.binary())
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.space_after_space = re.compile(r" (?<=\s )")
        self.of_pretoken = _Cache(lambda x: array("I", self.merge(x.encode())).tobytes(), CACHE_ENTRIES - STRETCH_ENTRIES)
        self.after_space = _Cache(lambda x: self.encode_stretch(" " + x), STRETCH_ENTRIES)
        self.special_bytes = {x: i.to_bytes(4, "little") for x, i in self.special.items()}

    def merge_short(self, word: bytes) -> list[int]:
        """ranks[i]: of parts i and i + 1."""
        rank, merged = self.rank.get, self.merged
        parts = [self.byte_id[b] for b in word]
        ranks = list(map(rank, zip(parts, parts[1:]), itertools.repeat(NEVER)))
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            parts[i] = own = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], own), NEVER)
            if i < len(ranks):
                ranks[i] = rank((own, parts[i + 1]), NEVER)
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        rank, n = self.rank, len(word)
        part = [self.byte_id[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]), NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j >= n or part[j] != right:
                continue
            part[i], part[j] = self.merged[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (x := rank.get((part[a], part[b]), NEVER)) != NEVER:
                    heapq.heappush(heap, (x, a, part[a], part[b]))
        return [x for x in part if x != -1]

    def merge(self, word: bytes) -> list[int]:
        return self.merge_short(word) if len(word) <= SHORT_BYTES else self.merge_long(word)

    def pretokens(self, text: str) -> list[str]:
        return self.words.findall(text)

    def pieces(self, pretoken: str) -> list[int]:
        return self.merge(pretoken.encode())

    def segments(self, text: str) -> list[str]:
        """The text cut at special strings, which stay as segments."""
        if self.cut is None or not any(x in text for x in self.special):
            return [text]
        return [x for x in self.cut.split(text) if x]

    @staticmethod
    def stretches(text: str) -> list[str]:
        """The text in pieces that pre-tokenize one by one as the whole does: cut before a space that follows no white space."""
        parts = text.split(" ")
        out, held = [], parts[0]
        for p in parts[1:]:
            if held and not held[-1].isspace():
                out.append(held)
                held = " " + p
            else:
                held += " " + p
        out.append(held)
        return out

    def encode_stretch(self, stretch: str) -> bytes:
        return b"".join(map(self.of_pretoken.__getitem__, self.words.findall(stretch)))

    def encode_segment(self, segment: str) -> bytes:
        """Stretches but the first begin with a space, which the cache's keys leave out; mostly they are what lies between spaces."""
        if self.space_after_space.search(segment):
            first, *rest = self.stretches(segment)
            rest = [x[1:] for x in rest]
        else:
            first, *rest = segment.split(" ")
        return self.encode_stretch(first) + b"".join(map(self.after_space.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join([self.special_bytes.get(x) or self.encode_segment(x) for x in self.segments(text)])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", errors="replace")

    def decode_all(self, ids: pa.Array) -> pa.Array:
        """The texts of a column of ids: the bytes of all its ids are gathered at once, and cut where rows end."""
        rows = [x or b"" for x in ids.to_pylist()]
        found = self.spelling.take(pa.array(np.frombuffer(b"".join(rows), np.uint32)))
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(found).to_numpy(), dtype=np.int64)])[np.cumsum([0, *map(len, rows)]) // 4]
        out = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), found.buffers()[2] or pa.py_buffer(b"")])
        try:
            return out.cast(pa.string())
        except pa.ArrowInvalid:  # ids of a part of a character
            return pa.array([x.decode("utf-8", errors="replace") for x in out.to_pylist()], pa.string())


@functools.lru_cache(maxsize=2)
def load(path: str) -> RankedBPE:
    return RankedBPE(path)


def encode(df: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids") -> DataFrame:
    """Add (or replace) a binary column of ids, little-endian unsigned 32-bit; `ids_array` turns it into integers."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in slices(batch, at):
                out = [bpe.encode(t) if t else b"" for t in part.column(at).to_pylist()]
                kept = [k for k, name in enumerate(part.schema.names) if name != ids]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in kept], pa.array(out, pa.binary())], [*[part.schema.names[k] for k in kept], ids])

    return df.mapInArrow(run, T.StructType([*[f for f in df.schema.fields if f.name != ids], T.StructField(ids, T.BinaryType())]))


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, text: str = "decoded") -> DataFrame:
    """Add (or replace) the text that a binary column of ids stands for."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            for part in slices(batch, at):
                kept = [k for k, name in enumerate(part.schema.names) if name != text]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in kept], bpe.decode_all(part.column(at))], [*[part.schema.names[k] for k in kept], text])

    return df.mapInArrow(run, T.StructType([*[f for f in df.schema.fields if f.name != text], T.StructField(text, T.StringType())]))


def encode_decode(df: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Replace the text by its ids, as `encode` gives them, and by what they stand for, as `decode` does.

    Rows go through one Python worker, so that a task holds one batch of them and one vocabulary, and only slices of a batch come back.
    """
    path = path or vocabulary_path()
    kept = [f for f in df.schema.fields if f.name not in (text, ids, decoded)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        names = [*[f.name for f in kept], ids, decoded]
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in slices(batch, at):
                out = pa.array([bpe.encode(t) if t else b"" for t in part.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], out, bpe.decode_all(out)], names)

    return df.select(*[f.name for f in kept], text).mapInArrow(run, T.StructType([*kept, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())]))


def ids_array(ids: str = "ids") -> Column:
    """The ids of a binary column as an array of longs, in DataFrame functions."""
    h = F.hex(F.col(ids))
    word = lambda k: F.concat(*[F.substring(h, 8 * k + lo, F.lit(2)) for lo in (7, 5, 3, 1)])
    n = (F.octet_length(F.col(ids)) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.conv(word(k), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def with_digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 from real ids and decoded texts, which are dropped."""
    return df.select(
        *[c for c in df.columns if c not in (ids, decoded)],
        (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col(ids), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    """Encode every document and decode the ids again; digests of both."""
    encoded = encode(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    return with_digests(decode(encoded))
