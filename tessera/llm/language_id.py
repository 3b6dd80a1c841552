"""Language identification of words in code-switched text by a linear-chain conditional random field.

A word's features are its prefixes and suffixes of one to three characters, its
character bigrams and trigrams (hashed), and the languages whose lexicons hold
it. Scores of features and of transitions between languages are learned
together, by gradient ascent on the likelihood of spliced sequences: stretches
of labelled documents in different languages, joined, so that switches are
seen. Forward-backward gives each word's probability of each language; a
document's language is the one with the largest mean over its words.

All documents of a slice are processed at once. Words lie in chunks; each
chunk's product of transition and emission matrices is computed for all chunks
together, products are chained per document, and then messages within chunks.
This is exact, and a long document costs no more per word than a short one.

The model is fitted on at most DOCS_PER_LANGUAGE labelled documents of each of
the MAX_LANGUAGES most frequent languages (by text hash), the documented bound
of this classifier. Those texts stay on the executors, which count their words
for the lexicons and cut out the stretches that the driver has drawn: what
reaches the driver is SEQUENCES x SEQUENCE words and LEXICON words a language.

A text longer than a slice (SLICE_CELLS over the languages) is cut into blocks between words. Their products of
matrices are chained, then each block gets its messages from both sides, so that
memory follows the block and the result is that of the whole text.

Nulls and edge cases: a null text, or one without letters, is "und" with score
0; a null language isn't learned from, nor one beyond the MAX_LANGUAGES with the
most distinct texts (ties: the first in alphabetical order); without labelled
text all are "und"; texts are read whole, whatever their length, and a run of
letters longer than a block counts as several words; ties go to the first language
in alphabetical order; repeated rows get repeated results.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._common import crc_mod, documents, slices, staged

DOCS_PER_LANGUAGE = 300
MAX_LANGUAGES = 200
LEXICON = 1500
BUCKETS = 1 << 16
CHUNK = 32
SEQUENCE = 32
SEQUENCES = 4000
EPOCHS = 4
SLICE_CELLS = 800_000
BLOCK_CHARS = 500_000
UNKNOWN = "und"

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(29)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _SHIFT)) * _K2
        return x ^ (x >> _SHIFT)


@functools.lru_cache(maxsize=1)
def character_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 2 for a letter, 1 for a mark, else 0; and its lower-case form."""
    kind = np.zeros(sys.maxunicode + 2, np.uint8)
    lower = np.arange(sys.maxunicode + 2, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kind[c] = 2
            if len(x := chr(c).lower()) == 1:
                lower[c] = ord(x)
        elif k == "M":
            kind[c] = 1
    return kind, lower


class Words:
    """The words of several texts: features, lexicon keys, places, and the number per text."""

    def __init__(self, texts: list[str]):
        kind, lower = character_tables()
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        k = kind[codes]
        inside = k > 0
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = self.ends - self.starts
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        text_of = np.searchsorted(self.text_start, self.starts, side="right") - 1
        self.count = np.bincount(text_of, minlength=len(texts))
        letters = np.concatenate([[0], np.cumsum(k == 2)])
        self.letters = letters[np.minimum(self.text_start + lengths, len(codes))] - letters[self.text_start]
        c = lower[codes[inside]].astype(np.uint64)
        n = len(c)
        self.first = np.concatenate([[0], np.cumsum(size)])[:-1]  # of each word, among word characters
        self.size = size
        with np.errstate(over="ignore"):
            h1 = _mix((c + np.uint64(1)) * _K1)
            pad = np.zeros(2, np.uint64)
            cc = np.concatenate([c, pad])
            h2 = _mix(h1 * _K1 + cc[1 : n + 1])
            h3 = _mix(h2 * _K1 + cc[2 : n + 2])
            place = np.arange(n, dtype=np.uint64) - np.repeat(self.first, size).astype(np.uint64)
            self.key = np.add.reduceat(_mix(h1 + (place + np.uint64(7)) * _K2), self.first) if n else np.empty(0, np.uint64)
        left = np.repeat(self.first + size, size) - np.arange(n)  # characters from here to the word's end
        spread = lambda h, salt: (1 + (h ^ np.uint64(salt * 0x51ED2705)) % np.uint64(BUCKETS - 1)).astype(np.int32)
        self.bigrams = np.where(left >= 2, spread(h2, 1), 0)
        self.trigrams = np.where(left >= 3, spread(h3, 2), 0)
        at, last = self.first, self.first + size
        affix = []
        for m, h in ((1, h1), (2, h2), (3, h3)):
            ok = size >= m
            affix.append(np.where(ok, spread(h[at], 10 + m), 0))
            affix.append(np.where(ok, spread(h[np.maximum(last - m, 0)], 20 + m), 0))
        self.affixes = np.stack(affix, axis=1) if n else np.zeros((0, 6), np.int32)

    def __len__(self) -> int:
        return len(self.starts)


class Model:
    """Weights of a fitted field. Row 0 of `features` is zero: the feature that isn't there."""

    def __init__(self, languages: list[str], lexicon: tuple[np.ndarray, np.ndarray]):
        n = len(languages)
        self.languages = languages
        self.keys, self.member = lexicon
        self.features = np.zeros((BUCKETS, n), np.float32)
        self.lexicon = np.zeros((n, n), np.float32)
        self.transitions = np.zeros((n, n), np.float32)

    def in_lexicon(self, keys: np.ndarray) -> np.ndarray:
        """Which languages' lexicons hold each word."""
        if not len(self.keys):
            return np.zeros((len(keys), len(self.languages)), np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.member[at] * (self.keys[at] == keys)[:, None]

    def emissions(self, w: Words) -> np.ndarray:
        if not len(w):
            return np.zeros((0, len(self.languages)), np.float32)
        grams = self.features[w.bigrams] + self.features[w.trigrams]
        out = np.add.reduceat(grams, w.first, axis=0)
        for k in range(w.affixes.shape[1]):
            out += self.features[w.affixes[:, k]]
        return out + self.in_lexicon(w.key) @ self.lexicon


def _potentials(scores: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition factors, up to a constant for each word."""
    return np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30, np.exp(transitions - transitions.max()).astype(np.float64)


def block_product(scores: np.ndarray, transitions: np.ndarray, opening: bool) -> np.ndarray:
    """The product of a block's transition and emission matrices, up to a constant. An opening block has no transition before its first word."""
    e, a = _potentials(scores, transitions)
    out, step = None, max(1, SLICE_CELLS // len(a) ** 2)
    for lo in range(0, len(e), step):
        m = a[None] * e[lo : lo + step, None, :]
        if opening and not lo:
            m[0] = np.diag(e[0])
        while len(m) > 1:  # neighbours are multiplied until one is left
            odd = m[-1:] if len(m) % 2 else m[:0]
            m = np.concatenate([m[: len(m) // 2 * 2 : 2] @ m[1::2], odd])
            m /= m.max(axis=(1, 2), keepdims=True)
        out = m[0] if out is None else out @ m[0]
        out /= out.max()
    return out


def forward_backward(scores: np.ndarray, count: np.ndarray, transitions: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Each word's probability of each label. scores: emissions of all sequences, one after the other; count: words of each.

    A single sequence may be a block of a longer one: before and after are the messages of what precedes and follows it.
    """
    n, k = scores.shape
    if not n:
        return scores
    e, a = _potentials(scores, transitions)
    count = count[count > 0]
    chunks = -(-count // CHUNK)
    total = int(chunks.sum())
    first = np.concatenate([[0], np.cumsum(chunks)])[:-1]
    base = np.concatenate([[0], np.cumsum(count)])[:-1]
    order = np.arange(total) - np.repeat(first, chunks)
    begin = np.repeat(base, chunks) + order * CHUNK
    size = np.minimum(CHUNK, np.repeat(base + count, chunks) - begin)
    opening = (order == 0) & (before is None)
    grid = np.minimum(begin[:, None] + np.arange(CHUNK), n - 1)
    p = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(CHUNK):
        live = np.flatnonzero(size > t)
        if not len(live):
            break
        step = p[live]
        moved = step @ a if t else np.where(opening[live, None, None], step, step @ a)
        moved *= e[grid[live, t]][:, None, :]
        p[live] = moved / moved.max(axis=(1, 2), keepdims=True)
    enter, leave = np.ones((total, k)), np.ones((total, k))
    if before is not None:
        enter[0] = before
    if after is not None:
        leave[-1] = after
    by_length = np.argsort(-chunks, kind="stable")
    f, c = first[by_length], chunks[by_length]
    for j in range(int(c[0]) - 1):
        at = f[: int(np.searchsorted(-c, -(j + 1), side="left"))] + j  # sequences with a chunk after this one
        x = np.einsum("ni,nij->nj", enter[at], p[at])
        enter[at + 1] = x / x.sum(axis=1, keepdims=True)
    for j in range(int(c[0]) - 1, 0, -1):
        at = f[: int(np.searchsorted(-c, -j, side="left"))] + j
        x = np.einsum("nij,nj->ni", p[at], leave[at])
        leave[at - 1] = x / x.sum(axis=1, keepdims=True)
    alpha = np.empty((CHUNK, total, k))
    now = enter
    for t in range(CHUNK):
        moved = now @ a if t else np.where(opening[:, None], now, now @ a)
        moved = moved * e[grid[:, t]]
        now = moved / moved.sum(axis=1, keepdims=True)
        alpha[t] = now
    out = np.empty((n, k))
    beta = leave.copy()
    for t in range(CHUNK - 1, -1, -1):
        live = np.flatnonzero(size > t)
        if not len(live):
            continue
        inner = live[size[live] > t + 1]
        if len(inner):
            x = (e[grid[inner, t + 1]] * beta[inner]) @ a.T
            beta[inner] = x / x.sum(axis=1, keepdims=True)
        m = alpha[t][live] * beta[live]
        out[grid[live, t]] = m / m.sum(axis=1, keepdims=True)
    return out


def _draw(own: list[list[tuple[int, int]]], seed: int) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """Stretches (sequence, text, first word, words) of spliced sequences, in order, and the labels of all their words.

    own: for each label, the numbers and word counts of its texts. Labels, then texts, are drawn evenly.
    """
    rng = np.random.default_rng(seed)
    live = [i for i, texts in enumerate(own) if texts]
    plan, labels = [], np.empty((SEQUENCES, SEQUENCE), np.int64)
    for s in range(SEQUENCES if live else 0):
        have = 0
        while have < SEQUENCE:
            y = live[rng.integers(len(live))]
            d, n = own[y][rng.integers(len(own[y]))]
            m = int(rng.integers(4, SEQUENCE + 1))
            lo = int(rng.integers(max(1, n - m + 1)))
            m = min(m, n - lo, SEQUENCE - have)
            plan.append((s, d, lo, m))
            labels[s, have : have + m] = y
            have += m
    return plan, labels


def _flat_features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the features of all words, one word after the other, and where each word's begin."""
    n, gram_of = len(w), np.repeat(np.arange(len(w), dtype=np.int32), w.size)
    index = np.concatenate([w.bigrams, w.trigrams, w.affixes.ravel()])
    word = np.concatenate([gram_of, gram_of, np.repeat(np.arange(n, dtype=np.int32), 6)])
    word, index = word[index > 0], index[index > 0]
    order = np.argsort(word, kind="stable")
    return index[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n))])


def learn(model: Model, sequences: list[str], label: np.ndarray, seed: int = 5) -> Model:
    """Adagrad on the likelihood of sequences of SEQUENCE words each; label: of each word."""
    n = len(model.languages)
    rng = np.random.default_rng(seed)
    w = Words(sequences)
    label = label.ravel()
    known = model.in_lexicon(w.key)
    feats, begin = _flat_features(w)
    sums = [np.full_like(x, 1e-2) for x in (model.features, model.lexicon, model.transitions)]
    rows = 64
    eye = np.eye(n, dtype=np.float32)
    for _ in range(EPOCHS):
        deal = rng.permutation(len(sequences))
        for lo in range(0, len(deal), rows):
            batch = deal[lo : lo + rows, None] * SEQUENCE + np.arange(SEQUENCE)
            flat = batch.ravel()
            index = np.concatenate([feats[begin[b[0]] : begin[b[-1] + 1]] for b in batch])
            word = np.repeat(np.arange(len(flat)), begin[flat + 1] - begin[flat])
            e = np.zeros((len(flat), n))
            np.add.at(e, word, model.features[index])
            e += known[flat] @ model.lexicon
            y = label[batch]
            # forward-backward over all sequences of the batch, in log space
            t = model.transitions.astype(np.float64)
            e3 = e.reshape(len(batch), SEQUENCE, n)
            up, down = np.zeros_like(e3), np.zeros_like(e3)
            up[:, 0] = e3[:, 0]
            for k in range(1, SEQUENCE):
                z = up[:, k - 1, :, None] + t
                top = z.max(axis=1, keepdims=True)
                up[:, k] = np.log(np.exp(z - top).sum(axis=1)) + top[:, 0] + e3[:, k]
            for k in range(SEQUENCE - 2, -1, -1):
                z = t + (e3[:, k + 1] + down[:, k + 1])[:, None, :]
                top = z.max(axis=2, keepdims=True)
                down[:, k] = np.log(np.exp(z - top).sum(axis=2)) + top[:, :, 0]
            top = up[:, -1].max(axis=1, keepdims=True)
            log_z = np.log(np.exp(up[:, -1] - top).sum(axis=1)) + top[:, 0]
            p = np.exp(up + down - log_z[:, None, None])
            pair = np.exp(up[:, :-1, :, None] + t + (e3 + down)[:, 1:, None, :] - log_z[:, None, None, None]).sum(axis=(0, 1))
            np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            g = (p.reshape(-1, n) - eye[label[flat]]).astype(np.float32) / len(batch)
            used, where = np.unique(index, return_inverse=True)
            grad = np.zeros((len(used), n), np.float32)
            np.add.at(grad, where, g[word])
            sums[0][used] += grad**2
            model.features[used] -= 0.3 * grad / np.sqrt(sums[0][used])
            for k, (weight, grad) in enumerate(((model.lexicon, known[flat].T @ g + 1e-3 * model.lexicon), (model.transitions, pair.astype(np.float32) / len(batch) + 1e-3 * model.transitions)), 1):
                sums[k] += grad**2
                weight -= 0.3 * grad / np.sqrt(sums[k])
    model.features[0] = 0
    return model


def _blocks(text: str, size: int = BLOCK_CHARS) -> list[tuple[int, str]]:
    """The text in blocks of about `size` characters, cut between words, each with its offset."""
    if len(text) <= size:
        return [(0, text)]
    kind, _ = character_tables()
    out, lo = [], 0
    while lo < len(text):
        hi = min(len(text), lo + size)
        while lo < hi < len(text) and kind[ord(text[hi])] and kind[ord(text[hi - 1])]:
            hi -= 1
        hi = hi if hi > lo else min(len(text), lo + size)
        out.append((lo, text[lo:hi]))
        lo = hi
    return out


def training_texts(df: DataFrame, text: str, label: str, per_language: int = DOCS_PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """(l, h, t): at most per_language distinct texts of each label, those of least hash, of the max_languages labels with the most.

    Hashes are made distinct, then ranked, which each task does for itself before any are dealt by label.
    """
    rows = df.filter(F.col(text).rlike(r"\p{L}") & F.col(label).isNotNull()).select(F.col(text).alias("t"), F.col(label).alias("l"), F.xxhash64(text).alias("h"))
    distinct = staged(rows.select("l", "h").distinct(), "text-hashes")
    most = distinct.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(max_languages).select("l")
    ranked = distinct.withColumn("rank", F.row_number().over(Window.partitionBy("l").orderBy("h"))).filter(F.col("rank") <= per_language)
    chosen = staged(ranked.join(F.broadcast(most), "l", "left_semi").select("l", "h"), "chosen-hashes")  # max_languages x per_language rows at most
    return staged(rows.join(F.broadcast(chosen), ["l", "h"], "left_semi").groupBy("l", "h").agg(F.min("t").alias("t")).repartition(16, "h"), "training-texts")


def _lexicons(texts: DataFrame) -> list[tuple[str, int]]:
    """(label, key) of the LEXICON most frequent words of each label, of those met twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for _, part in _blocks(t):
                    key, n = np.unique(Words([part]).key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n, pa.int64())], ["l", "key", "n"])

    counts = texts.select("l", "t").mapInArrow(run, "l string, key long, n long").groupBy("l", "key").agg(F.sum("n").alias("n")).filter("n > 1")
    order = Window.partitionBy("l").orderBy(F.desc("n"), "key")
    return [(r.l, r.key) for r in counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= LEXICON).select("l", "key").collect()]


def _word_counts(texts: DataFrame) -> list[tuple]:
    """(l, h, number of words) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [sum(len(Words([part])) for _, part in _blocks(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["l", "h", "n"])

    return sorted((r.l, r.h, r.n) for r in texts.select("l", "h", "t").mapInArrow(run, "l string, h long, n long").collect())


def _cut_out(texts: DataFrame, wanted: dict[tuple[str, int], list[tuple[int, int, int]]]) -> dict[int, str]:
    """The words of stretches (number, first word, words) of texts, joined by spaces."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)  # a few per sequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, h, t in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                at, words = [], []
                base = 0
                for _, part in _blocks(t):
                    w = Words([part])
                    for k, lo, m in shared.value.get((name, h), []):
                        here = range(max(lo, base), min(lo + m, base + len(w)))
                        if here:
                            at.append(k)
                            words.append(" ".join(part[w.starts[i - base] : w.ends[i - base]] for i in here))
                    base += len(w)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(range(len(at)), pa.int32()), pa.array(words, pa.string())], ["k", "i", "t"])

    found: dict[int, str] = {}
    for r in sorted(texts.select("l", "h", "t").mapInArrow(run, "k long, i int, t string").collect()):
        found[r.k] = f"{found[r.k]} {r.t}" if r.k in found else r.t
    return found


def fit(df: DataFrame, text: str = "text", label: str = "lang", per_language: int = DOCS_PER_LANGUAGE, max_languages: int = MAX_LANGUAGES, seed: int = 5) -> Model:
    """Learn from the labelled rows of df."""
    texts = training_texts(df.withColumn(label, F.col(label).cast("string")), text, label, per_language, max_languages)
    counted = [r for r in _word_counts(texts) if r[2]]
    languages = sorted({r[0] for r in counted})
    at = {x: i for i, x in enumerate(languages)}
    member: dict[int, np.ndarray] = {}
    for name, key in _lexicons(texts) if languages else []:
        member.setdefault(key, np.zeros(len(languages), np.float32))[at[name]] = 1
    keys = np.array(list(member), np.int64).view(np.uint64)
    order = np.argsort(keys)
    model = Model(languages, (keys[order], np.array(list(member.values()), np.float32).reshape(len(keys), len(languages))[order]))
    if not languages:
        return model
    own: list[list[tuple[int, int]]] = [[] for _ in languages]
    for d, (name, _, n) in enumerate(counted):
        own[at[name]].append((d, n))
    plan, labels = _draw(own, seed)
    wanted: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
    for k, (_, d, lo, m) in enumerate(plan):
        wanted.setdefault(counted[d][:2], []).append((k, lo, m))
    cut = _cut_out(texts, wanted)
    sequences: list[list[str]] = [[] for _ in range(SEQUENCES)]
    for k, (s, _, _, _) in enumerate(plan):
        sequences[s].append(cut[k])
    return learn(model, [" ".join(x) for x in sequences], labels, seed)


def _found(m: Model, text: str, size: int) -> tuple[int, float, list[tuple[int, int, int]]]:
    """Language, score and spans (start, end, language) of one text, block by block."""
    none = len(m.languages), 0.0, []
    blocks = _blocks(text, size)
    if not m.languages:
        return none
    counts, letters, products = [], 0, []
    for _, part in blocks:
        w = Words([part])
        counts.append(len(w))
        letters += int(w.letters.sum())
        products.append(block_product(m.emissions(w), m.transitions, not products) if len(w) else None)
    live = [b for b, n in enumerate(counts) if n]
    if not live or not letters:
        return none
    k = len(m.languages)
    before, after = {live[0]: None}, {live[-1]: None}
    now = np.ones(k)
    for b, following in zip(live, live[1:]):
        now = now @ products[b]
        now = before[following] = now / now.sum()
    now = np.ones(k)
    for b, preceding in zip(live[::-1], live[-2::-1]):
        now = products[b] @ now
        now = after[preceding] = now / now.sum()
    total, spans = np.zeros(k), []
    for b in live:
        w = Words([blocks[b][1]])
        p = forward_backward(m.emissions(w), w.count, m.transitions, before[b], after[b])
        total += p.sum(axis=0)
        each = p.argmax(axis=1)
        cut = [0, *(np.flatnonzero(np.diff(each)) + 1).tolist(), len(each)]
        for lo, hi in zip(cut, cut[1:]):
            start, end, y = blocks[b][0] + int(w.starts[lo]), blocks[b][0] + int(w.ends[hi - 1]), int(each[lo])
            if spans and lo == 0 and spans[-1][2] == y:
                start = spans.pop()[0]
            spans.append((start, end, y))
    mean = total / sum(counts)
    return int(mean.argmax()), float(np.clip(mean.max(), 0.0, 1.0)), spans


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", spans: bool = False, carry: list[str] | None = None) -> DataFrame:
    """One row per row of df: id, lang_pred, score, the columns of `carry`, and with `spans` the stretches of words in one language: (start, end, lang), in characters.

    If the text is among `carry`, the one copy that is read comes back.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages x BUCKETS numbers
    carry = carry or []
    beside = [c for c in carry if c != text or not isinstance(df.schema[c].dataType, T.StringType)]
    carried_at = [2 + beside.index(c) if c in beside else 1 for c in carry]
    budget = max(50_000, SLICE_CELLS // max(1, len(model.languages)))

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def long_one(m: Model, names: np.ndarray, part: pa.RecordBatch, t: str) -> pa.RecordBatch:
        best, score, found = _found(m, t, budget)
        out = [part.column(0), pa.array([names[best]], pa.string()), pa.array([score], pa.float64())]
        if spans:
            out.append(pa.array([[{"start": a, "end": b, "lang": names[y]} for a, b, y in found]], span))
        return pa.RecordBatch.from_arrays([*out, *[part.column(k) for k in carried_at]], [x.name for x in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for part in slices(batch, 1, budget):
                texts = [t or "" for t in part.column(1).to_pylist()]
                if len(texts) == 1 and len(texts[0]) > budget:
                    yield long_one(m, names, part, texts[0])
                    continue
                w = Words(texts)
                p = forward_backward(m.emissions(w), w.count, m.transitions) if m.languages else np.zeros((len(w), 0))
                best, score = np.full(len(texts), len(m.languages)), np.zeros(len(texts))
                live = np.flatnonzero((w.count > 0) & (w.letters > 0)) if m.languages else np.empty(0, np.int64)
                begin = np.concatenate([[0], np.cumsum(w.count)])
                if len(live):
                    sums = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
                    mean = (sums[begin[live + 1]] - sums[begin[live]]) / w.count[live, None]
                    best[live] = mean.argmax(axis=1)
                    score[live] = np.clip(mean.max(axis=1), 0.0, 1.0)
                out = [part.column(0), pa.array(names[best], pa.string()), pa.array(score, pa.float64())]
                if spans:
                    each = p.argmax(axis=1) if p.shape[1] else np.zeros(len(w), np.int64)
                    found = []
                    for d in range(len(texts)):
                        lo, hi = int(begin[d]), int(begin[d + 1])
                        if not score[d]:
                            found.append([])
                            continue
                        cut = [lo, *(np.flatnonzero(np.diff(each[lo:hi])) + lo + 1).tolist(), hi]
                        found.append([{"start": int(w.starts[a] - w.text_start[d]), "end": int(w.ends[b - 1] - w.text_start[d]), "lang": names[each[a]]} for a, b in zip(cut, cut[1:])])
                    out.append(pa.array(found, span))
                yield pa.RecordBatch.from_arrays([*out, *[part.column(k) for k in carried_at]], [x.name for x in schema])

    fields = [T.StructField("id", df.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if spans:
        fields.append(T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))))
    schema = T.StructType([*fields, *[df.schema[c] for c in carry]])
    out = df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"), *beside).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict every document; learn from those whose id's checksum isn't 1 mod 3."""
    docs = documents(spark, sf_dir)
    model = fit(docs.filter(crc_mod(F.col("doc_id"), 3) != 1))
    found = predict(docs, model)
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
