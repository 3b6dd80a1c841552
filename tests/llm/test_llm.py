"""The text operators: against brute force, the tokenizers library and SQL; and on nulls, ties, repeats, empty tables and clashing names."""

import cProfile
import glob
import hashlib
import math
import os
import random
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import attention_lm as lm
from tessera.llm import bpe, chosen_path, language_id, licenses, mixing, quality, sharding, token_counts, topk
from tessera.operators import graph

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n_tokens int, row int, ids string, score string, stratum string, sampled string, tokens string"
LONG = " ".join(f"word{i % 977}" for i in range(20_000))
BASE = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark green forest near the old stone bridge while the moon shines bright over the hills and the river flows slowly to the sea past quiet farms and sleeping towns".split()


def near(n):
    return " ".join([*BASE, f"tail{n}"])


TEXTS = [
    None, "", "   \n\t", "12 345 !!", "Hello<|endoftext|> world<|endoftext|>", near(1), near(1), near(2), near(3), " ".join(reversed(BASE)), LONG, LONG, "Licensed under CC BY-NC 4.0.\nAll rights reserved. all RIGHTS reserved",
    "This work is licensed under the GNU General Public License, version 3.", "Der schnelle braune Fuchs springt über den faulen Hund", "a b", "a b", "A  B", "x" * 3000, "漢字 ñandú İstanbul Kc by",
]


@pytest.fixture(scope="module")
def docs(spark):
    langs = ["en", None, "de"]
    rows = [(None if i in (3, 9) else 7 if i in (15, 16) else i, t, langs[i % 3], None if i % 4 == 0 else "src0", 0, "k", 1, 2, "x", "y", "z", "s", "t") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


def by_text(df, docs, columns):
    """Results per text; rows of ids that repeat or are null are compared as multisets elsewhere."""
    d = docs.filter("doc_id IS NOT NULL AND doc_id != 7").select("doc_id", "text")
    return {r.text: r for r in df.join(d, "doc_id").select("text", *columns).collect()}


# --- tokens ------------------------------------------------------------------


def test_ids_equal_the_library(library):
    b, r = bpe.load(bpe.vocabulary_path()), random.Random(3)
    letters = " \n\t'stréè0<|endoftext|>.,!　\x1c\x85ñ漢🙂́"
    texts = [t for t in TEXTS if t] + ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(3000)]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = b.encode(t)
        assert np.frombuffer(ids, np.uint32).tolist() == e.ids
        assert b.decode(ids) == library.decode(e.ids, skip_special_tokens=False)


def test_short_and_long_merges_agree():
    b, r = bpe.load(bpe.vocabulary_path()), random.Random(4)
    for _ in range(300):
        w = "".join(r.choice("abcde theinr") for _ in range(r.randint(1, 500))).encode()
        assert b.merge_short(w) == b.merge_long(w)


def test_stretches_share_pretokens_and_columns_are_decoded_at_once(library, monkeypatch):
    b, r = bpe.RankedBPE(bpe.vocabulary_path()), random.Random(6)
    merged = []
    merge = b.merge
    monkeypatch.setattr(b, "merge", lambda w: merged.append(w) or merge(w))
    b.encode("a zyxwv, zyxwv. zyxwv; (zyxwv)")
    assert merged.count(b" zyxwv") == 1  # once for each of three stretches before
    texts = ["".join(r.choice([" ", " ", "  ", "\n", "\u3000", "\x1c", "\x85", "the", "ß€", ",", "7", "'s", "<|endoftext|>"]) for _ in range(r.randrange(12))) for _ in range(3000)]
    ids = [b.encode(t) for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(b, "decode", None)
    assert b.decode_all(pa.array([*ids, None], pa.binary())).to_pylist() == [*texts, ""]
    assert b.decode_all(pa.array([None, b""], pa.binary()).slice(1)).to_pylist() == [""] and len(b.decode_all(pa.array([], pa.binary()))) == 0
    euro = [x.to_bytes(4, "little") for x in (b.byte_id[v] for v in "€".encode())]
    parts = [euro[0] + euro[1], euro[2], b"".join(euro)]  # two rows that are a character together, but not each
    assert b.decode_all(pa.array(parts, pa.binary())).to_pylist() == [library.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in parts]


def test_encode_decode_rows(docs, library):
    out = bpe.with_digests(bpe.decode(bpe.encode(docs.select("doc_id", "text"))))
    assert out.count() == len(TEXTS)
    for t, r in by_text(out.drop("text"), docs, ["n_tokens", "ids_sha256", "decoded_sha256"]).items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_ids_as_array(docs, library):
    r = bpe.encode(docs.filter("doc_id = 5").select("text")).select("text", bpe.ids_array().alias("a")).first()
    assert r.a == library.encode(r.text, add_special_tokens=False).ids


def test_registered_token_queries_equal_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    counted = entry.queries()["op2_token_counts"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in counted} == {i: (len(t.encode()), len(ids[i]), len(ids[i]) > 512) for i, t in texts.items()}
    coded = entry.queries()["op7_bpe_encode_decode"](spark, sf_dir).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {i: (len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x, skip_special_tokens=False).encode())) for i, x in ids.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded} == want and len(counted) == len(coded) == len(texts)


def test_empty_tables_give_no_rows(docs, empty):
    assert token_counts.count_tokens(empty).count() == 0 and licenses.scan(empty).count() == 0
    assert lm.score(empty, lm.fit(empty, lm.word_counts(empty)), lm.word_counts(empty)).count() == 0


@pytest.mark.parametrize("head", [0, 50, 1000])
def test_token_counts(docs, library, head):
    out = token_counts.count_tokens(docs, head_entries=head, head_sample=1)
    got = sorted((r.n_bytes, r.n_tokens) for r in out.collect())
    assert got == sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in TEXTS)


# --- licenses and quality ----------------------------------------------------


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", ["op4_license_scan", "op5_quality_rules", "op6_exact_top_k", "op8_ngram_jaccard_join"])
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    got = duck.execute(entry.oracle_sql()[name])
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(got.fetchall(), [d[0] for d in got.description])


def test_licenses_on_edges(docs, duck):
    out = licenses.scan(docs)
    r = by_text(out, docs, ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    assert (r[TEXTS[12]].n_base, r[TEXTS[12]].first_word, r[TEXTS[12]].last_word) == (3, 2, 10)
    assert r[TEXTS[12]].labels == "cc-by,reserved,template:cc-by-nc-4.0,template:reserved" and r[TEXTS[12]].score == 1.0
    assert r[TEXTS[13]].base_labels == "gpl" and "template:gpl-3.0" in r[TEXTS[13]].labels
    assert r[TEXTS[19]].n_base == 0 and r[""].n_words == 0 and r[""].labels == "" and r[""].score == 0.0
    assert out.count() == len(TEXTS)


def brute_force_labels(text, templates, threshold):
    """Labels of blocks by comparison with every template: a line and the words that follow it."""
    tokens, reach = licenses.template_tokens(templates), licenses.reaches(templates)
    family = licenses.families(tokens, threshold)
    words, out, at = licenses.template_words(text or ""), set(), 0
    for line in (text or "").split("\n"):
        n = len(licenses.template_words(line))
        hits = {}
        for k, t in tokens.items():
            shared = len(set(t) & set(words[at : at + n + reach[k] - 1])) if n else 0
            if shared >= threshold * len(t) - 1e-9:
                hits[k] = shared / len(t)
        out |= {k for k, x in hits.items() if x == max(y for j, y in hits.items() if family[j] == family[k] and reach[j] == reach[k])}
        at += n
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_license_join_against_every_pair(spark, threshold):
    r = random.Random(int(threshold * 10))
    words = [f"w{i}" for i in range(40)]
    templates = {f"t{k}": " ".join(r.choice(words) for _ in range(r.choice([1, 3, 6, 7, 20, 45]))) for k in range(12)} | {"blank": "..."}
    texts = [None, "", "\n\n"]
    for _ in range(80):
        t = [r.choice(words + [f"x{i}" for i in range(200)]) for _ in range(r.randint(1, 60))]
        for _ in range(r.randint(0, 2)):
            own = licenses.template_words(r.choice(list(templates.values())))
            own = [w for w in own if r.random() < 0.9]
            at = r.randrange(len(t) + 1)
            t[at:at] = own
        texts.append("".join(w + r.choice("     \n") for w in t))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {x.doc_id: set(filter(None, x.labels.split(","))) for x in licenses.scan(d, templates, threshold, {}).collect()}
    want = {i: brute_force_labels(t, templates, threshold) for i, t in enumerate(texts)}
    assert got == want and sum(map(len, want.values())) > 20


def test_wrapped_notices_and_siblings(spark):
    t = licenses.TEMPLATES
    wrap = lambda s, n: "\n".join(" ".join(s.split()[i : i + n]) for i in range(0, len(s.split()), n))
    texts = [wrap(t["text:mit"], 9), "x y z " + wrap(t["text:apache-2.0"], 7), "Licensed under\nCC BY-SA\n4.0", "Licensed under the Apache License 2.0", wrap(t["template:bsd"], 6) + " provided", "Licensed under a licence"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {x.doc_id: x.labels for x in licenses.scan(d).collect()}
    assert "text:mit" in got[0] and "text:apache-2.0" in got[1] and "template:apache-2.0" in got[1]
    assert got[2] == "cc-by,template:cc-by-sa-4.0" and got[3] == "template:apache-2.0" and got[4] == "template:bsd" and got[5] == ""


def test_repeats_cover_words(spark):
    t = ["a b c a b c", "a b c d a b c", "x x x x x", "a b", "a a a b", "l one\nl one\n\n \nl one"]
    d = spark.createDataFrame(list(enumerate(t)), "i int, text string")
    got = {r.i: (r.n_repeat_words, r.n_dup_lines) for r in quality.text_counts(d).collect()}
    assert got == {0: (6, 0), 1: (6, 0), 2: (5, 0), 3: (0, 0), 4: (0, 0), 5: (6, 2)}


def test_binomial_bound_is_exact(spark):
    rows = [(n,) for n in (1, 50, 300, 2000, 100_000)]
    d = spark.createDataFrame(rows, "n long")
    out = quality.largest_safe(d.withColumn("s", F.col("n").cast("string")), ["s"], "n", 0.02, F.lit(0.01)).collect()
    for r in out:
        n, total, k = int(r.s), 0.0, None
        for j in range(n + 1):
            total += math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(0.02) + (n - j) * math.log(0.98))
            if total > 0.01:
                break
            k = j
        assert r.k_max == k


def test_false_rejections_stay_bounded(spark, docs):
    r = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(r.choice(words) for _ in range(80)) + (" #" * r.randint(0, 5)), "en") for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = d.select("doc_id", F.lit(1).alias("quality"))
    out = quality.judge(d, labels)
    assert out.filter("NOT kept AND NOT base_failed").count() <= 2000 * quality.MAX_FALSE_REJECTION
    kept = quality.keep_good(d, labels)
    assert kept.count() == out.filter("kept").count() and kept.columns == d.columns
    got = quality.judge(docs, labels.limit(0)).collect()
    assert len(got) == len(TEXTS) and all(x.kept == (not x.base_failed) for x in got)


# --- search ------------------------------------------------------------------


def test_top_k_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(300)] + [(2000, None), (2001, [1.0, None] * 3), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (None, [1.0] * 6), (1000, [0.5] * 6)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("tree", F.lit("clash"))
    q = d.filter("vec_id % 100 = 0")
    got = {}
    for r in topk.top_k(d, q, 5, tree_rows=100, query_block=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for qid, v in {i: v for i, v in good if i % 100 == 0}.items():
        best = sorted(((-int(v @ w), i) for i, w in good if i != qid))[:5]
        assert [(i, -s) for s, i in best] == [(i, s) for _, i, s in sorted(got[qid])]
    assert topk.top_k(d.limit(0), q.limit(0)).count() == 0


def test_top_k_of_components_that_overflow(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100, [2e15, 1.0, -3e14, 0.5]), (101, [1e300, 0.0, 0.0, 1.0]), (102, [-1e300, 2.0, 0.0, 0.0]), (103, [1e16, 1e16, 0.0, 1.0]), (200, [-1.0, 0.5, 0.25, 3.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(d, d.filter("vec_id % 50 = 0"), 5, tree_rows=16, query_block=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: topk._whole_numbers(v, 1024) for i, v in rows}
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        assert sorted(got[q]) == [(n, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(best, 1)]


def test_regions_leave_far_trees_alone(spark, monkeypatch):
    """Crowded clusters far apart: most regions are excluded by their radii, and the result is that of all pairs."""
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(12, 5)) * 8)[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 5)) * 0.05
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    met, search = [], topk._search
    monkeypatch.setattr(topk, "TREE_ROWS", 50)
    monkeypatch.setattr(topk, "_search", lambda pages, asked, *a: met.append((pages.select("tree").distinct().count(), asked.count())) or search(pages, asked, *a))
    got = {}
    for r in topk.top_k(d, d.filter("vec_id % 50 = 0"), 7, tree_rows=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    w = np.floor(1024 * v).astype(np.int64)
    for q in range(0, 1500, 50):
        best = sorted((-int(w[q] @ w[i]), i) for i in range(1500) if i != q)[:7]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    trees, pairs = met[1]
    assert trees >= 30 and pairs < 0.5 * 30 * trees


# --- near duplicates ---------------------------------------------------------


def classes(texts, threshold=0.8):
    def grams(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\n", " ").replace("\t", " ").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    g = [grams(t) for t in texts]
    links = {i: {j for j in range(len(g)) if j != i and g[i] and len(g[i] & g[j]) >= threshold * len(g[i] | g[j]) - 1e-9 and g[j]} for i in range(len(g))}
    root = list(range(len(g)))
    for _ in g:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(g))]
    return root, [len(links[i]) for i in range(len(g))]


def check_join(spark, texts, threshold=0.8, keep=False):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in chosen_path.join(d, threshold).collect())
    root, n = classes(texts, threshold)
    assert got == [(i, root[i], n[i]) for i in range(len(texts))]
    if keep:
        kept = [r.doc_id for r in chosen_path.keep_one(d, threshold=threshold).collect()]
        wordless = {i for i, t in enumerate(texts) if not (t or "").split()}
        assert sorted(kept) == sorted({r for r in root} | wordless)


def test_join_against_brute_force(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    texts = list(TEXTS[:10])
    for _ in range(25):
        t = [r.choice(words) for _ in range(r.randint(8, 90))]
        for _ in range(r.randint(1, 5)):
            u = list(t)
            for _ in range(r.randint(0, 4)):
                u[r.randrange(len(u))] = r.choice(words)
            texts.append(" ".join(u))
    check_join(spark, texts, keep=True)


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_join_at_other_thresholds_with_split_buckets(spark, monkeypatch, threshold):
    """Pairs just over the threshold among many quotes of the same passages, in buckets that are split down to the last depth."""
    monkeypatch.setattr(chosen_path, "BUCKET", 12)
    monkeypatch.setattr(chosen_path, "CELL_SETS", 12)
    r, texts = random.Random(11), []
    own = lambda n: [f"u{r.random()}" for _ in range(n)]
    for p in range(10):
        passage = [f"p{p}w{i}" for i in range(60)]
        texts += [" ".join([*passage, *own(70)]) for _ in range(14)]
        shared = int(60 * (1 - threshold) / (2 * threshold) * 0.8)
        texts += [" ".join([*passage, *own(shared)]) for _ in range(2)]
    check_join(spark, texts, threshold)


def test_join_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BUCKET", 20)
    monkeypatch.setattr(chosen_path, "BLOCK_SETS", 30)
    check_join(spark, [near(i % 90) for i in range(120)] + [" ".join(reversed(BASE))])


def test_join_of_short_copies_among_long_quotes(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BUCKET", 5)
    monkeypatch.setattr(chosen_path, "MAX_DEPTH", 2)
    monkeypatch.setattr(chosen_path, "CELL_SETS", 8, raising=False)
    r = random.Random(5)
    own = lambda n: [f"u{r.random()}" for _ in range(n)]
    texts = []
    for p in range(12):
        passage = [f"p{p}w{i}" for i in range(40)]
        texts += [" ".join([*passage, *own(45)]) for _ in range(60)] + [" ".join([*passage, *own(3)]) for _ in range(2)]
    check_join(spark, texts)


@pytest.mark.parametrize("depth", [2, 4, 8])
def test_runs_meet_the_recall_at_every_depth(depth):
    rng, pairs, recall = np.random.default_rng(8), 3000, 0.99
    a = rng.integers(0, 2**32, (pairs, chosen_path.SIZE), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 2**32, a.shape, dtype=np.uint32))
    met = np.zeros(pairs, bool)
    for root in range(1, chosen_path.runs_for(0.8, recall, depth) + 1):
        sides = []
        for m in (a, b):
            at, path = np.arange(pairs), chosen_path.walk(np.full(pairs, chosen_path.mix(np.uint64(root))), m, chosen_path.START)
            for _ in range(chosen_path.START, depth, chosen_path.STEP):
                path, row = chosen_path.children(path, m[at], 0.8)
                at = at[row]
            sides.append(set(zip(at.tolist(), path.tolist())))
        met[[i for i, _ in sides[0] & sides[1]]] = True
    met &= (a == b).sum(axis=1) >= chosen_path.candidate_matches(0.8, recall)
    assert 1 - met.mean() <= 1 - recall


def test_split_buckets_get_the_runs_of_their_depth(spark, monkeypatch):
    rounds = []
    one = chosen_path._round
    monkeypatch.setattr(chosen_path, "BUCKET", 5)
    monkeypatch.setattr(chosen_path, "CELL_SETS", 5)
    monkeypatch.setattr(chosen_path, "_round", lambda reps, first, last, *a: rounds.append((first, last, *(out := one(reps, first, last, *a))[2:])) or out)
    words = " ".join(f"p{i}" for i in range(40))
    check_join(spark, [f"{words} " + " ".join(f"u{n}x{i}" for i in range(45)) for n in range(60)])
    deepest = max(depth for _, _, depth in rounds)
    assert deepest > chosen_path.START and max(last for _, last, _ in rounds) >= chosen_path.runs_for(chosen_path.THRESHOLD, chosen_path.RECALL, deepest)


def test_a_join_deals_rows_a_few_times_a_level(spark, monkeypatch):
    """Each table that is dealt by a key costs as many tasks as there are partitions, however few its rows: at most five a level, one a round, ten more."""
    names, levels = [], []
    one, staged = chosen_path._round, chosen_path.staged
    monkeypatch.setattr(chosen_path, "BUCKET", 5)
    monkeypatch.setattr(chosen_path, "CELL_SETS", 5)
    monkeypatch.setattr(chosen_path, "staged", lambda df, name: names.append(name) or staged(df, name))
    monkeypatch.setattr(graph, "stage", lambda df, name: names.append(name) or staged(df, name))
    monkeypatch.setattr(chosen_path, "_round", lambda *a: levels.append(((out := one(*a))[2] - chosen_path.START) // chosen_path.STEP + 1) or out)
    words = " ".join(f"p{i}" for i in range(40))
    check_join(spark, [f"{words} " + " ".join(f"u{n}x{i}" for i in range(45)) for n in range(30)] + [near(i) for i in range(12)])
    assert max(levels) > 1 and len(names) <= 5 * sum(levels) + len(levels) + 10


def test_sets_on_few_paths_are_not_dealt_to_meet_their_tokens(spark, monkeypatch):
    """Joins on the path and on the key dealt all starts and all samples once more, of which few are in a bucket."""
    plans, staged = {}, chosen_path.staged
    monkeypatch.setattr(chosen_path, "staged", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and staged(df, name))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = spark.createDataFrame([(i, f"{near(i // 3)} {' '.join(f't{i % 3}' for _ in range(i % 3))}") for i in range(36)], "doc_id long, text string")
        reps = staged(chosen_path._sign(d, "doc_id", "text").filter("tokens IS NOT NULL").select("key", "tokens"), "reps")
        found = [set(map(tuple, chosen_path.candidate_edges(reps).collect()))]
        assert plans["buckets"].count("Exchange hashpartitioning") == 1
        for most, bucket in ((0, 200), (500_000, 2), (0, 2)):  # joins, and buckets beside their pivots, picked and joined
            monkeypatch.setattr(chosen_path, "BROADCAST_KEYS", most)
            monkeypatch.setattr(chosen_path, "BUCKET", bucket)
            found.append(set(map(tuple, chosen_path.candidate_edges(reps).collect())))
        assert found[0] and found[0] == found[1] and found[2] and found[2] == found[3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_join_on_edges(spark, docs, empty):
    out = chosen_path.join(docs)
    assert out.count() == len(TEXTS)
    assert chosen_path.join(empty).count() == 0 and chosen_path.keep_one(empty).count() == 0
    kept = chosen_path.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.text for r in kept.collect())[LONG] == 1 and Counter(r.text for r in kept.collect())[near(1)] == 1


# --- sharding ----------------------------------------------------------------


def test_shards(spark, sf_dir, docs, empty):
    out = entry.queries()["op9_sharding"](spark, sf_dir).toPandas()
    assert len(out) == out.doc_id.nunique()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    loads, shards_of = Counter(), {}
    for r in out.itertuples():
        assert r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.size == len((texts[r.doc_id] or "").encode()) + 1
        loads[r.shard] += r.size
        shards_of.setdefault(texts[r.doc_id], set()).add(r.shard)
    largest = max(out.groupby("vslot")["size"].sum())
    assert max(loads.values()) - min(loads.values()) <= largest
    small = {t for t in texts.values() if sum(len(t.encode()) + 1 for x in texts.values() if x == t) * 16 * sharding.GROUP_SHARE <= sum(loads.values())}
    assert all(len(shards_of[t]) == 1 for t in small)
    d = docs.select("doc_id", "text")
    got = sharding.shard(d, 4).collect()
    assert Counter((r["size"], r.text_crc32) for r in got) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in TEXTS)
    assert sharding.shard(empty, 4).count() == 0


def test_a_hot_text_is_dealt_and_the_map_is_edited(spark, tmp_path):
    rows = [(i % 3, "hot text " * 5) for i in range(4000)] + [(i, f"text {i % 400} " * (1 + i % 7)) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "maps")
    out = sharding.shard(d, 8, map_path=path).toPandas()
    loads = out.groupby("shard")["size"].sum()
    assert len(loads) == 8 and loads.max() < 1.02 * loads.mean() and out.groupby(["text_crc32"]).shard.nunique().max() == 8
    assert (out[out.text_crc32 != zlib.crc32(("hot text " * 5).encode())].groupby("text_crc32").shard.nunique() == 1).mean() > 0.9
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    again = sharding.shard(d.filter("doc_id < 2500"), 8, map_path=path)
    assert again.count() == d.filter("doc_id < 2500").count()
    first, last = sharding.SlotMap.load(spark, path, 1), sharding.SlotMap.load(spark, path)
    assert last.version >= 1 and sum(a != b for a, b in zip(first.shard_of, last.shard_of)) < 1000


def test_slot_map_versions(spark, tmp_path):
    r = random.Random(2)
    size = [r.randint(1, 1000) for _ in range(512)]
    m = sharding.SlotMap.build(size, 8)
    loads = m.loads(size)
    assert max(loads) - min(loads) <= max(size)
    g = m.rebalance(size, 9)
    moved = [s for s in range(512) if g.shard_of[s] != m.shard_of[s]]
    assert moved and all(g.shard_of[s] == 8 for s in moved) and g.version == 2
    assert abs(g.loads(size)[8] - sum(size) / 9) < max(size)
    size2 = [x * (5 if m.shard_of[i] == 0 else 1) for i, x in enumerate(size)]
    h = m.rebalance(size2)
    assert max(h.loads(size2)) < max(m.loads(size2)) and sum(a != b for a, b in zip(h.shard_of, m.shard_of)) < 100
    m.save(spark, str(tmp_path / "map"))
    g.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == g and sharding.SlotMap.load(spark, str(tmp_path / "map"), 1) == m


# --- mixing ------------------------------------------------------------------


def test_raking_meets_marginals(spark):
    rng = np.random.default_rng(1)
    codes = [rng.integers(0, k, 200) for k in (5, 4, 3)]
    tokens = rng.integers(1, 1000, 200).astype(float)
    goals = [rng.dirichlet(np.ones(k)) for k in (5, 4, 3)]
    fitted = mixing.rake(tokens, codes, goals)
    for c, g in zip(codes, goals):
        assert np.bincount(c, weights=fitted) / fitted.sum() == pytest.approx(g, abs=1e-8)
    w = fitted / tokens
    rate = mixing.rate_for(tokens, w, 0.3 * tokens.sum())
    assert (np.minimum(1, rate * w) * tokens).sum() == pytest.approx(0.3 * tokens.sum())


def test_raking_on_driver_and_as_a_table(spark):
    r = random.Random(5)
    rows = [(f"s{i}", f"l{j}", f"t{k}", r.randint(0, 900), 1) for i in range(3) for j in range(2) for k in range(2)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, n long")
    both = [{(x.source, x.lang, x.topic): x.probability for x in f(cells, {"lang": {"l0": 0.7, "none": 0.1}}, 0.4).collect()} for f in (mixing.rake_cells, mixing.rake_table)]
    assert both[0] == pytest.approx(both[1], abs=1e-8)
    assert sum(p * t for (*_, t, _), p in zip(rows, [both[0][x[:3]] for x in rows])) == pytest.approx(0.4 * sum(x[3] for x in rows))


def test_op3_query_against_loops(spark, sf_dir):
    """Every row of the registered query: cells, raking and the draw in plain Python."""
    rows = {r.doc_id: r for r in entry.queries()["op3_mixing"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert rows.keys() == {d.doc_id for d in docs}
    cells = Counter()
    for d in docs:
        r = rows[d.doc_id]
        assert (r.source, r.lang) == (d.source or "und", d.lang or "und") and r.n_tokens == len([w for w in (d.text or "").encode().split()])
        cells[r.source, r.lang, r.topic] += r.n_tokens
    total = sum(cells.values())
    goals = []
    for k, name in enumerate(mixing.DIMENSIONS):
        now = Counter()
        for c, n in cells.items():
            now[c[k]] += n / total
        named = mixing.TARGETS.get(name, {})
        raised = {v: x ** mixing.TEMPER[name] for v, x in now.items() if v not in named}
        left = 1 - sum(named.values())
        goal = {v: named.get(v, left * raised.get(v, 0) / (sum(raised.values()) or 1)) for v in now}
        goals.append({v: x / sum(goal.values()) * total for v, x in goal.items()})
    fitted = {c: float(n) for c, n in cells.items()}
    for _ in range(400):
        for k, goal in enumerate(goals):
            now = Counter()
            for c, n in fitted.items():
                now[c[k]] += n
            fitted = {c: n * goal[c[k]] / now[c[k]] for c, n in fitted.items()}
    weight = {c: fitted[c] / cells[c] for c in cells}
    lo, hi = 0.0, 1e6
    for _ in range(200):
        rate = (lo + hi) / 2
        lo, hi = (rate, hi) if sum(min(1, rate * weight[c]) * cells[c] for c in cells) < mixing.BUDGET * total else (lo, rate)
    for d in docs:
        r = rows[d.doc_id]
        w = weight[r.source, r.lang, r.topic]
        u = zlib.crc32(f"{mixing.SEED}:{d.doc_id}:{zlib.crc32((d.text or '').encode())}".encode()) / 2**32
        assert r.weight == pytest.approx(w, rel=1e-6) and r.probability == pytest.approx(min(1, lo * w), rel=1e-6)
        assert r.sampled == (u < r.probability)


def test_mixing_rows(spark, sf_dir, docs, empty):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = {r.doc_id: (r.probability, r.sampled) for r in mixing.mix(d).collect()}
    assert all(0 <= p <= 1 for p, _ in a.values())
    assert {r.doc_id for r in mixing.sample(d).collect()} == {i for i, (_, s) in a.items() if s}
    assert mixing.mix(docs).count() == len(TEXTS) and mixing.mix(empty).count() == 0 and mixing.sample(docs).columns == docs.columns


# --- language ----------------------------------------------------------------


def test_forward_backward():
    r = np.random.default_rng(0)
    for n, k in ((1, 2), (70, 4), (33, 3)):
        s, t = r.normal(size=(n, k)), r.normal(size=(k, k))
        a, b = s.copy(), np.zeros((n, k))
        for i in range(1, n):
            a[i] = np.log(np.exp(a[i - 1][:, None] + t).sum(0)) + s[i]
        for i in range(n - 2, -1, -1):
            b[i] = np.log(np.exp(t + (s[i + 1] + b[i + 1])[None]).sum(1))
        want = np.exp(a + b - np.log(np.exp(a[-1]).sum()))
        assert np.abs(language_id.forward_backward(s.astype(np.float32), np.array([n]), t) - want).max() < 1e-5


@pytest.fixture(scope="module")
def language_model(spark, sf_dir):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language_id.fit(d.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1), per_language=60)


def test_held_out_languages(spark, language_model, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    out = language_id.predict(d, language_model).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.98 and out.score.between(0, 1).all()
    rows = language_id.predict(docs, language_model).collect()
    r = by_text(language_id.predict(docs, language_model), docs, ["lang_pred", "score"])
    assert len(rows) == len(TEXTS) and r[""].lang_pred == "und" and r["   \n\t"].score == 0 and r[TEXTS[4]].lang_pred != "und"
    assert language_id.predict(empty, language_model).count() == 0
    assert {x.lang_pred for x in language_id.predict(docs, language_id.fit(empty)).collect()} == {"und"}


def test_training_texts_are_distinct_and_copies_hide_no_language(spark):
    few = [(f"alpha beta {i}", "xx") for i in range(12)]
    many = [(f"gamma delta {i}", "yy") for i in range(40)]
    d = spark.createDataFrame([*few * 900, *many, *many[:1] * 20_000], "text string, lang string")
    got = [(r.t, r.l) for r in language_id.training_texts(d, "text", "lang", 15).collect()]
    assert len(set(got)) == len(got)
    assert Counter(x for _, x in got) == {"xx": 12, "yy": 15}
    assert {r.l for r in language_id.training_texts(d, "text", "lang", 15, max_languages=1).collect()} == {"yy"}


def test_a_long_text_is_chained_over_blocks(spark, language_model, monkeypatch):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.length("text").between(2000, 2500)).orderBy("doc_id").limit(12)
    text = "\n".join(r.text for r in d.collect())
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    whole = language_id.predict(one, language_model, spans=True).first()
    best, score, spans = language_id._found(language_model, text, 700)
    assert language_model.languages[best] == whole.lang_pred and score == pytest.approx(whole.score, abs=1e-6)
    assert [(a, b, language_model.languages[y]) for a, b, y in spans] == [tuple(s) for s in whole.spans]
    assert len(language_id._blocks("x" * 100, 30)) == 4 and "".join(p for _, p in language_id._blocks(text, 700)) == text


def test_op1_query_against_word_by_word_messages(spark, sf_dir):
    """The registered query's rows, against log-space forward-backward of single texts with a model fitted anew."""
    rows = {r.doc_id: r for r in entry.queries()["op1_language_id"](spark, sf_dir).collect()}
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = language_id.fit(d.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    texts = {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
    assert rows.keys() == texts.keys()
    for i, t in list(texts.items())[:40]:
        s = m.emissions(language_id.Words([t])).astype(float)
        a, b, tr = s.copy(), np.zeros_like(s), m.transitions.astype(float)
        for k in range(1, len(s)):
            a[k] = np.logaddexp.reduce(a[k - 1][:, None] + tr, axis=0) + s[k]
        for k in range(len(s) - 2, -1, -1):
            b[k] = np.logaddexp.reduce(tr + (s[k + 1] + b[k + 1])[None], axis=1)
        p = np.exp(a + b - np.logaddexp.reduce(a + b, axis=1, keepdims=True)).mean(axis=0)
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert rows[i].lang_pred == m.languages[p.argmax()] and rows[i].score == pytest.approx(p.max(), abs=1e-4)


def test_switches_are_spans(spark, language_model):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = (d.filter(F.col("lang") == x).filter(F.length("text") > 300).select(F.substring("text", 1, 300)).first()[0] for x in ("de", "es"))
    mixed = spark.createDataFrame([(1, f"{a} {b}")], "doc_id long, text string")
    spans = language_id.predict(mixed, language_model, spans=True).first().spans
    right = sum(s.end - s.start for s in spans if s.lang == ("de" if s.start < 300 else "es"))
    assert right > 0.85 * 600 and len(spans) >= 2


# --- language model ----------------------------------------------------------


def test_gradients():
    rng = np.random.default_rng(0)
    net = lm.Network()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    n = lm.CONTEXT + lm.STRIDE
    args = rng.integers(0, lm.INPUTS, (3, n)), np.array([True, False, False]), rng.integers(0, lm.GROUPS * lm.MEMBERS, (3, lm.STRIDE)), rng.random((3, lm.STRIDE)) < 0.8
    _, g = net.gradients(*args)
    for k, v in net.w.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        old = v[at]
        v[at] = old + 1e-5
        up = net.gradients(*args)[0]
        v[at] = old - 1e-5
        down = net.gradients(*args)[0]
        v[at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-4)


def test_a_training_step_is_a_few_large_products():
    """Adam written out for each weight ends where the step on all weights at once does, and a step makes few calls."""
    rng = np.random.default_rng(4)
    n = lm.CONTEXT + lm.STRIDE
    args = rng.integers(0, lm.INPUTS, (96, n)), rng.random(96) < 0.2, rng.integers(0, lm.GROUPS * lm.MEMBERS, (96, lm.STRIDE)), rng.random((96, lm.STRIDE)) < 0.8
    net, plain = lm.Network(), lm.Network()
    calls = cProfile.Profile()
    calls.enable()
    losses = net.train(*args, epochs=2)
    calls.disable()
    assert len(losses) == 4 and sum(x.callcount for x in calls.getstats()) < 4 * 400
    r, step, m = np.random.default_rng(lm.SEED), 0, {k: [0.0, 0.0] for k in plain.w}
    for _ in range(2):
        order = r.permutation(96)
        for lo in (0, 48):
            loss, g = plain.gradients(*[a[order[lo : lo + 48]] for a in args])
            assert loss == pytest.approx(losses[step], rel=1e-5)
            step += 1
            for k, d in g.items():
                m[k] = [0.9 * m[k][0] + 0.1 * d, 0.99 * m[k][1] + 0.01 * d * d]
                plain.w[k] = plain.w[k] - (4e-3 * (1 - 0.95 * step / 4) * (m[k][0] / (1 - 0.9**step)) / (np.sqrt(m[k][1] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    assert all(np.allclose(net.w[k], plain.w[k], atol=2e-5) for k in plain.w)


def test_tasks_of_a_worker_cut_a_word_once():
    path = bpe.vocabulary_path()
    lm.subwords(path).ids([b"oncecutword"])
    assert b"oncecutword" in lm.subwords(path).cache


def test_sizes_of_the_network():
    assert (lm.WIDTH, lm.HIDDEN, lm.CONTEXT, lm.STRIDE) == (32, 64, 16, 32)


def test_windows_score_each_place_once_and_alone():
    counts = np.random.default_rng(0).integers(0, 50, 50_258).astype(float)
    v = lm.Vocabulary.build(counts, [*bpe.load(bpe.vocabulary_path()).bytes_of, b""])
    assert np.bincount(v.class_of, weights=np.exp(v.log_share), minlength=lm.GROUPS * lm.MEMBERS)[np.unique(v.class_of)] == pytest.approx(1.0, abs=1e-3)
    net, rng = lm.Network(), np.random.default_rng(1)
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (1, 31, 32, 33, 200, 5)]

    def scores(ids):
        inputs, first, target, live, document = lm.windows(ids, v)
        assert live.sum() == sum(map(len, ids))
        p = net.log_probability(inputs, first, v.class_of[target]) * live
        return np.bincount(document, weights=p.sum(axis=1))

    assert scores(docs) == pytest.approx([scores([d])[0] for d in docs], rel=1e-5)
    # a later id changes no earlier score
    inputs, first, target, live, _ = lm.windows([docs[4]], v)
    changed = docs[4].copy()
    changed[150] = 7
    a = net.log_probability(inputs, first, v.class_of[target]).ravel()
    i2, f2, t2, _, _ = lm.windows([changed], v)
    b = net.log_probability(i2, f2, v.class_of[t2]).ravel()
    assert a[:150] == pytest.approx(b[:150], abs=1e-6) and abs(a[151] - b[151]) > 0


@pytest.mark.parametrize("head", [3, 10_000])
def test_base_scores(spark, docs, monkeypatch, head):
    monkeypatch.setattr(lm, "TRAIN_WINDOWS", 50)
    train = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    counts = lm.staged(lm.word_counts(train), "t")
    model = lm.fit(train, counts, head=head)
    out = lm.score(docs, model, counts).collect()
    words = lambda t: (t or "").encode().lower().split()
    mine = [t for i, t in zip([r.doc_id for r in docs.collect()], TEXTS) if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in mine for w in words(t))
    end, n = len(mine), sum(c.values()) + len(mine)
    below = math.log10(n + 0.5 * (len(c) + 1 + 1))
    want = sorted((len(words(t)) + 1, sum(c[w] > 0 for w in words(t)) + 1, round(sum(math.log10(c[w] + 0.5) for w in words(t)) + math.log10(end + 0.5) - (len(words(t)) + 1) * below, 4)) for t in TEXTS)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 4)) for r in out) == want
    assert model.n_tokens == n and all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_the_network_sees_every_window_of_distinct_texts(spark, monkeypatch):
    monkeypatch.setattr(lm, "TRAIN_WINDOWS", 100)
    r = random.Random(2)
    texts = [" ".join(r.choice(BASE) for _ in range(20)) for _ in range(1700)]
    d = spark.createDataFrame([(t,) for t in [*texts, *texts[:1] * 900]], "text string")
    seen = []
    trained = lm._trained_apart
    workers = []
    monkeypatch.setattr(lm, "_trained_apart", lambda *a: workers.append(a[0].rdd.getNumPartitions()) or seen.append((out := trained(*a))[1]) or out)
    model = lm.fit(d, lm.word_counts(d))
    ids = lm.Subwords(model.path)
    inputs, first, target, live, _ = lm.windows([ids.ids(lm.words_of(t)) for t in sorted(set(texts))], model.vocabulary)
    assert len(seen) > 1 and min(workers) > 1 and sum(seen) == len(inputs)
    start = lm.Network()
    start.set_prior(model.vocabulary.log_class)
    loss = [n.gradients(inputs, first, model.vocabulary.class_of[target], live)[0] for n in (start, model.network)]
    assert loss[1] < loss[0]


def test_held_out_score_beats_the_word_model(spark):
    """On held-out texts of sf0.01, of the registered query; and single texts against a forward pass written out for one place after the other."""
    rows = entry.queries()["op10_attention_lm"](spark, "/root/testdata/sf0.01").toPandas()
    held = rows[rows.held_out]
    assert len(held) > 100 and held.score.sum() > held.base_score.sum()
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    counts = lm.staged(lm.word_counts(d), "t")
    model = lm.fit(d, counts)
    w, v, sub = {k: x.astype(np.float64) for k, x in model.network.w.items()}, model.vocabulary, lm.Subwords(model.path)
    got = {r.doc_id: r.score for r in lm.score(d, model, counts).collect()}
    for r in d.limit(4).collect():
        ids = sub.ids(lm.words_of(r.text))
        before, total = [0, *v.input_of[ids[:-1]].tolist()], 0.0
        for at, i in enumerate(ids.tolist()):
            begin = at // lm.STRIDE * lm.STRIDE - lm.CONTEXT
            see = range(max(0, begin), at + 1)
            x = np.stack([w["embed"][before[k]] + w["place"][k - begin] for k in see])
            q = x[-1] @ w["q"] / math.sqrt(lm.WIDTH)
            a = np.exp(x @ w["k"] @ q)
            h = x[-1] + (a / a.sum()) @ (x @ w["v"]) @ w["o"]
            f = h + np.maximum(h @ w["up"] + w["bias"], 0) @ w["down"]
            g, m = divmod(int(v.class_of[i]), lm.MEMBERS)
            groups, members = f @ w["group"] + w["group_bias"], f @ w["member"][g] + w["member_bias"][g]
            total += groups[g] - np.log(np.exp(groups).sum()) + members[m] - np.log(np.exp(members).sum()) + v.log_share[i]
        assert got[r.doc_id] == pytest.approx(total / math.log(10), rel=1e-4)


def test_words_of_other_texts_only_are_in_the_head(spark):
    d = spark.createDataFrame([(i, "rare word here" if i % 2 else "often " * 50) for i in range(40)], "doc_id long, text string")
    counts = lm.staged(lm.word_counts(d, train=F.col("doc_id") % 2 == 1), "t")
    assert {bytes(r.word).decode(): (r.c, r.n) for r in counts.collect()} == {"rare": (20, 20), "word": (20, 20), "here": (20, 20), "often": (0, 1000)}
    model = lm.fit(d.filter("doc_id % 2 = 1"), counts, head=1)
    assert model.head == {b"often": 0} and model.n_distinct == 4 and model.n_tokens == 80
    assert {r.n_known for r in lm.score(d, model, counts).collect()} == {1, 4}


def test_no_training_texts(spark, docs):
    counts = lm.staged(lm.word_counts(docs.limit(0)), "t")
    out = lm.score(docs, lm.fit(docs.limit(0), counts), counts).collect()
    assert len(out) == len(TEXTS) and all(r.n_known == 0 for r in out)


# --- pipeline ----------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    now = docs
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES:
        out = lm.staged(stage(spark, now, sf_dir), "stage")
        if name == "quality_rules":
            want = ids(quality.judge(now, labels).filter("kept"))
        elif name == "language_id":
            m = language_id.fit(now)
            want = ids(language_id.predict(now, m).filter("lang_pred != 'und' AND score >= 0.5"))
        elif name == "near_duplicates":
            rows = sorted((r.doc_id, r.text) for r in now.collect())
            root, _ = classes([t for _, t in rows])
            want = sorted({rows[r][0] for r in root})
        elif name == "mixing":
            want = ids(mixing.mix(now).filter("sampled"))
        else:
            t = Tokenizer.from_file(bpe.vocabulary_path())
            assert {r.doc_id: r.n_tokens for r in out.collect()} == {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) for r in now.collect()}
            want = ids(now)
        assert ids(out) == want
        assert name == "encoding" or out.columns == docs.columns
        now = out


def test_language_stage_sends_a_text_once(spark, docs, monkeypatch):
    """Beside the predicted text, its row held a second copy of it in each batch."""
    d = docs.filter("text IS NOT NULL").drop("lang").withColumn("lang", F.when(F.col("text").contains("Fuchs"), "de").otherwise("en")).select(*docs.columns)
    predict, sent = language_id.predict, []
    with monkeypatch.context() as m:
        m.setattr(language_id, "predict", lambda rows, *a, **b: sent.append(rows) or predict(rows, *a, **b))
        out = corpus_pipeline.identify_language(spark, d, "")
    got = sorted(out.drop("lang").collect(), key=repr)
    assert sent[0].schema.simpleString().count("text:") == 1
    model = language_id.fit(d)
    kept = language_id.predict(d, model, carry=["text", "key"])
    assert kept.columns == ["doc_id", "lang_pred", "score", "text", "key"]
    want = [(r.doc_id, r.text) for r in kept.filter("lang_pred != 'und' AND score >= 0.5").collect()]
    assert out.columns == d.columns and got and sorted(map(repr, want)) == sorted(repr((r.doc_id, r.text)) for r in got)
    assert {repr(tuple(r)) for r in got} <= {repr(tuple(r)) for r in d.drop("lang").collect()}


def test_encoding_holds_one_batch_and_one_vocabulary_a_task(spark, docs, empty, capsys):
    """Two workers a task, each with its batch and vocabulary, took an executor's memory."""
    out = corpus_pipeline.encode(spark, docs, "")
    out.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    apart = bpe.with_digests(bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text")).drop("text")))
    assert out.columns == apart.columns and sorted(map(repr, out.collect())) == sorted(map(repr, apart.collect()))
    assert corpus_pipeline.encode(spark, empty, "").collect() == []
    clash = bpe.encode_decode(docs.withColumn("decoded", F.lit(1)))
    assert [c for c in clash.columns if c in ("text", "ids", "decoded")] == ["ids", "decoded"] and clash.count() == len(TEXTS)


def test_the_pipeline_hands_few_texts_at_a_time_to_workers(spark, docs, monkeypatch):
    """Batches of 10000 texts, held on both sides, took an executor's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(language_id, "fit", lambda d: language_id.Model(["de"], (np.arange(1, dtype=np.uint64), np.ones((1, 1), np.float32))))
    monkeypatch.setattr(chosen_path, "keep_one", lambda d: d)
    sizes = lambda: [r.n for r in spark.range(0, 2500, 1, 1).mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in it), "n long").collect()]
    try:
        for stage in (corpus_pipeline.identify_language, corpus_pipeline.near_duplicates, corpus_pipeline.encode):
            for given, most in (("10000", 1000), ("0", 1000), ("400", 400)):
                spark.conf.set(key, given)
                stage(spark, docs, "")
                assert max(sizes()) == most and sum(sizes()) == 2500
    finally:
        spark.conf.set(key, before)


def test_predicting_languages_holds_a_slice(spark, monkeypatch):
    """Two workers with slices of 750,000 characters took some 200 MB more of an executor."""
    model = language_id.Model(["de", "en", "es", "fr"], (np.arange(3, dtype=np.uint64), np.ones((3, 4), np.float32)))
    df, runs = spark.createDataFrame([(1, "x")], "doc_id long, text string"), []
    real = type(df).mapInArrow
    with monkeypatch.context() as m:
        m.setattr(type(df), "mapInArrow", lambda d, f, *a, **b: runs.append(f) or real(d, f, *a, **b))
        language_id.predict(df, model)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(600)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(600)), "t": texts})
    language_id.character_tables()
    tracemalloc.start()
    rows = sum(b.num_rows for b in runs[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 600 and sum(map(len, texts)) > 1_000_000 and peak < 60e6


def test_pipeline_on_edges(spark, docs, empty, tmp_path):
    labels = spark.createDataFrame([(5, 1, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    for i, d in enumerate((docs, empty)):
        d.write.parquet(str(tmp_path / f"{i}" / "documents.parquet"))
        labels.write.parquet(str(tmp_path / f"{i}" / "labels.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / f"{i}")).count() >= 0


def test_extra_columns_clash_with_nothing(docs):
    model = language_id.fit(docs.select(F.lit("ein kleiner Hund").alias("text"), F.lit("de").alias("lang")).unionByName(docs.select(F.lit("a small dog").alias("text"), F.lit("en").alias("lang"))))
    for out in (licenses.scan(docs), quality.judge(docs, docs.select("doc_id", F.lit(1).alias("quality"))), sharding.shard(docs), mixing.mix(docs), chosen_path.join(docs), language_id.predict(docs, model), token_counts.count_tokens(docs), bpe.decode(bpe.encode(docs.withColumn("decoded", F.lit(1)))), lm.score(docs, lm.fit(docs.limit(0), lm.word_counts(docs.limit(0))), lm.word_counts(docs))):
        assert out.count() == len(TEXTS)
