"""License scans: base phrases and an exact containment join of text blocks with templates, in DataFrame functions only.

A block is a line of a text and the words after it, as many as a template could
still take: with templates of up to n words, the n - 1 words that follow. Each
stretch of n words lies in a block, so that a notice wrapped over lines is met
as one on a single line is. Templates are dealt into classes by their number of
words, each with blocks of its own, so that short ones aren't sought in blocks
made for long ones.

A template T meets a block B, both sets of words, if |T and B| >= alpha =
ceil(threshold * |T|). Tokens of templates are put in order of their frequency
over the corpus, rarest first. A block that meets T must hold one of the first
|T| - alpha + 1 tokens of T (prefix filter) and alpha tokens of any template
(length filter); where its j-th such token is T's i-th, at most
1 + min(|T| - i - 1, |B| - j - 1) tokens can be shared from there on, the first
shared one (positional filter). What is left is verified by intersection.
Templates that meet each other are siblings; of siblings that meet one block,
those of the largest containment are reported.

Nulls and edge cases: a null text is empty; an empty text has no words, no
labels and score 0; words are counted over whole texts of any length; repeated
rows give repeated results; templates are a parameter, at most MAX_TEMPLATES of
them, as they are held by every task; a template without words meets nothing.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import NOT_WORD, documents, lower_ascii, split_words

#: Base phrases and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Labels and texts of templates: short notices, and the well-known wordings (fixed values).
TEMPLATES = {
    "template:apache-2.0": "Licensed under the Apache License, Version 2.0",
    "template:bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "template:cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "template:cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "template:gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "template:mit": "Released under the MIT License",
    "template:reserved": "All rights reserved",
    "text:apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "text:bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.""",
    "text:gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "text:mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.""",
}
THRESHOLD = 0.8
MAX_TEMPLATES = 1000


def template_words(text: str) -> list[str]:
    """A-Z lower-cased and split as texts are."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [x for x in re.split(NOT_WORD, lower) if x]


def template_tokens(templates: dict[str, str]) -> dict[str, list[str]]:
    return {k: sorted(set(w)) for k, t in templates.items() if (w := template_words(t))}


def required(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


def reaches(templates: dict[str, str]) -> dict[str, int]:
    """The class of each template: the words of the longest one of its power of two."""
    size = {k: len(w) for k, t in templates.items() if (w := template_words(t))}
    top: dict[int, int] = {}
    for n in size.values():
        top[n.bit_length()] = max(n, top.get(n.bit_length(), 0))
    return {k: top[n.bit_length()] for k, n in size.items()}


def families(tokens: dict[str, list[str]], threshold: float) -> dict[str, int]:
    """A number for each group of siblings: templates of which one meets the other, directly or through others."""
    labels = sorted(tokens)
    part = {x: i for i, x in enumerate(labels)}
    for x in labels:
        for y in labels:
            if x != y and part[x] != part[y] and len(set(tokens[x]) & set(tokens[y])) >= required(len(tokens[x]), threshold):
                old, new = max(part[x], part[y]), min(part[x], part[y])
                part = {k: new if v == old else v for k, v in part.items()}
    return part


def _literals(words: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in words]) if words else F.array().cast("array<string>")


def token_frequencies(df: DataFrame, universe: list[str], text: str = "text") -> dict[str, int]:
    """In how many texts of the corpus each of the templates' tokens stands: one row per token at most."""
    words = split_words(lower_ascii(F.coalesce(F.col(text), F.lit(""))), NOT_WORD)
    tokens = df.select(F.explode(F.array_intersect(words, _literals(universe))).alias("token"))
    return {r.token: r.n for r in tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def prefixes(tokens: dict[str, list[str]], rank: dict[str, int], threshold: float) -> dict[str, list[str]]:
    """The tokens of each template of which a block that meets it has one."""
    return {k: sorted(w, key=rank.__getitem__)[: len(w) - required(len(w), threshold) + 1] for k, w in tokens.items()}


def prefix_index(spark: SparkSession, tokens: dict[str, list[str]], rank: dict[str, int], threshold: float, reach: dict[str, int], family: dict[str, int]) -> DataFrame:
    """Rows (reach, token, label, family, i, size, alpha, template): the prefix of each template in the global order."""
    rows = []
    for label, words in sorted(tokens.items()):
        ordered = sorted(words, key=rank.__getitem__)
        rows += [(reach[label], x, label, family[label], i, len(ordered), required(len(ordered), threshold), ordered) for i, x in enumerate(prefixes(tokens, rank, threshold)[label])]
    return spark.createDataFrame(rows, "reach int, token string, label string, family int, i int, size int, alpha int, template array<string>")


def _once(c: Column) -> Column:
    """c, computed where it is selected. The condition always holds, but an id that counts rows keeps it from being copied into functions that run for each element of an array."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def _blocks(reach: dict[str, int], tokens: dict[str, list[str]], rank: dict[str, int], order: list[str], threshold: float) -> Column:
    """Structs (reach, line, ranks) of the blocks that pass the prefix filter and the length filter: ranks of their template tokens, rising. Uses columns __w, __sizes and __starts."""
    made = [_class_blocks(n, [k for k in reach if reach[k] == n], tokens, rank, order, threshold) for n in sorted(set(reach.values()))]
    return F.concat(*made) if made else F.array().cast("array<struct<reach:int,line:int,ranks:array<int>>>")


def _class_blocks(n: int, labels: list[str], tokens: dict[str, list[str]], rank: dict[str, int], order: list[str], threshold: float) -> Column:
    first = _literals(sorted({x for k in labels for x in prefixes(tokens, rank, threshold)[k]}))
    least = min(required(len(tokens[k]), threshold) for k in labels)
    known = _literals(sorted({x for k in labels for x in tokens[k]}))

    def block(i: Column) -> Column:
        return F.slice(F.col("__w"), F.get("__starts", i) + 1, F.get("__sizes", i) + n - 1)

    def ranks(i: Column) -> Column:
        return F.array_sort(F.transform(F.array_intersect(block(i), known), lambda x: F.array_position(_literals(order), x).cast("int")))

    lines = F.filter(F.sequence(F.lit(0), F.size("__sizes") - 1), lambda i: (F.get("__sizes", i) > 0) & F.arrays_overlap(block(i), first))
    lines = F.when(F.size("__sizes") > 0, lines).otherwise(F.array().cast("array<int>"))
    found = F.transform(lines, lambda i: F.struct(F.lit(n).alias("reach"), i.alias("line"), ranks(i).alias("ranks")))
    return F.filter(found, lambda x: F.size(x["ranks"]) >= least)


def scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Base and template labels of every row.

    One pass counts the templates' tokens, one pass scans. Texts aren't shuffled: each row carries its counts and the
    blocks that the filters leave, and matches are gathered per row with partial aggregation.
    """
    spark = df.sparkSession
    tokens = template_tokens(templates)
    if len(tokens) > MAX_TEMPLATES:
        raise ValueError(f"{len(tokens)} templates; at most {MAX_TEMPLATES}")
    universe = sorted({x for words in tokens.values() for x in words})
    n = token_frequencies(df, universe, text)
    order = sorted(universe, key=lambda x: (n.get(x, 0), x))
    rank = {x: k for k, x in enumerate(order)}
    reach, family = reaches(templates), families(tokens, threshold)
    index = prefix_index(spark, tokens, rank, threshold, reach, family)
    first = sorted({x for words in prefixes(tokens, rank, threshold).values() for x in words})

    d = df.select(F.col(id_col).alias("__id"), lower_ascii(F.coalesce(F.col(text), F.lit(""))).alias("__t"))
    d = d.select("__id", "__t", split_words(F.col("__t"), NOT_WORD).alias("__w"))
    d = d.select("__id", "__t", _once(F.col("__w")).alias("__w"), F.concat(F.lit(" "), F.array_join("__w", " "), F.lit(" ")).alias("__j"))
    j = F.col("__j")
    words_before = lambda x: (F.length(x) - F.length(F.regexp_replace(x, " ", ""))).cast("long")
    has = {p: F.contains(j, F.lit(f" {p} ")) for p in phrases}
    counts = [F.when(has[p], F.regexp_count(j, F.lit(f"(?= {p} )"))).otherwise(0) for p in phrases]
    firsts = [F.when(has[p], words_before(F.substring_index(j, f" {p} ", 1))) for p in phrases]
    lasts = [F.when(has[p], words_before(F.regexp_extract(j, rf"(?s)^(.*) {p} ", 1))) for p in phrases]
    total = sum(counts, F.lit(0))
    none = F.lit(None).cast("long")
    candidate = F.arrays_overlap("__w", _literals(first))
    sizes = F.when(candidate, F.transform(F.split(F.col("__t"), "\n"), lambda b: F.size(split_words(b, NOT_WORD)))).otherwise(F.array().cast("array<int>"))
    base = d.select(
        "__id",
        "__w",
        F.size("__w").cast("long").alias("n_words"),
        total.cast("long").alias("n_base"),
        F.least(*firsts, none, none).alias("first_word"),
        F.greatest(*lasts, none, none).alias("last_word"),
        F.array_compact(F.array(*[F.when(has[p], F.lit(label)) for p, label in phrases.items()])).cast("array<string>").alias("__base"),
        _once(sizes).alias("__sizes"),
    )
    # where each line begins: the running sum of the lines' words
    running = F.aggregate(
        "__sizes",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")),
        lambda a: a["starts"],
    )
    columns = ["__id", "n_words", "n_base", "first_word", "last_word", "__base"]
    base = base.select(*columns, "__w", "__sizes", _once(running).alias("__starts"))
    base = base.select(*columns, _blocks(reach, tokens, rank, order, threshold).alias("__blocks"), F.monotonically_increasing_id().alias("__row"))
    each = base.select("*", F.explode_outer("__blocks").alias("__b")).drop("__blocks")
    probes = each.select("*", F.posexplode_outer("__b.ranks").alias("j", "__rank")).withColumn("token", F.get(_literals(order), F.col("__rank") - 1)).withColumn("reach", F.col("__b.reach"))
    joined = probes.join(F.broadcast(index), ["reach", "token"], "left")
    held = F.size("__b.ranks")
    possible = (held >= F.col("alpha")) & (1 + F.least(F.col("size") - F.col("i") - 1, held - F.col("j") - 1) >= F.col("alpha"))
    shared = F.size(F.array_intersect(F.transform("__b.ranks", lambda r: F.get(_literals(order), r - 1)), "template"))
    joined = joined.withColumn("__hit", F.when(possible, F.when(shared >= F.col("alpha"), shared / F.col("size"))))
    hit = F.struct(F.col("reach"), F.col("__b.line").alias("line"), F.col("family"), F.col("__hit").alias("hit"), F.col("label"))
    out = joined.groupBy("__row").agg(*[F.first(c).alias(c) for c in columns], F.collect_set(F.when(F.col("__hit").isNotNull(), hit)).alias("__hits"))
    better = lambda h: F.exists("__hits", lambda g: (g["reach"] == h["reach"]) & (g["line"] == h["line"]) & (g["family"] == h["family"]) & (g["hit"] > h["hit"]))
    out = out.select(*columns, F.filter("__hits", lambda h: ~better(h)).alias("__best"))
    return out.select(
        F.col("__id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("__base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("__base", F.transform("__best", lambda h: h["label"])))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("__best", lambda h: h["hit"])), F.lit(0.0)).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan every document for base phrases and templates."""
    return scan(documents(spark, sf_dir))


def _sql() -> str:
    words = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tokens, reach = template_tokens(TEMPLATES), reaches(TEMPLATES)
    family = families(tokens, THRESHOLD)
    templates = ", ".join(f"('{k}', {reach[k]}, {family[k]}, [{', '.join(repr(x) for x in v)}])" for k, v in tokens.items())
    phrases = ", ".join(f"('{label}', [{', '.join(repr(x) for x in p.split())}])" for p, label in PHRASES.items())
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {lower} AS t FROM documents),
w AS (SELECT rid, doc_id, t, {words.format("t")} AS w FROM docs),
ph(label, p) AS (VALUES {phrases}),
places AS (SELECT rid, w, unnest(generate_series(1, len(w))) AS i FROM w),
hit AS (SELECT rid, i - 1 AS pos, label FROM places JOIN ph ON w[i] = p[1] AND w[i:i + len(p) - 1] = p),
base AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM hit GROUP BY rid),
tm(label, reach, family, t) AS (VALUES {templates}),
ln AS (SELECT rid, w, unnest(list_transform(string_split(t, chr(10)), lambda x: len({words.format("x")}))) AS n, unnest(generate_series(1, len(string_split(t, chr(10))))) AS line FROM w),
st AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY rid ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ln),
blk AS (SELECT rid, line, reach, list_distinct(w[s + 1:s + n + reach - 1]) AS b FROM st, (SELECT DISTINCT reach FROM tm) WHERE n > 0),
met AS (SELECT rid, line, reach, family, label, len(list_intersect(b, t)) / CAST(len(t) AS DOUBLE) AS s FROM blk JOIN tm USING (reach) WHERE len(list_intersect(b, t)) >= {THRESHOLD} * len(t) - 1e-9),
best AS (SELECT rid, label, s FROM met QUALIFY s = max(s) OVER (PARTITION BY rid, line, reach, family)),
tpl AS (SELECT rid, list(DISTINCT label) AS labels, max(s) AS score FROM best GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(tpl.labels, [])))), ',') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN tpl USING (rid)
"""


SQL = _sql()
