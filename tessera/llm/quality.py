"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Counts per text feed rules of the form "reject if value > cutoff". The cutoff of
a rule in a stratum comes from labelled good documents (the holdout): with n of
them, a cutoff that rejects k is safe if a rule whose true false-rejection rate
were above `rate` would reject k or fewer with probability at most `delta`, that
is, if the binomial distribution function at k is at most delta. Cutoffs are
tested from the loosest to the strictest, which needs no correction within a
rule (the rejection sets are nested); over rules and strata both the rate (by
the union of rejections) and delta (Bonferroni) are divided.

Nulls and edge cases: a null text counts as empty, fails the base rule and is
not kept; a null stratum is the stratum "und"; a stratum with too few labelled
documents, or none, rejects nothing beyond the base rule; labels for unknown
documents count for nothing; a document with several labels is good if all say
so. Repeated rows are judged alike. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import documents, split_words, staged

#: Most false rejections per stratum, over all rules, and the chance that the bound fails anywhere.
MAX_FALSE_REJECTION = 0.02
DELTA = 0.05
#: Strata up to this many are joined by broadcast; more take a shuffle join.
BROADCAST_STRATA = 20_000
#: Rule values are whole thousandths, or hundredths of a character.
RULES = ("symbols", "dup_lines", "repeats", "long_words", "short_words")


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of the whole text; drops the text."""
    keep = [F.col(c) for c in df.columns if c != text]
    t = F.coalesce(F.col(text), F.lit(""))
    d = df.select(*keep, t.alias("__t"), split_words(t).alias("__w"))
    n = F.size("__w")
    w, m = F.col("__w"), F.greatest(n - 2, F.lit(0))
    lines = F.filter(F.split(F.col("__t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    triples = F.arrays_zip(F.slice(w, 1, m).alias("a"), F.slice(w, F.when(n > 2, 2).otherwise(1), m).alias("b"), F.slice(w, F.when(n > 2, 3).otherwise(1), m).alias("c"))
    d = d.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col("__t"), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("__l"),
        F.transform(triples, lambda z: F.xxhash64(z["a"], z["b"], z["c"])).alias("__k"),
    )
    pairs = F.array_sort(F.transform(F.col("__k"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("__k")) < F.size("__k"), pairs).alias("__s"),
    )
    s = F.col("__s")
    again = F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]))
    at = F.array_sort(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    # The condition always holds. An id that counts rows keeps filters above this projection: pushed below it, they would
    # copy the sorted array into the functions that run on each of its elements, and sort it again for each.
    repeats = F.when(F.monotonically_increasing_id() >= 0, F.coalesce(covered, F.lit(0)).cast("long")).otherwise(F.lit(0).cast("long"))
    return d.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeats.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    """Each rule's integer value; large is bad."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda a, b: F.floor(1000 * a / F.greatest(b, F.lit(1))).cast("long")
    mean = F.floor(100 * F.col("word_chars") / n).cast("long")
    return {
        "symbols": share(F.col("n_symbols"), F.col("word_chars")),
        "dup_lines": share(F.col("n_dup_lines"), F.col("n_lines")),
        "repeats": share(F.col("n_repeat_words"), F.col("n_words")),
        "long_words": mean,
        "short_words": -mean,
    }


def log_gamma(x: Column) -> Column:
    """ln(gamma(x)) for x >= 1, by Stirling's series at x + 7: absolute error below 1e-9."""
    z = x + 7
    series = (z - 0.5) * F.ln(z) - z + F.lit(0.9189385332046727) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    down = F.ln(x)
    for k in range(1, 7):
        down = down + F.ln(x + k)
    return series - down


def largest_safe(counts: DataFrame, keys: list[str], n: str, rate: float, delta: Column) -> DataFrame:
    """Add k_max: the largest k with P(Binomial(n, rate) <= k) <= delta, by exact summation; null if there is none.

    Terms further than 40 standard deviations below the mean are under 1e-300 and left out, so that the sum is short at any n.
    """
    size = F.col(n).cast("double")
    top = F.floor(size * rate).cast("long")
    low = F.greatest(F.lit(0), F.floor(size * rate - 40 * F.sqrt(size * rate * (1 - rate)) - 40)).cast("long")
    j = F.col("__j").cast("double")
    log_p = log_gamma(size + 1) - log_gamma(j + 1) - log_gamma(size - j + 1) + j * F.ln(F.lit(rate)) + (size - j) * F.ln(F.lit(1 - rate))
    each = counts.select(*keys, n, delta.alias("__delta"), F.explode(F.sequence(low, top)).alias("__j"))
    upto = each.withColumn("__cdf", F.sum(F.exp(log_p)).over(Window.partitionBy(*keys).orderBy("__j")))
    return upto.groupBy(*keys).agg(F.max(F.when(F.col("__cdf") <= F.col("__delta"), F.col("__j"))).alias("k_max"))


def cutoffs(good: DataFrame, strata: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """One row per stratum with a cutoff for each rule (null: rejects nothing).

    good: stratum and rule values of labelled good documents. strata: all strata that will be judged, for the
    correction. Rows are pre-aggregated to histograms; nothing here is larger than strata x rules x distinct values.
    """
    values = F.stack(F.lit(len(RULES)), *[x for r in RULES for x in (F.lit(r), F.col(r))]).alias("rule", "value")
    hist = good.select("stratum", values).groupBy("stratum", "rule", "value").agg(F.count(F.lit(1)).alias("n"))
    sizes = hist.filter(F.col("rule") == RULES[0]).groupBy("stratum").agg(F.sum("n").alias("n_good"))
    tests = strata.agg((F.count(F.lit(1)) * len(RULES)).alias("tests"))
    sizes = sizes.join(F.broadcast(tests))  # one row
    k = largest_safe(sizes, ["stratum"], "n_good", max_false_rejection / len(RULES), F.lit(delta) / F.col("tests"))
    above = Window.partitionBy("stratum", "rule").orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = hist.withColumn("over", F.coalesce(F.sum("n").over(above), F.lit(0)))
    safe = ranked.join(k, "stratum").filter(F.col("over") <= F.col("k_max"))
    return safe.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("value"))).alias(f"cut_{r}") for r in RULES])


def _good_ids(labels: DataFrame, id_col: str) -> DataFrame:
    return labels.filter(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min("quality").alias("q")).filter("q = 1").select("__id")


def _stratum(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("und")).alias("stratum")


def _verdict(counts: DataFrame, cuts: DataFrame, n_strata: int) -> DataFrame:
    """Add cutoffs and kept."""
    out = counts.join(F.broadcast(cuts) if n_strata <= BROADCAST_STRATA else cuts, "stratum", "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected)


def _counted(part: DataFrame) -> DataFrame:
    counts = text_counts(part, "__text").withColumn("base_failed", base_failed())
    return counts.select("*", *[c.alias(r) for r, c in rule_values().items()])


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", stratum: str = "lang", max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """One row per row of df: id, counts, base_failed, kept, stratum and cutoffs.

    The counts, without texts, are staged once, as calibration and judging both read them.
    """
    counts = staged(_counted(df.select(F.col(id_col).alias("__id"), _stratum(stratum), F.col(text).alias("__text"))), "quality")
    good = counts.filter(~F.col("base_failed")).join(_good_ids(labels, id_col), "__id", "left_semi")
    strata = counts.select("stratum").distinct()
    out = _verdict(counts, cutoffs(good, strata, max_false_rejection, delta), strata.count())
    return out.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", *[f"cut_{r}" for r in RULES])


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", stratum: str = "lang", max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """The rows of df that are kept, with the columns of df.

    Rows that pass the base rules are written once with their counts; calibration then reads counts only, and no text is shuffled.
    """
    rows = df.select(F.struct(*df.columns).alias("__row"), F.col(id_col).alias("__id"), _stratum(stratum), F.col(text).alias("__text"))
    passed = staged(_counted(rows).filter(~F.col("base_failed")).select("__row", "__id", "stratum", "base_failed", *RULES), "counted")
    good = passed.select("__id", "stratum", *RULES).join(_good_ids(labels, id_col), "__id", "left_semi")
    strata = df.select(_stratum(stratum)).distinct()
    cuts = staged(cutoffs(good, strata, max_false_rejection, delta), "cutoffs")
    return _verdict(passed, cuts, strata.count()).filter("kept").select("__row.*")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Judge every document by cutoffs calibrated on the labelled ones, per language."""
    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("stratum")


_SQL_COUNTS = r"""
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS t FROM {documents}),
wl AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM wl WHERE len(w) > 2)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + d) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS d) GROUP BY rid),
counts AS (SELECT wl.rid, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM wl LEFT JOIN cov ON wl.rid = cov.rid),
vals AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    CAST(floor(1000.0 * n_symbols / greatest(word_chars, 1)) AS BIGINT) AS symbols,
    CAST(floor(1000.0 * n_dup_lines / greatest(n_lines, 1)) AS BIGINT) AS dup_lines,
    CAST(floor(1000.0 * n_repeat_words / greatest(n_words, 1)) AS BIGINT) AS repeats,
    CAST(floor(100.0 * word_chars / greatest(n_words, 1)) AS BIGINT) AS long_words,
    -CAST(floor(100.0 * word_chars / greatest(n_words, 1)) AS BIGINT) AS short_words FROM counts),
good AS (SELECT * FROM vals WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1)),
long AS (UNPIVOT (SELECT stratum, symbols, dup_lines, repeats, long_words, short_words FROM good) ON symbols, dup_lines, repeats, long_words, short_words INTO NAME rule VALUE v),
hist AS (SELECT stratum, rule, v, count(*) AS n FROM long GROUP BY ALL),
sizes AS (SELECT stratum, CAST(sum(n) AS DOUBLE) AS n, (SELECT count(DISTINCT stratum) FROM vals) * {rules} AS tests FROM hist WHERE rule = 'symbols' GROUP BY stratum),
terms AS (SELECT stratum, tests, j, exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rate} / {rules}) + (n - j) * ln(1 - {rate} / {rules})) AS p
    FROM (SELECT *, unnest(generate_series(0, CAST(floor(n * {rate} / {rules}) AS BIGINT))) AS j FROM sizes)),
safe AS (SELECT stratum, max(j) AS k FROM (SELECT stratum, tests, j, sum(p) OVER (PARTITION BY stratum ORDER BY j) AS c FROM terms) WHERE c <= {delta} / tests GROUP BY stratum),
ranked AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY stratum, rule ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM hist),
cuts AS (SELECT stratum, min(v) FILTER (rule = 'symbols') AS cut_symbols, min(v) FILTER (rule = 'dup_lines') AS cut_dup_lines, min(v) FILTER (rule = 'repeats') AS cut_repeats,
    min(v) FILTER (rule = 'long_words') AS cut_long_words, min(v) FILTER (rule = 'short_words') AS cut_short_words FROM ranked JOIN safe USING (stratum) WHERE above <= k GROUP BY stratum),
judged AS (SELECT v.*, c.* EXCLUDE (stratum), (NOT base_failed AND NOT coalesce(symbols > cut_symbols, false) AND NOT coalesce(dup_lines > cut_dup_lines, false)
    AND NOT coalesce(repeats > cut_repeats, false) AND NOT coalesce(long_words > cut_long_words, false) AND NOT coalesce(short_words > cut_short_words, false)) AS kept
    FROM vals v LEFT JOIN cuts c ON v.stratum = c.stratum)
"""
for _name, _value in {"documents": "documents", "rules": len(RULES), "rate": MAX_FALSE_REJECTION, "delta": DELTA}.items():
    _SQL_COUNTS = _SQL_COUNTS.replace("{" + _name + "}", str(_value))
SQL = "WITH " + _SQL_COUNTS + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cut_symbols, cut_dup_lines, cut_repeats, cut_long_words, cut_short_words FROM judged
"""
