"""Mixing sources to target weights: iterative proportional fitting, then Poisson sampling.

Token counts are summed over cells (source, language, topic). Raking scales the
cells to each dimension's target shares in turn until all three marginals agree.
A cell's weight is its fitted over its present tokens. Documents are kept with
probability min(1, rate * weight), where the rate makes the expected tokens equal
to the budget; the draw is a hash of the document's id and text, so it is the
same in every run and for every partitioning.

Cells up to DRIVER_CELLS are raked in numpy on the driver; more are raked as a
staged table, by one aggregation per dimension and round, to the same tolerance.

A target names shares of values. What they leave of 1 goes to the values that
aren't named, by their default shares; a dimension without a target has these
for all its values.

Nulls and edge cases: a null source or language is the value "und"; a null or
empty text has no tokens, and its weight is its cell's; a cell without tokens
has weight 1; shares of values that don't occur are spread over those that do;
empty tables give no rows; extra columns pass through where asked for.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import documents, staged

DIMENSIONS = ("source", "lang", "topic")
#: Default targets: present token shares to these powers, made to sum to 1, which damps the largest values.
TEMPER = {"source": 0.7, "lang": 0.6, "topic": 0.8}
#: Share of the tokens to keep.
BUDGET = 0.5
ROUNDS = 200
TOLERANCE = 1e-10
#: Targets of the registered query.
TARGETS = {"lang": {"en": 0.5, "de": 0.2}}
DRIVER_CELLS = 200_000
BROADCAST_CELLS = 200_000
SEED = 17


def topic(text: Column) -> Column:
    """A coarse topic by the form of a text; the first that fits."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(t, F.lit(" | ")), "table")
        .when(t.rlike(r"(?i)licen[sc]e|all rights reserved"), "license")
        .when(t.rlike(r"https?://|www\."), "web")
        .when(t.rlike(r"[{};]\s*(?:\n|$)"), "code")
        .when(t.rlike(r"[?!]"), "speech")
        .otherwise("prose")
    )


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def draw(*keys: Column, seed: int = SEED) -> Column:
    """A uniform number in [0, 1) that depends on the keys alone."""
    return F.crc32(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])) / F.lit(2.0**32)


def tempered(shares: dict[str, float], power: float) -> dict[str, float]:
    raised = {k: v**power if v > 0 else 0.0 for k, v in shares.items()}
    total = sum(raised.values()) or 1.0
    return {k: v / total for k, v in raised.items()}


def goal_shares(present: dict[str, float], named: dict[str, float] | None, power: float) -> dict[str, float]:
    """Target shares of the values with tokens, before they are made to sum to 1."""
    named = named or {}
    rest = tempered({k: v for k, v in present.items() if k not in named}, power)
    left = max(0.0, 1.0 - sum(named.values()))
    return {k: named[k] if k in named else left * rest[k] for k in present}


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Fitted tokens per cell: shares of each dimension's values are those of targets (as far as a fit exists)."""
    total, fitted = tokens.sum(), tokens.astype(np.float64).copy()
    if not total:
        return fitted
    goals = []
    for c, t in zip(codes, targets):
        live = np.bincount(c, weights=tokens, minlength=len(t)) > 0
        goals.append(np.where(live, t, 0.0) / max(np.where(live, t, 0.0).sum(), 1e-300) * total)
    for _ in range(rounds):
        worst = 0.0
        for c, goal in zip(codes, goals):
            now = np.bincount(c, weights=fitted, minlength=len(goal))
            factor = np.divide(goal, now, out=np.ones_like(now), where=now > 0)
            worst = max(worst, float(np.abs(factor - 1).max(initial=0.0)))
            fitted *= factor[c]
        if worst < tolerance:
            break
    return fitted


def rate_for(tokens: np.ndarray, weights: np.ndarray, budget: float) -> float:
    """The rate at which sum(min(1, rate * weight) * tokens) is the budget."""
    if budget >= tokens[weights > 0].sum():
        return float("inf")
    order = np.argsort(-weights)
    t, w = tokens[order].astype(np.float64), weights[order]
    full = np.concatenate([[0.0], np.cumsum(t)[:-1]])  # tokens of cells kept whole
    rest = np.cumsum((t * w)[::-1])[::-1]
    rates = np.divide(budget - full, rest, out=np.zeros_like(rest), where=rest > 0)
    ok = (rates * w <= 1 + 1e-12) & (rates >= 0)
    return float(rates[int(np.argmax(ok))])


def cell_table(docs: DataFrame) -> DataFrame:
    return docs.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))


def rake_cells(cells: DataFrame, targets: dict[str, dict[str, float]] | None, budget: float) -> DataFrame:
    """source, lang, topic, weight, probability; on the driver, for up to DRIVER_CELLS cells."""
    rows = cells.collect()
    tokens = np.array([r.tokens or 0 for r in rows], np.float64)
    codes, goals = [], []
    for d in DIMENSIONS:
        values = sorted({r[d] for r in rows})
        at = {v: k for k, v in enumerate(values)}
        c = np.array([at[r[d]] for r in rows], np.int64)
        shares = np.bincount(c, weights=tokens, minlength=len(values)) / max(tokens.sum(), 1.0)
        wanted = goal_shares(dict(zip(values, shares.tolist())), (targets or {}).get(d), TEMPER[d])
        codes.append(c)
        goals.append(np.array([wanted[v] for v in values]))
    fitted = rake(tokens, codes, goals) if rows else tokens
    weights = np.divide(fitted, tokens, out=np.ones_like(tokens), where=tokens > 0)
    rate = rate_for(tokens, weights, budget * tokens.sum()) if rows else 1.0
    p = np.where(weights > 0, np.minimum(1.0, rate * weights), 0.0) if np.isfinite(rate) else (weights > 0).astype(float)
    out = [(*[r[d] for d in DIMENSIONS], float(w), float(x)) for r, w, x in zip(rows, weights, p)]
    return cells.sparkSession.createDataFrame(out, "source string, lang string, topic string, weight double, probability double")


def rake_table(cells: DataFrame, targets: dict[str, dict[str, float]] | None, budget: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE, keep_every: int = 1) -> DataFrame:
    """As rake_cells, for any number of cells: the cells stay a table, which is staged every few rounds."""
    spark = cells.sparkSession
    fit = staged(cells.withColumn("fitted", F.col("tokens").cast("double")), "rake")
    total = fit.agg(F.sum("tokens")).first()[0] or 0
    goals = {}
    for d in DIMENSIONS:
        share = fit.groupBy(d).agg(F.sum("tokens").alias("t")).filter("t > 0")
        given = (targets or {}).get(d) or {}
        named = spark.createDataFrame(list(given.items()), f"{d} string, named double")
        goal = share.join(F.broadcast(named), d, "left").withColumn("raised", F.when(F.col("named").isNull(), F.pow(F.col("t") / total, TEMPER[d])))
        rest = goal.agg(F.sum("raised")).first()[0] or 1.0
        goal = goal.select(d, F.coalesce("named", F.col("raised") * (max(0.0, 1.0 - sum(given.values())) / rest)).alias("goal"))
        whole = goal.agg(F.sum("goal")).first()[0] or 1.0
        goals[d] = staged(goal.withColumn("goal", F.col("goal") * (total / whole)), "rake-goal")
    for k in range(rounds):
        worst = F.lit(0.0)
        for d in DIMENSIONS:
            factor = fit.groupBy(d).agg(F.sum("fitted").alias("now")).join(goals[d], d).select(d, F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(1.0).alias(f"f_{d}"))
            fit = fit.join(factor, d, "left").withColumn("fitted", F.col("fitted") * F.coalesce(f"f_{d}", F.lit(1.0)))
            worst = F.greatest(worst, F.coalesce(F.abs(F.col(f"f_{d}") - 1), F.lit(0.0)))
        fit = fit.withColumn("worst", worst).select(*DIMENSIONS, "tokens", "n", "fitted", "worst")
        if k % keep_every == keep_every - 1 or k == rounds - 1:
            fit = staged(fit, "rake")
            if (fit.agg(F.max("worst")).first()[0] or 0.0) < tolerance:
                break
    fit = fit.withColumn("weight", F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens")).otherwise(1.0))
    kept = lambda rate: fit.agg(F.sum(F.least(F.lit(1.0), F.col("weight") * rate) * F.col("tokens"))).first()[0] or 0.0
    low, high = 0.0, 1.0
    while kept(high) < budget * total * (1 - 1e-12) and high < 1e12:
        low, high = high, high * 4
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if kept(mid) < budget * total else (low, mid)
    return fit.select(*DIMENSIONS, "weight", F.least(F.lit(1.0), F.col("weight") * high).alias("probability"))


def _drawn(df: DataFrame, carry: list[str], targets, budget: float, id_col: str, text: str, topic_of, seed: int, driver_cells: int) -> DataFrame:
    """Some columns of df as a struct, __row, beside what is made here, so that no names clash. Rows without the text are staged, so that it is read once."""
    named = df.select(
        F.struct(*carry).alias("__row"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("und")).alias(c) for c in ("source", "lang")],
        topic_of(F.col(text)).alias("topic"),
        word_count(F.col(text)).alias("n_tokens"),
        draw(F.col(id_col), F.crc32(text), seed=seed).alias("u"),
    )
    if text not in carry:
        named = staged(named, "mixing")
    cells = staged(cell_table(named), "cells")
    n = cells.count()
    fitted = rake_cells(cells, targets, budget) if n <= driver_cells else staged(rake_table(cells, targets, budget), "fitted")
    if n <= BROADCAST_CELLS:
        fitted = F.broadcast(fitted)
    return named.join(fitted, list(DIMENSIONS), "left").withColumn("sampled", F.col("u") < F.col("probability"))


def mix(df: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, id_col: str = "doc_id", text: str = "text", topic_of=topic, seed: int = SEED, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """One row per row of df: its id, source, lang, topic, n_tokens, weight, probability and sampled."""
    out = _drawn(df, [id_col], targets, budget, id_col, text, topic_of, seed, driver_cells)
    return out.select(F.col(f"__row.{id_col}"), *DIMENSIONS, "n_tokens", "weight", "probability", "sampled")


def sample(df: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, id_col: str = "doc_id", text: str = "text", topic_of=topic, seed: int = SEED, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """The rows of df that the draw keeps, with the columns of df."""
    return _drawn(df, df.columns, targets, budget, id_col, text, topic_of, seed, driver_cells).filter("sampled").select("__row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, probability and draw of every document, raked to TARGETS and default shares."""
    return mix(documents(spark, sf_dir), TARGETS)
