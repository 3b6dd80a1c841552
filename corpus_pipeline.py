"""The corpus pipeline: quality rules, language ID, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents, further ones included.

Nulls and edge cases: an empty table passes all stages and stays empty; repeated
rows are judged alike, and one of them is left by near_duplicates; rows with a
null id take part like others. What each stage does with null, empty and very
long texts and with ties stands with it. No stage cuts a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chosen_path, language_id, mixing, quality
from tessera.llm._common import documents, staged

#: Most rows of a batch between Spark and its Python workers, which both hold whole batches of texts, at several times their size.
BATCH_ROWS = 1000
#: Documents whose best language has less than this mean probability are rejected, as are those without letters.
MIN_LANGUAGE_SCORE = 0.5


def in_small_batches(spark: SparkSession) -> None:
    """From now on the session's batches have at most BATCH_ROWS rows. What they hold is not cut, and results do not depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:  # without a limit, if not over 0
        spark.conf.set(key, BATCH_ROWS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or a cutoff calibrated on labelled good documents, go.

    A null or empty text has no words, fails the base rules and goes. A value equal to its cutoff stays. Documents whose
    language is null are a stratum of their own. Without labels only the base rules apply.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a clear language go; lang becomes the predicted one.

    The model learns from the stage's own documents with a language, as this relabels them rather than measures itself. A
    null text, or one without letters, has no language and goes; so do all, if no document has a language to learn from.
    Of equally likely languages the first in alphabetical order is taken.
    """
    in_small_batches(spark)
    model = language_id.fit(docs)
    others = F.struct(*[c for c in docs.columns if c != "text"])
    rows = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"), others.alias("__row"))
    found = language_id.predict(rows, model, "__id", "__text", carry=["__text", "__row"])  # a text is sent once
    found = found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    own = {"lang": F.col("lang_pred"), "text": F.col("__text")}
    return found.select(*[own.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by shingle similarity, the one with the least id stays.

    Null texts and texts without words link with nothing and stay. If several rows have the least id, one of them stays;
    if all ids of a class are null, one of its rows.
    """
    in_small_batches(spark)
    return chosen_path.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by raked weights of sources, languages and topics.

    Null sources and languages are the value "und". A document without words is kept by its cell's probability. The draw
    is a hash of id and text, so that repeated rows are kept or dropped together, in every run alike.
    """
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, decoded again; digests of both. A null text is encoded as an empty one: no ids."""
    in_small_batches(spark)
    return bpe.with_digests(bpe.encode_decode(docs.select("doc_id", "lang", "source", "text")))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", identify_language),
    ("near_duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The language model and the join's sampling have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
