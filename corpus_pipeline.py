"""A training corpus from documents: language ID, near-dedup, decontamination, source mixing, sharding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language, mixing, near_dup, sharding
from tessera.llm.common import staged

#: Two languages whose costs differ by less than this share don't tell a text's language, if the text has at least so many characters; a shorter one says too little to reject it.
LEAST_SCORE = 0.02
LEAST_CHARS = 100
SHARDS = 24


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (null and empty texts are such) and longer ones whose language the parse can't tell; labels are only learned from outside the held-out fold.

    Repeated rows have one fate; without labels every document is rejected; an empty table stays empty.
    """
    model = language.fit(docs, train=~language.held_out(F.col("doc_id")))
    told = language.identify(docs.withColumn("_copy", F.col("text")), model, text="_copy")
    sure = (F.col("score") >= LEAST_SCORE) | (F.length("text") < LEAST_CHARS)
    return told.filter((F.col("lang_pred") != "und") & sure).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each near-duplicate class the document of least id, and documents without an id or words as they are.

    Rows that share an id are one document: of several that stay, the least by text and other columns does.
    """
    classes = staged(near_dup.near_duplicates(docs).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.count(F.lit(1)).alias("n")), "classes")
    gone = classes.filter("doc_id > class_id").select(F.col("doc_id").alias("_gone"))
    kept = docs.join(_small(gone), F.col("doc_id") == F.col("_gone"), "left_anti")
    twice = classes.filter("doc_id = class_id AND n > 1").select(F.col("doc_id").alias("_twice"))
    if not twice.limit(1).count():
        return kept
    side = _small(twice)
    once = kept.join(side, F.col("doc_id") == F.col("_twice"), "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in docs.columns if c != "text"])).alias("_row"))
    return kept.join(side, F.col("doc_id") == F.col("_twice"), "left_anti").unionByName(once.select("_row.*").select(*docs.columns))


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= 500_000 else ids


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none, rows that share an id go together, an empty table of either kind drops nothing."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source (null is one) at the same weight, as many documents in all as come in; repeated rows and null texts are documents like others; an empty table stays empty."""
    return mixing.mix_sources(docs).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard and the slot in it; null ids count as 0, repeated rows get slots of their own, an empty table stays empty."""
    out = sharding.shard_documents(docs, SHARDS, grown=False)
    return out.select(*docs.columns, F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with columns that documents doesn't have under names that can't clash with its own."""

    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: f"extra_{i}_of_input" for i, c in enumerate(docs.columns) if c not in COLUMNS}
        return stage(spark, docs.withColumnsRenamed(names), sf_dir).withColumnsRenamed({v: k for k, v in names.items()})

    run_.__doc__ = stage.__doc__
    return run_


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", _apart(language_id)),
    ("near-dedup", _apart(near_dedup)),
    ("decontamination", _apart(decontamination)),
    ("mixing", _apart(source_mix)),
    ("sharding", _apart(shards)),
]

#: The language model and ProbMinHash have no SQL form; a test compares the rows of each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
