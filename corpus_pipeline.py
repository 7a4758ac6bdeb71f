"""The corpus pipeline: five stages over ``documents``, each one operator of ``labelloom.llm``.

Each stage gets what its predecessor wrote and returns what the next one reads.

Defined results, for all stages: null, empty and very long texts are read whole; rows
sharing a ``doc_id``, or without one, are rows like others; columns beside those named
here stay as they are, whatever they are called; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import decontaminate, mixing, quality_rules, setsketch, sharding
from labelloom.llm.common import Space, prepare, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null, empty and blank texts fail them, repeated rows are judged each."""
    return quality_rules.kept_rows(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest id.

    Texts without words are no copies of each other and stay all.  Where ids repeat or are
    missing, rows are compared by a number of their own: of a group the row with the
    smallest id stays (any id before none), of several the one that is stored first.
    """
    if docs.filter("doc_id is null").isEmpty() and docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        gone = setsketch.near_duplicates(spark, docs, width=5, percent=80).filter(~F.col("kept")).select("doc_id")
        return docs.join(gone, "doc_id", "left_anti")
    space = Space(spark, "keyed")
    keyed = space.save(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.monotonically_increasing_id().alias("_key")))
    found = setsketch.near_duplicates(spark, keyed.select(F.col("_key").alias("doc_id"), F.col("_row.text").alias("text")), width=5, percent=80)
    groups = found.select(F.col("doc_id").alias("_key"), "component_id").join(keyed.select("_key", F.col("_row.doc_id").alias("_id")), "_key")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_key")).alias("m")).select(F.col("m._key").alias("_key"))
    return keyed.join(first, "_key", "left_semi").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark: the limit of coverage is 0, so one window of ten words rejects; null texts have none and stay."""
    return decontaminate.remove(spark, docs, table(spark, sf_dir, "benchmark"), max_share=0.0)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often (three times at most) and in the order in which the mix reads them; texts without words are not read."""
    return mixing.mix(spark, docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot; an input column called like one of the result's gets ``input_`` before its name."""
    return sharding.shards(spark, docs, tuple(docs.columns))


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixture), ("sharding", shard)]
#: Covariance estimates and sketches have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages; what a stage returns is written as Parquet in the shared folder and read again.

    Once a stage's result is written, its own tables and its input go.
    """
    prepare(spark)
    space, old = Space(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        mark = len(Space.made)
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = space.save(docs)
            for own in Space.made[mark:]:
                own.clear()
            if old is not None:
                space.drop(old)
            old = docs
    return docs
