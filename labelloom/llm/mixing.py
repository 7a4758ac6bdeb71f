"""Mixing sources to target weights along a time-varying curriculum.

Sources share the corpus size by weight, with a ceiling in passes over their own
words; what a ceiling cuts off is shared out again by weight (water filling in
closed form over the sorted ceilings).  A source's weight changes over the run by
a linear schedule; the schedules' mean, weighted by target, is taken off them, so that the
weights sum to the same at every time and a position is the share of the mix read so
far.  Integrating a schedule gives the cumulative demand in words; the
inverse of that integral turns each document's place in its source's word stream
into a training position in [0, 1], by which documents are range-sorted.

A source's word stream runs over its documents in the order of a hash of id and text,
as many full passes as the target holds, then a part of one more pass.  Running
totals are taken in two steps, over hash buckets and inside them, so the largest
source is dealt over many tasks.  The number of buckets follows the row count.
Sources are ordered in one task: a row for each.

Defined results: a null text has no words, takes nothing and has no position; null
source is a source of its own and comes last; rows sharing a ``doc_id``, or without
one, count each, and equal ones stand next to each other in the stream; very long texts
are counted whole; other columns, whatever they are called, are ignored by ``mixed`` and
kept by ``mix``; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Space, words_column

#: Passes over a source's own words at most.
PASSES = 3
#: Weights by rank of the source, repeating.
WEIGHTS = (1, 2, 3)
#: How far each weight class rises (or falls) over the run: the weight at time t is in proportion to 1 + slope * (2t - 1), before the mean is taken off.
SLOPES = (-0.5, 0.0, 0.5)
#: Rows for which one hash bucket is made.
BUCKET_ROWS = 4000


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, slope, target; ``sizes`` has source and source_size, one row for each source.

    Target: ``min(PASSES * size, level * weight)``, the level such that targets sum to the sum of the sizes.
    """
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    rows = sizes.withColumn("_r", rank)

    def pick(values) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.col("_r") % len(values) + 1).cast("int"))

    rows = rows.withColumns({"weight": pick(WEIGHTS), "slope": pick(SLOPES), "cap": PASSES * F.col("source_size")})
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "_r")
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_level", (total - before) / weights)
    level = F.max("_level").over(Window.partitionBy())  # it rises while sources fill up, and falls once one is counted full too early
    rows = rows.withColumn("target", F.round(F.least(F.col("cap").cast("double"), level * F.col("weight")), 6))
    # every |slope| is half at most before and the mean lies between them, so none reaches 1
    mean = F.sum(F.col("target") * F.col("slope")).over(Window.partitionBy()) / F.sum("target").over(Window.partitionBy())
    return rows.select("source", "source_size", "weight", F.round(F.col("slope") - F.coalesce(mean, F.lit(0.0)), 9).alias("slope"), "target")


def position(share: Column, slope: Column) -> Column:
    """Time at which the given share of a source's demand has been met."""
    rest = 1 - slope
    return F.when(share <= 0, F.lit(0.0)).otherwise(2 * share / (rest + F.sqrt(rest * rest + 4 * slope * share)))


def plan(spark: SparkSession, docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, passes, start (words of the source before this document), slope, key.

    With ``carry`` the whole row goes along as ``_row``, so nothing need be joined back by an
    id; the words are then counted twice instead of writing the corpus once more.
    """
    space = Space(spark, "mixing")
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5(text.cast("binary")), F.lit(""))).cast("binary"))
    columns = [F.col("doc_id"), source.alias("source"), F.size(words_column(text)).cast("long").alias("size"), key.alias("key")]
    rows = docs.select(*columns)
    if not carry:
        rows = space.save(rows)
    digits = max(0, min(6, math.ceil(math.log(max(docs.count() / BUCKET_ROWS, 1), 16))))
    bucket = F.substring("key", 1, digits)
    base = space.save(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("_s")))
    per_source = space.save(targets(base.groupBy("source").agg(F.sum("_s").alias("source_size"))))
    if carry:
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *columns)
    rows = rows.withColumn("bucket", bucket)
    base = base.withColumn("base", F.sum("_s").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("source", "bucket", F.coalesce("base", F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))

    def on(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
        r = right.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in right.columns])
        out = left.join(r, [left[k].eqNullSafe(r[f"_k_{k}"]) for k in keys])
        return out.drop(*[f"_k_{k}" for k in keys])

    rows = on(on(rows, base, "source", "bucket"), per_source, "source")
    rows = rows.withColumn("start", F.col("base") + F.col("_in")).withColumn("words", F.round("target").cast("long"))
    rows = rows.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - F.col("passes") * F.col("source_size") - F.col("start")))
    return rows.withColumn("taken", (F.col("passes") * F.col("size") + part).cast("long")).drop("base", "_in", "bucket", "words", "weight")


def _when(copy: Column) -> Column:
    return F.when((F.col("taken") > 0) & (F.col("target") > 0), position((copy * F.col("source_size") + F.col("start")) / F.col("target"), F.col("slope")))


def mixed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns and the position of the first copy, range-sorted by position."""
    rows = plan(spark, docs).withColumn("position", F.round(_when(F.lit(0)), 9))
    rows = rows.orderBy(F.asc_nulls_last("position"), "key")
    return rows.select("doc_id", "size", "source_size", "target", "taken", "position")


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` as the mix reads them: a row for each copy, range-sorted by training position.

    The one document at which a source's last pass ends is taken whole if at
    least half of it lies within the target, else not.
    """
    rows = plan(spark, docs, carry=True)
    part = F.col("taken") - F.col("passes") * F.col("size")
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + F.when(2 * part >= F.col("size"), 1).otherwise(0)).otherwise(0)).filter("copies > 0")
    rows = rows.select("_row", "key", F.explode(F.transform(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int")), _when)).alias("_position"))
    return rows.orderBy("_position", "key").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, rank % 3 + 1 AS weight, 3 * source_size AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / CAST(weight AS DOUBLE), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / CAST(sum(weight) OVER (ORDER BY cap / CAST(weight AS DOUBLE), rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev FROM w),
g AS (SELECT source, source_size, weight, round(least(CAST(cap AS DOUBLE), (SELECT max(lev) FROM l) * weight), 6) AS target FROM l),
t AS (SELECT *, round(CAST((weight - 2) / CAST(2 AS DOUBLE) - sum(target * (weight - 2) / CAST(2 AS DOUBLE)) OVER () / sum(target) OVER () AS DOUBLE), 9) AS slope FROM g),
c AS (SELECT d.*, t.source_size, t.target, slope, CAST(round(target) AS BIGINT) AS words,
   CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS passes FROM c),
q AS (SELECT *, CAST(passes * size + greatest(0, least(size, words - passes * source_size - start)) AS BIGINT) AS taken, start / target AS u FROM p)
SELECT doc_id, size, source_size, target, taken, round(CAST(CASE WHEN taken > 0 AND target > 0 THEN CASE WHEN u <= 0 THEN 0.0 ELSE 2 * u / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * u)) END END AS DOUBLE), 9) AS position
FROM q
"""
