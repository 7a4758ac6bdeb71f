"""How well groups of labels agree with the events matched to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.storage import numbered


def best_match(matches: DataFrame) -> DataFrame:
    """label_id, event_id, score: the highest score; of equal ones the last by ``pos`` (or by event)."""
    order = F.struct("score", "pos") if "pos" in matches.columns else F.struct("score", "event_id")
    return matches.groupBy("label_id").agg(F.max_by(F.struct("event_id", "score"), order).alias("b")).select("label_id", "b.event_id", "b.score")


def assigned(groups: DataFrame, best: DataFrame) -> DataFrame:
    """label_id, group_id, event_id, score; labels without a match are ``unassigned`` with score 0."""
    out = groups.select("label_id", "group_id").join(best, "label_id", "left")
    return out.select("label_id", "group_id", F.coalesce("event_id", F.lit("unassigned")).alias("event_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def group_confidence(rows: DataFrame) -> DataFrame:
    """group_id, event_id, confidence: the most frequent event (of equal ones the first by name), its share times its mean score."""
    by_event = rows.groupBy("group_id", "event_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    top = by_event.groupBy("group_id").agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("n"), "event_id", "mean")).alias("t"))
    return top.select("group_id", "t.event_id", (-F.col("t.n") / F.col("size") * F.col("t.mean")).alias("confidence"))


def labels_per_group(groups: DataFrame) -> DataFrame:
    return groups.groupBy("group_id").agg(F.count("*").alias("n"))


def summary(counts: DataFrame, column: str = "n") -> DataFrame:
    """Number, mean and population standard deviation."""
    return counts.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd"))


def cluster_statistics(rows: DataFrame, mode: str = "intended") -> DataFrame:
    """Per statistic: n, mean, sd of labels per cluster, events per cluster, clusters per event.

    ``reference`` counts as existing reports do: one event a cluster, and labels in
    place of clusters per event.
    """
    per_cluster = rows.groupBy("group_id").agg(F.count("*").alias("n"))
    if mode == "reference":
        top = group_confidence(rows)
        events = top.groupBy("group_id").agg(F.count("*").alias("n"))
        clusters = rows.groupBy("event_id").agg(F.count("*").alias("n"))
    else:
        events = rows.groupBy("group_id").agg(F.count_distinct("event_id").alias("n"))
        clusters = rows.groupBy("event_id").agg(F.count_distinct("group_id").alias("n"))
    parts = [summary(df).select(F.lit(name).alias("statistic"), "n", "mean", "sd") for name, df in (("labels_per_cluster", per_cluster), ("events_per_cluster", events), ("clusters_per_event", clusters))]
    return parts[0].union(parts[1]).union(parts[2])


def group_by_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (with pos) and group_id: rank, from 0, of the key's first appearance."""
    first = rows.groupBy(*keys).agg(F.min("pos").alias("_first"))
    ranked = numbered(first, "_first", "group_id")
    out = rows.alias("r").join(ranked.alias("k"), [F.col(f"r.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys])
    return out.select("r.*", "k.group_id")
