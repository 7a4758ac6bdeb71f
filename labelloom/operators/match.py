"""Matching labels to collecting events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions import dates as D
from labelloom.storage import written

from .index import Index
from .search import search


def date_index(events: DataFrame) -> DataFrame:
    """ID and range of events whose date can be read."""
    found = events.select("ID", D.find_date(F.col("date")).alias("f"))
    return found.filter("f is not null").select("ID", F.struct("f.start", "f.end").alias("range"))


def search_by_date(queries: DataFrame, index: DataFrame, assume_same_century: bool = True, mode: str = "reference") -> DataFrame:
    """query_id, ID of events whose range overlaps; ``queries`` (query_id, range).

    An equi-join on years: both sides stand once for each year of their range
    (year in century, if centuries may be assumed).
    """
    def years(df: DataFrame) -> DataFrame:
        all_years = F.sequence(F.col("range.start.year"), F.greatest("range.start.year", "range.end.year"))
        return df.withColumn("_y", F.explode(F.array_distinct(F.transform(all_years, lambda y: y % 100)) if assume_same_century else all_years))

    q, e = years(queries.select("query_id", "range")), years(index).withColumnRenamed("range", "event_range")
    hits = q.join(e, "_y").filter(D.overlaps(F.col("range"), F.col("event_range"), assume_same_century, mode))
    return hits.select("query_id", "ID").distinct()


def match_events(labels: DataFrame, index: Index, dates: DataFrame | None = None, scoring: str = "w", persist: bool = False, text_search: bool = True, date_mode: str = "reference", fuzzy: bool = True) -> DataFrame:
    """label_id, event_id, score.

    With ``dates`` (a date index), labels with a date match overlapping events only;
    those left without any are matched without dates if ``persist``.
    """
    queries = labels.select(F.col("ID").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    if dates is None:
        return search(queries, index, scoring, fuzzy).select(F.col("query_id").alias("label_id"), F.col("ID").alias("event_id"), "score")
    found = queries.select("query_id", D.find_date(F.col("query")).alias("f"))
    dated = written(found.filter("f is not null").select("query_id", F.struct("f.start", "f.end").alias("range")), "dated")
    if not text_search:
        near = search_by_date(dated, dates, True, date_mode)
        return near.select(F.col("query_id").alias("label_id"), F.col("ID").alias("event_id"), F.lit(1.0).alias("score"))
    # what the text finds is bounded by it already: both ranges go along, no table of all pairs of a year
    every = written(search(queries, index, scoring, fuzzy).join(dated.withColumn("_dated", F.lit(True)), "query_id", "left"), "matches")
    both = every.filter("_dated").join(dates.select("ID", F.col("range").alias("event_range")), "ID")
    restricted = both.filter(D.overlaps(F.col("range"), F.col("event_range"), True, date_mode)).select("query_id", "ID", "score")
    hits = every.filter("_dated is null").select("query_id", "ID", "score").unionByName(restricted)
    if persist:
        lost = every.filter("_dated").join(restricted.select("query_id").distinct(), "query_id", "left_anti")
        hits = hits.unionByName(lost.select("query_id", "ID", "score"))
    return hits.select(F.col("query_id").alias("label_id"), F.col("ID").alias("event_id"), "score")


def unmatched(df: DataFrame, matches: DataFrame, column: str) -> DataFrame:
    """IDs without any hit."""
    return df.select("ID").join(matches.select(F.col(column).alias("ID")).distinct(), "ID", "left_anti")
