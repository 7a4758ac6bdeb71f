"""End-to-end plans: sorting labels, matching events, searching, checking agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import schema as S
from labelloom.functions import dates as D
from labelloom.functions import geo as G
from labelloom.functions import text as T
from labelloom.operators import cluster as C
from labelloom.operators import evaluate as E
from labelloom.operators import gazetteer as Z
from labelloom.operators import match as M
from labelloom.operators import names as N
from labelloom.operators.index import Options, make_index
from labelloom.operators.search import search as _search


def parse_info(texts: DataFrame, dates: bool = True, collectors: DataFrame | None = None, gazetteer: DataFrame | None = None, coordinates: bool = False) -> DataFrame:
    """ID and {date, collectors, geo} verbatim (v) and interpreted (i), empty strings where nothing is found.

    What a step reads it blanks for the next: dates, then names, then places.
    """
    rows = texts.select("ID", F.coalesce("text", F.lit("")).alias("text"))
    found = rows.withColumn("_d", D.find_date(F.col("text")) if dates else F.lit(None).cast(D.FOUND_TYPE))
    rows = found.select("ID", F.when(F.col("_d").isNotNull(), T.clear_ranges(F.col("text"), F.array(F.struct(F.col("_d.span_start").alias("start"), F.col("_d.span_end").alias("end"))), inclusive=False)).otherwise(F.col("text")).alias("text"), F.coalesce("_d.verbatim", F.lit("")).alias("date_v"), F.coalesce(D.iso_range(F.col("_d")), F.lit("")).alias("date_i"))
    if collectors is not None:
        named = N.find_collectors(rows, collectors).join(rows.select("ID", "text"), "ID")
        label = collectors.select(F.col("ID").alias("collector_id"), F.concat_ws(", ", "name", F.when(F.col("firstname") != "", F.col("firstname"))).alias("label"))
        parts = named.select("ID", "text", F.posexplode("names").alias("i", "n")).join(label, F.col("n.collector_id") == F.col("collector_id"))
        read = parts.groupBy("ID").agg(F.array_sort(F.collect_list(F.struct("i", F.substring("text", F.col("n.start") + 1, F.col("n.end") - F.col("n.start")).alias("v"), "label", F.col("n.start").alias("start"), F.col("n.end").alias("end")))).alias("p"))
        rows = rows.join(read, "ID", "left").select("ID", F.when(F.col("p").isNotNull(), T.clear_ranges(F.col("text"), F.col("p"), inclusive=False)).otherwise(F.col("text")).alias("text"), "date_v", "date_i", F.coalesce(F.array_join("p.v", "|"), F.lit("")).alias("collector_v"), F.coalesce(F.array_join("p.label", ", "), F.lit("")).alias("collector_i"))
    else:
        rows = rows.withColumns({"collector_v": F.lit(""), "collector_i": F.lit("")})
    at = G.latlng(F.col("text")) if coordinates else F.lit(None).cast("struct<lat:double,lng:double,verbatim:string>")
    rows = rows.withColumn("_g", at)
    place = F.lit(None).cast("string"), F.lit(None).cast("string")
    if gazetteer is not None:
        hits = Z.find_places(rows.filter("_g is null").select("ID", "text"), gazetteer).select("ID", "gram", F.concat_ws(", ", "name", F.when(F.col("country") != "no_country", F.col("country"))).alias("place"))
        rows = rows.join(hits, "ID", "left")
        place = F.col("gram"), F.col("place")
    return rows.select("ID", "date_v", "date_i", "collector_v", "collector_i", F.coalesce("_g.verbatim", place[0], F.lit("")).alias("geo_v"), F.coalesce(F.when(F.col("_g").isNotNull(), F.format_string("%.5f, %.5f", "_g.lat", "_g.lng")), place[1], F.lit("")).alias("geo_i"))


def sort_labels(labels: DataFrame, threshold: float = 0.8, min_len: int = 3, refine: bool = False, consensus: str | None = None, quorum: int = 2, parse_and_sort: bool = False, id_format: str = "label:5", **info) -> DataFrame:
    """Labels (ID, text, pos) with group_id, parsed information and the group's consensus."""
    labels = S.with_position(labels)
    if parse_and_sort:
        rows = labels.join(parse_info(labels, **info), "ID")
        rows = E.group_by_key(rows, ["date_i", "collector_i", "geo_i"])
        return rows.withColumn("group_id", T.id_formatter(id_format, F.col("group_id")))
    groups = C.cluster_by_text(labels, Options(2, min_len), threshold)
    rows = labels.join(groups, "ID")
    if refine:
        rows = rows.join(C.refine(rows.select("ID", "text", "leader", "pos")).select("ID", "part"), "ID")
    else:
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    leader = labels.select(F.col("ID").alias("leader"), F.col("pos").alias("_first"))
    rows = E.group_by_key(rows.join(leader, "leader").withColumn("_own", F.col("pos")).withColumn("pos", F.col("_first")), ["leader", "part"]).withColumn("pos", F.col("_own")).drop("_own", "_first")
    rows = rows.withColumn("group_id", T.id_formatter(id_format, F.col("group_id") + 1)).drop("leader", "part")
    source = rows.select("ID", "text")
    if consensus:
        members = rows.select("group_id", "ID", "pos", "text")
        best = C.pick_consensus(members, quorum) if consensus == "pick" else C.alignment_consensus(members, quorum)
        rows = rows.join(best, "group_id", "left")
        source = rows.select("ID", F.coalesce("consensus", "text").alias("text"))
    return rows.join(parse_info(source, **info), "ID") if info else rows


#: Columns of a table of sorted labels, and where they come from.
SORTED = {"label.ID": "ID", "label.v": "text", "group.ID": "group_id", "geo.v": "geo_v", "geo.i": "geo_i", "date.v": "date_v", "date.i": "date_i", "collector.v": "collector_v", "collector.i": "collector_i", "consensus.text": "consensus"}


def sorted_table(rows: DataFrame) -> DataFrame:
    """``sort_labels`` with the columns of its table, empty where nothing was read, in the order of group and label."""
    cells = [(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")).alias(k) for k, c in SORTED.items()]
    return rows.select(*cells, *["pos"] * ("pos" in rows.columns)).orderBy("`group.ID`", *["pos"] * ("pos" in rows.columns), "`label.ID`")


def match_events(labels: DataFrame, events: DataFrame, fields: tuple[str, ...] = ("text",), method: int = 1, scoring: str = "w", use_dates: bool = False, persist: bool = False, text_search: bool = True, date_mode: str = "reference") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches with both sides' fields, labels without a match, events without a match."""
    index = make_index(events, Options(method, 3, fields))
    found = M.match_events(labels, index, M.date_index(events) if use_dates else None, scoring, persist, text_search, date_mode)
    shown = found.join(labels.select(F.col("ID").alias("label_id"), F.col("text").alias("label_text")), "label_id").join(events.select(F.col("ID").alias("event_id"), "location", "date", "collector", F.col("text").alias("event_text")), "event_id")
    columns = {"label.ID": "label_id", "label.text": "label_text", "CE.ID": "event_id", "CE.location": "location", "CE.date": "date", "CE.collector": "collector", "CE.text": "event_text", "score": "score"}
    return shown.select(*[F.col(v).alias(k) for k, v in columns.items()]), M.unmatched(labels, found, "label_id"), M.unmatched(events, found, "event_id")


def search_labels(labels: DataFrame, query: str, method: int = 1, min_len: int = 3, scoring: str = "w", threshold: float = 0.0) -> DataFrame:
    """hit, score of one query, best first."""
    queries = labels.sparkSession.createDataFrame([("q", query)], "query_id string, query string")
    return _search(queries, make_index(labels, Options(method, min_len)), scoring, threshold=threshold).select(F.col("ID").alias("hit"), "score").orderBy(F.desc("score"), "hit")


def checkout(groups: DataFrame, matches: DataFrame, mode: str = "intended") -> tuple[DataFrame, DataFrame]:
    """Confidence of each group's event, and statistics of clusters and events."""
    rows = E.assigned(groups, E.best_match(matches))
    return E.group_confidence(rows).orderBy("group_id"), E.cluster_statistics(rows, mode)
