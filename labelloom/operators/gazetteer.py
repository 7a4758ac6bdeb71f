"""Places in texts, by a gazetteer (geoname_id, name, country, fcl, lat, lng, parent_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions import geo as G
from labelloom.functions import text as T
from labelloom.storage import written


def ngrams(texts: DataFrame, max_n: int = 4) -> DataFrame:
    """ID, n, gram: n-grams of words of three Latin letters or more."""
    words = F.regexp_extract_all(T.simplify(F.coalesce(F.col("text"), F.lit(""))), F.lit("([a-z]{3,})"), 1)

    def of(n: int):
        joined = F.array_distinct(F.transform(T.ngrams(F.col("w"), n), lambda g: F.array_join(g, " ")))
        return F.transform(joined, lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    grams = F.flatten(F.array(*map(of, range(1, max_n + 1))))
    return texts.select("ID", words.alias("w")).select("ID", F.explode(grams).alias("g")).select("ID", "g.*")


def find_places(texts: DataFrame, gazetteer: DataFrame, max_n: int | None = None) -> DataFrame:
    """ID, geoname_id, name, country, lat, lng, gram.

    N-grams are as long as the gazetteer's longest name unless ``max_n`` says less.

    The longest n-grams with any hit count.  Hits without a country go if others have
    one.  Of the countries the one with the most general hit wins, and of its hits
    the most special one is the place.
    """
    places = gazetteer.withColumn("gram", T.simplify(F.col("name"))).withColumn("rank", G.feature_rank(F.col("fcl"))).withColumn("country", F.coalesce("country", F.lit("no_country")))
    if max_n is None:
        max_n = places.agg(F.max(F.size(F.split("gram", " "))).alias("n")).first()["n"] or 1
    hits = ngrams(texts, max_n).join(places, "gram")
    longest = hits.groupBy("ID").agg(F.max("n").alias("n"))
    hits = hits.join(longest, ["ID", "n"])
    groups = hits.groupBy("ID", "country").agg(F.min("rank").alias("top"), F.max_by(F.struct("geoname_id", "name", "lat", "lng", "gram"), F.struct("rank", (-F.col("geoname_id")).alias("g"))).alias("best"))
    best = groups.groupBy("ID").agg(F.min(F.struct((F.col("country") == "no_country").alias("none"), "top", "country", "best")).alias("b"))
    return best.select("ID", "b.best.geoname_id", "b.best.name", "b.country", "b.best.lat", "b.best.lng", "b.best.gram")


def by_country(hits: DataFrame) -> DataFrame:
    """country, n, places."""
    return hits.groupBy(F.coalesce("country", F.lit("no_country")).alias("country")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("name")).alias("places"))


def hierarchy(gazetteer: DataFrame) -> DataFrame:
    """geoname_id, path: ids from the place to its outermost parent; a ring of parents ends where it meets itself.

    Paths double in each round: a path that ends at x is continued by the path of x.
    """
    paths = written(gazetteer.select("geoname_id", F.array("geoname_id").alias("path"), F.col("parent_id").alias("next")), "paths")
    while not paths.filter("next is not null").isEmpty():
        ahead = paths.select(F.col("geoname_id").alias("_id"), F.col("path").alias("_path"), F.col("next").alias("_next"))
        joined = paths.join(ahead, paths["next"] == ahead["_id"], "left")
        ring = F.coalesce(F.arrays_overlap("path", "_path"), F.lit(False))
        # of a ring, what is not on the path yet is taken up to the first place that is
        new = F.when(ring, F.slice("_path", F.lit(1), F.size("_path") - F.size(F.filter("_path", lambda x: F.array_contains("path", x))))).otherwise(F.coalesce("_path", F.array().cast("array<long>")))
        paths = written(joined.select("geoname_id", F.concat("path", new).alias("path"), F.when(~ring, F.col("_next")).alias("next")), "paths")
    return paths.select("geoname_id", "path")
