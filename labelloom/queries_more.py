"""Queries of readers, writers, commands and the smaller expressions, and their DuckDB forms.

What a reader is to read is first written from the test tables to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom import schema as S
from labelloom.functions import dates as D
from labelloom.functions import geo as G
from labelloom.functions import text as T
from labelloom.operators import evaluate as E
from labelloom.operators import gazetteer as Z
from labelloom.operators import match as M
from labelloom.operators import names as N
from labelloom.operators.index import Index, Options, make_index
from labelloom.operators.search import search
from labelloom.plans import pipelines as P
from labelloom.queries import _DOC_QUERIES, _ITEM_QUERIES, _index_sql, _read, _rounded, _search_sql, dated, items, labels, query
from labelloom.sources import readers as R
from labelloom.sources import writers as W
from labelloom.storage import new_path

# --- readers and writers --------------------------------------------------------------


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the schema, made from parts."""
    p = _read(spark, sf, "part")
    return p.select(F.col("p_partkey").cast("string").alias("ID"), F.col("p_brand").alias("location"), F.col("p_size").cast("string").alias("date"), F.col("p_type").alias("collector"), F.col("p_name").alias("text"))


_EVENTS = """SELECT CAST(p_partkey AS VARCHAR) AS "ID", p_brand AS location, CAST(p_size AS VARCHAR) AS date, p_type AS collector, p_name AS text FROM part"""


@query("""SELECT CAST(doc_id AS VARCHAR) AS "ID", coalesce(text, '') AS text FROM documents""")
def json_labels(spark, sf):
    """Written as JSON lines, read again; every line break and sign survives."""
    path = new_path(spark, "labels")
    W.write_json(labels(spark, sf).select(F.col("ID").cast("string").alias("ID"), "text"), path)
    return R.read_labels(spark, path).select("ID", "text")


@query(_EVENTS)
def json_events(spark, sf):
    path = new_path(spark, "events")
    W.write_json(_events(spark, sf), path)
    return R.read_events(spark, path).drop("pos")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS "ID", p_name AS text FROM part""")
def json_array_scan(spark, sf):
    """Arrays as other programs write them: one for each brand, over several lines."""
    path = new_path(spark, "arrays")
    one = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("ID"), F.col("p_name").alias("text"), F.lit(1).alias("more")))
    arrays = _read(spark, sf, "part").groupBy("p_brand").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(one), ",\n"), F.lit("\n]")).alias("value"))
    arrays.select("value").repartition("value").write.option("lineSep", "\n").text(path)
    # one file may hold several arrays here, so each is read from a file of its own
    files = [r["f"] for r in spark.read.text(path).select(F.input_file_name().alias("f")).distinct().collect()]
    parts = spark.read.text(files, wholetext=True).select(F.explode(F.filter(F.split("value", r"(?<=\])\n(?=\[)"), lambda x: x != "")).alias("value"))
    single = new_path(spark, "single")
    parts.withColumn("n", F.xxhash64("value")).write.partitionBy("n").text(single)
    return R.json_rows(spark, single, S.LABEL).select("ID", "text")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS "ID", c_name AS name, c_mktsegment AS firstname, CAST(c_nationkey AS VARCHAR) AS nation FROM customer""")
def json_collectors(spark, sf):
    path = new_path(spark, "collectors")
    c = _read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("ID"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("firstname"), F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("metadata"))
    W.write_json(c, path)
    return R.read_collectors(spark, path).select("ID", "name", "firstname", F.col("metadata")["nation"].alias("nation"))


@query("""SELECT 'label' || CASE WHEN n < 100000 THEN lpad(CAST(n AS VARCHAR), 5, '0') ELSE CAST(n AS VARCHAR) END AS "ID", text FROM (SELECT row_number() OVER (ORDER BY lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), page) AS n, text FROM (SELECT s_suppkey, s_name AS text, 0 AS page FROM supplier UNION ALL SELECT s_suppkey, '', 1 FROM supplier))""")
def ocr_pages(spark, sf):
    """OCR responses: a file for each supplier, its name on the first page, nothing on the second."""
    path = new_path(spark, "ocr")
    s = _read(spark, sf, "supplier")
    page = F.struct(F.struct(F.col("s_name").alias("text")).alias("fullTextAnnotation"))
    value = F.to_json(F.struct(F.array(page, F.lit(None).cast("struct<fullTextAnnotation:struct<text:string>>")).alias("responses")))
    value = F.regexp_replace(value, r",null\]", ",{}]")
    W.write_files(s.select(F.coalesce(F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit("~")).alias("k"), value.alias("value")), "k", path)
    pages = R.ocr_pages_of(spark, path)
    return R.number_pages(pages, "label:5")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS "ID", p_brand || ', ' || p_type AS location, CAST(p_size AS VARCHAR) AS date, p_name AS text FROM part""")
def delimited_scan(spark, sf):
    """A table without quoting; two columns are joined, an empty one left out."""
    path = new_path(spark, "table")
    W.write_tsv(_read(spark, sf, "part").select("p_partkey", "p_brand", F.lit("").alias("none"), "p_type", "p_size", "p_name"), path)
    return R.read_table(spark, path, {"ID": 0, "location": [1, 2, 3], "date": 4, "text": 5}).select("ID", "location", "date", "text")


@query("""SELECT 'colev' || lpad(CAST(row_number() OVER (ORDER BY n_nationkey) AS VARCHAR), 5, '0') AS "ID", n_name AS location, CAST(n_regionkey AS VARCHAR) AS date, '' AS collector, CAST(n_nationkey AS VARCHAR) AS text FROM nation""")
def events_table(spark, sf):
    path = new_path(spark, "events")
    W.write_tsv(_read(spark, sf, "nation").orderBy("n_nationkey").coalesce(1).select("n_name", "n_regionkey", F.lit("").alias("who"), "n_nationkey"), path)
    return R.read_events_table(spark, path).select("ID", "location", "date", "collector", "text")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS "ID", c_name AS name, '' AS firstname, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment || '; x' AS segment FROM customer""")
def collectors_table(spark, sf):
    """The metadata language: two keys, one value with a semicolon."""
    path = new_path(spark, "collectors")
    c = _read(spark, sf, "customer")
    data = F.concat(F.lit('nation="'), "c_nationkey", F.lit("\"; segment='"), "c_mktsegment", F.lit("; x'"))
    W.write_tsv(c.select(F.col("c_custkey").alias("ID"), F.col("c_name").alias("name"), data.alias("metadata")), path)
    got = R.read_collectors_table(spark, path)
    return got.select("ID", "name", "firstname", F.col("metadata")["nation"].alias("nation"), F.col("metadata")["segment"].alias("segment"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS label_id, max_by(o_orderpriority, o_orderkey) AS group_id FROM orders GROUP BY 1""")
def sorted_labels_scan(spark, sf):
    """The last row of a label counts."""
    path = new_path(spark, "sorted")
    W.write_tsv(_read(spark, sf, "orders").orderBy("o_orderkey").coalesce(1).select(F.col("o_custkey").alias("label.ID"), F.lit("").alias("label.v"), F.col("o_orderpriority").alias("group.ID")), path)
    return R.read_sorted_labels(spark, path)


@query("""SELECT CAST(o_custkey AS VARCHAR) AS label_id, CAST(max_by(o_orderkey, (s, o_orderkey)) AS VARCHAR) AS event_id FROM (SELECT *, o_orderkey % 7 AS s FROM orders) GROUP BY 1""")
def match_files_best(spark, sf):
    """Two match files; of equal scores the one that stands last in the order of the files."""
    o = _read(spark, sf, "orders").orderBy("o_orderkey").coalesce(1)
    cut = _read(spark, sf, "orders").agg(F.expr("percentile_approx(o_orderkey, 0.9)").alias("c")).first()["c"]
    paths = [new_path(spark, "matches") for _ in range(2)]
    for path, part in zip(paths, (o.filter(F.col("o_orderkey") <= cut), o.filter(F.col("o_orderkey") > cut)), strict=True):
        W.write_tsv(part.select(F.col("o_custkey").alias("label.ID"), F.col("o_orderkey").alias("CE.ID"), (F.col("o_orderkey") % 7).cast("double").alias("score")), path)
    return E.best_match(R.read_matches(spark, paths)).select("label_id", "event_id")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS "ID" FROM part WHERE p_partkey % 3 = 0""")
def id_list(spark, sf):
    path = new_path(spark, "ids")
    _read(spark, sf, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), F.col("p_partkey"), F.lit(" "))).otherwise("").alias("value")).write.text(path)
    return R.read_ids(spark, path)


@query(_search_sql(_index_sql(2, "documents", "doc_id"), _ITEM_QUERIES, False) + "SELECT query_id, ID, round(score, 6) AS score FROM hits")
def index_round_trip(spark, sf):
    """Searching an index that was written and read; its options come with it."""
    path = new_path(spark, "index")
    make_index(labels(spark, sf).select("ID", "text"), Options(2, 3)).write(path)
    queries = items(spark, sf).select(F.col("ID").alias("query_id"), F.col("text").alias("query"))
    return _rounded(search(queries, Index.read(spark, path), fuzzy=False), "score")


@query("SELECT o_orderkey AS \"ID\", CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d FROM orders")
def date_index_round_trip(spark, sf):
    path = new_path(spark, "dates")
    W.write_dates(M.date_index(dated(spark, sf).select("ID", F.col("text").alias("date"))), path)
    return R.read_dates(spark, path).select("ID", F.col("range.start.year").alias("y"), F.col("range.start.month").alias("m"), F.col("range.end.day").alias("d"))


@query("""SELECT CAST(p_partkey AS VARCHAR) || chr(9) || p_name || chr(9) || printf('%.3f', p_retailprice + 1e-9) || chr(9) || '\\t' || p_brand || '\\n' AS value FROM part""")
def tsv_export(spark, sf):
    """Lines of an exported table: three decimals, tabs and line ends as escapes."""
    p = _read(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice", F.concat(F.lit("\t"), "p_brand", F.lit("\n")).alias("b"))
    return W.tsv_lines(p)


@query("""SELECT n_nationkey AS k, '{"n_nationkey":' || n_nationkey || ',"n_name":' || CAST(to_json(n_name) AS VARCHAR) || '}' AS value FROM nation""")
def json_export(spark, sf):
    path = new_path(spark, "json")
    W.write_json(_read(spark, sf, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.text(path).select(F.get_json_object("value", "$.n_nationkey").cast("int").alias("k"), "value")


# --- filters and predicates -----------------------------------------------------------
@query("SELECT p_partkey AS \"ID\", p_name AS text FROM part WHERE p_size > 20 AND p_brand = 'Brand#2'")
def subset_condition(spark, sf):
    p = _read(spark, sf, "part").withColumnsRenamed({"p_partkey": "ID", "p_name": "text"})
    return S.subset(p, lambda df: (df["p_size"] > 20) & (df["p_brand"] == "Brand#2")).select("ID", "text")


@query(_search_sql(_index_sql(1, "documents", "doc_id"), _ITEM_QUERIES, False) + "SELECT query_id, ID, round(score, 6) AS score FROM hits JOIN documents ON doc_id = ID WHERE lang = 'en'")
def search_filtered(spark, sf):
    """A condition on documents changes no weight."""
    docs = _read(spark, sf, "documents").select(F.col("doc_id").alias("ID"), "text", "lang")
    index = make_index(docs.select("ID", "text"), Options(1, 3))
    index = Index(index.postings, index.max_scores, docs, index.options)
    queries = items(spark, sf).select(F.col("ID").alias("query_id"), F.col("text").alias("query"))
    return _rounded(search(queries, index, fuzzy=False, condition=F.col("lang") == "en"), "score")


@query(_search_sql(_index_sql(1, "documents", "doc_id"), _ITEM_QUERIES, False) + "SELECT query_id, ID, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, ID) AS INTEGER) AS rank FROM hits")
def ranked_hits(spark, sf):
    from pyspark.sql import Window

    queries = items(spark, sf).select(F.col("ID").alias("query_id"), F.col("text").alias("query"))
    found = _rounded(search(queries, make_index(labels(spark, sf).select("ID", "text"), Options(1, 3)), fuzzy=False), "score")
    return found.select("query_id", "ID", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ID")).alias("rank"))


@query(r"SELECT doc_id AS ID, regexp_replace(regexp_replace(text, '[0-9]+', '', 'g'), '[.,;]', '', 'g') AS text FROM documents")
def clean_text(spark, sf):
    return labels(spark, sf).select("ID", T.clean_text(F.col("text"), ["[0-9]+", "[.,;]"]).alias("text"))


@query("SELECT p_partkey AS \"ID\", least(p_size + 5, 30) >= greatest(p_size, 20) AS hit FROM part")
def interval_overlap(spark, sf):
    size = F.col("p_size")
    return _read(spark, sf, "part").select(F.col("p_partkey").alias("ID"), T.overlap(size, size + 5, F.lit(20), F.lit(30)).alias("hit"))


@query("SELECT o_orderkey AS \"ID\", o_orderkey % 2 = 0 AS number, o_orderkey % 3 > 0 AS range, o_orderkey % 5 = 0 AS one FROM orders")
def predicates(spark, sf):
    k = F.col("o_orderkey")
    day = lambda d: D.date(F.lit(1990), F.lit(5), d, F.lit(True))
    r = F.struct(day(F.lit(1)).alias("start"), day(F.when(k % 5 == 0, 1).otherwise(2)).alias("end"))
    return _read(spark, sf, "orders").select(k.alias("ID"), T.is_float(F.when(k % 2 == 0, "12.5").otherwise("twelve")).alias("number"), T.is_range(F.lit(0), k % 3).alias("range"), D.is_one_date(r).alias("one"))


# --- text expressions -----------------------------------------------------------------
@query("SELECT p_partkey AS \"ID\", p_size || '-' || (p_size + 3) || ', ' || (p_size + 9) AS ranges FROM part")
def written_ranges(spark, sf):
    s = F.col("p_size")
    r = F.array(F.struct(s.alias("start"), (s + 3).alias("end")), F.struct((s + 9).alias("start"), (s + 9).alias("end")))
    return _read(spark, sf, "part").select(F.col("p_partkey").alias("ID"), T.write_ranges(r).alias("ranges"))


@query(r"""SELECT doc_id AS ID, nullif(regexp_extract(text, '[a-z]{4}[aeiou]+', 0), '') AS found, CASE WHEN regexp_matches(text, '[a-z]{4}[aeiou]+') THEN CAST(length(regexp_extract(text, '^((?:.|\n)*?)[a-z]{4}[aeiou]+', 1)) AS INTEGER) END AS start FROM documents""")
def pattern_span(spark, sf):
    f = T.find_pattern(F.col("text"), "[a-z]{4}[aeiou]+")
    return labels(spark, sf).select("ID", f["match"].alias("found"), f["start"].alias("start"))


@query("SELECT p_partkey AS \"ID\", [p_name[1:2], p_name[3:5], p_name[6:]] AS parts FROM part")
def segments(spark, sf):
    return _read(spark, sf, "part").select(F.col("p_partkey").alias("ID"), T.text_segments(F.col("p_name"), F.array(F.lit(2), F.lit(5))).alias("parts"))


@query("SELECT p_partkey AS \"ID\", p_name || chr(10) || p_brand AS text FROM part")
def clean_strings(spark, sf):
    quote = F.when(F.col("p_partkey") % 3 == 0, '"').when(F.col("p_partkey") % 3 == 1, "'").otherwise("")
    return _read(spark, sf, "part").select(F.col("p_partkey").alias("ID"), T.clean_str(F.concat(F.lit(" "), quote, "p_name", F.lit("\\n"), "p_brand", quote)).alias("text"))


@query("SELECT p_partkey AS \"ID\", starts_with(p_name, left(p_brand, 1)) OR p_partkey % 4 <> 0 AS hit, CAST(CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE -1 END AS INTEGER) AS place FROM part")
def abbreviations(spark, sf):
    k, words = F.col("p_partkey"), F.split("p_name", " ")
    short = F.transform(words, lambda w: F.concat(F.left(w, F.lit(2)), F.lit(".")))
    wrong = F.array(F.lit("zz."))
    hit = T.fullname_match(F.when(k % 4 == 0, F.left("p_brand", F.lit(1))).otherwise(F.concat(F.left("p_name", F.lit(3)), F.lit("."))), F.col("p_name"))
    return _read(spark, sf, "part").select(k.alias("ID"), hit.alias("hit"), T.abbreviation_search(F.when(k % 2 == 0, short).otherwise(wrong), words).alias("place"))


@query("SELECT doc_id AS \"ID\", regexp_replace(text, '[<>=\\-\\s~]', '~', 'g') AS masked, text AS back FROM documents")
def special_chars(spark, sf):
    m = T.mask_special_chars(F.col("text"))
    return labels(spark, sf).select("ID", m["masked"].alias("masked"), T.unmask_special_chars(m["masked"], m["originals"]).alias("back"))


@query("SELECT p_partkey AS \"ID\", CAST(1 + CAST(p_name LIKE 'small %' OR p_name LIKE '% small' AS INTEGER) AS BIGINT) AS n FROM part")
def ngram_lookup(spark, sf):
    """The part's own words, and those of one other n-gram with a near token for each."""
    words = F.split("p_name", " ")
    grams = F.array(F.reverse(words), F.array(F.lit("none"), F.lit("here")), F.when(F.array_contains(words, "small"), F.transform(words, lambda w: F.when(w == "small", "smal").otherwise(w))).otherwise(F.array(F.lit("other"))))
    return _read(spark, sf, "part").select(F.col("p_partkey").alias("ID"), F.size(T.ngram_search(words, grams)).cast("long").alias("n"))


# --- dates ----------------------------------------------------------------------------
@query("""SELECT a.o_orderkey AS "ID", a.o_orderdate::DATE < DATE '1997-06-15' AS before, a.o_orderdate::DATE = DATE '1997-06-15' AS same FROM orders a""")
def date_comparisons(spark, sf):
    f = dated(spark, sf).select("ID", D.find_date(F.col("text")).alias("f"))
    day = D.date(F.lit(1997), F.lit(6), F.lit(15), F.lit(True))
    return f.select("ID", D.before(F.col("f.start"), day).alias("before"), D.same(F.col("f.start"), day).alias("same"))


_YM = "CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m"


@query(f"SELECT o_orderkey AS \"ID\", {_YM}, CAST(1 + (day(o_orderdate) - 1) % 27 AS INTEGER) AS d0, CAST(2 + (day(o_orderdate) - 1) % 27 AS INTEGER) AS d1 FROM orders")
def date_day_range(spark, sf):
    """Layout with two days: 3-4.11.1998."""
    d = (F.dayofmonth("o_orderdate") - 1) % 27
    text = F.concat(F.lit("from "), d + 1, F.lit("-"), d + 2, F.lit("."), F.month("o_orderdate"), F.lit("."), F.year("o_orderdate"))
    f = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("ID"), D.find_date(text).alias("f"))
    return f.select("ID", F.col("f.start.year").alias("y"), F.col("f.start.month").alias("m"), F.col("f.start.day").alias("d0"), F.col("f.end.day").alias("d1"))


@query("SELECT o_orderkey AS \"ID\", CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(13 + day(o_orderdate) % 15 AS INTEGER) AS d FROM orders")
def date_us_order(spark, sf):
    """Month before day, where the day cannot be a month."""
    text = F.concat(F.month("o_orderdate"), F.lit("/"), 13 + F.dayofmonth("o_orderdate") % 15, F.lit("/"), F.year("o_orderdate"))
    f = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("ID"), D.find_date(text).alias("f"))
    return f.select("ID", F.col("f.start.year").alias("y"), F.col("f.start.month").alias("m"), F.col("f.start.day").alias("d"))


@query(f"SELECT o_orderkey AS \"ID\", {_YM}, CAST(day(o_orderdate) AS INTEGER) AS d FROM orders")
def date_month_names(spark, sf):
    """Months by name, in two languages."""
    en = F.element_at(F.array(*map(F.lit, "January February March April May June July August September October November December".split())), F.month("o_orderdate"))
    de = F.element_at(F.array(*map(F.lit, "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split())), F.month("o_orderdate"))
    text = F.concat_ws(" ", F.lit("leg."), F.dayofmonth("o_orderdate"), F.when(F.col("o_orderkey") % 2 == 0, en).otherwise(de), F.year("o_orderdate"))
    f = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("ID"), D.find_date(text).alias("f"))
    return f.select("ID", F.col("f.start.year").alias("y"), F.col("f.start.month").alias("m"), F.col("f.start.day").alias("d"))


@query("SELECT o_orderkey AS \"ID\", year(o_orderdate) || '-' || month(o_orderdate) || '/' || (year(o_orderdate) + 1) || '-' || month(o_orderdate) AS iso FROM orders")
def date_range_built(spark, sf):
    """Ranges from two dates in either order."""
    day = lambda y: D.date(y, F.month("o_orderdate"), F.lit(None), F.lit(True))
    early, late = day(F.year("o_orderdate")), day(F.year("o_orderdate") + 1)
    swap = F.col("o_orderkey") % 2 == 0
    r = D.date_range(F.when(swap, late).otherwise(early), F.when(swap, early).otherwise(late))
    return _read(spark, sf, "orders").select(F.col("o_orderkey").alias("ID"), D.iso_range(r).alias("iso"))


@query("SELECT o_orderkey AS \"ID\", '{\"year\":' || year(o_orderdate) || ',\"month\":' || month(o_orderdate) || ',\"day\":' || day(o_orderdate) || ',\"century_unknown\":false}' AS json FROM orders")
def date_json_text(spark, sf):
    return dated(spark, sf).select("ID", D.date_json(D.find_date(F.col("text"))["start"]).alias("json"))


@query("SELECT o_orderkey AS \"ID\", year(o_orderdate) % 100 BETWEEN 93 AND 96 AS assumed, false AS strict FROM orders")
def date_overlap_centuries(spark, sf):
    """A two-digit year against known centuries: only if the century may be assumed."""
    f = dated(spark, sf, "M/yy").select("ID", D.find_date(F.col("text")).alias("f"))
    lit = lambda y: D.date(F.lit(y), F.lit(None), F.lit(None), F.lit(True))
    r = F.struct(lit(1993).alias("start"), lit(1996).alias("end"))
    return f.select("ID", D.overlaps(F.col("f"), r, True).alias("assumed"), D.overlaps(F.col("f"), r, False).alias("strict"))


# --- names, places, evaluation --------------------------------------------------------
@query("""WITH h AS (SELECT o_orderkey AS id, o_orderkey % 20 AS s, o_orderkey % 20 + 5 AS e, 5 AS score FROM orders)
SELECT id AS "ID", CASE WHEN s % 2 = 0 THEN ['b'] ELSE ['a', 'b'] END AS who FROM h""")
def span_merge(spark, sf):
    """Of two overlapping hits the higher one stays; hits apart stay both."""
    o = _read(spark, sf, "orders")
    s = (F.col("o_orderkey") % 20).cast("int")
    far = F.when(s % 2 == 0, 0).otherwise(100)
    hits = o.select(F.col("o_orderkey").alias("ID"), F.explode(F.array(F.struct(F.lit("a").alias("collector_id"), s.alias("start"), (s + 5).alias("end"), F.lit(5).alias("score")), F.struct(F.lit("b").alias("collector_id"), (s + 2 + far).alias("start"), (s + 9 + far).alias("end"), F.lit(7).alias("score")))).alias("h")).select("ID", "h.*")
    return N.merged(hits, "intended").select("ID", F.col("names.collector_id").alias("who"))


@query("""SELECT s_suppkey AS "ID", CASE s_suppkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'S' WHEN 2 THEN 'E' ELSE 'W' END AS cardinal FROM supplier""")
def cardinals(spark, sf):
    k = F.col("s_suppkey")
    letter = F.when(k % 4 == 0, "северн").when(k % 4 == 1, "South").when(k % 4 == 2, "Вост").otherwise("w.")
    return _read(spark, sf, "supplier").select(k.alias("ID"), G.cardinal(letter).alias("cardinal"))


@query("""SELECT CASE WHEN s_nationkey % 6 = 5 THEN 'no_country' ELSE CAST(s_nationkey % 6 AS VARCHAR) END AS country, count(*) AS n, list_sort(list_distinct(list(s_name))) AS places FROM supplier GROUP BY 1""")
def places_by_country(spark, sf):
    s = _read(spark, sf, "supplier")
    return Z.by_country(s.select(F.col("s_name").alias("name"), F.when(F.col("s_nationkey") % 6 < 5, (F.col("s_nationkey") % 6).cast("string")).alias("country")))


@query("""WITH RECURSIVE up(k, place, path) AS (SELECT p_partkey, p_partkey, [p_partkey] FROM part UNION ALL SELECT k, place // 2, list_append(path, place // 2) FROM up WHERE place > 0)
SELECT k AS geoname_id, path FROM up WHERE place = 0""")
def place_hierarchy(spark, sf):
    """A binary tree of parts; paths lead to part 0."""
    p = _read(spark, sf, "part").select(F.col("p_partkey").alias("geoname_id"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 2)).cast("long").alias("parent_id"))
    return Z.hierarchy(p)


@query("""SELECT p_partkey AS "ID", CAST(CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 8 END AS INTEGER) AS rank FROM part""")
def feature_ranks(spark, sf):
    k = F.col("p_partkey")
    return _read(spark, sf, "part").select(k.alias("ID"), G.feature_rank(F.when(k % 3 == 0, "A").when(k % 3 == 1, "P").otherwise("S")).cast("int").alias("rank"))


def _regions(spark, sf) -> DataFrame:
    """Places of several classes: each region as a country, a city and a spot of that name, and one without a country."""
    r = _read(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("name"))
    kinds = [(0, "A", "one"), (100, "P", "one"), (200, "S", "two"), (300, "P", None)]
    rows = F.explode(F.array(*[F.struct((F.col("k") + add).alias("geoname_id"), F.lit(fcl).alias("fcl"), F.lit(country).cast("string").alias("country")) for add, fcl, country in kinds]))
    return r.select("name", rows.alias("p")).select("p.geoname_id", "name", "p.country", "p.fcl", F.lit(0.0).alias("lat"), F.lit(0.0).alias("lng"), F.lit(None).cast("long").alias("parent_id"))


@query("""SELECT c_custkey AS "ID", CAST(r_regionkey + 100 AS BIGINT) AS geoname_id, 'one' AS country FROM customer JOIN region ON r_regionkey = c_custkey % 5""")
def gazetteer_places(spark, sf):
    """Several hits for a name: the country with the most general hit, and its most special place."""
    c, r = _read(spark, sf, "customer"), _read(spark, sf, "region")
    texts = c.join(r, F.col("c_custkey") % 5 == F.col("r_regionkey")).select(F.col("c_custkey").alias("ID"), F.concat(F.lit("found in "), F.initcap("r_name"), F.lit(", 1900")).alias("text"))
    return Z.find_places(texts, _regions(spark, sf)).select("ID", "geoname_id", "country")


@query("""SELECT o_orderkey AS "ID", day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate) AS date_v, year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate) AS date_i,
c_name AS collector_v, c_name AS collector_i, lower(r_name) AS geo_v, r_name || ', one' AS geo_i FROM orders JOIN customer ON o_custkey = c_custkey JOIN region ON r_regionkey = o_orderkey % 5""")
def parse_info_all(spark, sf):
    """Dates, collectors and places of one text."""
    o, c, r = _read(spark, sf, "orders"), _read(spark, sf, "customer"), _read(spark, sf, "region")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(r, F.col("o_orderkey") % 5 == F.col("r_regionkey"))
    texts = rows.select(F.col("o_orderkey").alias("ID"), F.concat(F.lit("leg. "), "c_name", F.lit("; "), F.initcap("r_name"), F.lit(", "), F.date_format("o_orderdate", "d.M.yyyy")).alias("text"))
    who = c.select(F.col("c_custkey").alias("ID"), F.col("c_name").alias("name"), F.lit("").alias("firstname"))
    return P.parse_info(texts, collectors=who, gazetteer=_regions(spark, sf))


# --- streams --------------------------------------------------------------------------
@query(_search_sql(_index_sql(1, "benchmark", "item_id"), _DOC_QUERIES, False) + "SELECT query_id AS label_id, ID AS event_id, round(score, 6) AS score FROM hits")
def stream_match(spark, sf):
    """Documents as a stream of JSON lines against a fixed collection; what its batches wrote."""
    from labelloom.streaming.match_stream import match_stream

    source, target = new_path(spark, "stream"), new_path(spark, "matches")
    W.write_json(labels(spark, sf).select(F.col("ID").cast("string").alias("ID"), "text"), source)
    index = make_index(items(spark, sf).select("ID", "text"), Options(1, 3)).saved()
    match_stream(R.stream_labels(spark, source), index, target, new_path(spark, "progress"), fuzzy=False).awaitTermination()
    return _rounded(spark.read.parquet(target).select(F.col("label_id").cast("long").alias("label_id"), "event_id", "score"), "score")
