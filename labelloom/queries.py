"""Queries over the test tables, one for each operator, and their DuckDB forms.

Labels are documents, events are benchmark items; dated labels are made from
orders, names from customers and suppliers, places from nations.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
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
from labelloom.operators.search import search, token_pairs
from labelloom.plans import pipelines as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _nudged(sql: str) -> str:
    return re.sub(r", 6\)", " + 1e-9, 6)", sql)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _nudged(sql)
        return f

    return add


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def labels(spark, sf) -> DataFrame:
    return _read(spark, sf, "documents").select(F.col("doc_id").alias("ID"), "text", F.col("doc_id").alias("pos"), "source")


def items(spark, sf) -> DataFrame:
    return _read(spark, sf, "benchmark").select(F.col("item_id").alias("ID"), "text", F.col("item_id").alias("pos"))


def dated(spark, sf, style: str = "d.M.yyyy") -> DataFrame:
    """ID, text, d: labels with a date, made from orders."""
    o = _read(spark, sf, "orders")
    day = F.date_format("o_orderdate", style)
    return o.select(F.col("o_orderkey").alias("ID"), F.concat(F.lit("leg. "), F.lower("o_orderpriority"), F.lit("; "), day).alias("text"), F.to_date("o_orderdate").alias("d"), F.col("o_custkey").alias("cust"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _r(c, 6) for c in columns})


def _r(c, digits: int):
    """Rounded after a nudge: exact halves must not hang on the order of a sum."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, digits)


# --- SQL pieces -----------------------------------------------------------------------
_TOK = r"regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[\p{{L}}\p{{N}}_]{{3,}}')"
_LEV = "levenshtein(replace({0}, 'ß', '~'), replace({1}, 'ß', '~'))"
_K = "greatest(CAST(floor(log2(length({0}))) AS INTEGER) - 1, 0)"


def _index_sql(method: int, source: str, key: str) -> str:
    """CTEs cnt(ID, token, tf), post(ID, token, tf, w), mx(ID, max_score)."""
    cnt = f"cnt AS (SELECT ID, token, count(*) AS tf FROM (SELECT {key} AS ID, unnest({_TOK.format('text')}) AS token FROM {source}) GROUP BY ALL)"
    if method == 1:
        post = "post AS (SELECT ID, token, tf, CAST(tf AS DOUBLE) AS w FROM cnt)"
    else:
        post = f"""df AS (SELECT token, count(*) AS df FROM cnt GROUP BY token),
raw AS (SELECT ID, token, tf, tf * (ln((1 + (SELECT count(DISTINCT {key}) FROM {source})) / (1 + df)::DOUBLE) + 1) AS raw FROM cnt JOIN df USING (token)),
nrm AS (SELECT ID, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY ID),
post AS (SELECT ID, token, tf, raw / norm AS w FROM raw JOIN nrm USING (ID))"""
    return f"{cnt}, {post}, mx AS (SELECT ID, sum(tf * w) AS max_score FROM post GROUP BY ID)"


def _search_sql(index: str, queries: str, fuzzy: bool, scoring: str = "w", texts: str = "", where: str = "") -> str:
    """``queries``: SQL of (query_id, query); the result: CTE hits(query_id, ID, score)."""
    qt = f"qs AS ({queries}), qt AS (SELECT query_id, len(t) AS m, unnest(range(1, len(t) + 1)) AS qpos, unnest(t) AS q FROM (SELECT query_id, {_TOK.format('query')} AS t FROM qs))"
    if fuzzy:
        pairs = f"""vq AS (SELECT DISTINCT q, {_K.format('q')} AS k FROM qt), vt AS (SELECT DISTINCT token FROM post),
pr AS (SELECT q, token, 0 AS d FROM vq JOIN vt ON q = token WHERE k = 0 UNION ALL SELECT q, token, {_LEV.format('q', 'token')} AS d FROM vq JOIN vt ON abs(length(q) - length(token)) <= k AND k > 0 AND {_LEV.format('q', 'token')} <= k),
cand AS (SELECT query_id, qpos, m, ID, token, tf, w, 1 - d / greatest(length(q), length(token))::DOUBLE AS i FROM qt JOIN pr USING (q) JOIN post USING (token))"""
    else:
        pairs = "cand AS (SELECT query_id, qpos, m, ID, token, tf, w, 1.0 AS i FROM qt JOIN post ON q = token)"
    weigh = "w * i" if scoring == "w" else "w"
    sums = f"""best AS (SELECT * FROM cand {where} QUALIFY row_number() OVER (PARTITION BY query_id, qpos, ID ORDER BY i DESC, w DESC, token) = 1),
used AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY query_id, ID, token ORDER BY qpos) <= tf),
sums AS (SELECT query_id, ID, sum({weigh}) AS raw, count(*) AS n, min(m) AS m FROM used GROUP BY ALL)"""
    if scoring == "w":
        hits = "hits AS (SELECT query_id, ID, raw / max_score * n / m AS score FROM sums JOIN mx USING (ID))"
    else:
        simple = r"lower(strip_accents(trim(regexp_replace({}, '\s+', ' ', 'g'))))"
        like = f"1 - {_LEV.format(simple.format('query'), simple.format('text'))} / greatest(length({simple.format('query')}), length({simple.format('text')}))::DOUBLE"
        value = f"({like}) * raw / max_score * n / m" if scoring == "w+l" else like
        hits = f"hits AS (SELECT query_id, ID, {value} AS score FROM sums JOIN mx USING (ID) JOIN qs USING (query_id) JOIN ({texts}) USING (ID))"
    return f"WITH {index}, {qt}, {pairs}, {sums}, {hits} "


_ITEM_QUERIES = "SELECT item_id AS query_id, text AS query FROM benchmark"
_DOC_QUERIES = "SELECT doc_id AS query_id, text AS query FROM documents"
_ROUND_HITS = "SELECT query_id, ID, round(score, 6) AS score FROM hits"


def _item_queries(spark, sf) -> DataFrame:
    return _read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# --- collections ----------------------------------------------------------------------
@query("""SELECT CAST(ID AS BIGINT) AS "ID", text, CAST(pos AS BIGINT) AS pos FROM (SELECT o_custkey AS ID, max_by(o_orderpriority, o_orderkey) AS text, min(o_orderkey) AS pos FROM orders GROUP BY 1)""")
def load_dedupe(spark, sf):
    o = _read(spark, sf, "orders").select(F.col("o_custkey").alias("ID"), F.col("o_orderpriority").alias("text"), F.col("o_orderkey").alias("pos"))
    return S.deduplicated(o)


@query("SELECT doc_id AS \"ID\", text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def subset_semi(spark, sf):
    ids = _read(spark, sf, "labels").select(F.col("doc_id").alias("ID"))
    return S.subset_by_id(labels(spark, sf), ids).select("ID", "text")


@query("SELECT doc_id AS \"ID\", text FROM documents WHERE doc_id = 7")
def point_lookup(spark, sf):
    return S.get(labels(spark, sf), 7).select("ID", "text")


@query("SELECT doc_id AS ID, regexp_replace(text, '[aeiou]+[0-9]*', '', 'g') AS text FROM documents")
def mask_delete(spark, sf):
    return labels(spark, sf).select("ID", T.mask(F.col("text"), "[aeiou]+[0-9]*").alias("text"))


@query("SELECT p_partkey AS \"ID\", p_name || chr(10) || p_brand || chr(10) || p_type AS text FROM part")
def corpus_concat(spark, sf):
    p = _read(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("ID"), T.corpus(p, ["p_name", "p_brand", "p_type"]).alias("text"))


# --- text -----------------------------------------------------------------------------
@query(r"SELECT doc_id AS ID, list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]{3,}'), lambda x: lower(x)) AS tokens FROM documents")
def tokenize_words(spark, sf):
    return labels(spark, sf).select("ID", T.tokenize(F.col("text"), 3).alias("tokens"))


@query(r"SELECT conv_id, turn, list_transform(regexp_extract_all(text, '\S+'), lambda x: lower(x)) AS tokens FROM conversations")
def tokenize_all(spark, sf):
    return _read(spark, sf, "conversations").select("conv_id", "turn", T.tokenize(F.col("text"), 1, "all").alias("tokens"))


@query(rf"SELECT item_id AS ID, list_transform(range(1, len(t) - 1), lambda i: t[i : i + 2]) AS grams FROM (SELECT item_id, {_TOK.format('text')} AS t FROM benchmark)")
def ngrams_ordered(spark, sf):
    return items(spark, sf).select("ID", T.ngrams(T.index_tokens(F.col("text"), 3), 3).alias("grams"))


@query(rf"SELECT item_id AS ID, list_sort(list_distinct(list_transform(range(1, len(t) - 1), lambda i: list_sort(t[i : i + 1])))) AS grams FROM (SELECT item_id, {_TOK.format('text')} AS t FROM benchmark)")
def ngrams_unordered(spark, sf):
    return items(spark, sf).select("ID", T.ngrams(T.index_tokens(F.col("text"), 3), 2, ordered=False).alias("grams"))


@query(rf"SELECT token, {_K.format('token')} AS k FROM (SELECT DISTINCT unnest({_TOK.format('text')}) AS token FROM documents)")
def mismatch_allowance(spark, sf):
    tokens = labels(spark, sf).select(F.explode(T.index_tokens(F.col("text"), 3)).alias("token")).distinct()
    return tokens.select("token", T.mismatch_allowance(F.col("token")).alias("k"))


@query("SELECT a.s_suppkey AS a, n_nationkey AS b, round(levenshtein(lower(s_name), lower(n_name)) / greatest(length(s_name), length(n_name))::DOUBLE, 6) AS d FROM supplier a JOIN nation ON s_nationkey = n_nationkey")
def norm_levenshtein(spark, sf):
    s, n = _read(spark, sf, "supplier"), _read(spark, sf, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("a"), F.col("n_nationkey").alias("b"), _r(T.norm_levenshtein(F.col("s_name"), F.col("n_name")), 6).alias("d"))


@query(r"SELECT doc_id AS ID, lower(strip_accents(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS text FROM documents")
def simplify(spark, sf):
    return labels(spark, sf).select("ID", T.simplify(F.col("text")).alias("text"))


@query("SELECT o_orderkey AS ID, CAST(month(o_orderdate) AS INTEGER) AS n FROM orders")
def roman_to_int(spark, sf):
    numerals = F.array(*map(F.lit, "I II III IV V VI VII VIII IX X XI XII".split()))
    o = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("ID"), F.element_at(numerals, F.month("o_orderdate")).alias("roman"))
    return o.select("ID", T.roman_to_int(F.col("roman")).alias("n"))


@query("SELECT c_custkey AS \"ID\", 'label' || CASE WHEN c_custkey < 100000 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') ELSE CAST(c_custkey AS VARCHAR) END AS label FROM customer")
def id_format(spark, sf):
    return _read(spark, sf, "customer").select(F.col("c_custkey").alias("ID"), T.id_formatter("label:5", F.col("c_custkey")).alias("label"))


@query("SELECT p_partkey AS ID, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1])), 'string_agg', ' ') AS short FROM part")
def abbreviate(spark, sf):
    return _read(spark, sf, "part").select(F.col("p_partkey").alias("ID"), T.abbreviate_name(F.col("p_name")).alias("short"))


@query("SELECT doc_id AS ID, text[1:3] || repeat(' ', greatest(least(9, length(text)) - 3, 0)) || text[greatest(10, 4):] AS text FROM documents WHERE length(text) >= 3")
def clear_ranges(spark, sf):
    return labels(spark, sf).filter(F.length("text") >= 3).select("ID", T.clear_ranges(F.col("text"), [(3, 8)]).alias("text"))


# --- index and search -----------------------------------------------------------------
@query(f"WITH {_index_sql(1, 'documents', 'doc_id')} SELECT ID, token, tf, w FROM post")
def index_counts(spark, sf):
    return make_index(labels(spark, sf).select("ID", "text"), Options(1, 3)).postings.select("ID", "token", "tf", "w")


@query(f"WITH {_index_sql(2, 'documents', 'doc_id')} SELECT ID, token, tf, round(w, 6) AS w FROM post")
def index_tfidf(spark, sf):
    return _rounded(make_index(labels(spark, sf).select("ID", "text"), Options(2, 3)).postings.select("ID", "token", "tf", "w"), "w")


@query(f"WITH {_index_sql(2, 'documents', 'doc_id')} SELECT ID, round(max_score, 6) AS max_score FROM mx")
def max_scores(spark, sf):
    return _rounded(make_index(labels(spark, sf).select("ID", "text"), Options(2, 3)).max_scores, "max_score")


def _fuzzy_vocabulary(strategy):
    def run(spark, sf):
        q = items(spark, sf).select(F.explode(T.index_tokens(F.col("text"), 3)).alias("q")).distinct()
        t = labels(spark, sf).select(F.explode(T.index_tokens(F.col("text"), 3)).alias("token")).distinct()
        return _rounded(token_pairs(q, t, strategy), "identity")

    return run


_PAIRS_SQL = f"""WITH vq AS (SELECT q, {_K.format('q')} AS k FROM (SELECT DISTINCT unnest({_TOK.format('text')}) AS q FROM benchmark)), vt AS (SELECT DISTINCT unnest({_TOK.format('text')}) AS token FROM documents),
pr AS (SELECT q, token, 0 AS d FROM vq JOIN vt ON q = token WHERE k = 0 UNION ALL SELECT q, token, {_LEV.format('q', 'token')} AS d FROM vq JOIN vt ON abs(length(q) - length(token)) <= k AND k > 0 AND {_LEV.format('q', 'token')} <= k)
SELECT q, token, round(1 - d / greatest(length(q), length(token))::DOUBLE, 6) AS identity FROM pr"""
QUERIES["fuzzy_tokens_blocked"] = _fuzzy_vocabulary("blocked")
ORACLE_SQL["fuzzy_tokens_blocked"] = _nudged(_PAIRS_SQL)


@query(_search_sql(_index_sql(2, "documents", "doc_id"), _ITEM_QUERIES, False) + _ROUND_HITS)
def search_exact_w(spark, sf):
    return _rounded(search(_item_queries(spark, sf), make_index(labels(spark, sf).select("ID", "text"), Options(2, 3)), fuzzy=False), "score")


@query(_search_sql(_index_sql(1, "documents", "doc_id"), _ITEM_QUERIES, True) + _ROUND_HITS)
def search_fuzzy_w(spark, sf):
    return _rounded(search(_item_queries(spark, sf), make_index(labels(spark, sf).select("ID", "text"), Options(1, 3)).saved()), "score")


def _search_items(scoring):
    return lambda spark, sf: _rounded(search(_item_queries(spark, sf), make_index(items(spark, sf).select("ID", "text"), Options(1, 3)), scoring), "score")


def _search_documents(scoring):
    """By similarity of whole texts, from 0.2 on."""
    return lambda spark, sf: _rounded(search(_item_queries(spark, sf), make_index(labels(spark, sf).select("ID", "text"), Options(1, 3)).saved(), scoring, threshold=0.2), "score")


for _name, _scoring in (("search_l", "l"), ("search_wl", "w+l")):
    QUERIES[_name] = _search_items(_scoring)
    ORACLE_SQL[_name] = _nudged(_search_sql(_index_sql(1, "benchmark", "item_id"), _ITEM_QUERIES, True, _scoring, "SELECT item_id AS ID, text FROM benchmark") + _ROUND_HITS)
QUERIES["search_l_documents"] = _search_documents("l")
ORACLE_SQL["search_l_documents"] = _nudged(_search_sql(_index_sql(1, "documents", "doc_id"), _ITEM_QUERIES, True, "l", "SELECT doc_id AS ID, text FROM documents") + _ROUND_HITS + " WHERE score >= 0.2")


@query(_search_sql(_index_sql(2, "documents", "doc_id"), _ITEM_QUERIES, False) + "SELECT query_id, ID, round(score, 6) AS score FROM hits WHERE score >= 0.1")
def search_threshold(spark, sf):
    return _rounded(search(_item_queries(spark, sf), make_index(labels(spark, sf).select("ID", "text"), Options(2, 3)), fuzzy=False, threshold=0.1), "score")


# --- matching -------------------------------------------------------------------------
_MATCH_SQL = _search_sql(_index_sql(1, "benchmark", "item_id"), _DOC_QUERIES, False)


def _matches(spark, sf, fuzzy=False):
    return M.match_events(labels(spark, sf), make_index(items(spark, sf).select("ID", "text"), Options(1, 3)), fuzzy=fuzzy)


@query(_MATCH_SQL + "SELECT query_id AS label_id, ID AS event_id, round(score, 6) AS score FROM hits")
def match_all_hits(spark, sf):
    return _rounded(_matches(spark, sf), "score")


@query(_MATCH_SQL + "SELECT doc_id AS ID FROM documents WHERE doc_id NOT IN (SELECT query_id FROM hits)")
def match_unmatched_labels(spark, sf):
    return M.unmatched(labels(spark, sf), _matches(spark, sf), "label_id")


@query(_MATCH_SQL + "SELECT item_id AS ID FROM benchmark WHERE item_id NOT IN (SELECT ID FROM hits)")
def match_unmatched_events(spark, sf):
    return M.unmatched(items(spark, sf), _matches(spark, sf), "event_id")


# --- dates ----------------------------------------------------------------------------
def _found(spark, sf, style="d.M.yyyy"):
    return dated(spark, sf, style).select("ID", "d", "cust", D.find_date(F.col("text")).alias("f"))


_YMD = "CAST({0}(o_orderdate) AS INTEGER) AS {0}"
_FIELDS = ", ".join(_YMD.format(x) for x in ("year", "month", "day"))


@query(f"SELECT o_orderkey AS ID, {_FIELDS}, 2 AS precision FROM orders")
def date_parse_dmy(spark, sf):
    return _found(spark, sf).select("ID", "f.start.year", "f.start.month", "f.start.day", "f.start.precision")


@query(f"SELECT o_orderkey AS ID, {_FIELDS} FROM orders")
def date_parse_roman(spark, sf):
    o = _read(spark, sf, "orders")
    roman = F.element_at(F.array(*map(F.lit, "I II III IV V VI VII VIII IX X XI XII".split())), F.month("o_orderdate"))
    text = F.concat_ws(".", F.dayofmonth("o_orderdate"), roman, F.year("o_orderdate"))
    return o.select(F.col("o_orderkey").alias("ID"), D.find_date(text).alias("f")).select("ID", "f.start.year", "f.start.month", "f.start.day")


@query("SELECT o_orderkey AS ID, CAST(year(o_orderdate) AS INTEGER) AS y0, CAST(year(o_orderdate) + 2 AS INTEGER) AS y1 FROM orders")
def date_parse_range(spark, sf):
    o = _read(spark, sf, "orders")
    text = F.concat(F.lit("between "), F.year("o_orderdate"), F.lit("-"), F.year("o_orderdate") + 2)
    return o.select(F.col("o_orderkey").alias("ID"), D.find_date(text).alias("f")).select("ID", F.col("f.start.year").alias("y0"), F.col("f.end.year").alias("y1"))


@query("SELECT o_orderkey AS ID, year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate) AS iso FROM orders")
def date_iso_text(spark, sf):
    return _found(spark, sf).select("ID", D.iso_range(F.col("f")).alias("iso"))


_EVENT_RANGES = "SELECT l_orderkey AS ev, min(year(l_shipdate)) AS y0, max(year(l_shipdate)) AS y1, min(l_shipdate)::DATE AS d0, max(l_shipdate)::DATE AS d1 FROM lineitem GROUP BY 1"


def _ranges(spark, sf):
    li = _read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("ev")).agg(F.min("l_shipdate").alias("d0"), F.max("l_shipdate").alias("d1"))
    one = lambda c: D.date(F.year(c), F.month(c), F.dayofmonth(c), F.lit(True))
    return li.select("ev", F.struct(one("d0").alias("start"), one("d1").alias("end")).alias("range"))


@query(f"SELECT o_orderkey AS ID, (year(o_orderdate) BETWEEN y0 AND y1) AS hit FROM orders JOIN ({_EVENT_RANGES}) ON o_orderkey = ev")
def date_overlap_reference(spark, sf):
    f = _found(spark, sf).join(_ranges(spark, sf), F.col("ID") == F.col("ev"))
    return f.select("ID", D.overlaps(F.col("f"), F.col("range")).alias("hit"))


@query(f"SELECT o_orderkey AS ID, (o_orderdate::DATE BETWEEN d0 AND d1) AS hit FROM orders JOIN ({_EVENT_RANGES}) ON o_orderkey = ev")
def date_overlap_calendar(spark, sf):
    f = _found(spark, sf).join(_ranges(spark, sf), F.col("ID") == F.col("ev"))
    return f.select("ID", D.overlaps(F.col("f"), F.col("range"), mode="calendar").alias("hit"))


@query("SELECT o_orderkey AS ID, (year(o_orderdate) BETWEEN 1993 AND 1996 AND month(o_orderdate) BETWEEN 3 AND 9 AND day(o_orderdate) BETWEEN 5 AND 25) AS inside FROM orders")
def date_is_in(spark, sf):
    lit = lambda y, m, d: D.date(F.lit(y), F.lit(m), F.lit(d), F.lit(True))
    r = F.struct(lit(1993, 3, 5).alias("start"), lit(1996, 9, 25).alias("end"))
    return _found(spark, sf).select("ID", D.is_in(F.col("f.start"), r).alias("inside"))


@query("SELECT o_orderkey AS ID, CAST(1800 + year(o_orderdate) % 100 AS INTEGER) AS year, '-' || (year(o_orderdate) % 100) || '-' || month(o_orderdate) || CASE WHEN year(o_orderdate) % 100 = 0 AND month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN '' ELSE '-' || day(o_orderdate) END AS iso FROM orders")
def date_century_shift(spark, sf):
    """Two-digit years are checked as 19yy, so 29 February '00 is read as a month."""
    f = _found(spark, sf, "d.M.yy")
    return f.select("ID", D.set_century(F.col("f.start"), F.lit(18))["year"].alias("year"), D.iso(F.col("f.start")).alias("iso"))


def _dated_match(spark, sf, persist, fuzzy=False):
    """Customers' latest orders (labels) against their parts of the year's calendar: events are nations' yearly lists."""
    o = dated(spark, sf)
    lab = o.groupBy("cust").agg(F.max_by("text", "ID").alias("text"), F.max("ID").alias("k")).select(F.col("cust").alias("ID"), "text")
    years = _read(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), F.lower("o_orderpriority").alias("p")).distinct()
    ev = years.select(F.concat_ws("/", "y", "p").alias("ID"), F.col("y").cast("string").alias("date"), F.concat_ws(" ", F.lit("priority"), "p").alias("text"))
    index = make_index(ev.select("ID", "text"), Options(1, 3))
    return _rounded(M.match_events(lab, index, M.date_index(ev), persist=persist, fuzzy=fuzzy), "score")


_EVENTS_SQL = "ev AS (SELECT DISTINCT year(o_orderdate) || '/' || lower(o_orderpriority) AS eid, year(o_orderdate) AS y, 'priority ' || lower(o_orderpriority) AS text FROM orders)"
_LABELS_SQL = "lab AS (SELECT o_custkey AS lid, max_by('leg. ' || lower(o_orderpriority) || '; ' || day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate), o_orderkey) AS text, max_by(year(o_orderdate), o_orderkey) AS y FROM orders GROUP BY 1)"
_DATED_SQL = f"WITH {_LABELS_SQL}, {_EVENTS_SQL}, " + _search_sql(_index_sql(1, "ev", "eid"), "SELECT lid AS query_id, text AS query FROM lab", False).removeprefix("WITH ")


@query(_DATED_SQL + "SELECT query_id AS label_id, ID AS event_id, round(score, 6) AS score FROM hits JOIN lab ON lid = query_id JOIN ev ON eid = ID WHERE lab.y = ev.y")
def match_date_filtered(spark, sf):
    return _dated_match(spark, sf, False)


@query(_DATED_SQL + """, near AS (SELECT query_id, ID, score FROM hits JOIN lab ON lid = query_id JOIN ev ON eid = ID WHERE lab.y = ev.y)
SELECT query_id AS label_id, ID AS event_id, round(score, 6) AS score FROM (SELECT * FROM near UNION ALL SELECT * FROM hits WHERE query_id NOT IN (SELECT query_id FROM near))""")
def match_persist(spark, sf):
    return _dated_match(spark, sf, True)


# --- evaluation -----------------------------------------------------------------------
_BEST_SQL = _MATCH_SQL + ", top AS (SELECT query_id AS label_id, max_by(ID, (round(score, 6), ID)) AS event_id, max(round(score, 6)) AS score FROM hits GROUP BY 1)"
_JOINED_SQL = _BEST_SQL + ", j AS (SELECT doc_id AS label_id, source AS group_id, coalesce(CAST(event_id AS VARCHAR), 'unassigned') AS event_id, coalesce(score, 0.0) AS score FROM documents LEFT JOIN top ON doc_id = label_id)"


def _best(spark, sf, fuzzy=False):
    return E.best_match(_rounded(_matches(spark, sf, fuzzy), "score"))


def _assigned(spark, sf, fuzzy=False):
    best = _best(spark, sf, fuzzy).withColumn("event_id", F.col("event_id").cast("string"))
    return E.assigned(labels(spark, sf).select(F.col("ID").alias("label_id"), F.col("source").alias("group_id")), best)


@query(_BEST_SQL + " SELECT label_id, event_id, score FROM top")
def best_match(spark, sf):
    return _best(spark, sf)


@query(_JOINED_SQL + " SELECT label_id, group_id, event_id, score FROM j")
def left_join_unassigned(spark, sf):
    return _assigned(spark, sf)


@query(_JOINED_SQL + """, e AS (SELECT group_id, event_id, count(*) AS n, avg(score) AS mean FROM j GROUP BY ALL)
SELECT group_id, event_id, round(n / size * mean, 6) AS confidence FROM (SELECT *, sum(n) OVER (PARTITION BY group_id)::DOUBLE AS size FROM e) QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY n DESC, event_id) = 1""")
def group_confidence(spark, sf):
    return _rounded(E.group_confidence(_assigned(spark, sf)), "confidence")


@query(_JOINED_SQL + """, s AS (SELECT 'labels_per_cluster' AS statistic, count(*) AS k FROM j GROUP BY group_id
UNION ALL SELECT 'events_per_cluster', count(DISTINCT event_id) FROM j GROUP BY group_id UNION ALL SELECT 'clusters_per_event', count(DISTINCT group_id) FROM j GROUP BY event_id)
SELECT statistic, count(*) AS n, round(avg(k), 6) AS mean, round(stddev_pop(k), 6) AS sd FROM s GROUP BY statistic""")
def cluster_stats(spark, sf):
    return _rounded(E.cluster_statistics(_assigned(spark, sf)), "mean", "sd")


@query("SELECT o_orderkey AS ID, CAST(dense_rank() OVER (ORDER BY f) - 1 AS BIGINT) AS group_id FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY year(o_orderdate), month(o_orderdate)) AS f FROM orders)")
def group_by_parsed_info(spark, sf):
    rows = dated(spark, sf, "M/yyyy").select("ID", F.col("ID").alias("pos"), D.iso_range(D.find_date(F.col("text"))).alias("date_i"))
    return E.group_by_key(rows, ["date_i"]).select("ID", F.col("group_id").cast("long").alias("group_id"))


# --- clusters -------------------------------------------------------------------------
_NEAR_SQL = "SELECT a.s_nationkey AS g, a.s_suppkey AS i, b.s_suppkey AS j, levenshtein(lower(a.s_name), lower(b.s_name)) / greatest(length(a.s_name), length(b.s_name))::DOUBLE AS d FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey"


def _suppliers(spark, sf):
    return _read(spark, sf, "supplier").select(F.col("s_nationkey").alias("group_id"), F.col("s_suppkey").alias("ID"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("text"))


@query(f"SELECT s_suppkey AS ID, round(m, 6) AS median FROM supplier LEFT JOIN (SELECT i, median(d) AS m FROM ({_NEAR_SQL}) GROUP BY i) ON i = s_suppkey")
def median_distance(spark, sf):
    return C.median_distances(_suppliers(spark, sf)).select("ID", _r("median", 6).alias("median"))


@query(f"""SELECT g AS group_id, min_by(s_name, (round(m, 9), s_suppkey)) AS consensus FROM (SELECT g, i, median(d) AS m FROM ({_NEAR_SQL}) GROUP BY ALL) JOIN supplier ON s_suppkey = i GROUP BY g HAVING count(*) >= 2""")
def pick_consensus(spark, sf):
    return C.pick_consensus(_suppliers(spark, sf))


def _leaders_sql(source: str, key: str, fuzzy: bool, threshold: float) -> str:
    """Leaders one by one in the order of the key."""
    return _search_sql(_index_sql(2, source, key), f"SELECT {key} AS query_id, text AS query FROM {source}", fuzzy, where="WHERE query_id <> ID").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
inc AS (SELECT ID, list(query_id) AS src FROM hits WHERE score >= {threshold} AND query_id < ID GROUP BY ID),
n AS (SELECT {key} AS k, row_number() OVER (ORDER BY {key}) AS rn, coalesce(src, []) AS src FROM {source} LEFT JOIN inc ON ID = {key}),
r(rn, lead) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT n.rn, CASE WHEN list_has_any(lead, src) THEN lead ELSE list_append(lead, k) END FROM r JOIN n ON n.rn = r.rn + 1),
l AS (SELECT lead FROM r ORDER BY rn DESC LIMIT 1)
SELECT k AS "ID", CASE WHEN list_contains(lead, k) THEN k ELSE list_min(list_intersect(src, lead)) END AS leader FROM n, l"""


@query(_leaders_sql("documents", "doc_id", False, 0.8))
def leader_cluster_exact(spark, sf):
    """Leader clusters of all documents by equal tokens."""
    return C.cluster_by_text(labels(spark, sf).select("ID", "text", "pos"), fuzzy=False)


_PARTS = "WITH parts AS (SELECT p_partkey, p_name || ' ' || p_type || CASE WHEN p_partkey % 7 = 0 THEN 's' ELSE '' END AS text FROM part), "


@query(_leaders_sql("parts", "p_partkey", True, 0.5).replace("WITH RECURSIVE ", _PARTS.replace("WITH ", "WITH RECURSIVE "), 1))
def leader_cluster(spark, sf):
    """Leader clusters of the labels of all parts, some of them misspelt, as the command makes them."""
    p = _read(spark, sf, "part")
    text = F.concat("p_name", F.lit(" "), "p_type", F.when(F.col("p_partkey") % 7 == 0, "s").otherwise(""))
    return C.cluster_by_text(p.select(F.col("p_partkey").alias("ID"), text.alias("text"), F.col("p_partkey").alias("pos")), threshold=0.5)


@query()
def kmedoids_refine(spark, sf):
    """Names of parts, by brand."""
    p = _read(spark, sf, "part")
    return C.refine(p.select(F.col("p_partkey").alias("ID"), F.col("p_name").alias("text"), F.col("p_brand").alias("leader"), F.col("p_partkey").alias("pos")))


@query()
def alignment_consensus(spark, sf):
    return C.alignment_consensus(_suppliers(spark, sf))


# --- names and places -----------------------------------------------------------------
@query("""SELECT s_suppkey AS ID, unnest(['{N}', '{f} {N}', '{N} {f}', '{q} {N}', '{N} {q}', '{F} {N}', '{N} {F}']) AS format,
unnest([n, upper(f[1]) || ' ' || n, n || ' ' || upper(f[1]), upper(f[1]) || '. ' || n, n || ' ' || upper(f[1]) || '.', f || ' ' || n, n || ' ' || f]) AS variant
FROM (SELECT s_suppkey, lower(s_name) AS n, lower(n_name) AS f FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def name_variants(spark, sf):
    s, n = _read(spark, sf, "supplier"), _read(spark, sf, "nation")
    c = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("ID"), F.col("s_name").alias("name"), F.col("n_name").alias("firstname"))
    return N.variants(c)


@query("""SELECT o_orderkey AS ID, c_custkey AS collector_id, CAST(5 AS INTEGER) AS start, CAST(5 + length(c_name) AS INTEGER) AS "end", length(c_name)::INTEGER AS score FROM orders JOIN customer ON o_custkey = c_custkey""")
def find_collectors(spark, sf):
    o, c = _read(spark, sf, "orders"), _read(spark, sf, "customer")
    who = c.select(F.col("c_custkey").alias("ID"), F.col("c_name").alias("name"), F.lit("").alias("firstname"))
    texts = o.join(who, F.col("o_custkey") == who["ID"]).select(F.col("o_orderkey").alias("ID"), F.concat(F.lit("leg. "), "name", F.lit(", "), "o_orderpriority").alias("text"))
    return N.find_names(texts, who)


@query("SELECT s_suppkey AS ID, round((s_suppkey % 90) + (s_suppkey % 60) / 60.0, 6) AS lat, round(-((s_suppkey % 180) + (s_suppkey % 59) / 60.0 + (s_suppkey % 60) / 3600.0), 6) AS lng FROM supplier")
def latlng_decimal(spark, sf):
    k = F.col("s_suppkey")
    text = F.concat(F.lit("coll. at "), k % 90, F.lit("°"), k % 60, F.lit("' N, "), k % 180, F.lit("°"), k % 59, F.lit("'"), k % 60, F.lit("\" W, 1900")).alias("text")
    found = _read(spark, sf, "supplier").select(k.alias("ID"), G.latlng(text).alias("g"))
    return found.select("ID", _r("g.lat", 6).alias("lat"), _r("g.lng", 6).alias("lng"))


@query("SELECT p_partkey AS ID, round(CASE p_partkey % 3 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size * 1000 ELSE p_size * 0.3048 END, 6) AS metres FROM part")
def distance_metres(spark, sf):
    unit = F.element_at(F.array(F.lit("m"), F.lit(" km"), F.lit("ft")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return _read(spark, sf, "part").select(F.col("p_partkey").alias("ID"), _r(G.distance_metres(F.concat(F.lit("alt. "), "p_size", unit)), 6).alias("metres"))


@query("SELECT item_id AS ID, count(*) AS n FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(strip_accents(text)), '[a-z]{3,}'))) AS w FROM benchmark) GROUP BY 1")
def gazetteer_words(spark, sf):
    return Z.ngrams(items(spark, sf), 1).groupBy("ID").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS ID, s_nationkey::BIGINT AS geoname_id, CAST(n_regionkey AS VARCHAR) AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def gazetteer_ngrams(spark, sf):
    """Places named by letters that stand for each nation's number."""
    n, s = _read(spark, sf, "nation"), _read(spark, sf, "supplier")
    gaz = n.select(F.col("n_nationkey").cast("long").alias("geoname_id"), F.concat(F.lit("Old nat"), F.translate(F.col("n_nationkey").cast("string"), "0123456789", "abcdefghij"), F.lit("land")).alias("name"), F.col("n_regionkey").cast("string").alias("country"), F.lit("P").alias("fcl"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lng"), F.lit(None).cast("long").alias("parent_id"))
    texts = s.select(F.col("s_suppkey").alias("ID"), F.concat(F.lit("found near old Nat"), F.translate(F.col("s_nationkey").cast("string"), "0123456789", "abcdefghij"), F.lit("land, 1900")).alias("text"))
    return Z.find_places(texts, gaz).select("ID", "geoname_id", "country")


@query("SELECT o_orderkey AS ID, year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate) AS date_i, day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate) AS date_v, '' AS collector_v, '' AS collector_i, '' AS geo_v, '' AS geo_i FROM orders")
def parse_info(spark, sf):
    return P.parse_info(dated(spark, sf).select("ID", "text"))


# --- exact matching, and matching as the operator does it: tokens within an edit distance ---
_FUZZY_SQL = _search_sql(_index_sql(1, "benchmark", "item_id"), _DOC_QUERIES, True)
_FUZZY_DATED_SQL = f"WITH {_LABELS_SQL}, {_EVENTS_SQL}, " + _search_sql(_index_sql(1, "ev", "eid"), "SELECT lid AS query_id, text AS query FROM lab", True).removeprefix("WITH ")
_FUZZY = {
    "match_all_hits": lambda spark, sf: _rounded(_matches(spark, sf, True), "score"),
    "match_unmatched_labels": lambda spark, sf: M.unmatched(labels(spark, sf), _matches(spark, sf, True), "label_id"),
    "match_unmatched_events": lambda spark, sf: M.unmatched(items(spark, sf), _matches(spark, sf, True), "event_id"),
    "match_date_filtered": lambda spark, sf: _dated_match(spark, sf, False, True),
    "match_persist": lambda spark, sf: _dated_match(spark, sf, True, True),
    "best_match": lambda spark, sf: _best(spark, sf, True),
    "left_join_unassigned": lambda spark, sf: _assigned(spark, sf, True),
    "group_confidence": lambda spark, sf: _rounded(E.group_confidence(_assigned(spark, sf, True)), "confidence"),
    "cluster_stats": lambda spark, sf: _rounded(E.cluster_statistics(_assigned(spark, sf, True)), "mean", "sd"),
}
for _name, _f in _FUZZY.items():
    QUERIES[f"{_name}_fuzzy"] = _f
    _exact = ORACLE_SQL[_name]
    ORACLE_SQL[f"{_name}_fuzzy"] = _exact.replace(_nudged(_DATED_SQL), _nudged(_FUZZY_DATED_SQL)).replace(_nudged(_MATCH_SQL), _nudged(_FUZZY_SQL))
    assert ORACLE_SQL[f"{_name}_fuzzy"] != _exact

from labelloom import queries_more as _more  # noqa: E402, F401  (adds its queries to these)
