"""Queries of this subpackage, each over whole tables, and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, language, mixing, quality_model, quality_rules, setsketch, sharding, tool_calls, toxicity
from .common import prepare, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scored(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(spark, table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(spark, table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(spark, table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(spark, table(spark, sf_dir, "documents"), width=2, percent=80)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(spark, table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.every_turn(spark, table(spark, sf_dir, "conversations"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(spark, table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _ready(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {f.__name__: _ready(f) for f in (op1_quality_classifier, op2_html_extraction, op3_language_id, op4_mixing, op5_toxicity, op6_near_dedup, op7_sharding, op8_decontamination, op9_chat_formatting, op10_quality_rules, pipeline)}

NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 OR (len(w) = 1 AND w[1] = '') THEN [] WHEN len(w) < 2 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n, list_aggregate(list_sort(g), 'string_agg', '|') AS k FROM s),
class AS (SELECT k, min(doc_id) AS rep FROM n WHERE n > 0 GROUP BY k),
rep AS (SELECT doc_id, g, len(g) AS n FROM s WHERE doc_id IN (SELECT rep FROM class)),
e AS (SELECT doc_id, n, unnest(g) AS g FROM rep),
df AS (SELECT g, count(*) AS c FROM e GROUP BY g),
p AS (SELECT doc_id, n, g FROM (SELECT e.doc_id, e.n, e.g, row_number() OVER (PARTITION BY e.doc_id ORDER BY c, e.g) AS r FROM e JOIN df USING (g)) WHERE r <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1),
cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id AND x.n * 100 >= y.n * 80 AND y.n * 100 >= x.n * 80),
link AS (SELECT a, b FROM cand JOIN rep x ON x.doc_id = a JOIN rep y ON y.doc_id = b WHERE 100 * len(list_intersect(x.g, y.g)) >= 80 * (x.n + y.n - len(list_intersect(x.g, y.g)))),
links AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(comp.c, class.rep, n.doc_id) AS component_id, n.doc_id = coalesce(comp.c, class.rep, n.doc_id) AS kept
FROM n LEFT JOIN class ON n.n > 0 AND class.k = n.k LEFT JOIN comp ON comp.a = class.rep
"""

ORACLE_SQL = {"op4_mixing": mixing.ORACLE_SQL, "op6_near_dedup": NEAR_SQL, "op8_decontamination": decontaminate.ORACLE_SQL, "op9_chat_formatting": tool_calls.ORACLE_SQL}
