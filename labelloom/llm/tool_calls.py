"""Chat formatting: linking tool calls to their results, in DataFrame functions only.

Calls and results are hash-joined by identifier.  Levels give a topological
order: a call stands one level above the deepest call that it depends on.  Chains of
calls that each need one other are contracted by pointer doubling; then rounds of joins
go over the calls with several needs.  So there are about log2 of the longest chain
rounds, and one more for each call with several needs on the deepest path.
Arguments are validated against the schema of the named tool.  Each call is serialised with its result as canonical
JSON: keys in code-point order, no spaces, characters above ASCII as they are.

Rows stay one a call from start to end; a conversation of any length is never
gathered.

Defined results: the smallest row of several with one identifier counts; a call without
a result has ``linked`` false and a null result; a result without a call is a row
of its own, with a null name; arguments that are no JSON object are invalid and
serialised as null; dependencies on unknown calls are ignored; calls in or behind
a cycle have a null level; null identifiers link nothing and are left out by ``linked``.
``every_turn`` carries every row of the table: what ``linked`` leaves out, other roles, and rows
without conversation or turn stand as rows of their own, and so does each of several equal
rows; very long texts are written whole; an empty table gives an empty result; other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Space

#: Types that a schema can name, and how Spark's variant type calls them.
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": r"BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}

#: The tools that turns of a plain conversation stand for: its first question, and what follows on an earlier one.
TURNS = {"ask": {"required": {"prompt": "string"}}, "follow": {"required": {"after": "string", "prompt": "string"}}}


def json_text(value: Column) -> Column:
    """JSON form of a string."""
    inside = F.to_json(F.array(value))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(inside, F.lit(2), F.length(inside) - 2))


def problems(name: Column, arguments: Column, tools: dict) -> Column:
    """Array of what is wrong with a call: unknown tool, no object, missing, unknown or ill-typed keys."""
    v = F.try_parse_json(arguments)
    keys = F.map_keys(F.from_json(arguments, "map<string,string>"))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    out = F.when(~is_object, F.array(F.lit("no object")))
    for tool, schema in sorted(tools.items()):
        need, may = schema.get("required", {}), schema.get("optional", {})
        known = F.array(*[F.lit(k) for k in sorted({*need, *may})]).cast("array<string>")
        parts = [F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(F.lit("unknown "), k))]
        for k, kind in sorted({**need, **may}.items()):
            there = F.array_contains(keys, k)
            typed = F.schema_of_variant(F.try_variant_get(v, f'$["{k}"]', "variant")).rlike(f"^({_TYPES[kind]})$")
            missing = F.array(F.lit(f"missing {k}")) if k in need else F.array().cast("array<string>")
            parts.append(F.when(~there, missing).when(~F.coalesce(typed, F.lit(False)), F.array(F.lit(f"type of {k}"))).otherwise(F.array().cast("array<string>")))
        out = out.when(name == tool, F.concat(*parts))
    return out.otherwise(F.array(F.lit("unknown tool")))


def _anchors(calls: DataFrame, needs: DataFrame, space: Space) -> DataFrame:
    """id, up, dist: the call that a chain of single needs leads to, and its length; rings lead nowhere and are left out.

    ``needs``: id, n (needs of the call), up (one of them).
    """
    single = F.col("n") == 1
    own = calls.select("id").join(needs, "id", "left").select("id", F.when(single, F.col("up")).alias("up"), F.when(single, 1).otherwise(0).cast("long").alias("dist"))
    pointers = space.save(own.withColumn("open", F.col("up").isNotNull()))
    for _ in range(2 + math.ceil(math.log2(max(2, pointers.count())))):
        if pointers.filter("open").isEmpty():
            break
        # an end of a chain points nowhere; whoever points at one is settled
        ahead = pointers.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("dist").alias("_dist"))
        moved = pointers.join(ahead, "up", "left").select("id", F.coalesce("_up", "up").alias("up"), (F.col("dist") + F.when(F.col("_up").isNotNull(), F.col("_dist")).otherwise(0)).alias("dist"), F.col("_up").isNotNull().alias("open"))
        pointers, old = space.save(moved), pointers
        space.drop(old)
    return pointers.filter("not open").select("id", F.coalesce("up", "id").alias("up"), "dist")


def levels(calls: DataFrame, edges: DataFrame, space: Space) -> DataFrame:
    """id, level of each call that has one; ``edges`` (id, needs) between known calls."""
    edges = space.save(edges.distinct())
    needs = edges.groupBy("id").agg(F.count("*").alias("n"), F.min("needs").alias("up"))
    anchors = space.save(_anchors(calls, needs, space))
    # what is left: calls without needs, level 0, and calls with several, one above the deepest of them
    several = needs.filter("n > 1").select("id")
    ends = anchors.select(F.col("id").alias("needs"), F.col("up").alias("_up"), (F.col("dist") + 1).alias("far"))
    open_edges = space.save(edges.join(several, "id", "left_semi").join(ends, "needs", "left").select("id", F.col("_up").alias("needs"), "far", F.lit(None).cast("long").alias("below")))
    done = space.save(anchors.select(F.col("up").alias("id")).distinct().join(several, "id", "left_anti").withColumn("level", F.lit(0).cast("long")))
    parts = [done]
    while not open_edges.isEmpty() and not done.isEmpty():
        # what an edge needs is settled once, so an edge met keeps only its level
        met = open_edges.join(done.select(F.col("id").alias("needs"), F.col("level").alias("_new")), "needs", "left")
        open_edges, old = space.save(met.select("id", "needs", "far", F.coalesce("below", F.col("_new") + F.col("far")).alias("below"))), open_edges
        space.drop(old)
        state = open_edges.groupBy("id").agg(F.count("*").alias("n"), F.count("below").alias("m"), F.max("below").alias("level"))
        done = space.save(state.filter("n = m").select("id", "level"))
        parts.append(done)
        open_edges, old = space.save(open_edges.join(done.select("id"), "id", "left_anti")), open_edges
        space.drop(old)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    found = found.select(F.col("id").alias("up"), "level")
    return anchors.join(found, "up").select("id", (F.col("level") + F.col("dist")).cast("int").alias("level"))


def linked(spark: SparkSession, calls: DataFrame, results: DataFrame, tools: dict) -> DataFrame:
    """Calls (id, place, name, arguments, needs array) and results (id, place, content) as one row each call or lone result.

    Returns id, place, name, level, linked, valid, problems, json.
    """
    space = Space(spark, "calls")
    first = calls.filter("id is not null").groupBy("id").agg(F.min(F.struct("place", "name", "arguments", "needs")).alias("c"))
    calls = space.save(first.select("id", "c.*"))
    results = results.filter("id is not null").groupBy("id").agg(F.min(F.struct("place", "content")).alias("r")).select("id", F.col("r.place").alias("result_place"), "r.content", F.lit(True).alias("_r"))
    wanted = calls.select("id", F.explode("needs").alias("needs")).filter("needs is not null")
    edges = wanted.join(calls.select(F.col("id").alias("needs")), "needs", "left_semi")
    level = levels(calls, edges, space)
    rows = calls.withColumn("_c", F.lit(True)).join(level, "id", "left")
    rows = rows.join(results.hint("shuffle_hash"), "id", "full_outer")
    bad = problems(F.col("name"), F.col("arguments"), tools)
    rows = rows.withColumn("problems", F.when(F.col("_c"), bad))
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null"))
    whole = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), json_text(F.col("id")), F.lit(',"name":'), json_text(F.col("name")), F.lit(',"result":'), json_text(F.col("content")), F.lit("}"))
    return rows.select("id", F.coalesce("place", "result_place").alias("place"), "name", "level", (F.coalesce("_c", F.lit(False)) & F.coalesce("_r", F.lit(False))).alias("linked"), F.coalesce(F.size("problems") == 0, F.lit(False)).alias("valid"), F.coalesce(F.array_join("problems", ","), F.lit("")).alias("problems"), whole.alias("json"))


def conversation_calls(talk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that a plain conversation stands for.

    A conversation's first user turn calls ``ask``; each later one calls ``follow``, naming
    and needing the question two turns before.  The assistant's turn right after a call is its result.
    """
    turn, conv = F.col("turn").cast("long"), F.col("conv_id").cast("string")
    text = F.col("text").cast("string")
    users = talk.filter(F.col("role") == "user").select(conv.alias("conv"), turn.alias("place"), text.alias("text"))
    opening = users.groupBy("conv").agg(F.min("place").alias("first"))
    later, before = F.col("place") > F.col("first"), F.concat_ws("-", "conv", F.col("place") - 2)
    prompt = F.concat(F.lit('"prompt":'), json_text(F.col("text")), F.lit("}"))
    arguments = F.when(later, F.concat(F.lit('{"after":'), json_text(before), F.lit(","), prompt)).otherwise(F.concat(F.lit("{"), prompt))
    calls = users.join(opening, "conv").select(F.concat_ws("-", "conv", "place").alias("id"), "place", F.when(later, "follow").otherwise("ask").alias("name"), arguments.alias("arguments"), F.when(later, F.array(before)).otherwise(F.array().cast("array<string>")).alias("needs"))
    results = talk.filter(F.col("role") == "assistant").select(F.concat_ws("-", conv, turn - 1).alias("id"), (turn - 1).alias("place"), text.alias("content"))
    return calls, results


def formatted(spark: SparkSession, talk: DataFrame, tools: dict | None = None) -> DataFrame:
    """The linked calls of plain conversations; rows of other roles and further rows of a turn are left to ``every_turn``."""
    calls, results = conversation_calls(talk.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()))
    return linked(spark, calls, results, tools or TURNS)


def every_turn(spark: SparkSession, talk: DataFrame, tools: dict | None = None) -> DataFrame:
    """The rows of ``formatted`` and each row of the table that they leave out.

    ``kind`` is call or result for the former; a result linked to a call is part of the
    call's row.  The others, which are further rows of a turn, other roles, and rows
    without conversation or turn, each have an identifier of their own, their role as
    kind, no level, and the JSON of their content.
    """
    rows = formatted(spark, talk, tools).withColumn("kind", F.when(F.col("name").isNull(), "result").otherwise("call"))
    talk = talk.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("place"), "role", F.col("text").cast("string").alias("content"))
    alike = talk.groupBy("conv", "place", "role", "content").agg(F.count("*").alias("n"))
    # the text that linked() takes of a turn: the smallest arguments, the smallest content
    spoken = alike.filter(F.col("conv").isNotNull() & F.col("place").isNotNull() & F.col("role").isin("user", "assistant"))
    order = F.when(F.col("role") == "user", json_text(F.col("content"))).otherwise(F.col("content"))
    taken = spoken.groupBy("conv", "place", "role").agg(F.min(F.struct(order.alias("o"), "content")).alias("t")).select("conv", "place", "role", F.col("t.content").alias("_text"), F.lit(True).alias("_taken"))
    found = alike.join(taken, ["conv", "place", "role"], "left")
    left = F.col("n") - F.when(F.col("_taken") & F.col("content").eqNullSafe(F.col("_text")), 1).otherwise(0)
    rest = found.withColumn("n", left).filter("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    kind = F.coalesce("role", F.lit("none"))
    own = F.md5(F.concat(kind, F.lit("\n"), json_text(F.col("content"))).cast("binary"))
    rest = rest.withColumn("id", F.concat(F.coalesce("conv", F.lit("")), F.lit("-"), F.coalesce(F.col("place").cast("string"), F.lit("")), F.lit("-"), own, F.lit("-"), F.col("copy").cast("string")))
    whole = F.concat(F.lit('{"content":'), json_text(F.col("content")), F.lit(',"id":'), json_text(F.col("id")), F.lit(',"role":'), json_text(F.col("role")), F.lit("}"))
    rest = rest.select("id", "place", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("level"), F.lit(False).alias("linked"), F.lit(False).alias("valid"), F.lit("").alias("problems"), whole.alias("json"), kind.alias("kind"))
    return rows.unionByName(rest)


ORACLE_SQL = """
WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS conv, CAST(turn AS BIGINT) AS place, role, CAST(text AS VARCHAR) AS text, coalesce(CAST(to_json(text) AS VARCHAR), 'null') AS j FROM conversations),
n AS (SELECT *, CASE WHEN conv IS NOT NULL AND place IS NOT NULL AND role IN ('user', 'assistant')
   THEN row_number() OVER (PARTITION BY conv, place, role ORDER BY CASE WHEN role = 'user' THEN j END, text NULLS FIRST) ELSE 0 END AS k FROM t),
u AS (SELECT *, min(place) OVER (PARTITION BY conv) AS first, row_number() OVER (PARTITION BY conv, place % 2 ORDER BY place) AS i FROM n WHERE role = 'user' AND k = 1),
c AS (SELECT *, conv || '-' || place AS id, row_number() OVER (PARTITION BY conv, place % 2, place - 2 * i ORDER BY place) - 1 AS level,
   '{' || CASE WHEN place > first THEN '"after":' || CAST(to_json(conv || '-' || (place - 2)) AS VARCHAR) || ',' ELSE '' END || '"prompt":' || j || '}' AS arguments FROM u),
r AS (SELECT conv || '-' || (place - 1) AS id, place - 1 AS place, j FROM n WHERE role = 'assistant' AND k = 1),
x AS (SELECT *, coalesce(conv, '') || '-' || coalesce(CAST(place AS VARCHAR), '') || '-' || md5(coalesce(role, 'none') || chr(10) || j) || '-' || row_number() OVER (PARTITION BY conv, place, role, text) AS id FROM n WHERE k <> 1)
SELECT coalesce(c.id, r.id) AS id, coalesce(c.place, r.place) AS place, CASE WHEN c.id IS NOT NULL THEN CASE WHEN c.place > c.first THEN 'follow' ELSE 'ask' END END AS name,
  CAST(c.level AS INTEGER) AS level, c.id IS NOT NULL AND r.id IS NOT NULL AS linked, c.text IS NOT NULL AS valid, CASE WHEN c.id IS NOT NULL AND c.text IS NULL THEN 'type of prompt' ELSE '' END AS problems,
  '{"arguments":' || coalesce(c.arguments, 'null') || ',"id":' || CAST(to_json(coalesce(c.id, r.id)) AS VARCHAR)
   || ',"name":' || CASE WHEN c.id IS NULL THEN 'null' WHEN c.place > c.first THEN '"follow"' ELSE '"ask"' END || ',"result":' || coalesce(r.j, 'null') || '}' AS json,
  CASE WHEN c.id IS NULL THEN 'result' ELSE 'call' END AS kind
FROM c FULL JOIN r ON c.id = r.id
UNION ALL
SELECT id, place, NULL, NULL, false, false, '', '{"content":' || j || ',"id":' || CAST(to_json(id) AS VARCHAR) || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}', coalesce(role, 'none') FROM x
"""
