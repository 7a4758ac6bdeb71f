"""Fuzzy ranked search as a similarity join.

A query token matches index tokens within an edit distance that grows with its
length.  Distinct tokens are matched with each other first; postings come after.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions import text as T
from labelloom.storage import ready, written

from .index import Index, Options
from .small import small_search

#: Token pairs (query vocabulary times index vocabulary) up to which each executor compares all of them with a broadcast.
PAIR_LIMIT = 2e7
#: Query tokens that may be broadcast at all.
BROADCAST_TOKENS = 50_000
#: Numbers of 64 bits that stand for the set of a text's tokens in bounds of exact scores.
SET_WORDS = 16
#: Pairs of texts in one Arrow batch.
PAIR_ROWS = 512


def _verified(pairs: DataFrame) -> DataFrame:
    d = F.levenshtein("q", "token", 4096)
    return pairs.withColumn("d", d).filter((F.col("d") >= 0) & (F.col("d") <= F.col("k"))).select("q", "token", (1 - F.col("d") / F.greatest(F.length("q"), F.length("token"))).alias("identity"))


def token_pairs(queries: DataFrame, vocabulary: DataFrame, strategy: str = "auto", allowance=T.mismatch_allowance) -> DataFrame:
    """q, token, identity for ``levenshtein(q, token) <= allowance(q)``.

    ``queries`` (q) and ``vocabulary`` (token) are distinct.  Tokens that allow no
    error go through an equi-join.  For others: ``broadcast`` compares all pairs
    of near lengths, for small vocabularies; ``blocked`` is an equi-join on pieces
    (of k+1 pieces of a token at least one survives k errors, moved by k at most).
    """
    queries = queries.withColumn("k", allowance(F.col("q")))
    exact = queries.filter("k = 0").join(vocabulary.withColumnRenamed("token", "q"), "q").select("q", F.col("q").alias("token"), F.lit(1.0).alias("identity"))
    loose = queries.filter("k > 0")
    few = small = False
    if strategy == "auto":
        n, size = loose.count(), vocabulary.count()
        few, small = n <= BROADCAST_TOKENS, size <= BROADCAST_TOKENS
        strategy = "broadcast" if few and n * size <= PAIR_LIMIT else "blocked"
    if strategy == "broadcast":
        near = vocabulary.join(F.broadcast(loose), (F.abs(F.length("q") - F.length("token")) <= F.col("k")) & (F.levenshtein("q", "token") <= F.col("k")))
        return exact.union(_verified(near))
    return exact.union(_verified(_blocked(loose, vocabulary, few, small).distinct()))


def _blocked(loose: DataFrame, vocabulary: DataFrame, few: bool, small: bool = False) -> DataFrame:
    """Candidates that share a piece; pieces of ``few`` query tokens are broadcast (five each at most, for tokens under 64 characters), or those of a ``small`` vocabulary."""

    def begin(length: Column, k: Column, i: Column) -> Column:
        return F.floor(length * i / (k + 1)).cast("int")

    def key(length: Column, i: Column, piece: Column) -> Column:
        return F.xxhash64(length.cast("int"), i.cast("int"), piece)

    n = F.length("q")
    own = F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: key(n, i, F.substring("q", begin(n, F.col("k"), i) + 1, begin(n, F.col("k"), i + 1) - begin(n, F.col("k"), i))))
    left = loose.select("q", "k", F.explode(own).alias("key"))
    lengths = loose.groupBy(F.length("q").alias("len")).agg(F.min("k").alias("k"))  # one row for each token length
    m = F.length("token")
    target = vocabulary.join(F.broadcast(lengths), F.abs(m - F.col("len")) <= F.col("k"))
    k = F.col("k")
    pieces = F.flatten(F.transform(F.sequence(F.lit(0), k), lambda i: F.transform(F.sequence(F.greatest(begin(F.col("len"), k, i) - k, F.lit(0)), F.least(begin(F.col("len"), k, i) + k, m)), lambda s: key(F.col("len"), i, F.substring("token", s + 1, begin(F.col("len"), k, i + 1) - begin(F.col("len"), k, i))))))
    right = target.select("token", F.explode(F.array_distinct(pieces)).alias("key"))
    if small and not few:
        right = F.broadcast(right)
    return right.join(F.broadcast(left) if few else left, "key").select("q", "token", "k")


def query_tokens(queries: DataFrame, min_len: int) -> DataFrame:
    """query_id, qpos, q, m of queries (query_id, query)."""
    tokens = queries.select("query_id", T.index_tokens(F.coalesce(F.col("query"), F.lit("")), min_len).alias("t"))
    return tokens.select("query_id", F.size("t").alias("m"), F.posexplode("t").alias("qpos", "q"))


def search(queries: DataFrame, index: Index, scoring: str = "w", fuzzy: bool = True, condition: Column | None = None, threshold: float | None = None, strategy: str = "auto", exclude_self: bool = False, allowance=T.mismatch_allowance) -> DataFrame:
    """query_id, ID, score of all documents with a matching token.

    ``scoring``: ``w`` weight of matches over the document's highest score, times
    the share of query tokens matched; ``l`` similarity of the texts; ``w+l`` the
    product.  ``condition`` restricts the documents and changes no weight.

    With a threshold t, a score by weight needs a match at ceil(t * m) of a query's m places,
    so at one of any m - ceil(t * m) + 1 of them: only the documents found by the rarest of
    these are scored, and the postings of common tokens are not expanded.
    """
    if scoring not in ("w", "l", "w+l"):
        raise ValueError(f"unknown scoring: {scoring}")
    one = small_search(queries, index, scoring, fuzzy, condition, threshold, strategy, allowance)
    if one is not None:
        one = one.filter(F.col("query_id") != F.col("ID")) if exclude_self else one
        return one if threshold is None else one.filter(F.col("score") >= threshold)
    index = index.saved() if index.by_id else index
    tokens = query_tokens(queries, index.options.min_len)
    postings = index.postings
    if condition is not None:
        postings = postings.join(index.texts.filter(condition).select("ID"), "ID", "left_semi")
    if fuzzy:
        pairs = token_pairs(tokens.select("q").distinct(), postings.select("token").distinct(), strategy, allowance)
        near = tokens.join(pairs, "q")
    else:
        near = tokens.withColumns({"token": F.col("q"), "identity": F.lit(1.0)})
    own = F.col("query_id") != F.col("ID") if exclude_self else F.lit(True)
    if threshold is not None and threshold > 0 and scoring != "l":
        near = written(near, "near")
        if not fuzzy and scoring == "w":
            return _pair_scores(_exact_candidates(near, postings, threshold, index.max_scores, own), near, postings, index.max_scores).filter(F.col("score") >= threshold)
        found = _candidates(near, postings, threshold) if fuzzy else _exact_candidates(near, postings, threshold, index.max_scores, own)
        matches = near.join(found.filter(own), "query_id").join(postings, ["token", "ID"])
    else:
        matches = near.join(postings, "token").filter(own)
    if fuzzy:
        # the best token of a document for a place in the query: a partial aggregate before the shuffle
        best = matches.groupBy("query_id", "qpos", "ID").agg(F.min(F.struct((-F.col("identity")).alias("i"), (-F.col("w")).alias("w"), "token", "tf", "m")).alias("b"))
        chosen = best.select("query_id", "qpos", "ID", "b.token", "b.tf", "b.m", (-F.col("b.w")).alias("w"), (-F.col("b.i")).alias("identity"))
    else:
        chosen = matches.select("query_id", "qpos", "ID", "token", "tf", "m", "w", "identity")
    # a document's occurrences of a token are used up in query order
    used = F.row_number().over(Window.partitionBy("query_id", "ID", "token").orderBy("qpos"))
    counted = chosen.withColumn("used", used).filter("used <= tf")
    factor = F.col("identity") if scoring == "w" else F.lit(1.0)
    sums = counted.groupBy("query_id", "ID").agg(F.sum(F.col("w") * factor).alias("raw"), F.count("*").alias("n"), F.first("m").alias("m"))
    scored = sums.join(index.max_scores, "ID").withColumn("weight", F.col("raw") / F.col("max_score") * F.col("n") / F.col("m"))
    if scoring != "w":
        # texts are simplified once each, not once a pair
        both = scored.join(index.texts.select("ID", T.simplify(F.col("text")).alias("_text")), "ID").join(queries.select("query_id", T.simplify(F.coalesce("query", F.lit(""))).alias("_query")), "query_id")
        if threshold is not None:  # texts are at least as far apart as their lengths
            a, b = F.length("_query"), F.length("_text")
            both = both.filter(F.least(a, b) >= threshold * F.greatest(a, b) - 1e-9)
        likeness = 1 - T.norm_levenshtein(F.col("_query"), F.col("_text"), False)
        scored = both.withColumn("weight", likeness * F.col("weight") if scoring == "w+l" else likeness)
    out = scored.select("query_id", "ID", F.col("weight").alias("score"))
    return out if threshold is None else out.filter(F.col("score") >= threshold)


def _candidates(near: DataFrame, postings: DataFrame, threshold: float) -> DataFrame:
    """query_id, ID: documents with a match at one of the rarest places of a query that a score of ``threshold`` must touch.

    ``near``: query_id, qpos, m, token, of each place and token near it.
    """
    df = written(postings.groupBy("token").agg(F.count("*").alias("df")), "frequencies")
    places = near.join(df, "token").groupBy("query_id", "qpos").agg(F.first("m").alias("m"), F.sum("df").alias("hits"), F.min("token").alias("token"))
    rare = _rare(places, threshold).select("query_id", "qpos")
    return near.join(rare, ["query_id", "qpos"]).select("query_id", "token").distinct().join(postings.select("token", "ID"), "token").select("query_id", "ID").distinct()


def _rare(places: DataFrame, threshold: float) -> DataFrame:
    """Places with their rank ``r`` by rarity, as far as needed; those without any near token come first and find nothing."""
    order = Window.partitionBy("query_id").orderBy("hits", "token", "qpos")
    ranked = places.withColumn("r", F.row_number().over(order) + F.col("m") - F.count("*").over(Window.partitionBy("query_id")))
    return ranked.filter(F.col("r") <= F.col("m") - F.ceil(F.lit(threshold) * F.col("m") - 1e-9) + 1)


def _words(token: Column) -> list[Column]:
    """Aggregates: a set of tokens as ``SET_WORDS`` numbers of 64 bits, a bit a token."""
    bit = F.pmod(F.xxhash64(token), F.lit(64 * SET_WORDS))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    return [F.coalesce(F.bit_or(F.when(F.floor(bit / 64) == i, one)), F.lit(0).cast("long")).alias(f"b{i}") for i in range(SET_WORDS)]


def _exact_candidates(near: DataFrame, postings: DataFrame, threshold: float, max_scores: DataFrame, own: Column) -> DataFrame:
    """query_id, ID: as ``_candidates``, for equal tokens and with bounds that every pair of that score keeps.

    The rarest token that both have is among the rarest of the query, and among the rarest of the document that hold
    1 - threshold of its weight.  All rarer ones are not matched, nor is a token of the query whose bit is not among the
    document's: what is left of weight and places bounds the score.  Both sides carry their sets of bits, so a pair is
    dropped in the join and only those that keep the bounds are shuffled.
    """
    df = written(postings.groupBy("token").agg(F.count("*").alias("df")), "frequencies")
    rare = _rare(near.join(df.withColumnRenamed("df", "hits"), "token"), threshold).groupBy("query_id", "token").agg(F.min("r").alias("r"), F.first("m").alias("m"))
    left = rare.join(near.groupBy("query_id").agg(*_words(F.col("token"))), "query_id")
    left = left.select("query_id", "token", "m", (F.col("m") - F.col("r") + 1).alias("left"), F.array(*[f"b{i}" for i in range(SET_WORDS)]).alias("b"))
    before = Window.partitionBy("ID").orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
    rows = postings.join(df, "token").withColumns({"_w": F.coalesce(F.sum(F.col("tf") * F.col("w")).over(before), F.lit(0.0)), "_n": F.coalesce(F.sum("tf").over(before), F.lit(0))})
    sets = postings.groupBy("ID").agg(F.sum("tf").alias("total"), *_words(F.col("token"))).join(max_scores, "ID")
    right = rows.select("ID", "token", "_w", "_n").join(sets, "ID").filter(F.col("_w") <= (1 - threshold + 1e-9) * F.col("max_score"))
    right = right.select("ID", "token", (1 - F.col("_w") / F.col("max_score")).alias("share"), (F.col("total") - F.col("_n")).alias("rest"), F.array(*[f"b{i}" for i in range(SET_WORDS)]).alias("c"))
    missing = sum((F.bit_count(F.col("b")[i].bitwiseAND(F.bitwise_not(F.col("c")[i]))) for i in range(1, SET_WORDS)), F.bit_count(F.col("b")[0].bitwiseAND(F.bitwise_not(F.col("c")[0]))))
    needed = F.lit(threshold - 1e-9) * F.col("m")
    pairs = left.join(right, "token").filter(own).filter(F.col("share") * F.least("left", "rest") >= needed).filter(F.col("share") * (F.col("m") - missing) >= needed)
    return pairs.select("query_id", "ID").distinct()


def _pair_scores(pairs: DataFrame, near: DataFrame, postings: DataFrame, max_scores: DataFrame) -> DataFrame:
    """query_id, ID, score by weight of pairs (query_id, ID), for equal tokens.

    A query goes to its documents as one row of sorted hashes and counts; a document is shuffled once, and no token of a
    pair is a row.  Hashes have 64 bits and are not checked for collisions.
    """
    spark = pairs.sparkSession
    ready(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > PAIR_ROWS:  # rows hold whole texts
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PAIR_ROWS))
    of_query = near.groupBy("query_id", F.xxhash64("token").alias("h")).agg(F.count("*").alias("k"), F.first("m").alias("m"))
    q = of_query.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("h", "k"))).alias("q"), F.first("m").alias("m"))
    d = postings.groupBy("ID").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("token").alias("h"), F.col("tf").cast("long").alias("tf"), F.col("w").cast("double").alias("w")))).alias("d")).join(max_scores, "ID")
    both = pairs.join(q, "query_id").join(d, "ID").select("query_id", "ID", F.col("q.h").alias("qh"), F.col("q.k").alias("k"), F.col("m").cast("double").alias("m"), F.col("d.h").alias("dh"), F.col("d.tf").alias("tf"), F.col("d.w").alias("w"), "max_score")
    kinds = dict(both.dtypes)
    return both.mapInArrow(_score_pairs, f"query_id {kinds['query_id']}, ID {kinds['ID']}, score double")


def _score_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = {c: (batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in ("qh", "k", "dh", "tf", "w")}
        m, top, out = batch.column("m").to_numpy(), batch.column("max_score").to_numpy(), np.zeros(batch.num_rows)
        for i in range(batch.num_rows):
            qh, k, dh, tf, w = (values[at[i] : at[i + 1]] for at, values in columns.values())
            at = np.minimum(np.searchsorted(dh, qh), len(dh) - 1)
            hit = dh[at] == qh
            n = np.minimum(k[hit], tf[at[hit]])
            out[i] = (n * w[at[hit]]).sum() / top[i] * n.sum() / m[i]
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("ID"), pa.array(out)], names=["query_id", "ID", "score"])


def self_similarity(df: DataFrame, options: Options, threshold: float = 0.8, scoring: str = "w", strategy: str = "auto", fuzzy: bool = True) -> DataFrame:
    """query_id, ID, score: every text as a query for all others."""
    from .index import make_index

    return search(df.select(F.col("ID").alias("query_id"), F.col("text").alias("query")), make_index(df, options).saved(), scoring, fuzzy, threshold=threshold, strategy=strategy, exclude_self=True)
