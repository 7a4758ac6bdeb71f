"""Search where queries or documents are few: the few are sent to all tasks, and each row of the other side is scored by itself.

Nothing is shuffled but the rows of the large side, once: neither matches nor pairs of
query and document are gathered.  Scores are those of ``search``.  Where too many tokens of the
large side are near a small one for all tasks to hold them, its rows are dealt into parts and
each part gets the pairs of its own tokens (``in_parts``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import text as T
from labelloom.storage import ready, written

if TYPE_CHECKING:
    from .index import Index

#: Rows and tokens of a side that all tasks may hold, and pairs of near tokens above which each part of the rows gets its own.
SMALL_ROWS, SMALL_TOKENS, NEAR_PAIRS = 20_000, 1_000_000, 4_000_000
#: Matches that a task holds at a time (of one row it may be more).
STEP = 2_000_000


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of all ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def ranks(*keys: np.ndarray) -> np.ndarray:
    """Number of each row within its group, from 0; equal keys stand together."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.arange(n)
    return at - np.maximum.accumulate(np.where(new, at, 0))


class Ranges:
    """Rows sorted by a key from 0 to n - 1, and where each key's rows begin."""

    def __init__(self, key: np.ndarray, n: int, **columns: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.counts = np.bincount(key, minlength=n)
        self.starts = np.cumsum(self.counts) - self.counts
        self.columns = {k: v[order] for k, v in columns.items()}

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """For each row of the keys, one after the other: the place of its key, and the columns."""
        counts = self.counts[keys]
        at = spans(self.starts[keys], counts)
        return np.repeat(np.arange(len(keys)), counts), {k: v[at] for k, v in self.columns.items()}


class Texts:
    """Edit distances of one text to many, in bits of one long number (Myers, Hyyrö); a zero bit keeps the carry of each text from the next."""

    def __init__(self, texts: list[str]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.order = np.argsort(self.lengths, kind="stable")
        self.sorted = self.lengths[self.order]
        self.at = np.concatenate([[0], np.cumsum(self.sorted + 1)])
        self.low = sum_bits([a for a, n in zip(self.at, self.sorted, strict=False) if n], self.at[-1])
        places: dict[str, list[int]] = {}
        for a, i in zip(self.at, self.order, strict=False):
            for j, c in enumerate(texts[i]):
                places.setdefault(c, []).append(a + j)
        self.places = {c: sum_bits(p, self.at[-1]) for c, p in places.items()}
        self.all = 0
        for p in self.places.values():
            self.all |= p

    def distances(self, text: str, wanted: np.ndarray) -> np.ndarray:
        """Distances to the texts of these numbers."""
        n = self.lengths[wanted]
        first, last = np.searchsorted(self.sorted, n.min()), np.searchsorted(self.sorted, n.max(), "right")
        off, bits = int(self.at[first]), int(self.at[last] - self.at[first])
        cut = (1 << bits) - 1
        whole, low = (self.all >> off) & cut, (self.low >> off) & cut
        places = {c: (self.places.get(c, 0) >> off) & cut for c in set(text)}
        up, down = whole, 0
        # bits between texts are cleared only where they could be carried on: what is shifted out of them meets a set bit of ``low``
        for c in text:
            eq = places[c]
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph = ((down | (whole ^ (xh | up))) << 1) | low
            up, down = ((whole ^ (xv | ph)) | ((up & xh) << 1)) & whole, ph & xv
        sums = [np.concatenate([[0], np.cumsum(np.unpackbits(np.frombuffer(x.to_bytes(bits // 8 + 1, "little"), np.uint8), bitorder="little"), dtype=np.int64)]) for x in (up, down)]
        a, b = self.at[first:last] - off, self.at[first + 1 : last + 1] - off
        out = np.zeros(len(self.lengths), np.int64)
        out[self.order[first:last]] = len(text) + (sums[0][b] - sums[0][a]) - (sums[1][b] - sums[1][a])
        return out[wanted]


def sum_bits(places: list[int], size: int) -> int:
    bits = np.zeros(int(size) + 1, np.uint8)
    bits[np.asarray(places, np.int64)] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


class Scorer:
    """Scores of rows of the large side against all of the small one.

    ``near``: pairs (h: hash of a token of the large side, s: number of a token of the small side, identity), in the
    order of the large side's tokens; ``side``: rows (e: number of the small row, s, and pos, or tf and w), ``norm``: a
    number for each small row, its count of tokens or its highest score.
    """

    def __init__(self, near: dict | None, side: dict, norm: np.ndarray, exact: bool, scoring: str, texts: list[str] | None, threshold: float | None):
        n = int(side["s"].max(initial=-1)) + 1
        if near is not None:
            self.meet(near)
        self.exact, self.scoring, self.norm, self.threshold = exact, scoring, norm, threshold
        self.texts = None if texts is None else Texts(texts)
        extra = {}
        if "pos" in side:
            order = np.lexsort((side["pos"], side["s"], side["e"]))
            side = {k: v[order] for k, v in side.items()}
            extra = {"pos": side["pos"], "r": ranks(side["e"], side["s"])}
        else:
            extra = {"tf": side["tf"], "w": side["w"]}
        self.side = Ranges(side["s"], n, e=side["e"], **extra)

    def meet(self, near: dict) -> None:
        """From now on these pairs hold."""
        self.hashes, first, at = np.unique(near["h"], return_index=True, return_inverse=True)
        self.rank = first  # in the order of the tokens
        self.near = Ranges(at, len(self.hashes), s=near["s"], i=near["identity"])

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are near any small token, and the numbers of these."""
        if not len(self.hashes):
            return np.zeros(len(h), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        return hit, at[hit]

    def queries(self, row: np.ndarray, pos: np.ndarray, h: np.ndarray, m: np.ndarray) -> Iterator[tuple]:
        """Rows are queries and the small side documents: row, small row and score."""
        hit, a = self.known(h)
        row, pos = row[hit], pos[hit]
        order = np.lexsort((pos, a, row))
        row, pos, a = row[order], pos[order], a[order]
        turn = ranks(row, a)
        # the best token of each small row, for each token of the rows
        words, at = np.unique(a, return_inverse=True)
        of, pair = self.near.of(words)
        back, post = self.side.of(pair["s"])
        of, tok, i, e, tf, w = of[back], pair["s"][back], pair["i"][back], post["e"], post["tf"], post["w"]
        if not self.exact:
            order = np.lexsort((tok, -w, -i, e, of))
            order = order[ranks(of[order], e[order]) == 0]
            of, tok, i, e, tf, w = (x[order] for x in (of, tok, i, e, tf, w))
        best = Ranges(of, len(words), e=e, tok=tok, tf=tf, v=w * i if self.scoring == "w" else w)
        most = np.zeros(len(words), np.int64)
        np.maximum.at(most, of, tf)
        some = turn < most[at]
        row, pos, at, turn = row[some], pos[some], at[some], turn[some]
        for part in self._parts(row, best.counts[at]):
            back, got = best.of(at[part])
            free = turn[part][back] < got["tf"]
            yield self._sums(row[part][back][free], *(got[k][free] for k in ("e", "tok", "tf", "v")), pos[part][back][free], lambda r, e: (self.norm[e], m[r]))

    def documents(self, row: np.ndarray, h: np.ndarray, tf: np.ndarray, w: np.ndarray, top: np.ndarray) -> Iterator[tuple]:
        """Rows are documents and the small side queries: row, small row and score."""
        hit, a = self.known(h)
        row, tf, w = row[hit], tf[hit], w[hit]
        back, pair = self.near.of(a)
        row, a, tf, w, s, i = row[back], a[back], tf[back], w[back], pair["s"], pair["i"]
        order = np.lexsort((self.rank[a], -w, -i, s, row))
        order = order[ranks(row[order], s[order]) == 0]
        row, a, tf, s, v = row[order], a[order], tf[order], s[order], (w * i if self.scoring == "w" else w)[order]
        for part in self._parts(row, self.side.counts[s]):
            back, got = self.side.of(s[part])
            free = got["r"] < tf[part][back]
            back = back[free]
            yield self._sums(row[part][back], got["e"][free], a[part][back], tf[part][back], v[part][back], got["pos"][free], lambda r, e: (top[r], self.norm[e]))

    def _parts(self, row: np.ndarray, counts: np.ndarray) -> Iterator[slice]:
        """Slices of whole rows, with about ``STEP`` matches each."""
        if len(row):
            ends = np.append(np.flatnonzero(row[1:] != row[:-1]) + 1, len(row))
            total = np.cumsum(counts)[ends - 1]
            begin = done = 0
            while begin < len(row):
                k = max(np.searchsorted(total, done + STEP, "right"), np.searchsorted(ends, begin, "right") + 1)
                end, done = ends[min(k, len(ends)) - 1], total[min(k, len(ends)) - 1]
                yield slice(begin, end)
                begin = end

    def _sums(self, row, e, tok, tf, v, pos, norms) -> tuple:
        """A document's occurrences of a token are used up in the order of the query."""
        if not self.exact:  # equal tokens are cut already
            order = np.lexsort((pos, tok, e, row))
            order = order[ranks(row[order], e[order], tok[order]) < tf[order]]
            row, e, v = row[order], e[order], v[order]
        size = max(len(self.norm), 1)
        key, at = np.unique(row * size + e, return_inverse=True)
        row, e = key // size, key % size
        top, m = norms(row, e)
        return row, e, np.bincount(at, v, len(key)) / top * np.bincount(at, minlength=len(key)) / m

    def like(self, texts: list[str], row: np.ndarray, e: np.ndarray, score: np.ndarray) -> tuple:
        """Scores by the likeness of texts; with a threshold only where the lengths allow it."""
        own = np.array([len(t) for t in texts], np.int64)[row]
        longer, shorter = np.maximum(own, self.texts.lengths[e]), np.minimum(own, self.texts.lengths[e])
        if self.threshold is not None:
            keep = shorter >= self.threshold * longer - 1e-9
            row, e, score, longer = row[keep], e[keep], score[keep], longer[keep]
        like = np.ones(len(row))
        begins = np.flatnonzero(ranks(row) == 0)
        for a, b in zip(begins, np.append(begins[1:], len(row)), strict=True):
            d = self.texts.distances(texts[row[a]], e[a:b])
            like[a:b] = 1 - np.where(longer[a:b] > 0, d / np.maximum(longer[a:b], 1), 0)
        return row, e, like * score if self.scoring == "w+l" else like


def in_parts(rows: DataFrame, pairs: DataFrame, words: list[str], tasks: int) -> DataFrame:
    """``rows`` (part, h: hashes of tokens, ...), after the near pairs of each part's tokens, as rows (part, h, s, i) in the order of the tokens.

    Every pair goes to the parts whose rows hold its token, once each, and no row is joined with its pairs.
    """
    numbers = rows.sparkSession.createDataFrame(list(enumerate(words)), "s int, little string")
    near = pairs.join(F.broadcast(numbers), "little").groupBy(F.xxhash64("big").alias("h")).agg(F.min("big").alias("big"), F.collect_list(F.struct("s", "identity")).alias("p"))
    held = rows.select("part", F.explode("h").alias("h")).distinct().join(near, "h")
    pairs = held.select("part", F.array("h").alias("h"), F.col("p.s").alias("s"), F.col("p.identity").alias("i"), F.col("big").alias("_order"))
    both = pairs.unionByName(rows, allowMissingColumns=True)
    return both.repartition(tasks, "part").sortWithinPartitions("part", F.col("s").isNull(), "_order").drop("_order")


def met(scorer: Scorer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``in_parts`` without the pairs, which the scorer has met before the rows of their part."""
    own, found = None, []
    for batch in batches:
        part, pairs = batch.column("part").to_numpy(), batch.column("s").is_valid().to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(ranks(part, pairs) == 0)
        for a, b in zip(begins, np.append(begins[1:], len(part)), strict=True):
            piece = batch.slice(a, b - a)
            if part[a] != own:
                own, found = part[a], []
                scorer.meet(_pairs_of(found))
            if pairs[a]:
                found.append(piece.select(["h", "s", "i"]))
            else:
                if found:
                    scorer.meet(_pairs_of(found))
                    found = []
                yield piece


def _pairs_of(found: list[pa.RecordBatch]) -> dict:
    flat = [[b.column(c).flatten().to_numpy(zero_copy_only=False) for b in found] for c in ("h", "s", "i")]
    sizes = [np.diff(b.column("s").offsets.to_numpy()) for b in found]
    h, s, i = (np.concatenate(x) if x else np.zeros(0) for x in flat)
    return {"h": np.repeat(h.astype(np.int64), np.concatenate(sizes) if sizes else 0), "s": s.astype(np.int64), "identity": i.astype(float)}


def _numbered(values: pa.Array | pa.ChunkedArray, among: list) -> np.ndarray:
    at = {v: i for i, v in enumerate(among)}
    return np.array([at[v] for v in values.to_pylist()], np.int64)


def small_side(queries: DataFrame, index: Index, condition: Column | None, like: bool) -> tuple[pa.Table, bool] | None:
    """Tokens of a side with few rows and tokens, and whether it is the documents; of both such, of the documents or, to compare texts, of that with fewer rows."""
    from .search import query_tokens

    counts = [(df.limit(SMALL_ROWS + 1).count(), of_queries) for of_queries, df in ((True, index.texts), (False, queries))]
    for n, of_queries in sorted(counts, key=lambda c: c[0] if like else 0):
        if n > SMALL_ROWS:
            continue
        if of_queries:
            postings = index.postings if condition is None else index.postings.join(index.texts.filter(condition).select("ID"), "ID", "left_semi")
            side = postings.select(F.col("ID").alias("e"), "token", "tf", "w")
        else:
            side = query_tokens(queries, index.options.min_len).select(F.col("query_id").alias("e"), F.col("q").alias("token"), F.col("qpos").alias("pos"), "m")
        found = side.withColumn("h", F.xxhash64("token")).limit(SMALL_TOKENS + 1).toArrow()
        if found.num_rows <= SMALL_TOKENS:
            return found, of_queries
    return None


def small_search(queries: DataFrame, index: Index, scoring: str, fuzzy: bool, condition: Column | None, threshold: float | None, strategy: str, allowance) -> DataFrame | None:
    """query_id, ID, score, or None if neither queries nor documents are few."""
    from .search import token_pairs

    like = scoring != "w"
    found = small_side(queries, index, condition, like)
    if found is None:
        return None
    side, of_queries = found
    ready(queries.sparkSession)
    tokens = T.index_tokens(F.coalesce(F.col("query"), F.lit("")), index.options.min_len)
    kept = None if condition is None else index.texts.filter(condition).select("ID")
    # small tokens and small rows by number, tokens in the order of their characters
    words = sorted(set(side["token"].to_pylist()), key=lambda t: t.encode())
    table = {"s": _numbered(side["token"], words)}
    if of_queries:
        tops = index.max_scores.toArrow()
        ids = tops["ID"].to_pylist()
        norm = tops["max_score"].to_numpy().astype(float)
        table |= {"tf": side["tf"].to_numpy().astype(np.int64), "w": side["w"].to_numpy().astype(float)}
    else:
        m = dict(zip(side["e"].to_pylist(), side["m"].to_pylist(), strict=True))
        ids, norm = list(m), np.array(list(m.values()), float)
        table["pos"] = side["pos"].to_numpy().astype(np.int64)
    table["e"] = _numbered(side["e"], ids)
    spark, near_tokens, parted = queries.sparkSession, None, False
    texts = None
    if like:
        source = index.texts.select(F.col("ID").alias("e"), "text") if of_queries else queries.select(F.col("query_id").alias("e"), F.coalesce("query", F.lit("")).alias("text"))
        found = source.select("e", T.simplify(F.col("text")).alias("text")).toArrow()
        by_id = dict(zip(found["e"].to_pylist(), found["text"].to_pylist(), strict=True))
        texts = [by_id[i] for i in ids]
    postings, long = index.postings, None
    if like and not of_queries:
        long = index.texts if condition is None else index.texts.filter(condition)
        long = long.select("ID", T.simplify(F.col("text")).alias("text"))
        if threshold is not None and threshold > 0:
            # texts too short or too long for it are dropped before any token of theirs is looked at
            n = F.length("text")
            long = long.filter((n * threshold <= max(map(len, texts), default=0) + 1e-6) & (n >= threshold * min(map(len, texts), default=0) - 1e-6))
            long = written(long, "texts")
            postings = postings.join(long.select("ID"), "ID", "left_semi")
    # as many tasks as cores can share: rows are small in bytes, and would be put together in a few tasks
    tasks = max(spark.sparkContext.defaultParallelism * 4, 32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = queries.select("query_id", "query").repartition(tasks, "query_id").select("query_id", tokens.alias("t"), *([T.simplify(F.coalesce("query", F.lit(""))).alias("text")] if like else []))
    if fuzzy:
        small = spark.createDataFrame([(w,) for w in words], "token string")
        if of_queries:
            rows = written(rows.withColumn("part", F.spark_partition_id()), "query_tokens")  # texts become tokens once
            large = written(rows.select(F.explode("t").alias("q")).distinct(), "vocabulary").repartition(tasks)
            pairs = token_pairs(large, small, strategy, allowance).select(F.col("q").alias("big"), F.col("token").alias("little"), "identity")
        else:
            large = written(postings.select("token").distinct(), "vocabulary").repartition(tasks)
            pairs = token_pairs(small.withColumnRenamed("token", "q"), large, strategy, allowance).select(F.col("token").alias("big"), F.col("q").alias("little"), "identity")
        pairs = written(pairs, "pairs")
        parted, near = pairs.count() > NEAR_PAIRS, None
        near_tokens = pairs.select(F.col("big").alias("token")).distinct()
        if not parted:
            got = pairs.withColumn("h", F.xxhash64("big")).orderBy("big").select("h", "little", "identity").toArrow()
            near = {"h": got["h"].to_numpy(), "s": _numbered(got["little"], words), "identity": got["identity"].to_numpy().astype(float)}
    else:
        of = dict(zip(side["token"].to_pylist(), side["h"].to_pylist(), strict=True))
        near = {"h": np.array([of[w] for w in words], np.int64), "s": np.arange(len(words)), "identity": np.ones(len(words))}
        near_tokens = spark.createDataFrame([(w,) for w in words], "token string")
    near_tokens = near_tokens if parted else F.broadcast(near_tokens)
    if of_queries:
        small_name, name = "ID", "query_id"
        rows = rows.select(*(["part"] if parted else []), "query_id", F.transform("t", lambda t: F.xxhash64(t)).alias("h"), *(["text"] if like else []))
    else:
        small_name, name = "query_id", "ID"
        hit = F.struct(F.xxhash64("token").alias("h"), F.col("tf").cast("long").alias("tf"), F.col("w").cast("double").alias("w"))
        if index.by_id:  # hits and highest scores in one pass over the postings
            flagged = postings.join(near_tokens.withColumn("_near", F.lit(True)), "token", "left")
            found = flagged.groupBy("ID").agg(F.sum(F.col("tf") * F.col("w")).alias("max_score"), F.collect_list(F.when(F.col("_near"), hit)).alias("p")).filter(F.size("p") > 0)
            tops = kept
        else:
            found = postings.join(near_tokens, "token", "left_semi").select("ID", hit.alias("p")).groupBy("ID").agg(F.collect_list("p").alias("p"))
            tops = index.max_scores if kept is None else index.max_scores.join(kept, "ID", "left_semi")
        if like:
            tops = long if index.by_id else index.max_scores.join(long, "ID")
        rows = found if tops is None else found.join(tops, "ID")
        rows = rows.select("ID", F.col("p.h").alias("h"), F.col("p.tf").alias("tf"), F.col("p.w").alias("w"), "max_score", *(["text"] if like else []))
        if like:  # not by the ID alone, by which the rows lie already
            rows = rows.repartition(tasks, F.xxhash64("ID"))
        if parted:
            rows = written(rows.withColumn("part", F.pmod(F.xxhash64("ID"), F.lit(tasks)).cast("int")), "rows")
    if parted:
        rows = in_parts(rows, pairs, words, tasks)
    small_ids = pa.array(ids, side.schema.field("e").type)
    scorer_of = (near, table, norm, not fuzzy, scoring, texts, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*scorer_of)
        for batch in met(scorer, batches) if parted else batches:
            h = batch.column("h")
            counts = np.diff(h.offsets.to_numpy())
            row = np.repeat(np.arange(len(counts)), counts)
            flat = h.flatten().to_numpy(zero_copy_only=False)
            if of_queries:
                scored = scorer.queries(row, np.arange(len(row)), flat, counts.astype(float))
            else:
                scored = scorer.documents(row, flat, batch.column("tf").flatten().to_numpy(), batch.column("w").flatten().to_numpy(), batch.column("max_score").to_numpy())
            lines = batch.column("text").to_pylist() if like else None
            for r, e, score in scored:
                if like:
                    r, e, score = scorer.like(lines, r, e, score)
                for i in range(0, len(r), 1 << 18):
                    one = slice(i, i + (1 << 18))
                    yield pa.RecordBatch.from_arrays([batch.column(name).take(pa.array(r[one])), small_ids.take(pa.array(e[one])), pa.array(score[one])], names=[name, small_name, "score"])

    kinds = {"query_id": dict(queries.dtypes)["query_id"], "ID": dict(index.postings.dtypes)["ID"]}
    out = rows.mapInArrow(run, f"`{name}` {kinds[name]}, `{small_name}` {kinds[small_name]}, score double")
    return out.select("query_id", "ID", "score")
