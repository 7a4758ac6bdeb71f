"""Benchmark decontamination with a generalised suffix automaton.

The test items are normalised to word sequences and put into one suffix automaton
over words (separate sequences, one automaton).  Training texts stream through
it: at each word the automaton holds the longest match that ends there.  Where it
reaches the window length (or a whole shorter item), the matched span is marked;
spans give the hit words, and the states' item sets tell which items occur.

The automaton is broadcast.  Its size is bounded by ``MAX_WORDS`` item words.  If there are
more, hashes of all windows of the items are first joined with those of the
documents, and only items with a window that may occur go into automata; what they are
is settled by the automaton alone, so the result is the same.  If these are still
more than ``MAX_WORDS`` words, they make several automata, each read by a pass of its own over
the same rows in the same stage chain, so no broadcast grows past the bound; the time
then grows with the words of *occurring* items.

Defined results: null texts have no words and no hits; items without words have
no window; equal items are all counted, null identifiers as the empty one; an empty table of items leaves every
document clean; rows sharing a ``doc_id``, or without one, are answered row by row; very long texts
are read whole; an empty table gives an empty result; other columns, whatever they are
called, are ignored by ``contamination`` and kept by ``remove``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare

#: Item words in one automaton at most (an item longer than that gets its own).
MAX_WORDS = 200_000

#: ASCII letters to lower case, digits kept, all other ASCII a space; bytes of other characters stay.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, asked for windows of ``window`` words.

    ``items``: (name, words).  ``gram[s]``: names of items with the window that
    state ``s`` stands for; ``short[s]``: nearest state up the suffix links,
    itself included, at which a whole item shorter than the window ends.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, set[str]] = {}
        shorts: dict[int, list[tuple[int, str]]] = {}
        for name, sequence in items:
            last, states = 0, []
            tokens = [self.ids.setdefault(w, len(self.ids)) for w in sequence]
            for t in tokens:
                last = self._extend(last, t)
                states.append(last)
            del states
        for name, sequence in items:
            tokens = [self.ids[w] for w in sequence]
            if 0 < len(tokens) < window:
                s = 0
                for t in tokens:
                    s = self.next[s][t]
                shorts.setdefault(s, []).append((len(tokens), name))
            else:
                s, n = 0, 0
                for t in tokens:
                    s, n = self.step(s, n, t)
                    if n >= window:
                        ends.setdefault(self.covering(s), set()).add(name)
        self.gram = ends
        self.shorts = shorts
        self.short = [-1] * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.short[s] = s if s in shorts else self.short[self.link[s]] if s else -1
        self.least = min([window if ends else 1 << 30, *(n for x in shorts.values() for n, _ in x)])

    def _extend(self, last: int, t: int) -> int:
        if t in self.next[last]:
            q = self.next[last][t]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, t, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][t]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, t, q)
        return new

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, t: int, q: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[c], self.link[q] = self.link[q], c
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = c
            p = self.link[p]
        return c

    def step(self, s: int, n: int, t: int) -> tuple[int, int]:
        """State and matched length after one more word."""
        while s and t not in self.next[s]:
            s = self.link[s]
            n = self.length[s]
        if t in self.next[s]:
            return self.next[s][t], n + 1
        return 0, 0

    def covering(self, s: int) -> int:
        """The suffix of state ``s`` with exactly ``window`` words."""
        while self.length[self.link[s]] >= self.window:
            s = self.link[s]
        return s

    def scan(self, sequence: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (start, end) of occurring windows, in order of their ends, and the names of their items."""
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in sequence), np.int64, len(sequence))
        known = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).astype(np.int8), [0]])))
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        for start, end in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if end - start < self.least:  # no window fits between two unknown words
                continue
            s = n = 0
            for i, t in enumerate(ids[start:end].tolist(), start + 1):
                s, n = self.step(s, n, t)
                if n >= self.window:
                    spans.append((i - self.window, i))
                    names |= self.gram.get(self.covering(s), set())
                v = self.short[s]
                while v > 0:
                    for size, name in self.shorts[v]:
                        if size <= n:
                            spans.append((i - size, i))
                            names.add(name)
                    v = self.short[self.link[v]]
        return spans, names


def _window_hashes(texts: DataFrame, lengths: tuple[int, ...], of_items: int = 0) -> DataFrame:
    """h: distinct hashes of each text's windows of ``lengths`` words; with ``of_items`` (the window), of an item's own windows, with its item_id and text."""
    columns = ["item_id", "text"] if of_items else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes = [], []
            for i, text in enumerate(batch.column("text")):
                w = [xxhash.xxh3_64_intdigest(x) for x in words(text.as_py())]
                own: set[int] = set()
                for n in (min(of_items, len(w)),) if of_items else lengths:
                    if n and len(w) >= n:
                        x = np.array(w, np.uint64)
                        h = np.full(len(w) - n + 1, n, np.uint64)
                        for k in range(n):
                            h = (h ^ x[k : len(w) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                            h ^= h >> np.uint64(29)
                        own.update(np.unique(h).view(np.int64).tolist())
                rows += [i] * len(own)
                hashes += own
            taken = batch.take(pa.array(rows, pa.int64())) if columns else None
            yield pa.RecordBatch.from_arrays([*([taken.column(c) for c in columns] if columns else []), pa.array(hashes, pa.int64())], [*columns, "h"])

    return texts.select(*columns or ["text"]).mapInArrow(run, ", ".join([*(f"{c} string" for c in columns), "h long"]))


def _occurring(items: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """Items (item_id, text) of which a window may occur in ``docs`` (by hashes, so some more)."""
    sizes = items.select(F.least(F.size(F.regexp_extract_all("text", F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)), F.lit(window)).alias("n")).filter("n > 0").distinct()
    lengths = tuple(sorted(r["n"] for r in sizes.collect()))  # `window` rows at most
    own = _window_hashes(items, (), of_items=window)
    known = own.select("h").distinct()
    found = _window_hashes(docs.select(F.col("text").cast("string").alias("text")), lengths).join(known, "h", "left_semi").distinct()
    return own.join(found, "h", "left_semi").select("item_id", "text").distinct()


def _automata(spark: SparkSession, items: DataFrame, docs: DataFrame, window: int) -> list:
    """Broadcast automata, each of at most ``MAX_WORDS`` item words."""
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))).alias("n")).first()["n"] or 0
    if total > MAX_WORDS:
        items = _occurring(items, docs, window)
    out, part, size = [], [], 0
    for row in items.toLocalIterator():
        sequence = words(row["text"])
        if part and size + len(sequence) > MAX_WORDS:
            out.append(spark.sparkContext.broadcast(SuffixAutomaton(part, window)))
            part, size = [], 0
        if sequence:
            part.append((row["item_id"], sequence))
            size += len(sequence)
    if part or not out:
        out.append(spark.sparkContext.broadcast(SuffixAutomaton(part, window)))
    return out


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = 10, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """The columns ``keep`` and n_words, spans (array of [start, end) word positions, merged), n_hit, items (sorted ids)."""
    prepare(spark)
    span_type, name_type = pa.list_(pa.list_(pa.int32())), pa.list_(pa.string())

    def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
        out: list[list[int]] = []
        for a, b in sorted(spans):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return out

    def passes(bc):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = bc.value
            for batch in batches:
                spans, names, sizes = [], [], []
                for text, old, have in zip(batch.column("_text"), batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
                    sequence = words(text.as_py())
                    found, hit = automaton.scan(sequence)
                    spans.append(merged([*map(tuple, old or []), *found]))
                    names.append(sorted({*(have or []), *hit}))
                    sizes.append(len(sequence))
                rest = {"spans": pa.array(spans, span_type), "items": pa.array(names, name_type), "n_words": pa.array(sizes, pa.int64())}
                yield pa.RecordBatch.from_arrays([rest.get(c, batch.column(c) if c in batch.schema.names else None) for c in batch.schema.names], batch.schema.names)

        return run

    kept = docs.select(*keep, F.col("text").cast("string").alias("_text"), F.lit(None).cast("array<array<int>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_words"))
    for bc in _automata(spark, items, docs, window):
        kept = kept.mapInArrow(passes(bc), kept.schema)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return kept.select(*keep, *["_text"] * with_text, "n_words", "spans", hit.alias("n_hit"), "items")


def remove(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = 10, max_share: float = 0.0) -> DataFrame:
    """``docs`` without what stands in ``items``.

    A document of which more than ``max_share`` of the words are hit goes; of any other the
    hit spans are cut out of the text.  With 0 every document with a hit goes.
    """
    rest = [c for c in docs.columns if c != "text"]
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), "text")
    found = contamination(spark, nested, items, window, keep=("_row",), with_text=True)
    kept = found.filter(F.col("n_hit") <= F.lit(max_share) * F.col("n_words"))
    if max_share > 0:
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [cut_spans(t.as_py(), s) for t, s in zip(batch.column("_text"), batch.column("spans").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], ["_row", "_text"])

        kept = kept.select("_row", "_text", "spans").mapInArrow(cut, kept.select("_row", "_text").schema)
    return kept.select(*[F.col("_text").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def cut_spans(text: str | None, spans: list[list[int]]) -> str | None:
    """``text`` without the words of ``spans`` (as of ``contamination``); what stands between the words of a span goes with it."""
    if text is None or not spans:
        return text
    data = text.encode("utf-8", "surrogatepass")
    folded = data.translate(_FOLD)
    places, i = [], 0
    for w in folded.split():
        i = folded.index(w, i)
        places.append((i, i + len(w)))
        i += len(w)
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``contamination``."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def sha256_of(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, k, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, k, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT occ.r, occ.i, occ.n, win.item, win.k FROM occ JOIN win ON occ.g = win.g AND occ.n = win.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN names USING (r)
"""
