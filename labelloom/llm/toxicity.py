"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding.

Folding undoes disguise: compatibility forms, accents and invisible characters go,
look-alike letters of other scripts and digits or signs standing for letters
become those letters (1, l, ! and | all count as i).  The lexicon is learned from
labelled rows: words whose log-likelihood ratio with the label is beyond chance for
the number of words tested, weighted by their log odds, unless a stronger entry stands beside them in most of
their toxic rows.  Phrases of a lexicon word and a neighbour that occur in
clean rows only are exceptions; a match inside one counts nothing.  Matches are
whole words.  The score is a logistic function of the matched weight and of its
density in the text.

Bounds: ``TRAIN_ROWS`` labelled rows with the smallest hash of the id; their texts are
joined and written once.  Every word and phrase of theirs that passes the tests is taken,
so the lexicon is bounded by the sample; counts are aggregated before any reaches the
driver.

Defined results: null and empty texts match nothing and get the base score; ids with
several labels count once (the larger); rows sharing a ``doc_id``, or without one, are
scored each, and learned from each if labelled; very long texts are read whole; without
labels or lexicon all scores are the base score; an empty table gives an empty result; other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Space, held_out, prepare
from .quality_model import labelled

TRAIN_ROWS = 20_000
#: Share of chance finds among the entries at most, and least clean rows of an exception.
CHANCE, LEAST_CLEAN = 0.05, 3
#: Cuts tried for the log-likelihood ratio: multiples of 1 / STEPS below TOP.
STEPS, TOP = 4, 60
LEAST_WEIGHT = 1.5

# Look-alikes by the Latin letter they resemble.
_LOOK_ALIKE = {"a": "аα4@", "b": "ьβ8", "c": "сϲ", "d": "ԁ", "e": "еєε3", "g": "ԍ9", "h": "һн", "i": "іїιl1!|", "j": "ј", "k": "кκ", "m": "мᴍ", "n": "пη", "o": "оο0σ", "p": "рρ", "q": "ԛ", "s": "ѕ5$", "t": "тτ7", "u": "υ", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уү", "z": "ʐ"}
_FOLD = {ord(c): k for k, cs in _LOOK_ALIKE.items() for c in cs if c not in "@$!|"}
_SIGNS = {c: k for k, cs in _LOOK_ALIKE.items() for c in cs if c in "@$!|"}
_SIGN = re.compile(r"[@$!|](?=[^\W_])")
_UNSEEN = re.compile("[̀-ͯ­​-‏⁠﻿]+")
_RUN = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case without accents, invisible characters and look-alikes."""
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text))
    text = text.lower()
    if not _SIGNS.keys().isdisjoint(text):
        text = _SIGN.sub(lambda m: _SIGNS[m[0]], text)
    return text.translate(_FOLD)


class Lexicon:
    """Weights of words and exception phrases, all folded, in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: set[str] = frozenset()):
        self.weights, self.exceptions = weights, set(exceptions)
        self._automaton = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "_automaton": None}

    def matches(self, folded: str) -> list[tuple[int, int, str]]:
        """(start, end, word) of whole-word matches outside exception phrases."""
        if not self.weights:
            return []
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for w in {*self.weights, *self.exceptions}:
                self._automaton.add_word(w, w)
            self._automaton.make_automaton()
        found, covered = [], []
        for last, w in self._automaton.iter(folded):
            a, b = last + 1 - len(w), last + 1
            if (a and folded[a - 1].isalnum()) or (b < len(folded) and folded[b].isalnum()):
                continue
            if w in self.exceptions:
                covered.append((a, b))
            if w in self.weights:
                found.append((a, b, w))
        if not covered:
            return found
        covered.sort()
        starts, furthest = [a for a, _ in covered], list(accumulate((b for _, b in covered), max))
        # inside a phrase: one that starts no later reaches as far
        return [m for m in found if not (i := bisect_right(starts, m[0])) or furthest[i - 1] < m[1]]

    def measure(self, text: str | None) -> tuple[float, float]:
        """Matched weight, and that weight per hundred words, on log scales."""
        folded = fold(text or "")
        total = sum(self.weights[w] for _, _, w in self.matches(folded))
        if not total:
            return 0.0, 0.0
        return float(np.log1p(total)), float(np.log1p(100 * total / max(1, len(folded.split()))))


def _counted(rows: DataFrame, items) -> DataFrame:
    """item, toxic and clean rows that have it; ``items(folded text)`` gives a row's items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ys = [], []
            for t, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                own = items(fold(t.as_py() or ""))
                names += own
                ys += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ys, pa.int32())], ["item", "y"])

    return rows.select("text", "y").mapInArrow(run, "item string, y int").groupBy("item").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))


def _phrases(lexicon: Lexicon, folded: str) -> set[str]:
    """Each match with the whole word that stands one space before or after it."""
    found = lexicon.matches(folded)
    if not found:
        return set()
    runs = [m.span() for m in _RUN.finditer(folded)]
    starts, out = [a for a, _ in runs], set()
    for a, b, _ in found:
        i, j = bisect_left(starts, a) - 1, bisect_left(starts, b)
        if i >= 0 and runs[i][1] == a - 1 and folded[a - 1] == " ":
            out.add(folded[runs[i][0] : b])
        if j < len(runs) and starts[j] == b + 1 and folded[b] == " ":
            out.add(folded[a : runs[j][1]])
    return out


def _strongest(ratios: dict[str, float], folded: str) -> set[str]:
    """Entries of a text whose ratio is at least half of the largest in it."""
    own = ratios.keys() & set(_RUN.findall(folded))
    top = max((ratios[w] for w in own), default=0)
    return {w for w in own if ratios[w] >= 0.5 * top}


def least_ratio(words: DataFrame) -> float | None:
    """Smallest cut of ``ratio`` with at most ``CHANCE`` of the words above it there by chance; None if no cut will do.

    ``words`` (ratio, weight, top), ``top`` being the ratio if all rows of the word were
    toxic: words too rare to reach a cut are not tested by it.
    """

    def step(c: str):
        return F.floor(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(TOP))) * STEPS)

    kinds = words.groupBy(step("top").alias("top"), F.when(F.col("weight") > LEAST_WEIGHT, step("ratio")).alias("ratio")).count().collect()  # a row for each pair of steps at most
    for cut in range(1, STEPS * TOP + 1):
        tested = sum(r["count"] for r in kinds if r["top"] >= cut)
        taken = sum(r["count"] for r in kinds if r["ratio"] is not None and r["ratio"] >= cut)
        if taken and tested * math.erfc(math.sqrt(cut / STEPS / 2)) <= CHANCE * taken:
            return cut / STEPS
    return None


def learn(rows: DataFrame) -> Lexicon:
    """Lexicon of labelled rows (text, y)."""
    size = rows.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    p, q = float(size["p"] or 0), float(size["n"] - (size["p"] or 0))
    if not p or not q:
        return Lexicon({})
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    rate = (a + b) / (p + q)

    def term(k, n, r):
        return F.when(k > 0, k * F.log(k / (n * r))).otherwise(0.0) + F.when(n - k > 0, (n - k) * F.log((n - k) / (n * (1 - r)))).otherwise(0.0)

    weight = F.log((a + 0.5) / (p + 1)) - F.log((b + 0.5) / (q + 1))
    words = _counted(rows, lambda folded: set(_RUN.findall(folded))).filter(F.length("item") > 2)
    words = words.withColumn("ratio", 2 * (term(a, F.lit(p), rate) + term(b, F.lit(q), rate))).withColumn("weight", weight)
    most = F.least(a + b, F.lit(p))
    space = Space(rows.sparkSession, "words")
    words = space.save(words.withColumn("top", 2 * (term(most, F.lit(p), rate) + term(a + b - most, F.lit(q), rate))))
    cut = least_ratio(words)
    if cut is None:
        space.clear()
        return Lexicon({})
    best = words.filter((F.col("ratio") >= cut) & (F.col("weight") > LEAST_WEIGHT))
    found = best.select("item", "weight", "ratio", "toxic").collect()  # beyond chance in the sample
    ratios = {r["item"]: r["ratio"] for r in found}
    space.clear()
    # words that only keep company with stronger ones, as in copies of one text, explain nothing
    near = _counted(rows, lambda folded: _strongest(ratios, folded)).filter(F.col("toxic") > 0).select("item", "toxic").collect()  # some of `found`
    alone = {r["item"]: r["toxic"] for r in near}
    lexicon = Lexicon({r["item"]: r["weight"] for r in found if 2 * alone.get(r["item"], 0) >= r["toxic"]})
    if not lexicon.weights:
        return lexicon
    phrases = _counted(rows, lambda folded: _phrases(lexicon, folded)).filter((F.col("toxic") == 0) & (F.col("clean") >= LEAST_CLEAN))
    return Lexicon(lexicon.weights, {r["item"] for r in phrases.collect()})


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Coefficients of a small logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    prepare(spark)
    space = Space(spark, "toxicity")
    rows = space.save(docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(labelled(labels, "toxic", rows=TRAIN_ROWS)), "doc_id").select("text", "y"))
    shared = spark.sparkContext.broadcast(learn(rows))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in batches:
            got = [lexicon.measure(t.as_py()) for t in batch.column("text")]
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.array([a for a, _ in got], pa.float64()), pa.array([b for _, b in got], pa.float64())], [*rest, "total", "density"])

    sample = rows.mapInArrow(measured, "y int, total double, density double").groupBy("y", "total", "density").count().toArrow()
    y, a, b, n = (sample.column(c).to_numpy() for c in ("y", "total", "density", "count"))
    if len(y):
        order = np.lexsort((y, a, b))
        y, a, b, n = y[order], a[order], b[order], n[order]
        x = np.repeat(np.stack([np.ones(len(y)), a, b], axis=1), n, axis=0)
        w = _logistic(x, np.repeat(y, n).astype(float)).tolist()
    else:
        w = [0.0, 0.0, 0.0]
    space.clear()
    out = docs.select(F.col("doc_id").cast("long"), held_out("doc_id", 4, 2).alias("held_out"), F.col("text").cast("string")).mapInArrow(measured, "doc_id long, held_out boolean, total double, density double")
    score = 1 / (1 + F.exp(-(w[0] + w[1] * F.col("total") + w[2] * F.col("density"))))
    return out.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
