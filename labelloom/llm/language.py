"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters.  A word's score for a language is the sum of learned
weights of its prefixes and suffixes (1 to 4 characters), its inner trigrams and its
place in a lexicon of words typical of one language; learned transitions link
neighbouring words, so single foreign or ambiguous words follow their
surroundings while longer passages may switch.  Forward-backward gives each word's
marginals; a document's language has the largest sum of marginals, weighted by
word length.

Everything is vectorised over the words of a batch: one chain holds all its
documents, with breaks between them, and is cut into chunks whose transfer
products are combined (forward-backward as a prefix scan).

Training: ``TRAIN_DOCS`` documents per language with the smallest hash of the id, of which
the driver gets the whole texts, one for each id.
Their passages are cut and shuffled into code-switched sequences, and the
conditional likelihood is climbed by AdaGrad.

Defined results: null texts and texts without a letter give ``und`` with score 0;
without any training rows all do; null languages teach nothing; rows sharing a ``doc_id``,
or without one, are answered each, and of rows of one training id the one with the smallest text
teaches; very long texts are read whole; an empty table gives an empty result; other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, prepare, share

BITS, TRAIN_DOCS, EPOCHS, CHUNK = 16, 120, 24, 256
#: Training ids that may be broadcast.
SMALL = 100_000
#: Words of a training passage, and of the lexicon: least count and least share of one language.
PASSAGE, LEXICON_COUNT, LEXICON_SHARE = 40, 5, 0.95
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTER = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])
    return _LETTER


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    return ((x * np.uint64(2) + np.uint64(1)) * _MIX * np.uint64(2 * salt + 3) >> np.uint64(64 - BITS)).astype(np.int64)


class Words:
    """Words of texts: document and length of each, hash of each, and hashed affixes and trigrams."""

    def __init__(self, texts: list[str | None]):
        lowered = [(t or "").lower() for t in texts]
        joined = "\n".join(lowered)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[code] if len(code) else np.zeros(0, bool)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], letter.view(np.int8), [0]])))
        self.start, self.end = edge[::2], edge[1::2]
        self.size = self.end - self.start
        at = np.cumsum([0, *(len(t) + 1 for t in lowered)])
        self.doc = np.searchsorted(at, self.start, side="right") - 1
        c = np.concatenate([code, np.zeros(4, np.uint32)]).astype(np.uint64)
        n = len(self.start)
        if not n:
            self.word, self.affix, self.grams, self.gram_at = np.zeros(0, np.uint64), np.zeros((0, 8), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        affix = np.empty((n, 8), np.int64)
        p, s = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for k in range(4):  # shorter words repeat their longest affix
            ok = self.size > k
            p = np.where(ok, p * np.uint64(0x100001B3) + c[self.start + k], p)
            s = np.where(ok, s * np.uint64(0x100001B3) + c[np.maximum(self.end - 1 - k, 0)], s)
            affix[:, k], affix[:, 4 + k] = _hash(p, k), _hash(s, 4 + k)
        self.affix = affix
        # trigrams that start at each letter, to the end of the word and one place beyond
        inside = np.flatnonzero(letter)
        padded = np.where(np.concatenate([letter, np.zeros(4, bool)]), c, 0)
        g = (padded[inside] * np.uint64(0x1003F) + padded[inside + 1]) * np.uint64(0x1003F) + np.where(padded[inside + 1] > 0, padded[inside + 2], 0)
        self.grams = _hash(g, 8)
        self.gram_at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        place = np.arange(len(inside)) - np.repeat(self.gram_at, self.size)
        mixed = (c[inside] + np.uint64(1)) * (place.astype(np.uint64) * _MIX | np.uint64(1))
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX
        self.word = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), self.gram_at)


class Model:
    """Languages, weights of hashed features, lexicon and transitions."""

    def __init__(self, langs: list[str]):
        k = len(langs)
        self.langs = langs
        self.w = np.zeros((1 << BITS, k), np.float32)
        self.lex = np.zeros((k + 1, k), np.float32)  # the last row: words in no lexicon
        self.keys, self.of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.trans, self.first = np.zeros((k, k)), np.zeros(k)

    def lexicon(self, words: Words) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(words.word), len(self.langs))
        at = np.minimum(np.searchsorted(self.keys, words.word), len(self.keys) - 1)
        return np.where(self.keys[at] == words.word, self.of[at], len(self.langs))

    def emissions(self, words: Words) -> np.ndarray:
        out = self.lex[self.lexicon(words)].astype(np.float64)
        for k in range(8):
            out += self.w[words.affix[:, k]]
        for j in range(len(self.langs)):
            out[:, j] += np.add.reduceat(self.w[:, j][words.grams], words.gram_at) if len(words.grams) else 0.0
        return out

    def marginals(self, emissions: np.ndarray, breaks: np.ndarray, pairs: bool = False):
        """Posterior of each word's language (and summed pair and first posteriors); ``breaks`` marks first words."""
        n, k = emissions.shape
        t, f = np.exp(self.trans - self.trans.max()), np.exp(self.first - self.first.max())
        chunks = max(1, -(-n // CHUNK))
        e = np.ones((chunks * CHUNK, k))
        e[:n] = np.exp(np.maximum(emissions - emissions.max(axis=1, keepdims=True), -60))
        cut = np.ones(chunks * CHUNK, bool)
        cut[:n] = breaks
        cut[0] = True
        e, cut = e.reshape(chunks, CHUNK, k), cut.reshape(chunks, CHUNK)
        fresh = f / f.sum()

        def forward(x, i):  # x: (chunks, ..., k) rows of weights over states before word i
            y = x @ t
            c = cut[:, i]
            if c.any():
                y[c] = x[c].sum(axis=-1, keepdims=True) * fresh
            y *= e[:, i].reshape(chunks, *[1] * (y.ndim - 2), k)
            return y / y.sum(axis=-1, keepdims=True).max(axis=-2, keepdims=True) if y.ndim == 3 else y / y.sum(axis=-1, keepdims=True)

        prod = np.broadcast_to(np.eye(k), (chunks, k, k)).copy()
        for i in range(CHUNK):
            prod = forward(prod, i)
        alpha0, beta1 = np.empty((chunks, k)), np.empty((chunks, k))
        a = fresh
        for c in range(chunks):
            alpha0[c] = a
            a = a @ prod[c]
            a = a / a.sum()
        b = np.ones(k)
        for c in range(chunks - 1, -1, -1):
            beta1[c] = b
            b = prod[c] @ b
            b = b / b.sum()
        alpha = np.empty((chunks, CHUNK, k))
        x = alpha0
        for i in range(CHUNK):
            x = alpha[:, i] = forward(x, i)
        gamma = np.empty((chunks, CHUNK, k))
        b = beta1
        joint = np.zeros((k, k)) if pairs else None
        for i in range(CHUNK - 1, -1, -1):
            g = alpha[:, i] * b
            gamma[:, i] = g / g.sum(axis=1, keepdims=True)
            eb = e[:, i] * b
            if pairs:
                before = alpha[:, i - 1] if i else alpha0
                xi = before[:, :, None] * t * eb[:, None, :]
                xi /= xi.sum(axis=(1, 2), keepdims=True)
                at = np.arange(chunks) * CHUNK + i
                joint += xi[~cut[:, i] & (at < n)].sum(axis=0)
            b = np.where(cut[:, i, None], (eb @ fresh)[:, None], eb @ t.T)
            b = b / b.sum(axis=1, keepdims=True)
        gamma = gamma.reshape(-1, k)[:n]
        return (gamma, joint) if pairs else gamma


def train(texts: list[str], labels: list[str], seed: int = 11) -> Model:
    """Model of texts with one language each."""
    model = Model(langs := sorted(set(labels)))
    k = len(langs)
    if k < 1:
        return model
    words = Words(texts)
    y = np.array([langs.index(x) for x in labels])[words.doc]
    keys, back = np.unique(words.word, return_inverse=True)
    table = np.zeros((len(keys), k))
    np.add.at(table, (back, y), 1)
    total, top = table.sum(axis=1), table.max(axis=1)
    typical = (total >= LEXICON_COUNT) & (top >= LEXICON_SHARE * total)
    model.keys, model.of = keys[typical], table[typical].argmax(axis=1)
    # code-switched sequences: passages of documents in random order
    rng = np.random.default_rng(seed)
    edges = np.unique(np.concatenate([np.arange(0, len(y), PASSAGE), np.flatnonzero(np.diff(words.doc)) + 1, [len(y)]]))
    passages = [np.arange(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    grams = np.concatenate([words.gram_at, [len(words.grams)]])
    lexicon = model.lexicon(words)
    seen, seen_t, seen_l, seen_f = np.full(model.w.shape, 1e-6, np.float32), np.full((k, k), 1e-6), np.full(model.lex.shape, 1e-6), np.full(k, 1e-6)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(passages))
        for part in np.array_split(order, max(1, min(8, len(passages) // 20))):
            rows = np.concatenate([passages[i] for i in part]) if len(part) else np.zeros(0, int)
            if not len(rows):
                continue
            own = Words.__new__(Words)
            own.affix, own.word, own.size = words.affix[rows], words.word[rows], words.size[rows]
            own.gram_at = np.concatenate([[0], np.cumsum(own.size)[:-1]])
            own.grams = words.grams[np.repeat(grams[rows] - own.gram_at, own.size) + np.arange(own.size.sum())]
            breaks = np.zeros(len(rows), bool)
            starts = np.cumsum([0, *(len(passages[i]) for i in part)])[:-1]
            breaks[starts[rng.random(len(starts)) < 0.5]] = True
            breaks[0] = True
            gamma, joint = model.marginals(model.emissions(own), breaks, pairs=True)
            want = np.eye(k)[y[rows]]
            diff = want - gamma
            n = len(rows)
            grad = np.empty_like(model.w)
            at = np.concatenate([own.affix.T.ravel(), own.grams])
            who = np.concatenate([np.tile(np.arange(n), 8), np.repeat(np.arange(n), own.size)])
            for j in range(k):
                grad[:, j] = np.bincount(at, diff[who, j], 1 << BITS) / n - 1e-7 * model.w[:, j]
            inner = ~breaks[1:]
            moves = np.zeros((k, k))
            np.add.at(moves, (y[rows][:-1][inner], y[rows][1:][inner]), 1)
            grad_t, grad_f = (moves - joint) / n, diff[breaks].sum(axis=0) / n
            grad_l = np.zeros_like(model.lex)
            np.add.at(grad_l, lexicon[rows], diff)
            grad_l /= n
            for value, gradient, total_sq, rate in ((model.w, grad, seen, 0.2), (model.trans, grad_t, seen_t, 0.2), (model.lex, grad_l, seen_l, 0.2), (model.first, grad_f, seen_f, 0.1)):
                total_sq += gradient * gradient
                value += (rate * gradient / np.sqrt(total_sq)).astype(value.dtype)
    return model


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    words = Words(texts)
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not len(words.start) or not model.langs:
        return langs, scores
    gamma = model.marginals(model.emissions(words), np.concatenate([[True], words.doc[1:] != words.doc[:-1]]))
    k = len(model.langs)
    total = np.stack([np.bincount(words.doc, gamma[:, j] * words.size, len(texts)) for j in range(k)], axis=1)
    for d in np.flatnonzero(total.sum(axis=1) > 0):
        j = int(total[d].argmax())
        langs[d], scores[d] = model.langs[j], min(1.0, float(total[d, j] / total[d].sum()))
    return langs, scores


def fit(docs: DataFrame, per_language: int = TRAIN_DOCS) -> Model:
    """Model of at most ``per_language`` training documents of each language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (share("doc_id", 5) != 0)).select("doc_id", F.col("lang").cast("string"))
    # the smallest hashes of each language, without gathering a language in one task
    salted = known.withColumn("h", F.xxhash64(F.lit("lang"), "doc_id")).withColumn("salt", F.pmod("h", F.lit(64)))
    best = salted.select("lang", "doc_id", "h", "salt").distinct().withColumn("r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy("h", "doc_id"))).filter(F.col("r") <= per_language)
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("r") <= per_language).select("doc_id")
    if best.count() <= SMALL:  # a few hundred ids a language: texts need no shuffle then
        best = F.broadcast(best)
    found = docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string")).filter("text is not null and lang is not null").join(best, "doc_id", "left_semi")
    rows = found.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("doc_id", "r.*").toArrow()
    table = sorted(r for r in zip(*[rows.column(c).to_pylist() for c in ("doc_id", "text", "lang")], strict=True) if r[1] is not None and r[2] is not None)
    return train([t for _, t, _ in table], [x for _, _, x in table])


def identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, part, size = [], [], [], 0
            texts = batch.column("text")
            for i in range(batch.num_rows):
                part.append(texts[i].as_py())
                size += len(part[-1] or "")
                if size > 1_000_000 or i == batch.num_rows - 1:
                    a, b = predict(shared.value, part)
                    langs += a
                    scores += b
                    part, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long"), held_out("doc_id", 5, 0).alias("held_out"), F.col("text").cast("string"))
    return out.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
