"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL-proximal.

Texts become streams of tokens (runs of letters, of digits, of signs).  Two kinds of
n-grams are hashed into ``2 ** BITS`` columns: of lower-cased words (1 and 2) and of
word shapes (1 to 3; a shape also says whether the word repeats its
predecessor).  Weights come from follow-the-regularised-leader updates on a bounded
sample of labelled rows; L1 keeps them sparse, and a score is one sparse dot
product through the logistic function.

The sample: the ``TRAIN_ROWS`` training labels with the smallest hash of the id.
Only their feature vectors reach the driver, and only the weights are broadcast.

Defined results: null and empty texts have the bias alone and get its score; ids
with several labels count once (the larger); no labels at all give 0.5; rows
sharing a ``doc_id``, or without one, are scored each, and of rows of one training id the one with the
smallest vector teaches; very long texts are read whole; an empty table gives an
empty result; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, prepare, share

BITS, TRAIN_ROWS, EPOCHS = 18, 6000, 3
#: FTRL-proximal: learning rate, its smoothing, L1, L2.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CACHE: dict[str, tuple[int, int]] = {}


def _codes(token: str) -> tuple[int, int]:
    """Hash of the lower-cased token and of its shape."""
    first = token[0]
    if first.isalpha():
        shape = "XX" if len(token) > 1 and token.isupper() else "X" if first.isupper() else "x" if token.islower() else "xX"
    elif first.isdigit():
        shape = "0"
    else:
        shape = token[:3]
    if len(_CACHE) > 200_000:
        _CACHE.clear()
    got = _CACHE[token] = (xxhash.xxh3_64_intdigest(token.lower()), xxhash.xxh3_64_intdigest(shape, seed=1))
    return got


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted columns and values of a text's hashed n-grams; column 0 is the bias."""
    tokens = _TOKEN.findall(text or "")
    n = len(tokens)
    if not n:
        return np.zeros(1, np.uint32), np.ones(1, np.float32)
    get = _CACHE.get
    pairs = np.array([get(t) or _codes(t) for t in tokens], np.uint64)
    word, shape = pairs[:, 0], pairs[:, 1].copy()
    shape[1:] += (word[1:] == word[:-1]).astype(np.uint64)
    columns, values = [np.zeros(1, np.int64)], [np.ones(1)]
    for stream, order, share_of in ((word, 2, 0.5), (shape, 3, 1.0)):
        gram = stream
        for k in range(1, order + 1):
            if k > 1:
                if n < k:
                    break
                gram = (gram[:-1] * _MIX) ^ (stream[k - 1 :] * np.uint64(2 * k + 1))
                gram = gram ^ (gram >> np.uint64(29))
            hashed = ((gram + np.uint64(k)) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)
            at, count = np.unique(hashed, return_counts=True)
            weight = np.sqrt(count / len(gram))
            columns.append(at)
            values.append(share_of * weight / np.sqrt((weight**2).sum()))
    at, back = np.unique(np.concatenate(columns), return_inverse=True)
    return at.astype(np.uint32), np.bincount(back, np.concatenate(values)).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> np.ndarray:
    """Weights after ``EPOCHS`` passes of FTRL-proximal over (columns, values, label)."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, (np.sign(zz) * L1 - zz) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(1 << BITS)).astype(np.float32)


def labelled(labels: DataFrame, name: str, parts: int = 4, rest: int = 2, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id and y of at most ``rows`` training labels: those with the smallest hash of the id."""
    known = labels.select("doc_id", F.col(name).cast("int").alias("y")).filter(F.col("y").isNotNull() & (share("doc_id", parts) != rest))
    return known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64(F.lit(name), "doc_id"), "doc_id").limit(rows)


def fit(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """Weights learned from the texts of ``sample`` (doc_id, y; bounded by its maker)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())], ["doc_id", "y", "at", "x"])

    found = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")
    vectors = found.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, at binary, x binary")
    # a row for each id of the sample, however often the table has it
    rows = vectors.groupBy("doc_id", "y").agg(F.min(F.struct("at", "x")).alias("v")).select("doc_id", "y", "v.*").toArrow()
    table = sorted(zip(*[rows.column(c).to_pylist() for c in ("doc_id", "at", "x", "y")], strict=True), key=lambda r: r[:3])
    return train([(np.frombuffer(a, np.uint32).astype(np.int64), np.frombuffer(x, np.float32).astype(np.float64), y) for _, a, x, y in table])


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labelled(labels, "quality")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            scores = []
            for t in batch.column("text"):
                at, x = features(t.as_py())
                scores.append(1 / (1 + np.exp(-float(w[at] @ x))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    out = docs.select(F.col("doc_id").cast("long"), held_out("doc_id", 4, 2).alias("held_out"), F.col("text").cast("string"))
    return out.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
