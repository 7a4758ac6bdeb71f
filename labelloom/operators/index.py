"""Inverted index: postings with weights, and each document's highest possible score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions import text as T
from labelloom.storage import ready, written

#: Rows of counts that a task puts out at a time.
STEP = 1 << 17
#: Rows of counts that a task sorts or gathers by ID at most, about, where weights are computed.
TASK_ROWS = 500_000


@dataclass(frozen=True)
class Options:
    """method 1: token counts; method 2: TF-IDF, L2-normalised."""

    method: int = 1
    min_len: int = 1
    keys: tuple[str, ...] | None = None
    masks: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.method not in (1, 2):
            raise ValueError(f"unknown index method: {self.method}")


@dataclass(frozen=True)
class Index:
    """postings (ID, token, tf, w), max_scores (ID, max_score) and texts (ID, text).

    ``by_id``: the postings are still to be computed and come dealt by ID, so what is gathered by ID needs no shuffle.
    """

    postings: DataFrame
    max_scores: DataFrame
    texts: DataFrame
    options: Options
    by_id: bool = False

    def write(self, path: str) -> None:
        """Parquet, the postings sorted by token so that a lookup skips row groups."""
        self.postings.sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/postings")
        spark = self.texts.sparkSession
        tops = _max_scores(spark.read.parquet(f"{path}/postings")) if self.by_id else self.max_scores  # postings are computed once
        tops.write.mode("overwrite").parquet(f"{path}/max_scores")
        self.texts.write.mode("overwrite").parquet(f"{path}/texts")
        o = self.options
        row = (o.method, o.min_len, list(o.keys) if o.keys else None, dict(o.masks))
        spark.createDataFrame([row], "method int, min_len int, keys array<string>, masks map<string,string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/options")

    @staticmethod
    def read(spark, path: str, options: Options | None = None) -> Index:
        """The index as it was written, its options included."""
        if options is None:
            r = spark.read.parquet(f"{path}/options").first()
            options = Options(r["method"], r["min_len"], tuple(r["keys"]) if r["keys"] else None, dict(r["masks"] or {}))
        return Index(*[spark.read.parquet(f"{path}/{t}") for t in ("postings", "max_scores", "texts")], options)

    def saved(self) -> Index:
        """The index from tables in the shared folder, so that searches compute nothing of it again."""
        postings = self.postings if self.options.method == 1 else written(self.postings, "postings")  # counts are a table already
        return Index(postings, written(_max_scores(postings), "max_scores"), self.texts, self.options)


def _max_scores(postings: DataFrame) -> DataFrame:
    return postings.groupBy("ID").agg(F.sum(F.col("tf") * F.col("w")).alias("max_score"))


def _tokens(df: DataFrame, options: Options) -> Column:
    tokens = [T.index_tokens(T.mask(F.coalesce(F.col(k).cast("string"), F.lit("")), options.masks.get(k)), options.min_len) for k in _keys(df, options)]
    return F.concat(*tokens) if len(tokens) > 1 else tokens[0]


def _keys(df: DataFrame, options: Options) -> tuple[str, ...]:
    return options.keys or tuple(c for c in df.columns if c not in ("ID", "pos"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[pa.Array]]]:
    """ID and tokens of each run of rows with the same ID, over the ends of batches too."""
    own = held = None
    for batch in batches:
        ids, tokens, begin = batch.column("ID"), batch.column("t"), 0
        keys = ids.to_pylist()
        for i, key in enumerate(keys, 1):
            if i == len(keys) or keys[i] != key:
                part = tokens.slice(begin, i - begin).flatten()
                if held is not None and own == key:
                    held[1].append(part)
                else:
                    if held is not None:
                        yield held
                    own, held = key, (ids.slice(begin, 1), [part])
                begin = i
    if held is not None:
        yield held


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ID, token, tf of rows (ID, t) in the order of ID: a task holds the counts of one ID, and not a table of all its tokens."""
    ids, sizes, found, rows = [], [], [], 0

    def out() -> pa.RecordBatch:
        at = pa.array(np.repeat(np.arange(len(ids)), sizes))
        columns = [pa.concat_arrays(ids).take(at)] + [pa.concat_arrays([f.field(k) for f in found]) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, names=["ID", "token", "tf"])

    for own, tokens in _runs(batches):
        counts = pc.value_counts(pa.chunked_array(tokens))
        ids.append(own)
        sizes.append(len(counts))
        found.append(counts)
        rows += len(counts)
        if rows >= STEP:
            yield out()
            ids, sizes, found, rows = [], [], [], 0
    if rows:
        yield out()


def token_counts(df: DataFrame, options: Options) -> DataFrame:
    """ID, token, tf: one shuffle, of the texts by ID; they become tokens after it, in all tasks however few splits the input has, and are counted ID by ID."""
    ready(df.sparkSession)
    rows = df.select("ID", *dict.fromkeys(_keys(df, options))).repartition("ID").sortWithinPartitions("ID")
    tokens = rows.select("ID", _tokens(rows, options).alias("t"))
    return tokens.mapInArrow(counted, f"ID {dict(df.dtypes)['ID']}, token string, tf long")


def _parts(counts: DataFrame) -> int | None:
    """Tasks among which counts are dealt, so that the rows of one do not grow with the table; None if Spark's own number is enough."""
    least = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-counts.count() // TASK_ROWS)
    return wanted if wanted > least else None


def make_index(df: DataFrame, options: Options = Options()) -> Index:  # noqa: B008
    """Texts become tokens once: the counts are a table in the shared folder, from which all else is computed."""
    counts = written(token_counts(df, options), "counts")
    if options.method == 1:
        postings = counts.withColumn("w", F.col("tf").cast("double"))
    else:
        # written, so that its size is known and Spark broadcasts it where it is small
        df_counts = written(counts.groupBy("token").agg(F.count("*").alias("df")), "document_counts")
        n = df.select(F.count_distinct("ID").alias("n")).first()["n"]
        # frequencies are hashed, not sorted with the counts; weights are computed where the rows lie by ID, so that whole numbers are shuffled
        parts = _parts(counts)
        dealt = (lambda rows, key: rows.repartition(parts, key)) if parts else lambda rows, key: rows
        rows = dealt(counts, "token").join(dealt(df_counts, "token").hint("shuffle_hash"), "token").select("ID", "token", "tf", "df")
        rows = rows.repartition(parts, "ID") if parts else rows.repartition("ID")
        raw = rows.withColumn("raw", F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
        norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("ID")))
        postings = raw.select("ID", "token", "tf", (F.col("raw") / norm).alias("w"))
    text = F.col("text").cast("string") if "text" in df.columns else F.lit("")
    return Index(postings, _max_scores(postings), df.select("ID", F.coalesce(text, F.lit("")).alias("text")), options, options.method == 2)
