"""Shared helpers: reading tables, shared storage, splits, hashing."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Rows in one Arrow batch: whole texts can be long, so batches stay short.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep Arrow batches short."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_REPO, *paths])
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:  # read when a plan runs, so it stays
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and master and executors are one machine (tests) a
    temporary folder is made, and removed when the process ends.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + (own := tempfile.mkdtemp(prefix="labelloom-"))
        atexit.register(shutil.rmtree, own, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Space:
    """Tables of one run in the shared folder; they cut lineage and outlive executors."""

    #: All that were made in this process, in order.
    made: ClassVar[list[Space]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        Space.made.append(self)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._labelloom_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        self._delete(*[df._labelloom_path for df in frames])

    def clear(self) -> None:
        """Delete all tables of this run."""
        self._delete(self.root)

    def _delete(self, *paths: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def share(id_col: str, parts: int) -> Column:
    """``crc32`` of the id as text modulo ``parts``: the split that contracts name."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def held_out(id_col: str, parts: int, rest: int) -> Column:
    return F.coalesce(share(id_col, parts) == rest, F.lit(False))


def words_column(text: Column) -> Column:
    """Array of words of a text; empty for null and blank texts."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row.

    Inside a lambda Catalyst would evaluate an expression anew for each element;
    a bound lambda variable is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), use), 1)
