"""Tables in the folder that driver and executors share, and the package on the workers' path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ready(spark: SparkSession | None = None) -> None:
    """Let Python workers import this package from where the driver has it."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None:
        env = spark.sparkContext.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if _REPO not in paths:
            env["PYTHONPATH"] = os.pathsep.join([_REPO, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where the session names none, one is made and removed when the process ends, but only if
    master and executors are one machine.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + (own := tempfile.mkdtemp(prefix="labelloom-tables-"))
        atexit.register(shutil.rmtree, own, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` from a Parquet table in the shared folder: computed once, of known size, safe from lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reliable(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with gapless numbers from 0 in ``order``: a range sort, places inside each partition, and partition offsets."""
    rows = reliable(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # a row for each partition
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    out = rows.withColumn("_p", part).join(offsets, "_p")
    return out.withColumn(name, F.col("_o") + F.col("_at") - F.shiftleft("_p", 33)).drop("_p", "_o", "_at")
