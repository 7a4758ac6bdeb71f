"""Schemas of the data model and rules for cleaning a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType


def _strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


LABEL = _strings("ID", "text")
EVENT = _strings("ID", "location", "date", "collector", "text")
COLLECTOR = StructType([*_strings("ID", "name", "firstname").fields, StructField("metadata", MapType(StringType(), StringType()))])
MATCH = _strings("label_id", "event_id", "score")
OCR = "responses array<struct<fullTextAnnotation:struct<text:string>>>"


def with_position(df: DataFrame) -> DataFrame:
    """Adds ``pos``, an order-keeping number that needs no shuffle."""
    return df if "pos" in df.columns else df.withColumn("pos", F.monotonically_increasing_id())


def file_position(argument: int = 0) -> Column:
    """Position of a row of a file: place of the argument, path, place in the file.

    Spark reads files in an order of its own, large ones first, so its row numbers alone do not
    follow the arguments.
    """
    return F.struct(F.lit(argument).alias("argument"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def deduplicated(df: DataFrame) -> DataFrame:
    """One row for each ID: the last row's values at the first row's position.  Null texts become empty."""
    df = with_position(df)
    fields = [c for c in df.columns if c not in ("ID", "pos")]
    out = df.groupBy("ID").agg(F.max_by(F.struct(*fields), "pos").alias("_v"), F.min("pos").alias("pos"))
    out = out.select("ID", *[F.col(f"_v.{c}").alias(c) for c in fields], "pos")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in fields if dict(df.dtypes)[c] == "string"})


def check(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` if it has the schema's columns, else an error that names what is missing."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def subset(df: DataFrame, condition) -> DataFrame:
    """Rows for which the condition (a Column or a function of the DataFrame) holds."""
    return df.filter(condition(df) if callable(condition) else condition)


def subset_by_id(df: DataFrame, ids: DataFrame, column: str = "ID") -> DataFrame:
    """Rows whose ID is among ``ids``; duplicate ids do no harm."""
    return df.join(ids.select(column), column, "left_semi")


def get(df: DataFrame, identifier: str) -> DataFrame:
    """The row with the ID (pushed down to the scan)."""
    return df.filter(F.col("ID") == identifier)
