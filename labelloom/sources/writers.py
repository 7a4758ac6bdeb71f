"""Writers: JSON, TSV and Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.storage import numbered

#: Files that a task writes into one folder: their names number them with three digits.
TASK_FILES = 500


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, one file a partition; characters stay as they are."""
    df.drop("pos").write.mode("overwrite").json(path)


def write_files(df: DataFrame, order: str, path: str) -> None:
    """Each row's ``value`` as a text file of its own, all in one folder; the names are in the order of ``order``.

    All tasks share the work, and move their files themselves: to make a folder, or to move a file, takes longer than to write it.
    """
    rows = numbered(df, order, "_n")
    tasks = rows.count() // TASK_FILES + 1
    dealt = rows.repartitionById(tasks, F.floor(F.col("_n") / TASK_FILES).cast("int")).sortWithinPartitions("_n")
    dealt.select("value").write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


def json_array(df: DataFrame):
    """Pieces of one JSON array in order, for a file or standard output."""
    rows = df.orderBy("pos").drop("pos") if "pos" in df.columns else df
    yield "["
    for i, r in enumerate(rows.toJSON().toLocalIterator()):
        yield ("," if i else "") + "\n  " + r
    yield "\n]\n"


def escaped(c: Column) -> Column:
    """Tabs, line ends and backslashes written as escapes."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))


def _cells(df: DataFrame) -> list[Column]:
    """Columns as TSV cells; nulls are empty, doubles have three decimals."""
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        if kinds[c] in ("double", "float"):
            return F.coalesce(F.format_string("%.3f", F.col(f"`{c}`").cast("double")), F.lit(""))
        return escaped(F.coalesce((F.to_json(f"`{c}`") if kinds[c].startswith(("array", "map", "struct")) else F.col(f"`{c}`").cast("string")), F.lit("")))

    return [cell(c).alias(c) for c in df.columns]


def tsv_lines(df: DataFrame) -> DataFrame:
    """``value``: rows as TSV."""
    return df.select(F.concat_ws("\t", *_cells(df)).alias("value"))


def write_tsv(df: DataFrame, path: str) -> None:
    """A folder of TSV files, each with the header."""
    df = df.drop("pos")
    plain = {"sep": "\t", "quote": "", "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.select(*_cells(df)).write.mode("overwrite").csv(path, header=True, **plain)


def tsv_table(df: DataFrame):
    """Header and lines, for a file or standard output."""
    df = df.drop("pos")
    yield "\t".join(df.columns)
    for r in tsv_lines(df).toLocalIterator():
        yield r["value"]


def write_dates(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)
