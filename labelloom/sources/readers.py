"""Readers: JSON collections, delimited tables, OCR output, id and pattern lists."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelloom import schema as S
from labelloom.functions import text as T
from labelloom.operators.index import Index, Options
from labelloom.storage import numbered as number_rows
from labelloom.storage import written

#: Bytes for which a small file counts beside its own where files are dealt over tasks.
OPEN_COST = 1 << 16


def _paths(path) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def is_array(spark: SparkSession, path: str) -> bool:
    """Whether the first character that is not white space opens an array."""
    first = spark.read.text(path).filter(F.trim("value") != "").first()
    return first is not None and first["value"].lstrip("\ufeff \t").startswith("[")


def json_rows(spark: SparkSession, path, schema: StructType | None = None) -> DataFrame:
    """Objects of JSON lines (split over tasks) or of JSON arrays (a task for each file), in the order of the paths, with pos.

    What is no JSON object is an error, not a row of nulls.
    """
    parts = []
    for i, p in enumerate(_paths(path)):
        reader = spark.read.schema(schema) if schema is not None else spark.read
        df = reader.json(p, multiLine=is_array(spark, p), mode="FAILFAST")
        parts.append(df.withColumn("pos", S.file_position(i)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_json(spark: SparkSession, path, schema: StructType) -> DataFrame:
    """JSON lines or a JSON array; other keys are ignored, a later duplicate ID wins."""
    return S.deduplicated(json_rows(spark, path, schema))


def first_keys(spark: SparkSession, path: str) -> list[str]:
    """Keys of the first object, in order; none for an empty file."""
    text, decoder = "", json.JSONDecoder()
    for row in spark.read.text(path).toLocalIterator():
        text = (text + row["value"] + "\n").lstrip("\ufeff \t\r\n[")
        if text:
            try:
                return list(decoder.raw_decode(text)[0])
            except ValueError:
                continue
    return []


def read_labels(spark: SparkSession, path) -> DataFrame:
    return read_json(spark, path, S.LABEL)


def read_events(spark: SparkSession, path) -> DataFrame:
    return read_json(spark, path, S.EVENT)


def read_collectors(spark: SparkSession, path) -> DataFrame:
    return json_rows(spark, path, S.COLLECTOR)


def stream_labels(spark: SparkSession, path) -> DataFrame:
    """Labels as a stream of JSON-lines files."""
    return spark.readStream.schema(S.LABEL).json(path)


def ocr_pages_of(spark: SparkSession, path) -> DataFrame:
    """file (path), page (from 0), text of OCR responses; a file is one JSON object."""
    raw = spark.read.schema(S.OCR).json(path, multiLine=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode("responses").alias("page", "r")).select("file", "page", F.coalesce("r.fullTextAnnotation.text", F.lit("")).alias("text"))


def read_ocr(spark: SparkSession, path) -> DataFrame:
    """file (name), page (from 0), text of OCR responses."""
    return ocr_pages_of(spark, path).withColumn("file", F.element_at(F.split("file", "/"), -1))


def read_together(df: DataFrame) -> DataFrame:
    """A table of what is read from small files, many of them in a task: Spark would count 4 MB for each."""
    conf, name = df.sparkSession.conf, "spark.sql.files.openCostInBytes"
    before = conf.get(name)
    conf.set(name, OPEN_COST)
    try:
        return written(df, "pages")
    finally:
        conf.set(name, before)


def number_pages(pages: DataFrame, id_format, start: int = 1) -> DataFrame:
    """ID, text of pages, numbered in the order of files and pages; the files are read once."""
    pages = read_together(pages)
    return number_rows(pages.withColumn("_k", F.struct("file", "page")), "_k", "_i").select(T.id_formatter(id_format, F.col("_i") + start).alias("ID"), "text")


def ocr_labels(spark: SparkSession, path, id_format: str = "label:5", start: int = 1, ids: DataFrame | None = None) -> DataFrame:
    """Labels of OCR output: running numbers over files and pages in order, or IDs by file name (``ids``: file, ID)."""
    if ids is not None:
        return read_ocr(spark, path).join(ids, "file").select("ID", "text")
    return number_pages(ocr_pages_of(spark, path), id_format, start)


def read_table(spark: SparkSession, path, columns: dict[str, list[int] | int], sep: str = "\t", skip_first: bool = True, data_sep: str = ", ", id_format: str | None = None, clean: tuple[str, ...] = ()) -> DataFrame:
    """A delimited file without quoting.

    ``columns``: target field to source places (from 0); several are joined, empty ones left out.
    A generated ID replaces one from the table.
    """
    parts = [spark.read.text(p).select("value", S.file_position(i).alias("pos")) for i, p in enumerate(_paths(path))]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.union(p)
    if skip_first:
        first = lines.filter("pos.block = 0").groupBy(F.col("pos.argument").alias("_a"), F.col("pos.file").alias("_f")).agg(F.min("pos").alias("_p"))
        lines = lines.join(F.broadcast(first), F.col("pos") == F.col("_p"), "left_anti")  # a row for each file
    cells = F.split("value", re.escape(sep))

    def value(places: list[int] | int, name: str) -> Column:
        parts = [F.trim(F.get(cells, F.lit(p))) for p in ([places] if isinstance(places, int) else places)]
        if name in clean:
            parts = [T.clean_str(p) for p in parts]
        return F.concat_ws(data_sep, *[F.when(p != "", p) for p in parts])

    out = lines.filter(F.trim("value") != "").select(*[value(p, name).alias(name) for name, p in columns.items() if not (name == "ID" and id_format)], "pos")
    if id_format:
        out = numbered(out, id_format)
    return out


def numbered(df: DataFrame, id_format: str, start: int = 1) -> DataFrame:
    """``df`` (with pos) and gapless formatted IDs in order of pos."""
    return number_rows(df, "pos", "_i").withColumn("ID", T.id_formatter(id_format, F.col("_i") + start)).drop("_i")


def read_labels_table(spark: SparkSession, path, id_column: int | None = 0, text_column: int = 1, id_format: str | None = None, **options) -> DataFrame:
    return read_table(spark, path, {"ID": id_column or 0, "text": text_column}, id_format=id_format, **options)


def read_events_table(spark: SparkSession, path, location=0, date=1, collector=2, text=3, id_column: int | None = None, id_format: str | None = "colev:5", **options) -> DataFrame:
    columns = {"location": location, "date": date, "collector": collector, "text": text}
    if id_column is not None:
        columns["ID"], id_format = id_column, None
    return read_table(spark, path, columns, id_format=id_format, **options)


def metadata(s: Column) -> Column:
    """``k="v"; k2='v2'`` as a map; semicolons inside quotes belong to the value; bad syntax is an error."""
    pair = r"""\s*([\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')\s*"""
    bad = (F.trim(s) != "") & ~s.rlike(rf"^(?:{pair})(?:;{pair})*;?\s*$")
    keys, double, single = (F.regexp_extract_all(s, F.lit(pair), i) for i in (1, 2, 3))
    values = F.zip_with(double, single, lambda a, b: F.when(F.length(F.coalesce(a, F.lit(""))) > 0, a).otherwise(F.coalesce(b, F.lit(""))))
    return F.when(bad, F.raise_error(F.concat(F.lit("bad metadata: "), s)).cast("map<string,string>")).otherwise(F.map_from_arrays(keys, values))


def read_collectors_table(spark: SparkSession, path) -> DataFrame:
    """Collectors of a TSV with header: ID and name needed, firstname and metadata may be."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="")
    unknown = set(raw.columns) - {"ID", "name", "firstname", "metadata"}
    missing = {"ID", "name"} - set(raw.columns)
    if unknown or missing:
        raise ValueError(f"unknown columns {sorted(unknown)}, missing columns {sorted(missing)}")
    first = F.coalesce("firstname", F.lit("")) if "firstname" in raw.columns else F.lit("")
    data = metadata(F.coalesce("metadata", F.lit(""))) if "metadata" in raw.columns else F.create_map().cast("map<string,string>")
    return raw.select("ID", "name", first.alias("firstname"), data.alias("metadata"), S.file_position().alias("pos"))


def _tsv(spark: SparkSession, paths) -> DataFrame:
    """Tables with a header in each file, in the order of the paths, with pos."""
    parts = [spark.read.csv(p, sep="\t", header=True, quote="").withColumn("pos", S.file_position(i)) for i, p in enumerate(_paths(paths))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_sorted_labels(spark: SparkSession, path) -> DataFrame:
    """label_id, group_id of sorted labels; the last row of a label counts."""
    return _tsv(spark, path).groupBy(F.col("`label.ID`").alias("label_id")).agg(F.max_by("`group.ID`", "pos").alias("group_id"))


def read_matches(spark: SparkSession, paths) -> DataFrame:
    """label_id, event_id, score, pos of one or more match files."""
    return _tsv(spark, paths).select(F.col("`label.ID`").alias("label_id"), F.col("`CE.ID`").alias("event_id"), F.col("score").cast("double").alias("score"), "pos")


def read_ids(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("ID")).filter("ID <> ''")


def read_expressions(spark: SparkSession, path) -> list[str]:
    """Patterns of a list file: ``regex[TAB FLAG,FLAG]``; # starts a comment line."""
    flags = {"IGNORECASE": "i", "I": "i", "MULTILINE": "m", "M": "m", "DOTALL": "s", "S": "s", "VERBOSE": "x", "X": "x"}
    out = []
    for row in spark.read.text(path).toLocalIterator():
        expression, _, names = row["value"].partition("\t")
        if expression.strip() and not expression.startswith("#"):
            on = "".join(sorted({flags[n.strip().upper()] for n in names.split(",") if n.strip()}))
            out.append(f"(?{on}){expression}" if on else expression)
    return out


def read_index(spark: SparkSession, path: str, options: Options | None = None) -> Index:
    return Index.read(spark, path, options)


def read_dates(spark: SparkSession, path: str) -> DataFrame:
    """The date index (ID, range) that ``write_dates`` wrote."""
    return spark.read.parquet(path)
