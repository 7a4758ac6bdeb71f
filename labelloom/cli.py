"""The nine commands, as ``python -m labelloom.cli COMMAND``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from labelloom import schema as S
from labelloom.functions import text as T
from labelloom.plans import pipelines as P
from labelloom.sources import readers as R
from labelloom.sources import writers as W
from labelloom.storage import new_path, ready


def _places(spec: str) -> list[int]:
    return T.range_reader(spec)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="labelloom")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *inputs: str):
        p = sub.add_parser(name)
        for i in inputs:
            p.add_argument(i, nargs="+" if i.endswith("s+") else None)
        p.add_argument("-o", "--output", help="folder for the result; standard output without it")
        return p

    # an input "-" is standard input
    p = command("make_labels", "input")
    p.add_argument("-i", "--id-column", type=int, default=1)
    p.add_argument("-f", "--id-format")
    p.add_argument("--header", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("-s", "--separator", default="\t")
    p.add_argument("-t", "--text-column", type=int, default=2)
    p.add_argument("--clean", help="file of patterns to delete")
    p.add_argument("--ocr", action="store_true", help="input is OCR output (a file or a folder)")
    p.add_argument("--table", help="TSV of file name and ID, with --ocr")
    p = command("make_collecting_events", "input")
    for short, name, default in (("-l", "location", "1"), ("-d", "date", "2"), ("-c", "collector", "3"), ("-t", "text", "4")):
        p.add_argument(short, f"--{name}", default=default)
    p.add_argument("-i", "--id-column", type=int)
    p.add_argument("-f", "--id-format", default="colev:5")
    p.add_argument("--header", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("-q", "--clean-columns", action="store_true")
    p.add_argument("-s", "--separator", default="\t")
    command("make_collectordb", "input")
    p = command("sort_labels", "input")
    p.add_argument("-c", "--collectors")
    p.add_argument("-d", "--date", action="store_true")
    p.add_argument("-f", "--id-format", default="label:5")
    p.add_argument("-g", "--gazetteer", help="Parquet table of places")
    p.add_argument("-m", "--min-len", type=int, default=3)
    p.add_argument("-p", "--parse-and-sort", action="store_true")
    p.add_argument("-q", "--quorum", type=int, default=2)
    p.add_argument("-r", "--refine", action="store_true")
    p.add_argument("-s", "--similarity", type=float, default=0.8)
    p.add_argument("-v", "--consensus", choices=["pick", "alignment"])
    p = command("match_collecting_events", "labels", "events")
    p.add_argument("-d", "--date", action="store_true")
    p.add_argument("-f", "--fields", default="text")
    p.add_argument("-m", "--method", type=int, default=1)
    p.add_argument("-p", "--persist", action="store_true")
    p.add_argument("-s", "--scoring", default="w")
    p.add_argument("-u", "--unmatched", action="store_true", help="also list what has no match, on standard error")
    p.add_argument("-x", "--no-text-search", action="store_true")
    p = command("search_labels", "input", "query")
    p.add_argument("-l", "--min-len", type=int, default=3)
    p.add_argument("-m", "--method", type=int, default=1)
    p.add_argument("-r", "--raw", action="store_true", help="take the query as it is, escapes undecoded")
    p.add_argument("-s", "--scoring", default="w")
    p.add_argument("-t", "--threshold", type=float, default=0.0)
    p = command("checkout_collecting_events", "sorted", "matches+")
    p.add_argument("-l", "--log")
    command("subset_db", "input", "ids")
    command("table_export", "input")
    return top


def run(spark: SparkSession, argv: list[str], out=sys.stdout, err=sys.stderr, stdin=None) -> None:
    a = parser().parse_args(argv)

    ready(spark)
    if getattr(a, "input", None) == "-":  # what comes in by standard input is the driver's
        a.input = new_path(spark, "stdin")
        spark.createDataFrame([(line.rstrip("\n"),) for line in (stdin or sys.stdin)], "value string").coalesce(1).write.text(a.input)

    def emit(df, as_json: bool) -> None:
        if a.output:
            (W.write_json if as_json else W.write_tsv)(df, a.output)
        elif as_json:
            out.writelines(W.json_array(df))
        else:
            out.writelines(line + "\n" for line in W.tsv_table(df))

    if a.command == "make_labels":
        if a.ocr:
            ids = spark.read.csv(a.table, sep="\t", quote="").toDF("file", "ID") if a.table else None
            df = R.ocr_labels(spark, a.input, a.id_format or "label:5", ids=ids)
        else:
            df = R.read_labels_table(spark, a.input, a.id_column - 1, a.text_column - 1, a.id_format, sep=a.separator, skip_first=a.header)
        if a.clean:
            df = df.withColumn("text", T.clean_text(F.col("text"), R.read_expressions(spark, a.clean)))
        emit(df, True)
    elif a.command == "make_collecting_events":
        columns = {k: _places(getattr(a, k)) for k in ("location", "date", "collector", "text")}
        clean = tuple(columns) if a.clean_columns else ()
        emit(R.read_events_table(spark, a.input, **columns, id_column=None if a.id_column is None else a.id_column - 1, id_format=a.id_format, sep=a.separator, skip_first=a.header, clean=clean), True)
    elif a.command == "make_collectordb":
        emit(R.read_collectors_table(spark, a.input), True)
    elif a.command == "sort_labels":
        info = {}
        if a.collectors:
            info["collectors"] = R.read_collectors(spark, a.collectors)
        if a.gazetteer:
            info |= {"gazetteer": spark.read.parquet(a.gazetteer), "coordinates": True}
        if a.date or info or a.parse_and_sort:
            info["dates"] = a.date
        emit(P.sorted_table(P.sort_labels(R.read_labels(spark, a.input), a.similarity, a.min_len, a.refine, a.consensus, a.quorum, a.parse_and_sort, a.id_format, **info)), False)
    elif a.command == "match_collecting_events":
        found, labels, events = P.match_events(R.read_labels(spark, a.labels), R.read_events(spark, a.events), tuple(a.fields.split(",")), a.method, a.scoring, a.date, a.persist, not a.no_text_search)
        emit(found, False)
        if a.unmatched:
            for name, df in (("label", labels), ("event", events)):
                err.writelines(f"no match: {name} {r['ID']}\n" for r in df.toLocalIterator())
    elif a.command == "search_labels":
        query = a.query if a.raw else a.query.encode().decode("unicode_escape") if a.query.isascii() else a.query
        emit(P.search_labels(R.read_labels(spark, a.input), query, a.method, a.min_len, a.scoring, a.threshold), False)
    elif a.command == "checkout_collecting_events":
        found, stats = P.checkout(R.read_sorted_labels(spark, a.sorted), R.read_matches(spark, getattr(a, "matches+")))
        emit(found.withColumnsRenamed({"group_id": "group.ID", "event_id": "ce.ID"}), False)
        text = "".join(f"{r['statistic']}\tn={r['n']}\tmean={r['mean']:.3f}\tsd={r['sd']:.3f}\n" for r in stats.collect())  # three rows
        Path(a.log).write_text(text) if a.log else err.write(text)
    elif a.command == "subset_db":
        emit(S.subset_by_id(R.json_rows(spark, a.input), R.read_ids(spark, a.ids)), True)
    elif a.command == "table_export":
        keys = R.first_keys(spark, a.input)
        if keys:
            emit(R.json_rows(spark, a.input).orderBy("pos").select(*[F.col(f"`{k}`") for k in keys]), False)


def main() -> None:
    spark = SparkSession.builder.appName("labelloom").getOrCreate()
    run(spark, sys.argv[1:])


if __name__ == "__main__":
    main()
