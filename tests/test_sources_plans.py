"""Readers, writers, commands, plans, streaming, entry points."""

import io
import json

import pytest
from pyspark.sql import functions as F

from labelloom import cli
from labelloom.operators.index import Options, make_index
from labelloom.plans import pipelines as P
from labelloom.sources import readers as R
from labelloom.sources import writers as W
from labelloom.streaming.match_stream import match_stream


@pytest.fixture
def files(tmp_path):
    def put(name, content):
        (tmp_path / name).write_text(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False))
        return str(tmp_path / name)

    return put


LABELS = [{"ID": "l1", "text": "Museum Berlin {x} 5.3.1936"}, {"ID": "l2", "text": "Museum Berlin 5.3.1936"}, {"ID": "l1", "text": "Museum Berlin\t5.3.1936"}]
EVENTS = [{"ID": "e1", "location": "Berlin", "date": "1936", "collector": "Walz", "text": "museum berlin"}]


def test_json(spark, files):
    df = R.read_labels(spark, files("l.json", LABELS))
    assert [(r.ID, r.text) for r in df.orderBy("pos").collect()] == [("l1", "Museum Berlin\t5.3.1936"), ("l2", "Museum Berlin 5.3.1936")]
    assert json.loads("".join(W.json_array(df)))[0]["ID"] == "l1"


def test_tables(spark, files):
    path = files("e.tsv", "loc\tloc2\tdate\twho\ttext\nA\t\t1936\tW\tone\nB\tC\t1940\tX\t'two'\n")
    rows = R.read_events_table(spark, path, location=[0, 1], date=2, collector=3, text=4, clean=("text",)).orderBy("ID").collect()
    assert [(r.ID, r.location, r.text) for r in rows] == [("colev00001", "A", "one"), ("colev00002", "B, C", "two")]
    rows = R.read_labels_table(spark, files("l.tsv", "a\tx\nb\ty\n"), skip_first=False).collect()
    assert sorted((r.ID, r.text) for r in rows) == [("a", "x"), ("b", "y")]
    c = R.read_collectors_table(spark, files("c.tsv", "ID\tname\tmetadata\n1\tWalz\tentity_type=\"a;b\"; k='v'\n"))
    assert c.first().metadata == {"entity_type": "a;b", "k": "v"}
    with pytest.raises(ValueError):
        R.read_collectors_table(spark, files("bad.tsv", "ID\tother\n1\t2\n"))
    with pytest.raises(Exception, match="bad metadata"):
        spark.range(1).select(R.metadata(F.lit("nonsense"))).collect()


def test_ocr(spark, tmp_path):
    d = tmp_path / "ocr"
    d.mkdir()
    for name, texts in (("a.json", ["one", "two"]), ("b.json", ["three"])):
        (d / name).write_text(json.dumps({"responses": [{"fullTextAnnotation": {"text": t}} for t in texts]}))
    assert sorted((r.ID, r.text) for r in R.ocr_labels(spark, str(d)).collect()) == [("label00001", "one"), ("label00002", "two"), ("label00003", "three")]
    ids = spark.createDataFrame([("b.json", "x")], "file string, ID string")
    assert [tuple(r) for r in R.ocr_labels(spark, str(d), ids=ids).collect()] == [("x", "three")]


def test_files_of_rows_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """a file for each supplier, in one folder without a folder each, written in many tasks and read once in few, in the order of the keys."""
    from labelloom import queries_more as M
    from labelloom import queries as Q

    monkeypatch.setattr(W, "TASK_FILES", 7)
    paths = []
    monkeypatch.setattr(M, "new_path", lambda spark, name: paths.append(str(tmp_path / name)) or paths[-1])
    keys = [int(k * 37 % 101) for k in range(100)]
    spark.createDataFrame([(k, f"s{k}") for k in keys] + [(None, "none")], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r.ID: r.text for r in Q.QUERIES["ocr_pages"](spark, str(tmp_path)).collect()}
    want = [t for k in sorted(keys) for t in (f"s{k}", "")] + ["none", ""]
    assert got == {f"label{i:05d}": t for i, t in enumerate(want, 1)}
    names = sorted(f.name for f in (tmp_path / "ocr").iterdir() if f.name.startswith("part-"))
    assert len(names) == 101 and len({n[:10] for n in names}) == 15
    assert spark.conf.get("spark.sql.files.openCostInBytes") in ("4194304", "4194304b")


def test_expressions(spark, files):
    path = files("x.txt", "# comment\nabc\tIGNORECASE\n[0-9]+\n")
    assert R.read_expressions(spark, path) == ["(?i)abc", "[0-9]+"]


def run(spark, *argv):
    out, err = io.StringIO(), io.StringIO()
    cli.run(spark, list(argv), out, err)
    return out.getvalue(), err.getvalue()


def test_commands(spark, files, tmp_path):
    l, e = files("l.json", LABELS), files("e.json", EVENTS)
    table, err = run(spark, "match_collecting_events", l, e, "-d", "-u")
    assert table.splitlines()[0].split("\t")[0] == "label.ID" and len(table.splitlines()) == 3 and err == ""
    groups, _ = run(spark, "sort_labels", l, "-d", "-v", "pick")
    head, *lines = [x.split("\t") for x in groups.splitlines()]
    assert head == ["label.ID", "label.v", "group.ID", "geo.v", "geo.i", "date.v", "date.i", "collector.v", "collector.i", "consensus.text"]
    assert {x[head.index("group.ID")] for x in lines} == {"label00001"} and {x[head.index("date.i")] for x in lines} == {"1936-3-5"}
    assert {x[head.index("consensus.text")] for x in lines} == {"Museum Berlin\\t5.3.1936"}
    parsed, _ = run(spark, "sort_labels", l, "-p", "-d")
    assert len(parsed.splitlines()) == 3
    found, _ = run(spark, "search_labels", l, "musem", "-t", "0.1")
    assert len(found.splitlines()) == 3
    sorted_file, match_file = files("s.tsv", "label.ID\tlabel.v\tgroup.ID\nl1\tx\tg\nl2\tx\tg\n"), files("m.tsv", table)
    conf, log = run(spark, "checkout_collecting_events", sorted_file, match_file)
    assert conf.splitlines()[0] == "group.ID\tce.ID\tconfidence" and conf.splitlines()[1].startswith("g\te1\t") and "labels_per_cluster" in log
    kept, _ = run(spark, "subset_db", l, files("ids.txt", "l2\nl2\n"))
    assert [x["ID"] for x in json.loads(kept)] == ["l2"]
    assert run(spark, "table_export", e)[0].splitlines()[0] == "ID\tlocation\tdate\tcollector\ttext"  # the keys of the first object
    made, _ = run(spark, "make_labels", files("t.tsv", "id\ttext\n1\tabc 12\n"), "--clean", files("x.txt", "[0-9]+\n"))
    assert json.loads(made) == [{"ID": "1", "text": "abc "}]
    made, _ = run(spark, "make_collecting_events", files("e.tsv", "h\nA\t1936\tW\tone\n"))
    assert json.loads(made)[0]["ID"] == "colev00001"
    made, _ = run(spark, "make_collectordb", files("c.tsv", "ID\tname\n1\tWalz\n"))
    assert json.loads(made)[0]["name"] == "Walz"


def test_commands_read_their_own_output(spark, files, tmp_path):
    out = lambda name: str(tmp_path / name)
    many = [{"ID": f"l{i}", "text": f"Museum Berlin collection {'west' if i % 2 else 'east'} 5.3.1936"} for i in range(30)] + [{"ID": "x", "text": "Étage \"q\"\tother\nwords"}]
    run(spark, "make_labels", files("t.tsv", "id\ttext\n" + "".join(f"{x['ID']}\t{x['text']}\n" for x in many[:30])), "-o", out("made"))
    assert R.read_labels(spark, out("made")).count() == 30
    W.write_json(spark.createDataFrame([(x["ID"], x["text"], i) for i, x in enumerate(many)], "ID string, text string, pos int").repartition(3), out("labels"))
    got = {r.ID: r.text for r in R.read_labels(spark, out("labels")).collect()}
    assert got == {x["ID"]: x["text"] for x in many}
    run(spark, "make_collecting_events", files("e.tsv", "h\nBerlin\t1936\tWalz\tmuseum berlin east\nBerlin\t1936\tWalz\tmuseum berlin west\n"), "-o", out("events"))
    run(spark, "sort_labels", out("labels"), "-d", "-v", "pick", "-o", out("sorted"))
    run(spark, "match_collecting_events", out("labels"), out("events"), "-o", out("matches"))
    assert R.read_sorted_labels(spark, out("sorted")).count() == 31 and R.read_matches(spark, out("matches")).count() >= 60
    run(spark, "checkout_collecting_events", out("sorted"), out("matches"), "-l", out("log"), "-o", out("confidence"))
    rows = spark.read.csv(out("confidence"), sep="\t", header=True).collect()
    assert len(rows) == R.read_sorted_labels(spark, out("sorted")).select("group_id").distinct().count() and {r["ce.ID"] for r in rows} <= {"colev00001", "colev00002", "unassigned"}
    run(spark, "subset_db", out("labels"), files("ids.txt", "l3\nx\n"), "-o", out("subset"))
    assert {r.ID for r in R.read_labels(spark, out("subset")).collect()} == {"l3", "x"}
    run(spark, "table_export", out("events"), "-o", out("table"))
    assert spark.read.csv(out("table"), sep="\t", header=True, quote="").columns == ["location", "date", "collector", "text", "ID"]


def test_json_lines_arrays_and_order(spark, files, tmp_path):
    lines = "".join(json.dumps(x) + "\n" for x in LABELS)
    assert [(r.ID, r.text) for r in R.read_labels(spark, files("a.jsonl", lines)).orderBy("pos").collect()] == [("l1", "Museum Berlin\t5.3.1936"), ("l2", "Museum Berlin 5.3.1936")]
    assert R.read_labels(spark, files("indented.json", json.dumps(LABELS, indent=2))).count() == 2
    assert R.read_labels(spark, files("empty.json", "[\n]\n")).count() == 0
    with pytest.raises(Exception):
        R.read_labels(spark, files("bad.json", '{"ID": "a", "text": "b"}\nnonsense\n')).collect()
    # the last of equal IDs is that of the last argument, however large the files
    a, b = files("zz.json", json.dumps([{"ID": "x", "text": "first"}] + [{"ID": f"y{i}", "text": "w " * 50} for i in range(500)])), files("aa.json", [{"ID": "x", "text": "second"}])
    assert {r.ID: r.text for r in R.read_labels(spark, [a, b]).collect()}["x"] == "second" and {r.ID: r.text for r in R.read_labels(spark, [b, a]).collect()}["x"] == "first"
    m, n = files("m1.tsv", "label.ID\tCE.ID\tscore\nl\te1\t0.5\n" + "k\te0\t0.1\n" * 200), files("m0.tsv", "label.ID\tCE.ID\tscore\nl\te2\t0.5\n")
    from labelloom.operators import evaluate as E

    assert [{r.label_id: r.event_id for r in E.best_match(R.read_matches(spark, p)).collect()}["l"] for p in ([m, n], [n, m])] == ["e2", "e1"]
    assert R.first_keys(spark, files("k.json", json.dumps([{"b": {"c": [1, "}"]}, "a": 2}], indent=1))) == ["b", "a"] and R.first_keys(spark, files("none.json", "")) == []
    out = io.StringIO()
    cli.run(spark, ["make_labels", "-"], out, io.StringIO(), io.StringIO("id\ttext\n7\tby standard input\n"))
    assert json.loads(out.getvalue()) == [{"ID": "7", "text": "by standard input"}]


def test_date_index_round_trip(spark, tmp_path):
    from labelloom.operators import match as M

    dates = M.date_index(spark.createDataFrame([("e1", "1936"), ("e2", "5.3.1940"), ("e3", "?")], "ID string, date string"))
    W.write_dates(dates, str(tmp_path / "dates"))
    again = R.read_dates(spark, str(tmp_path / "dates"))
    assert sorted(map(str, again.collect())) == sorted(map(str, dates.collect())) and again.count() == 2


def test_parse_info(spark):
    t = spark.createDataFrame([("a", "Dire Daoua, leg. Walz 5.3.1936 at 10°30' N, 20°15' E"), ("b", "Dire Daoua")], "ID string, text string")
    c = spark.createDataFrame([("c", "Walz", "A")], "ID string, name string, firstname string")
    g = spark.createDataFrame([(2, "Dire Daoua", "ET", "P", 9.6, 41.9, None)], "geoname_id long, name string, country string, fcl string, lat double, lng double, parent_id long")
    got = {r.ID: r for r in P.parse_info(t, collectors=c, gazetteer=g, coordinates=True).collect()}
    a = got["a"]
    assert (a.date_v, a.date_i, a.collector_v, a.collector_i, a.geo_i) == ("5.3.1936", "1936-3-5", "Walz", "Walz, A", "10.50000, 20.25000")
    assert got["b"].geo_i == "Dire Daoua, ET" and got["b"].date_v == ""


def test_sort_with_refinement(spark):
    texts = [f"museum berlin collection number {'west' if i % 2 else 'east'}" for i in range(10)] + ["something else entirely"]
    lab = spark.createDataFrame([(f"L{i:02}", t, i) for i, t in enumerate(texts)], "ID string, text string, pos long")
    got = P.sort_labels(lab, 0.5, refine=True, consensus="alignment").orderBy("pos").collect()
    assert len(got) == 11 and got[0].group_id == "label00001" and got[10].group_id not in {r.group_id for r in got[:10]}


def test_stream_equals_batch(spark, tmp_path):
    from labelloom.operators import match as M

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(x) for x in LABELS[:2]))
    ev = spark.createDataFrame([("e1", "museum berlin"), ("e2", "nothing")], "ID string, text string")
    index = make_index(ev, Options(1, 3))
    q = match_stream(R.stream_labels(spark, str(tmp_path / "in")), index, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    lab = spark.createDataFrame([(x["ID"], x["text"]) for x in LABELS[:2]], "ID string, text string")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, M.match_events(lab, index).collect()))


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "ID", "score"]
