"""The pipeline: each stage's rows against its own input."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near_mixing_sharding import SCHEMA, brute_components, brute_hits, vocabulary


def test_stages_on_planted_cases(spark, tmp_path):
    r = random.Random(21)
    words = vocabulary(r)
    items = [(i, " ".join(r.choice(words) for _ in range(30))) for i in range(5)]
    rows = []
    for i in range(300):
        t = " ".join(r.choice(words) for _ in range(r.randint(60, 200)))
        if i % 50 == 7:
            t += " " + items[i % 5][1]
        if i % 20 == 3:
            t = rows[-1][1].replace(" ", "  ", 1)
        if i % 25 == 11:
            t = t.replace(" ", "*** ")
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        seen.append(spark.read.parquet(str(tmp_path / f"stage{k}")))
    assert all(s.columns == docs.columns for s in seen[:-1])
    ids = [sorted(x.doc_id for x in s.select("doc_id").collect()) for s in seen]
    assert set(ids[1]) == {i for i, *_ in rows if i % 25 != 11}
    kept = {x.doc_id: x.text for x in seen[1].collect()}
    roots = brute_components([(i, t) for i, t in kept.items()], 5)
    assert ids[2] == sorted(i for i in kept if roots[i][1] == i)
    assert ids[3] == [i for i in ids[2] if not brute_hits(kept[i], items)[1]]
    assert set(ids[4]) <= set(ids[3]) and ids[5] == ids[4]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids[5])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_nulls(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "a", 0), (1, text, "en", "a", 0), (2, text + " more", None, None, None), (None, text[::-1], "en", "a", 0), (4, None, "en", "a", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted((r.doc_id or -1) for r in got.collect()) == [-1, 1, 4] and got.columns == docs.columns
    # one id with different texts, and copies without an id
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(1, text, "en", "a", 0), (1, other, "en", "a", 0), (None, text + " more", "en", "a", 0), (None, "lone " * 9, "en", "a", 0), (3, other, "en", "a", 0), (5, "", "en", "a", 0), (5, None, "en", "a", 0), (6, "word " * 60_000, "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("_key", F.lit(1)).withColumn("component_id", F.lit(2))
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or -1, (r.text or "")[:2]) for r in got.collect())) == [(-1, "lo"), (1, "v0"), (1, "w0"), (5, ""), (5, ""), (6, "wo")]


def test_stages_keep_clashing_columns(spark, tmp_path):
    r = random.Random(3)
    words = vocabulary(r)
    rows = [(i if i % 9 else None, " ".join(r.choice(words) for _ in range(50)), "en", f"s{i % 2}", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("kept", "size", "shard", "slot", "_row", "_k", "key", "spans", "position", "n_words", "g", "d2", "target"):
        docs = docs.withColumn(c, F.lit("own"))
    spark.createDataFrame([(1, "some text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"input_size", "input_shard", "input_slot", "kept", "shard"} <= set(out.columns) and out.filter("input_shard = 'own' and kept = 'own'").count() == out.count() > 30
