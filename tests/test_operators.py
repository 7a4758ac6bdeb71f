"""Operators against plain Python, golden values and each other."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom import queries as Q
from labelloom import schema as S
from labelloom.functions import text as T
from labelloom.operators import cluster as C
from labelloom.operators import evaluate as E
from labelloom.operators import gazetteer as Z
from labelloom.operators import match as M
from labelloom.operators import names as N
from labelloom.operators.index import Options, make_index, token_counts
from labelloom.operators.search import search, self_similarity, token_pairs


def labels(spark, texts):
    return spark.createDataFrame([(f"L{i}", t, i) for i, t in enumerate(texts)], "ID string, text string, pos long")


def queries(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, query string")


def score(spark, docs, q, **kw):
    rows = search(queries(spark, q), make_index(labels(spark, docs).select("ID", "text"), Options(1, 3)), **kw).collect()
    return {r.ID: round(r.score, 4) for r in rows}


def test_golden_scores(spark):
    assert score(spark, ["aaa bbb bbb"], "bbb bbb ccc", fuzzy=False) == {"L0": 0.5333}
    assert score(spark, ["aaa bbb bbb"], "bbb bbb bbb", fuzzy=False) == {"L0": 0.5333}
    assert score(spark, ["aaa bbb bbb", "ddd", "", None], "") == {}
    assert score(spark, ["Museum Berlin"], "Musem Berlin") == {"L0": round((1 + 1 - 1 / 6) / 2, 4)}
    with pytest.raises(ValueError):
        score(spark, ["a"], "a", scoring="x")
    with pytest.raises(ValueError):
        Options(3)


def plain_search(docs, q):
    """The scoring rules in plain Python, token counts, words of three letters or more."""
    def lev(a, b):
        return C.edit_distance(a, b)

    tokens = [t for t in q.lower().split() if len(t) > 2]
    out = {}
    for i, d in enumerate(docs):
        own = [t for t in d.lower().split() if len(t) > 2]
        tf = {t: own.count(t) for t in own}
        left, raw, n = dict(tf), 0.0, 0
        for t in tokens:
            k = max(len(t).bit_length() - 2, 0)
            near = [(-(1 - lev(t, x) / max(len(t), len(x))), -tf[x], x) for x in tf if lev(t, x) <= k]
            if near:
                s, _, x = min(near)
                if left[x]:
                    left[x] -= 1
                    raw += -s * tf[x]
                    n += 1
        if n:
            out[f"L{i}"] = round(raw / sum(v * v for v in tf.values()) * n / len(tokens), 4)
    return out


def test_search_equals_plain_python(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abc") for _ in range(r.randint(2, 9))) for _ in range(60)]
    docs = [" ".join(r.choice(words) for _ in range(r.randint(1, 12))) for _ in range(30)]
    for q in (" ".join(r.choice(words) for _ in range(8)) for _ in range(2)):
        for strategy in ("broadcast", "blocked"):
            assert score(spark, docs, q, strategy=strategy) == plain_search(docs, q)


def test_fuzzy_match_queries_equal_plain_python(spark, tmp_path):
    events, texts = ["museum berlin", "forest hamburg", "meadow"], ["musem berlin", "forrest edge", "nothing here", "hamburg museum", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(events)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    orders = [(1, 1, "5-LOW", "1995-03-02"), (2, 2, "1-URGENT", "1996-04-03")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate string").withColumn("o_orderdate", F.to_date("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    got = {n: Q.QUERIES[f"{n}_fuzzy"](spark, str(tmp_path)).collect() for n in ("match_all_hits", "match_unmatched_labels", "match_unmatched_events", "best_match", "left_join_unassigned", "group_confidence", "cluster_stats", "match_date_filtered", "match_persist")}
    hits = {(d, int(e[1:])): s for d, t in enumerate(texts) for e, s in plain_search(events, t or "").items()}
    assert (0, 0) in hits and (1, 1) in hits
    assert {(r.label_id, r.event_id): round(r.score, 4) for r in got["match_all_hits"]} == hits
    assert {r.ID for r in got["match_unmatched_labels"]} == set(range(5)) - {d for d, _ in hits} == {2, 4}
    assert {r.ID for r in got["match_unmatched_events"]} == {2}
    best = {d: max((s, e) for (x, e), s in hits.items() if x == d)[1] for d, _ in hits}
    assert {r.label_id: r.event_id for r in got["best_match"]} == best
    assert {r.label_id: r.event_id for r in got["left_join_unassigned"]} == {d: str(best.get(d, "unassigned")) for d in range(5)}
    assert len(got["group_confidence"]) == 1 and {r.statistic for r in got["cluster_stats"]} == {"labels_per_cluster", "events_per_cluster", "clusters_per_event"}
    for n in ("match_date_filtered", "match_persist"):
        assert {(r.label_id, r.event_id) for r in got[n]} == {(1, "1995/5-low"), (2, "1996/1-urgent")}


def test_strategies_agree(spark):
    r = random.Random(6)
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randint(1, 20))) for _ in range(300)})
    q = spark.createDataFrame([(w,) for w in words[::3]], "q string")
    v = spark.createDataFrame([(w,) for w in words], "token string")
    a, b = (sorted(token_pairs(q, v, s).collect()) for s in ("broadcast", "blocked"))
    assert a == b and len(a) > len(words) / 3


def test_self_score_and_range(spark):
    texts = ["museum berlin west", "museum berlin", "totally other words here"]
    got = {(r.query_id, r.ID): r.score for r in search(labels(spark, texts).select(F.col("ID").alias("query_id"), F.col("text").alias("query")), make_index(labels(spark, texts).select("ID", "text"), Options(2, 3))).collect()}
    assert all(abs(got[(f"L{i}", f"L{i}")] - 1) < 1e-9 for i in range(3))
    assert all(0 < s <= 1 + 1e-9 for s in got.values())
    assert all(r.query_id != r.ID for r in self_similarity(labels(spark, texts), Options(2, 3), 0.0).collect())


def test_threshold_finds_the_same(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(3, 8))) for _ in range(50)]
    docs = [" ".join(r.choice(words) for _ in range(r.randint(1, 12))) for _ in range(60)]
    docs += [" ".join(w + r.choice(["", "", "x"]) for w in d.split()) for d in docs[:25]]
    lab = labels(spark, docs)
    for options in (Options(1, 3), Options(2, 3)):
        whole = {(x.query_id, x.ID): round(x.score, 9) for x in self_similarity(lab, options, 0.0).collect()}
        for t in (0.2, 0.8):
            got = {(x.query_id, x.ID): round(x.score, 9) for x in self_similarity(lab, options, t).collect()}
            assert got == {k: v for k, v in whole.items() if v >= t} and len(got) > 5
        exact = {(x.query_id, x.ID): round(x.score, 9) for x in self_similarity(lab, options, 0.0, fuzzy=False).collect()}
        got = {(x.query_id, x.ID): round(x.score, 9) for x in self_similarity(lab, options, 0.4, fuzzy=False).collect()}
        assert got == {k: v for k, v in exact.items() if v >= 0.4} and got


def test_filter_changes_no_weight(spark):
    docs = ["aaa bbb", "aaa ccc"]
    assert score(spark, docs, "aaa", condition=F.col("ID") == "L1") == {"L1": score(spark, docs, "aaa")["L1"]}


def test_index_round_trip(spark, tmp_path):
    from labelloom.operators.index import Index

    index = make_index(labels(spark, ["aaa bbb", "bbb"]).select("ID", "text"), Options(2, 3))
    index.write(str(tmp_path))
    again = Index.read(spark, str(tmp_path))
    assert sorted(index.postings.collect()) == sorted(again.postings.collect()) and again.options == index.options
    own = search(queries(spark, "aaa bbb xx"), again).filter("ID = 'L0'").first()
    assert abs(own.score - 1) < 1e-9  # the shortest token of the options is known again


def plain_leaders(n, edges):
    left, out = list(range(n)), {}
    while left:
        s = left[0]
        for x in [s, *[x for x in left if x != s and (s, x) in edges]]:
            out[x] = s
        left = [x for x in left if x not in out]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_leaders_equal_sequential(spark, seed):
    r = random.Random(seed)
    n = 40
    edges = {(r.randrange(n), r.randrange(n)) for _ in range(70)}
    nodes = spark.createDataFrame([(i, i) for i in range(n)], "ID long, pos long")
    e = spark.createDataFrame([x for x in edges if x[0] != x[1]], "src long, dst long")
    assert {x.ID: x.leader for x in C.leaders(nodes, e).collect()} == plain_leaders(n, edges)


def test_deduplicated(spark):
    rows = spark.createDataFrame([("a", "1", 0), ("b", None, 1), ("a", "2", 2)], "ID string, text string, pos long")
    assert sorted(map(tuple, S.deduplicated(rows).select("ID", "text", "pos").collect())) == [("a", "2", 0), ("b", "", 1)]
    with pytest.raises(ValueError):
        S.check(rows, S.EVENT)


def test_confidence(spark):
    rows = spark.createDataFrame([("g", "E1", 0.9), ("g", "E1", 0.7), ("g", "E2", 1.0), ("g", "unassigned", 0.0), ("h", "unassigned", 0.0)], "group_id string, event_id string, score double")
    got = {r.group_id: (r.event_id, round(r.confidence, 3)) for r in E.group_confidence(rows).collect()}
    assert got == {"g": ("E1", 0.4), "h": ("unassigned", 0.0)}
    m = spark.createDataFrame([("l", "a", 0.5, 0), ("l", "b", 0.5, 1), ("l", "c", 0.1, 2)], "label_id string, event_id string, score double, pos long")
    assert E.best_match(m).first().event_id == "b"
    stats = {r.statistic: r.mean for r in E.cluster_statistics(rows.withColumn("label_id", F.lit("x")), "reference").collect()}
    assert stats["events_per_cluster"] == 1.0


def test_group_numbers(spark):
    rows = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x"), (3, None), (4, None)], "pos long, k string")
    assert [r.group_id for r in E.group_by_key(rows, ["k"]).orderBy("pos").collect()] == [0, 1, 0, 2, 2]


def test_names(spark):
    c = spark.createDataFrame([("c1", "Walz", "A J"), ("c2", "Waltz (Jr.)", ""), ("c3", "van Walz", None)], "ID string, name string, firstname string")
    forms = [r.variant for r in N.variants(c, False).filter("ID = 'c1'").collect()]
    assert set(forms) == {"Walz", "A J Walz", "Walz A J", "A. J. Walz", "Walz A. J."} and len(forms) == 7
    t = spark.createDataFrame([("t1", "leg. a j WALZ 1905"), ("t2", "leg. Wals"), ("t3", "Wálz; waltz (jr.) x"), ("t4", None), ("t5", "van walz")], "ID string, text string")
    hits = {(r.ID, r.collector_id): (r.start, r.end) for r in N.find_names(t, c).collect()}
    assert hits == {("t1", "c1"): (5, 13), ("t3", "c1"): (0, 4), ("t3", "c2"): (6, 17), ("t5", "c1"): (4, 8), ("t5", "c3"): (0, 8)}
    merged = {r.ID: [n.collector_id for n in r.names] for r in N.find_collectors(t, c, "intended").collect()}
    assert merged["t5"] == ["c3"] and merged["t3"] == ["c1", "c2"]
    m = spark.createDataFrame([("m", "Museum Berlin", "")], "ID string, name string, firstname string")
    assert [r.place for r in N.find_entities(spark.createDataFrame([("t", "in Mus. Berl. 12")], "ID string, text string"), m).collect()] == [1]


def test_names_with_errors_and_common_words(spark):
    c = spark.createDataFrame([(f"c{i}", f"Collector#{i:05}", "") for i in range(40)] + [("w", "Walz", "Anna"), ("m", "van der Meer", "")], "ID string, name string, firstname string")
    t = spark.createDataFrame([("t1", "leg. collector#00007 and Wals"), ("t2", "ANNA WALS, van der Mer"), ("t3", "walzer"), ("t4", "collector 00007"), ("t5", "")], "ID string, text string")
    assert {(r.ID, r.collector_id) for r in N.find_names(t, c).collect()} == {("t1", "c7")}
    got = {(r.ID, r.collector_id): (r.start, r.end, r.score) for r in N.find_names(t, c, fuzzy=True).collect()}
    assert got[("t2", "w")] == (0, 9, 8) and got[("t2", "m")] == (11, 22, 11) and got[("t1", "w")] == (25, 29, 3)
    assert got[("t1", "c7")] == (5, 20, 15) and ("t3", "w") not in got and ("t4", "c7") in got
    only = N.find_collectors(t, c, search_rule=lambda df: F.col("ID") == "w", fuzzy=True)
    assert {n.collector_id for r in only.collect() for n in r.names} == {"w"}


def test_hierarchy_of_any_depth(spark):
    rows = [(i, i - 1 if i else None) for i in range(40)] + [(100, 102), (101, 100), (102, 101), (103, 101), (104, 999)]
    g = spark.createDataFrame(rows, "geoname_id long, parent_id long")
    got = {r.geoname_id: r.path for r in Z.hierarchy(g).collect()}
    assert got[39] == list(range(39, -1, -1)) and got[0] == [0] and got[104] == [104]
    assert got[100] == [100, 102, 101] and got[103][:3] == [103, 101, 100] and set(got[103]) == {103, 101, 100, 102}


def test_long_place_names(spark):
    g = spark.createDataFrame([(1, "old mill near the great river bend", "X", "P", 0.0, 0.0, None)], "geoname_id long, name string, country string, fcl string, lat double, lng double, parent_id long")
    t = spark.createDataFrame([("a", "at Old Mill near the Great River Bend, 1936")], "ID string, text string")
    assert [r.geoname_id for r in Z.find_places(t, g).collect()] == [1]


def plain_silhouette(dist, own):
    out = []
    for i in range(len(own)):
        same = [dist[i][j] for j in range(len(own)) if own[j] == own[i] and j != i]
        if not same:
            out.append(0.0)
            continue
        a = sum(same) / len(same)
        b = min(sum(dist[i][j] for j in range(len(own)) if own[j] == c) / sum(own[j] == c for j in range(len(own))) for c in set(own) if c != own[i])
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return sum(out) / len(out)


def test_medoids_and_silhouette():
    import itertools

    import numpy as np

    lines = ["museum berlin", "museum berlim", "musem berlin", "forest edge", "forest edgy", "fores edge", "river", "rivers", "a river"]
    dist = C.distances(lines)
    assert all(abs(dist[i, j] - C.edit_distance(a, b) / max(len(a), len(b))) < 1e-12 for i, a in enumerate(lines) for j, b in enumerate(lines))
    for k in (1, 2, 3):
        own, inertia = C.medoids(dist, k)
        best = min(sum(min(dist[i, m] for m in ms) for i in range(len(lines))) for ms in itertools.combinations(range(len(lines)), k))
        assert abs(inertia - best) < 1e-9 and len(set(own.tolist())) == k
        if k > 1:
            assert abs(C.silhouette(dist, own) - plain_silhouette(dist.tolist(), own.tolist())) < 1e-12
    assert C.knee([9.0, 4.0, 1.0, 0.9, 0.8, 0.7]) == 2 and C.knee([1.0, 1.0, 1.0]) is None
    assert len(set(C.split(lines, "silhouette"))) == 3 and np.array(C.split(lines[:5])).sum() == 0


def test_large_clusters_are_refined(spark, monkeypatch):
    r = random.Random(9)
    kinds = ["museum berlin", "forest edge", "river bank of the plain"]
    texts = [kinds[i % 3] + r.choice(["", ".", " x"]) for i in range(300)]
    rows = [(i, t, "g" if i < 290 else "h", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "ID long, text string, leader string, pos long")
    want = {x.ID: x.part for x in C.refine(df).collect()}
    monkeypatch.setattr(C, "REFINE_TO", 60)
    got = {x.ID: x.part for x in C.refine(df).collect()}
    for parts in (want, got):
        assert set(parts) == set(range(300)) and len({parts[i] for i in range(290)}) > 1
        kinds_of = {}
        for i in range(290):
            kinds_of.setdefault(parts[i], set()).add(i % 3)
        assert all(len(v) == 1 for v in kinds_of.values())


def test_gazetteer(spark):
    g = spark.createDataFrame([(1, "Ethiopia", "ET", "A", 9.0, 40.0, None), (2, "Dire Daoua", "ET", "P", 9.6, 41.9, 1), (3, "Daoua", None, "H", 1.0, 1.0, None), (4, "Dire", "FR", "S", 1.0, 1.0, None)], "geoname_id long, name string, country string, fcl string, lat double, lng double, parent_id long")
    t = spark.createDataFrame([("a", "Abessinien, Dire Daoua 1936"), ("b", "dire and daoua"), ("c", "nothing")], "ID string, text string")
    got = {r.ID: (r.geoname_id, r.country) for r in Z.find_places(t, g).collect()}
    assert got == {"a": (2, "ET"), "b": (4, "FR")}
    assert {r.geoname_id: r.path for r in Z.hierarchy(g).collect()}[2] == [2, 1]
    assert {r.country: r.n for r in Z.by_country(g).collect()} == {"ET": 2, "no_country": 1, "FR": 1}


def test_date_matching_and_fallback(spark):
    ev = spark.createDataFrame([("e1", "1936", "museum berlin"), ("e2", "1940", "museum berlin"), ("e3", "?", "museum")], "ID string, date string, text string")
    lab = labels(spark, ["Museum Berlin 5.3.1936", "Museum Berlin 1.1.1950", "Museum", "other words"])
    index, dates = make_index(ev.select("ID", "text"), Options(1, 3)), M.date_index(ev)
    pairs = lambda **k: sorted((r.label_id, r.event_id) for r in M.match_events(lab, index, dates, **k).collect())
    every = [("L2", "e1"), ("L2", "e2"), ("L2", "e3")]
    assert pairs() == [("L0", "e1"), *every]
    assert pairs(persist=True) == [("L0", "e1"), ("L1", "e1"), ("L1", "e2"), ("L1", "e3"), *every]
    assert pairs(text_search=False) == [("L0", "e1")]
    assert [r.ID for r in M.unmatched(lab, M.match_events(lab, index), "label_id").collect()] == ["L3"]


def test_consensus(spark):
    m = spark.createDataFrame([("g", "1", 0, "abcd"), ("g", "2", 1, "abxd"), ("g", "3", 2, "abcd"), ("h", "4", 3, "solo")], "group_id string, ID string, pos long, text string")
    assert [tuple(r) for r in C.pick_consensus(m).collect()] == [("g", "abcd")]
    assert [tuple(r) for r in C.alignment_consensus(m).collect()] == [("g", "abcd")]
    assert one_null(C.median_distances(m))


def test_consensus_equals_local_form(spark, monkeypatch):
    texts = {"g": ["abcd", "abxd", "abcd", "bcd", None, ""], "h": ["ab", "ba"], "i": ["Wald 3", "Walde 3", "Wald  3.", "Wald 3", "ald 3"] * 3, "j": ["solo"]}
    rows = [(g, f"{g}{n}", n, t) for g, lines in texts.items() for n, t in enumerate(lines)]
    m = spark.createDataFrame(rows, "group_id string, ID string, pos long, text string")
    want = {g: C.aligned_consensus([t or "" for t in lines]) for g, lines in texts.items() if len(lines) > 1}
    assert {r.group_id: r.consensus for r in C.alignment_consensus(m).collect()} == want
    monkeypatch.setattr(C, "PART_TEXTS", 2)  # groups in several parts
    for r in C.median_distances(m.filter("group_id in ('h', 'i') and text is not null"), simplified=False).collect():
        d = C.distances(texts[r.group_id])[r.pos]
        others = [x for i, x in enumerate(d) if i != r.pos]
        assert abs(r.median - sorted(others)[len(others) // 2]) < 1e-9 if len(others) % 2 else abs(r.median - sum(sorted(others)[len(others) // 2 - 1 : len(others) // 2 + 1]) / 2) < 1e-9


def one_null(df):
    return [r.ID for r in df.filter("median is null").collect()] == ["4"]


def test_corpus_and_masks(spark):
    df = spark.createDataFrame([("x1y", None)], "a string, b string")
    assert df.select(T.corpus(df, ["a", "b"], {"a": "[0-9]"}).alias("v")).first().v == "xy\n"


def test_few_rows_score_as_joins_do(spark, monkeypatch):
    """Either side may be the small one, or none; no pairs are gathered where one is."""
    from labelloom.operators import small

    r = random.Random(9)
    words = ["".join(r.choice("abc") for _ in range(r.randint(3, 9))) for _ in range(40)]
    docs = [" ".join(r.choice(words) for _ in range(r.randint(0, 14))) for _ in range(25)]
    asked = labels(spark, [" ".join(r.choice(words) for _ in range(8)) for _ in range(12)]).select(F.col("ID").alias("query_id"), F.col("text").alias("query"))
    for options, fuzzy, scoring in ((Options(1, 3), True, "w+l"),):
        index, got = make_index(labels(spark, docs).select("ID", "text"), options), []
        for rows in (100, 20, 0):  # documents are few, queries are few, neither is
            monkeypatch.setattr(small, "SMALL_ROWS", rows)
            got.append({(x.query_id, x.ID): round(x.score, 9) for x in search(asked, index, scoring, fuzzy).collect()})
        assert got[0] == got[1] == got[2] and len(got[0]) > 50
    monkeypatch.setattr(small, "SMALL_ROWS", 100)
    plan = search(asked, make_index(labels(spark, docs).select("ID", "text"), Options(1, 3)), fuzzy=False)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and "Join" not in plan


def test_few_queries_are_the_small_side_of_documents_with_many_tokens(spark, monkeypatch):
    """few documents with too many tokens must not send few queries through the joins, nor do few tasks compare the texts."""
    from labelloom.operators import small

    docs = [" ".join(f"word{i % 7}" if j else f"own{i}" for j in range(12)) for i in range(30)]
    asked = labels(spark, docs[:4]).select(F.col("ID").alias("query_id"), F.col("text").alias("query"))
    index = make_index(labels(spark, docs).select("ID", "text"), Options(1, 3))
    for scoring in ("w", "l"):
        want = {(x.query_id, x.ID): round(x.score, 9) for x in search(asked, index, scoring).collect()}
        with monkeypatch.context() as m:
            m.setattr(small, "SMALL_TOKENS", 50)  # of the queries 48
            found = search(asked, index, scoring)
            assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
            assert {(x.query_id, x.ID): round(x.score, 9) for x in found.collect()} == want and len(want) > 20
            if scoring == "l":
                assert found.rdd.getNumPartitions() >= 32


def test_weights_are_computed_in_as_many_tasks_as_rows_need(spark, monkeypatch):
    """the rows that one task sorts by ID do not grow with the table."""
    from labelloom.operators import index as module

    docs = labels(spark, [f"alpha beta{i % 5} gamma{i} alpha" for i in range(40)]).select("ID", "text")
    want = {(x.ID, x.token, x.tf, round(x.w, 9)) for x in make_index(docs, Options(2, 3)).postings.collect()}
    monkeypatch.setattr(module, "TASK_ROWS", 10)
    found = make_index(docs, Options(2, 3)).postings
    assert found.rdd.getNumPartitions() == 12 and {(x.ID, x.token, x.tf, round(x.w, 9)) for x in found.collect()} == want


def test_distances_of_many_texts_at_once():
    from labelloom.operators.small import Texts

    r = random.Random(10)
    texts = ["".join(r.choice("abcé") for _ in range(r.randint(0, 90))) for _ in range(30)]
    for text in (*texts[:10], "", "x" * 200):
        assert Texts(texts).distances(text, np.arange(30)).tolist() == [C.edit_distance(text, t) for t in texts]


def test_distances_to_many_texts_and_weighted_medians():
    r = random.Random(11)
    texts = sorted(("".join(r.choice("abcé") for _ in range(r.randint(0, n))) for n in (5, 20, 63, 90) for _ in range(15)), key=len)
    for text in (*texts, "x" * 63, "x" * 64):
        want = [C.edit_distance(text, t) / max(len(text), len(t), 1) for t in texts]
        assert C.distances_to(text, C.Coded(texts)).tolist() == want
    values, weights = np.array([0.5, 0.1, 0.9]), np.array([1, 2, 3])
    assert C.weighted_median(values, weights) == np.median(np.repeat(values, weights)) and C.weighted_median(values, weights * 0) is None


def test_medians_of_a_group_are_dealt_over_tasks(spark):
    m = spark.range(600).select(F.lit("g").alias("group_id"), F.col("id").alias("ID"), F.col("id").alias("pos"), F.concat(F.lit("name "), "id").alias("text"))
    med = C.median_distances(m)
    parts = med._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in parts and "levenshtein" not in parts
    assert med.filter("median is null").count() == 0


def test_tokens_are_counted_id_by_id(spark):
    """No hash table of all tokens of a task; rows with the same ID count together, over the ends of batches too."""
    rows = [(i % 40, f"aaa b{i % 7}bb aaa") for i in range(200)] + [(99, None), (98, "")]
    df = spark.createDataFrame(rows, "ID long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        counts = token_counts(df, Options(1, 3))
        got = {(r.ID, r.token): r.tf for r in counts.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = Counter((i, t) for i, text in rows for t in (text or "").split())
    assert got == dict(want)
    assert "Aggregate" not in counts._jdf.queryExecution().executedPlan().toString()


def test_hits_and_highest_scores_come_from_one_pass(spark):
    """TF-IDF postings that are not stored are shuffled twice, by token and by ID, and not again for norms, highest scores or hits."""
    docs = spark.createDataFrame([(i, f"word{i % 5} other{i} same") for i in range(50)], "ID long, text string")
    index = make_index(docs, Options(2, 3))
    plan = index.max_scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ID") == 1, plan
    queries = spark.createDataFrame([(1, "word1 other1 same"), (2, "nothing here")], "query_id long, query string")
    for options in (dict(), dict(threshold=0.5), dict(condition=F.col("ID") < 9)):
        one = {(r.query_id, r.ID): round(r.score, 9) for r in search(queries, index, fuzzy=False, **options).collect()}
        other = {(r.query_id, r.ID): round(r.score, 9) for r in search(queries, index.saved(), fuzzy=False, **options).collect()}
        assert one == other and one[1, 1] == 1.0


def test_exact_pairs_that_share_only_a_rare_word_are_not_candidates(spark, monkeypatch):
    """Bounds drop them in the join; scores of the rest are those without a threshold."""
    from labelloom.operators import search as R
    from labelloom.operators import small

    monkeypatch.setattr(small, "SMALL_ROWS", -1)
    rng = random.Random(5)
    texts = [" ".join(["rare" + str(i // 2)] + [f"word{rng.randrange(30)}" for _ in range(9)]) for i in range(30)]
    texts += [t + " tail" for t in texts[:5]] + [t.replace("word1", "other", 1) for t in texts[5:12]] + ["", "word1 word1 word1 word1", "word1 word1 word1"]
    df = spark.createDataFrame(list(enumerate(texts)), "ID long, text string")
    index = make_index(df, Options(2, 3)).saved()
    q = df.select(F.col("ID").alias("query_id"), F.col("text").alias("query"))
    near = R.query_tokens(q, 3).withColumns({"token": F.col("q"), "identity": F.lit(1.0)})
    own = F.col("query_id") != F.col("ID")
    pairs = {tuple(r) for r in R._exact_candidates(near, index.postings, 0.8, index.max_scores, own).collect()}
    every = {(r.query_id, r.ID): r.score for r in search(q, index, fuzzy=False, exclude_self=True).collect()}
    want = {p: s for p, s in every.items() if s >= 0.8}
    got = {(r.query_id, r.ID): r.score for r in search(q, index, fuzzy=False, exclude_self=True, threshold=0.8).collect()}
    assert len(want) >= 5 and set(got) == set(want) <= pairs and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert (0, 1) not in pairs and len(pairs) < 3 * len(want)


def test_more_near_pairs_than_tasks_may_hold(spark, monkeypatch):
    """F3 F7 F8: many near pairs must not send a search with one small side through the joins; each part gets those of its own tokens."""
    from labelloom.operators import small

    r = random.Random(4)
    words = ["".join(r.choice("abc") for _ in range(r.randint(3, 9))) for _ in range(60)]
    docs = [" ".join(r.choice(words) for _ in range(r.randint(0, 14))) for _ in range(40)] + ["zzzzzz qqqqqq"] * 3
    asked = labels(spark, docs[:12] + ["", "xxxxxx"]).select(F.col("ID").alias("query_id"), F.col("text").alias("query"))
    index = make_index(labels(spark, docs).select("ID", "text"), Options(1, 3))
    for rows, scoring in ((100, "w"), (20, "w"), (20, "l")):  # documents are few, queries are few
        monkeypatch.setattr(small, "SMALL_ROWS", rows)
        want = {(x.query_id, x.ID): round(x.score, 9) for x in search(asked, index, scoring).collect()}
        with monkeypatch.context() as m:
            m.setattr(small, "NEAR_PAIRS", 10)
            found = search(asked, index, scoring)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" in plan and "Window" not in plan
            assert {(x.query_id, x.ID): round(x.score, 9) for x in found.collect()} == want and len(want) > 100
