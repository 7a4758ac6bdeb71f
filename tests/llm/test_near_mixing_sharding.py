"""Near duplicates, mixing, sharding, decontamination against brute force, and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import decontaminate, mixing, setsketch, sharding
from labelloom.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "one", "en", "b", 3), (5, "one", "en", "b", 3), (5, "one", "en", "b", 3), (None, "no id here", "de", None, 9)]


def vocabulary(r, n=400):
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


def corpus(seed, n=120):
    """Texts with near copies at various distances, exact copies and long texts."""
    r = random.Random(seed)
    words = vocabulary(r)
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.6:
            t = r.choice(texts).split()
            for _ in range(r.randint(0, max(1, len(t) // 12))):
                t[r.randrange(len(t))] = r.choice(words)
            texts.append(" ".join(t))
        else:
            texts.append(" ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 30, 60, 200, 3000]))))
    return texts


def rows_of(texts):
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def shingle_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(rows, width):
    sets = {i: shingle_set(t, width) for i, t, *_ in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return {i: (len(sets[i]), label[i]) for i in ids}


@pytest.mark.parametrize(("seed", "width"), [(1, 2), (2, 5)])
def test_components_equal_brute_force(spark, seed, width):
    rows = rows_of(corpus(seed))
    got = setsketch.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_group_of_near_copies_is_linked_across_buckets(spark):
    r = random.Random(9)
    words = vocabulary(r)
    base = [r.choice(words) for _ in range(150)]
    rows = []
    for i in range(250):
        t = list(base)
        for _ in range(r.randint(0, 9)):
            t[r.randrange(150)] = f"x{r.random()}"
        rows.append((i, " ".join(t), "en", "a", 0))
    got = {x.doc_id: x.component_id for x in setsketch.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), 2).collect()}
    assert got == {k: v[1] for k, v in brute_components(rows, 2).items()}


def test_components_with_blocks_and_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 3)  # many parts, and many keys above the cut
    monkeypatch.setattr(setsketch, "SHARES", 50)
    rows = rows_of(corpus(4))
    got = setsketch.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), 2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 2)


def test_one_id_with_several_texts_is_defined(spark):
    r = random.Random(31)
    words = vocabulary(r)
    texts = [" ".join(r.choice(words) for _ in range(80)) for _ in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[0]), (2, texts[0] + " x"), (3, texts[1] + " x"), (4, texts[2]), (4, texts[2]), (5, texts[2] + " y"), (6, " ".join(r.choice(words) for _ in range(30_000)))]
    rows = [(i, t, "en", "a", 0) for i, t in rows]
    got = [sorted(map(tuple, setsketch.near_duplicates(spark, spark.createDataFrame(rows[::k], SCHEMA).repartition(3), 2).collect())) for k in (1, -1)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert {x[2] for x in got[0] if x[0] in (4, 5)} == {4} and [x[3] for x in got[0] if x[0] == 6] == [True]


def test_sketch_properties():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 2**63, 3000).astype(np.uint64), r.integers(0, 2**63, 1000).astype(np.uint64)
    x, y = setsketch.registers(a), setsketch.registers(np.concatenate([a[1000:], b]))
    assert (np.maximum(x, setsketch.registers(b)) == setsketch.registers(np.concatenate([a, b]))).all()  # merge by maximum
    got = setsketch.likely_similarity(x[None], y[None], np.array([3000.0]), np.array([3000.0]))[0]
    assert abs(got - 0.5) < 0.15


def test_near_duplicates_edge_cases(spark):
    got = setsketch.near_duplicates(spark, spark.createDataFrame(EDGES, SCHEMA).withColumn("kept", F.lit(1)).withColumn("rep", F.lit(2)), 2).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in got) == [(-1, 2, -1, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False)]
    assert setsketch.near_duplicates(spark, spark.createDataFrame([], SCHEMA), 2).count() == 0


def test_mixing_targets_and_limits(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 40))), "en", r.choice(["a", "a", "a", "b", "c", "d", None]), 0) for i in range(900)] + [(5000, "x y z", "en", "tiny", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixed(spark, docs).collect()
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    source = {i: s for i, _, _, s, _ in rows}
    names = sorted({s for s in source.values() if s}) + [None]
    sizes = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    weights = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while True:  # share by weight, fix what exceeds its ceiling, repeat
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 3 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * weights[s] for s in open_}
    taken = dict.fromkeys(names, 0)
    for x in got:
        assert x.size == size[x.doc_id] and x.source_size == sizes[source[x.doc_id]]
        assert abs(x.target - target[source[x.doc_id]]) < 1e-5
        assert 0 <= x.taken <= 3 * x.size
        assert x.position is None or 0 <= x.position <= 1
        taken[source[x.doc_id]] += x.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(got, key=str) == sorted(mixing.mixed(spark, docs.repartition(7)).collect(), key=str)  # reruns agree
    copies = {}
    for x in mixing.mix(spark, docs).collect():
        copies[x.doc_id] = copies.get(x.doc_id, 0) + 1
    assert all(n <= 3 for n in copies.values())
    assert all(abs(sum(copies.get(i, 0) * size[i] for i in size if source[i] == s) - target[s]) <= 40 for s in names)


def test_positions_invert_the_integral():
    def demand(t, slope):
        return t + slope * (t * t - t)

    for slope in (*mixing.SLOPES, -0.9, 0.9):
        for share in (0.1, 0.5, 0.9, 1.0):
            rest = 1 - slope
            t = 2 * share / (rest + (rest * rest + 4 * slope * share) ** 0.5)
            assert abs(demand(t, slope) - share) < 1e-12


def test_mix_reads_the_same_share_at_every_time(spark):
    r = random.Random(14)
    docs = spark.createDataFrame([(i, " ".join("w" for _ in range(r.randint(20, 40))), "en", "abc"[i % 3], 0) for i in range(3000)], SCHEMA)
    total = sum(x.taken for x in mixing.mixed(spark, docs).collect())
    targets = {}
    for x in mixing.plan(spark, docs).select("source", "target", "slope").distinct().collect():
        targets[x.source] = (x.target, x.slope)
    assert abs(sum(t * s for t, s in targets.values())) < 1e-3 * total and len({s for _, s in targets.values()}) == 3
    order = [x.source for x in mixing.mix(spark, docs).collect()]
    half = len(order) // 2  # a rising source is read later
    assert order[:half].count("a") > order[half:].count("a") and order[:half].count("c") < order[half:].count("c")


def test_mix_with_repeated_and_missing_ids(spark):
    rows = [(None, f"text number {i} " + "w " * 30, "en", "a", 0) for i in range(40)] + [(7, "the same words here " * 5, "en", "a", 0)] * 5 + [(8, f"b {i} " * 9, "en", "b", 0) for i in range(20)] + [(9, "long " * 50_000, "en", "b", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    copies = {}
    for x in mixing.mix(spark, docs).collect():
        copies[x.text] = copies.get(x.text, 0) + 1
    assert all(n <= 3 for t, n in copies.items() if not t.startswith("the same")) and copies["the same words here " * 5] <= 15
    four = spark.createDataFrame([(None, f"t{i} words", "en", "a", 0) for i in range(4)], SCHEMA)
    assert mixing.mix(spark, four).count() == 4


def test_mixing_edge_cases(spark):
    docs = spark.createDataFrame(EDGES, SCHEMA).withColumn("_id", F.lit(7)).withColumn("size", F.lit(9)).withColumn("bucket", F.lit("x"))
    assert mixing.mixed(spark, docs).count() == len(EDGES)
    assert mixing.mix(spark, docs).columns == docs.columns
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mixed(spark, empty).count() == 0 and mixing.mix(spark, empty).count() == 0


def test_bins_match_a_plain_best_fit():
    r = random.Random(1)
    for _ in range(20):
        sizes = [r.randint(1, 60) for _ in range(200)]
        capacity = r.randint(60, 300)
        rooms, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(room, k) for k, room in enumerate(rooms) if room >= sizes[i]]
            if fits:
                k = min(fits)[1]
            else:
                k = len(rooms)
                rooms.append(capacity)
            rooms[k] -= sizes[i]
            want[i] = k
        assert sharding.best_fit_decreasing(sizes, capacity) == want


def test_runs_equal_one_by_one_and_the_capacity_is_tight():
    r = random.Random(4)
    for _ in range(30):
        items = [(size, r.randint(1, 9)) for size in r.sample(range(1, 90), 40)]
        capacity = r.randint(90, 400)
        runs = sharding.best_fit_runs(items, capacity)
        ordered = sorted(items, reverse=True)
        one_by_one = sharding.best_fit_decreasing([s for s, n in ordered for _ in range(n)], capacity)
        assert [b for i in sorted(range(len(items)), key=lambda i: -items[i][0]) for b, k in runs[i] for _ in range(k)] == one_by_one
        shards = r.randint(2, 6)
        total, found = sum(s * n for s, n in items), sharding.pack(items, shards)
        loads = [0] * shards
        for (s, n), parts in zip(items, found, strict=True):
            assert sum(k for _, k in parts) == n  # a run for each bin
            for b, k in parts:
                loads[b] += s * k
        assert sum(loads) == total and max(loads) <= -(-total // shards) + 90


def brute_shards(texts, n_shards):
    """Loads of the shards if every group is packed by itself."""
    sizes = {}
    for t in texts:
        sizes[t] = sizes.get(t, 0) + len((t or "").encode()) + 1
    capacity = 1
    while True:  # the smallest capacity, by trying all from a third of the mean
        capacity = max(capacity + 1, sum(sizes.values()) // n_shards // 3)
        bins = sharding.best_fit_decreasing(list(sizes.values()), capacity)
        if max(bins) < n_shards:
            break
    loads = [0] * n_shards
    for b, v in zip(bins, sizes.values(), strict=True):
        loads[b] += v
    return sorted(loads)


def test_every_group_is_packed(spark, monkeypatch):
    r = random.Random(41)
    texts = ["x" * r.choice([3, 3, 3, 9, 20, 200, 700]) + str(i) for i in range(900)] + ["copy"] * 300 + [None] * 30 + ["big " * 900]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    for pieces, bucket in ((256, 4000), (2, 30)):  # most groups alone; nearly all by size
        monkeypatch.setattr(sharding, "PIECES", pieces)
        monkeypatch.setattr(sharding, "BUCKET_GROUPS", bucket)
        loads = [0] * 4
        of_text = {}
        for x in sharding.shards(spark, docs, n_shards=4).collect():
            loads[x.shard] += x.size
            of_text.setdefault(texts[x.doc_id], set()).add(x.shard)
        assert sorted(loads) == brute_shards(texts, 4) and all(len(v) == 1 for v in of_text.values())
    sizes = [1, 65_535, 65_536, 65_537, 10**6, 10**12 + 7]
    got = [x.c for x in spark.createDataFrame([(s,) for s in sizes], "s long").select(sharding.size_class(F.col("s")).alias("c")).collect()]
    assert got[:3] == sizes[:3] and all(s <= c <= 1.004 * s for s, c in zip(sizes, got, strict=True))


def test_shards(spark):
    r = random.Random(2)
    texts = ["copied text " * 20] * 700 + ["é" * r.randint(0, 300) + str(r.random()) for _ in range(1500)] + ["long " * 5000]
    rows = rows_of(texts)
    got = sharding.shards(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(x.doc_id for x in got) == list(range(len(rows)))
    by_shard, of_text = {}, {}
    for x in got:
        data = texts[x.doc_id].encode()
        assert (x.size, x.text_crc32, x.law, x.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        by_shard.setdefault(x.shard, []).append(x)
        of_text.setdefault(texts[x.doc_id], set()).add(x.shard)
    assert all(len(s) == 1 for s in of_text.values())
    assert set(by_shard) <= set(range(16))
    assert all(sorted(x.slot for x in xs) == list(range(len(xs))) for xs in by_shard.values())
    loads = [sum(x.size for x in xs) for xs in by_shard.values()]
    hot = len("copied text " * 20) * 700 + 700
    rest = [v for v in loads if v < hot]
    assert max(rest) <= 1.05 * max(sum(loads) / 16, 25001)


def test_shards_edge_cases(spark):
    docs = spark.createDataFrame(EDGES, SCHEMA).withColumn("shard", F.lit(1)).withColumn("slot", F.lit(1))
    got = sharding.shards(spark, docs, tuple(docs.columns)).collect()
    assert len(got) == len(EDGES)
    assert [x.text_crc32 for x in got if x.text is None] == [None]
    assert {x.input_shard for x in got} == {x.input_slot for x in got} == {1}  # columns of the input stay
    assert sharding.shards(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def brute_hits(doc, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    w, hit, names = words(doc), set(), set()
    for name, text in items:
        x = words(text)
        n = min(window, len(x))
        for j in range(max(len(x) - window, 0) + 1 if x else 0):
            g = x[j : j + n]
            for i in range(len(w) - n + 1):
                if w[i : i + n] == g:
                    hit |= set(range(i, i + n))
                    names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_decontamination_equals_brute_force(spark, monkeypatch):
    r = random.Random(8)
    words = ["a", "b", "c", "dé", "E9"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 2, 4, 9, 10, 11, 25])))) for i in range(25)] + [(99, None), (100, "..."), (3, "a b c a b c a b c a b c")]
    docs = [(i, " ".join(r.choice(words + ["unknown"] * (i % 3)) for _ in range(r.randint(0, 120)))) for i in range(60)]
    docs += [(200, "x " + items[5][1].upper().replace(" ", ", ") + " y"), (201, None), (202, ""), (202, items[6][1]), (None, "no id " + items[5][1]), (203, "unknown " * 50_000 + items[5][1]), (204, "x " + items[9][1].replace(" ", ", ") + " y")]
    item_df = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((d, *brute_hits(t, items)) for d, t in docs), key=str)
    doc_df = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.digest(decontaminate.contamination(spark, doc_df, item_df)).collect()
    assert sorted(map(tuple, got), key=str) == want
    monkeypatch.setattr(decontaminate, "MAX_WORDS", 40)  # only what may occur, in several automata
    some = decontaminate._occurring(item_df.select(F.col("item_id").cast("string"), "text"), doc_df.filter("doc_id = 204"), 10).select("item_id").collect()
    assert {"9"} <= {r.item_id for r in some} and "99" not in {r.item_id for r in some}
    got = decontaminate.digest(decontaminate.contamination(spark, doc_df, item_df)).collect()
    assert sorted(map(tuple, got), key=str) == want
    clashing = doc_df.limit(3).withColumn("spans", F.lit(1)).withColumn("items", F.lit("x")).withColumn("n_words", F.lit(0))
    assert decontaminate.digest(decontaminate.contamination(spark, clashing, item_df)).count() == 3
    assert decontaminate.digest(decontaminate.contamination(spark, doc_df.limit(0), item_df)).count() == 0


def test_decontamination_removes_documents_and_spans(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"before {item}, after", 1), (2, "clean text", 2), (3, None, 3)], "doc_id long, text string, spans int")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.remove(spark, docs, items).collect()) == [2, 3]
    assert decontaminate.remove(spark, docs, items).columns == docs.columns
    assert {r.doc_id: r.text for r in decontaminate.remove(spark, docs, items, max_share=0.9).collect()} == {1: "before , after", 2: "clean text", 3: None}
    assert decontaminate.remove(spark, docs, items, max_share=0.5).count() == 2  # eleven of thirteen words are hit
    found = decontaminate.contamination(spark, docs.select("doc_id", "text"), items).filter("doc_id = 1").first()
    assert decontaminate.cut_spans(f"before {item}, after", found.spans) == "before , after"
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove(spark, docs, none).count() == 3
    prepare(spark)
