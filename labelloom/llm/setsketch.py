"""Near-duplicate detection with SetSketch registers.

A document's set of word shingles is summarised by ``m`` registers
``floor(1 - log_b(x_i))``, with ``x_i`` the smallest of the exponential values
that hash ``i`` gives the set's elements.  Registers are mergeable by maximum and
locality-sensitive: two equal ones have about the probability of the Jaccard
similarity.  Bands of registers propose pairs; the joint likelihood of the
registers of two documents estimates the similarity; pairs that pass are
confirmed on their full sets.

Plan: documents of equal sets form a class, and only class representatives take
part.  Each is first paired with the smallest id that shares a band bucket with
it, not with all members, and components are formed.  For that, sets are dealt by
pivot, those of a large group over several tasks, and the pivot's set passes once a
task, so each member's set moves once.  Members of buckets that
still hold several components are then paired across components, where the rare
elements of their full sets leave the threshold possible (prefix principle), so
that no link that shares a bucket is lost and no group is paired with itself.
Keys that hold more than 1/``SHARES`` of a table's rows (there are at most ``SHARES``
such keys, whatever the table) are joined by a broadcast and their pairs are dealt
in blocks, so no key is one task.
Components come from alternating large and small stars over written tables;
nothing about documents reaches the driver but counts.

Defined results: null, empty and blank texts have the empty set, are linked with
nothing and are kept; rows sharing a ``doc_id`` are one document, whose set, if their
texts differ, is the one with the smallest fingerprint; a row without ``doc_id`` goes to
the class of its equals, else it is kept; very long texts are read whole; an empty
table gives an empty result; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Space, prepare

#: Parameters of the sketch (base, rate, largest value) after the SetSketch paper.
BASE, RATE, LIMIT = 1.001, 20.0, 2**16 - 2
BANDS, ROWS = 32, 5
#: Members of a pivot, and rows of a key, that one task compares; keys above 1/SHARES of all rows are joined apart.
BLOCK, SHARES = 1000, 4096
#: Ids whose texts are looked up by a broadcast (16 bytes of fingerprint and a few numbers each); more are joined by a shuffle of the texts.
SMALL = 400_000
#: A pair goes on to the exact test if its estimate is at most so many standard errors below the threshold.
SLACK = 5.0

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX2
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``width``-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(width, n)
    out = mix(h[: n - k + 1] + np.uint64(k))
    for i in range(1, k):
        out = mix(out * _MIX + h[i : n - k + 1 + i])
    return np.unique(out)


def registers(elements: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set of hashes."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(elements), 512):
        x = elements[i : i + 512, None] * _A
        x += _C
        np.minimum(least, x.min(axis=0), out=least)
    x = -np.log1p(-np.clip((least.astype(np.float64) + 0.5) / 2.0**64, 1e-300, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1.0 - np.log(x) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def likely_similarity(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs, from both sketches together and known set sizes."""
    above = (regs_a > regs_b).sum(axis=1)
    below = (regs_a < regs_b).sum(axis=1)
    same = regs_a.shape[1] - above - below
    u = n_a / (n_a + n_b)
    v = 1 - u

    def p(x):
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    def slope(x):
        return (BASE - 1) / BASE / (1 - x * (BASE - 1) / BASE) / np.log(BASE)

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    top = hi.copy()
    for _ in range(30):  # the log-likelihood is concave in J: bisect its derivative
        j = (lo + hi) / 2
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        px, py = np.maximum(p(x), 1e-12), np.maximum(p(y), 1e-12)
        d = -above * v * slope(x) / px - below * u * slope(y) / py + same * (v * slope(x) + u * slope(y)) / np.maximum(1 - px - py, 1e-12)
        lo, hi = np.where(d > 0, j, lo), np.where(d > 0, hi, j)
    return np.minimum((lo + hi) / 2, top)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fingerprint(s: np.ndarray) -> bytes | None:
    """128 bits of a set; None for the empty one."""
    return np.array([s.sum(dtype=np.uint64), mix(s * _MIX).sum(dtype=np.uint64)]).tobytes() if len(s) else None


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, fp (128 bits of the set), regs (registers, 16 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fps, regs = [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py(), width)
                n.append(len(s))
                fps.append(fingerprint(s))
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "fp", "regs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, fp binary, regs binary")


def _sets(docs: DataFrame, wanted: DataFrame, width: int, repeated: bool) -> DataFrame:
    """``wanted`` (id, fp and more) and elements, the whole set: one row for each id.

    Of the rows of an id those with the fingerprint count; if ids are ``repeated``, one of them.
    """
    schema = f"{', '.join(f'{n} {t}' for n, t in wanted.dtypes if n != 'fp')}, elements array<long>"
    rest = [c for c in wanted.columns if c != "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), width) for t in batch.column("text")]
            keep = [fingerprint(s) == fp for s, fp in zip(sets, batch.column("fp").to_pylist(), strict=True)]
            sets = [s.view(np.int64) for s, k in zip(sets, keep, strict=True) if k]
            batch = batch.filter(pa.array(keep, pa.bool_()))
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *sets])))], [*rest, "elements"])

    found = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).join(wanted, "id").mapInArrow(run, schema)
    return found.dropDuplicates(["id"]) if repeated else found


def _joined(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` (with ``id``) and the columns of ``table`` (one row a ``key``, a number or bytes, with the number of rows that have it).

    Keys with more than ``total / SHARES`` rows are few whatever the tables' sizes; they are
    broadcast, and their rows stay where they are.
    """
    cut = max(BLOCK, total // SHARES)
    hot, rest = table.filter(F.col(count) > cut), table.filter(F.col(count) <= cut)
    names = [c for c in table.columns if c != key]
    out = rows.join(F.broadcast(hot.select(key, *[F.col(c).alias(f"_h_{c}") for c in names])), key, "left")
    other = F.xxhash64("id", key)
    if dict(rows.dtypes)[key] == "binary":
        other = F.unhex(F.sha1(other.cast("string").cast("binary")))
    out = out.withColumn("_k", F.when(F.col(f"_h_{count}").isNull(), F.col(key)).otherwise(other))
    out = out.join(rest.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_c_{c}") for c in names]), "_k", "left")
    found = out.select(*[F.col(c) for c in rows.columns], *[F.when(F.col(f"_h_{count}").isNotNull(), F.col(f"_h_{c}")).otherwise(F.col(f"_c_{c}")).alias(c) for c in names])
    return found.filter(F.col(count).isNotNull())


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose joint estimate leaves the threshold possible."""
    a = reps.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("regs").alias("regs_a"))
    b = reps.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("regs").alias("regs_b"))
    least = percent / 100 - SLACK * (percent / 100 * (1 - percent / 100) / (BANDS * ROWS)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("regs_a", "regs_b")]
                y = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b")]
                batch = batch.filter(pa.array(likely_similarity(*x, *y) >= least))
            yield batch.select(["a", "b"])

    fits = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    return pairs.join(b, "b").join(a, "a").filter(fits).mapInArrow(run, "a long, b long")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sets of distinct elements."""
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that reach the similarity on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("set_a"), batch.column("set_b")
            (xv, xo), (yv, yo) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (x, y))
            keep = [_alike(xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]], percent) for i in range(batch.num_rows)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    a, b = sets.select(F.col("id").alias("a"), F.col("elements").alias("set_a")), sets.select(F.col("id").alias("b"), F.col("elements").alias("set_b"))
    return pairs.join(b, "b").join(a, "a").mapInArrow(run, "a long, b long")


def _confirmed_stars(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members and their pivots that reach the similarity on their full sets.

    ``sets``: id, pivot (null without one), parts (tasks over which the pivot's members
    are dealt), own_parts (the same for the id itself, null if it is no pivot), elements.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, None
        for batch in batches:
            c = batch.column("elements")
            values, ends = c.values.to_numpy(), c.offsets.to_numpy()
            a, b = [], []
            for i, (key, flag, x) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("key", "flag", "id")), strict=True)):
                elements = values[ends[i] : ends[i + 1]]
                if flag == 0:
                    pivot, own = key, elements.copy()
                elif key == pivot and _alike(own, elements, percent):
                    a.append(x)
                    b.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    members = sets.filter("pivot is not null").select(F.col("pivot").alias("key"), F.pmod(F.xxhash64("id"), "parts").alias("part"), F.lit(1).alias("flag"), "id", "elements")
    pivots = sets.filter("own_parts is not null").select(F.col("id").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("own_parts") - 1)).alias("part"), F.lit(0).alias("flag"), "id", "elements")
    return members.union(pivots).repartition("key", "part").sortWithinPartitions("key", "part", "flag").mapInArrow(run, "a long, b long")


def _shared_prefix(members: DataFrame, sets: DataFrame, percent: int, space: Space) -> DataFrame:
    """Pairs (a, b) of different components that can reach the threshold, by the prefix principle.

    ``members``: id, c, n.  Elements are ordered: first those that only one component has,
    which propose nothing, then the others by rarity.  In any such order two sets of the
    wanted similarity share one of the first ``n - ceil(percent% of n) + 1`` of
    either, and the ranks of the first one they share bound what they can share.
    """
    elements = sets.select("id", "elements").join(members.select("id", "c"), "id").select("id", "c", F.explode("elements").alias("e"))
    total = members.agg(F.sum("n").alias("n")).first()["n"] or 0
    common = space.save(elements.groupBy("e").agg(F.count("*").alias("df"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("e", "df"))
    shared = _joined(elements.select("id", "e"), common, "e", "df", total)
    own = Window.partitionBy("id")
    ranked = shared.withColumn("r", F.row_number().over(own.orderBy("df", "e"))).withColumn("k", F.count("*").over(own)).join(members, "id").withColumn("r", F.col("n") - F.col("k") + F.col("r"))
    prefix = space.save(ranked.filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("e", "id", "c", "n", "r"))
    mixed = space.save(prefix.groupBy("e").agg(F.count("*").alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("e", "k"))
    prefix = _joined(prefix, mixed, "e", "k", prefix.count()).withColumn("parts", F.ceil(F.col("k") / BLOCK))
    x = prefix.select("e", F.pmod(F.xxhash64("id"), "parts").alias("part"), *(F.col(c).alias(f"{c}_a") for c in ("id", "c", "n", "r")))
    y = prefix.select("e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(f"{c}_b") for c in ("id", "c", "n", "r")))
    # if this is the first shared element, no more than what follows it can be shared
    most = 1 + F.least(F.col("n_a") - F.col("r_a"), F.col("n_b") - F.col("r_b"))
    fits = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent) & (most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
    return x.join(y, ["e", "part"]).filter((F.col("id_a") < F.col("id_b")) & (F.col("c_a") != F.col("c_b")) & fits).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def components(edges: DataFrame, space: Space) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component), component the smallest id; roots have no row.

    Alternating large-star and small-star steps; each step aggregates before it
    joins and is written to the shared folder.
    """
    e = space.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        roots = e.select(F.col("v").alias("u")).distinct()
        stats = e.join(roots.withColumn("inner", F.lit(1)), "u", "left").agg(F.count("*").alias("n"), F.count("inner").alias("inner"), F.count_distinct("u").alias("ids")).first()
        if not stats["inner"] and stats["n"] == stats["ids"]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        e, old = space.save(small), e
        space.drop(old)


def _labelled(rows: DataFrame, column: str, found: DataFrame, name: str) -> DataFrame:
    """``rows`` with the component of ``column``; an id without a row is its own component."""
    return rows.join(found.select(F.col("id").alias(column), F.col("component").alias("_c")), column, "left").withColumn(name, F.coalesce("_c", column)).drop("_c")


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``."""
    prepare(spark)
    space = Space(spark, "setsketch")
    sketches = space.save(sketch(docs, width))
    some = sketches.filter("n_shingles > 0")
    classes = space.save(some.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")))
    of_class = _joined(some.select(F.col("doc_id").alias("id"), "n_shingles", "fp"), classes, "fp", "k", sketches.count()).select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("rep", "id").alias("rep"))
    member = space.save(of_class.unionByName(sketches.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("rep"))))
    chosen = member.filter("n_shingles > 0").select(F.col("rep").alias("doc_id")).distinct()
    named = sketches.filter("n_shingles > 0").join(chosen, "doc_id", "left_semi").groupBy("doc_id")
    reps = space.save(named.agg(F.min_by(F.struct("fp", "n_shingles", "regs"), "fp").alias("s"), F.count("*").alias("rows")).select("doc_id", "s.*", "rows"))
    space.drop(sketches, classes)
    repeated = not reps.filter("rows > 1").isEmpty()

    # buckets: (band, its registers) -> members
    size = ROWS * 2
    keys = reps.select(F.col("doc_id").alias("id"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("regs", i * size + 1, F.lit(size))))).alias("key"))
    shared = space.save(keys.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("k")).filter("k > 1"))
    buckets = space.save(_joined(keys, shared, "key", "k", reps.count() * BANDS).select("id", "key", "pivot"))

    # one pair for each document first: most groups are found so
    ids = buckets.groupBy("id").agg(F.min(F.when(F.col("id") != F.col("pivot"), F.col("pivot"))).alias("pivot"))
    ids = space.save(ids)
    stars = space.save(_likely(ids.filter("pivot is not null").select(F.col("id").alias("a"), F.col("pivot").alias("b")), reps, percent))
    parts = stars.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    wanted = ids.select("id").join(stars.join(parts, "b").select(F.col("a").alias("id"), F.col("b").alias("pivot"), "parts"), "id", "left")
    wanted = wanted.join(parts.select(F.col("b").alias("id"), F.col("parts").alias("own_parts")), "id", "left").join(reps.select(F.col("doc_id").alias("id"), "fp"), "id")
    wanted = space.save(wanted)
    sets = space.save(_sets(docs, F.broadcast(wanted) if wanted.count() <= SMALL else wanted, width, repeated))
    links = space.save(_confirmed_stars(sets, percent))
    found = components(links, space)

    # then what shares a bucket but not yet a component
    m = space.save(_labelled(buckets.select("key", "id"), "id", found, "c"))
    mixed = space.save(m.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k")).filter("lo <> hi").select("key", "k"))
    open_ids = _joined(m, mixed, "key", "k", m.count()).select("id", "c").distinct()
    open_ids = space.save(open_ids.join(reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n")), "id"))
    space.drop(m, buckets, shared, mixed, ids, stars, wanted)
    last = space.save(_likely(_shared_prefix(open_ids, sets, percent, space), reps, percent))
    more = space.save(_confirmed(sets, last, percent))
    space.drop(sets, last, open_ids)
    found = components(links.union(more), space)
    space.drop(links, more, reps)
    return _labelled(member, "rep", found, "component_id").select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
