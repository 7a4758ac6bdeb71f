"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Equal texts are one group and stay together.  Every group is packed: groups sorted by
size enter the bin with the tightest remaining capacity, found in a balanced tree; the
smallest capacity that needs no more than the wanted number of bins is searched for.

The driver packs sizes, not groups.  Groups of ``1 / (shards * PIECES)`` of all bytes or
rows and more are items of their own (at most twice ``shards * PIECES``).  All others are
counted by size: a size below ``FINE`` stands for itself, a larger one is rounded up to
``LEADING`` bits for the packing (0.4 % at most), so there are at most
``FINE + 47 * 2 ** (LEADING - 1)`` sizes, however large the corpus.  Best fit puts equal
items into one bin until it is full, so a size is dealt in few runs; where it is dealt
over several bins, the groups with the smallest hashes go to the first, and the hashes at
which to cut are found by counting, so again only bounded tables leave the cluster.

Slots number the rows of a shard without gaps.  They come from row numbers inside
hash buckets plus bucket offsets, so that no shard is one task.

Defined results: a null text is a group of its own, of size 1 a row, with a null
``text_crc32``; repeated rows are in one shard and get different slots; rows without a
``doc_id`` are rows like others; very long texts are weighed whole; an input column called like one of
the result's is returned as ``input_`` and its name; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Space

SHARDS, PIECES = 16, 256
#: Sizes that are packed as they are, and the leading bits of larger ones.
FINE, LEADING = 1 << 16, 9
#: Groups of one size for which one bucket of hashes is counted.
BUCKET_GROUPS = 4000
#: Share of the capacity by which the search may miss the smallest one.
EXACT = 10_000
#: Rows of a shard for which one bucket of slots is made.
SLOT_ROWS = 4000


class Bins:
    """Bins ordered by remaining capacity in a treap (a balanced search tree)."""

    def __init__(self):
        self.root, self.seed = None, 1

    def _priority(self) -> int:
        self.seed = self.seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        return self.seed >> 33

    @staticmethod
    def _split(node, key):
        """Trees with keys below ``key`` and the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = Bins._split(node[3], key)
            return (node[0], node[1], node[2], low), high
        low, high = Bins._split(node[2], key)
        return low, (node[0], node[1], high, node[3])

    @staticmethod
    def _merge(a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return (a[0], a[1], a[2], Bins._merge(a[3], b))
        return (b[0], b[1], Bins._merge(a, b[2]), b[3])

    def add(self, room: int, name: int) -> None:
        low, high = self._split(self.root, (room, name))
        self.root = self._merge(self._merge(low, ((room, name), self._priority(), None, None)), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room that still holds ``size``."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        key = node[0]
        _, high = self._split(high, (key[0], key[1] + 1))
        self.root = self._merge(low, high)
        return key


def best_fit_runs(items: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[list[tuple[int, int]]] | None:
    """Runs (bin, number) of each item (size, number of equal ones), by best fit in descending order of size.

    Bins have one capacity, and a size above it gets a bin of its own.  None once more
    than ``most`` bins are needed.
    """
    bins, out, n = Bins(), [[] for _ in items], 0
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], i)):
        size, left = items[i]
        while left:
            found = bins.take(size)
            if found is None:
                if n == most:
                    return None
                found = (max(capacity, size), n)
                n += 1
            # the tightest bin that holds one is the tightest until it is full
            k = min(left, found[0] // size)
            out[i].append((found[1], k))
            bins.add(found[0] - k * size, found[1])
            left -= k
    return out


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size."""
    return [runs[0][0] for runs in best_fit_runs([(s, 1) for s in sizes], capacity)]


def pack(items: list[tuple[int, int]], shards: int = SHARDS) -> list[list[tuple[int, int]]]:
    """Runs of each item (size, number) at the smallest capacity found that needs at most ``shards`` bins.

    Items above an equal share take a bin each; the capacity is that of the other bins.
    """
    if not items:
        return []
    rest, left = sum(s * n for s, n in items), shards
    for size in (s for s, n in sorted(items, reverse=True)[:shards] for _ in range(min(n, shards))):
        if left == 1 or size * left <= rest:
            break
        rest, left = rest - size, left - 1
    low = max(1, -(-rest // left))
    step = max(1, low // EXACT)
    below, high = low - 1, low
    while (best := best_fit_runs(items, high, shards)) is None:
        below, high, step = high, low + step, 4 * step
    while high - below > max(1, low // EXACT):
        mid = (below + high) // 2
        got = best_fit_runs(items, mid, shards)
        if got is None:
            below = mid
        else:
            best, high = got, mid
    return best


def size_class(size: Column) -> Column:
    """The size, rounded up to ``LEADING`` bits from ``FINE`` on."""
    one = F.when(size < FINE, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(size)) - LEADING).cast("long"))
    return F.when(size < FINE, size).otherwise(F.ceil(size / one).cast("long") * one)


def _cuts(spark: SparkSession, groups: DataFrame, runs: dict[int, list[tuple[int, int]]], n_groups: int) -> dict[tuple[int, int], bytes]:
    """(size class, rank) -> hash of the group that ends a run, for classes with several runs; ``groups`` has _g and cls."""
    wanted = []
    for cls, parts in runs.items():
        rank = 0
        for _, k in parts[:-1]:
            rank += k
            wanted.append((cls, rank))
    if not wanted:
        return {}
    ranks = spark.createDataFrame(wanted, "cls long, rank long")  # a few for each bin
    digits = max(1, min(6, math.ceil(math.log(max(n_groups / BUCKET_GROUPS, 1), 16))))
    own = groups.select("_g", "cls", F.substring(F.hex("_g"), 1, digits).alias("b")).join(F.broadcast(ranks.select("cls").distinct()), "cls")
    counts = own.groupBy("cls", "b").agg(F.count("*").alias("n"))
    ends = counts.withColumn("end", F.sum("n").over(Window.partitionBy("cls").orderBy("b"))).withColumn("start", F.col("end") - F.col("n"))
    hit = ends.join(F.broadcast(ranks), "cls").filter((F.col("rank") > F.col("start")) & (F.col("rank") <= F.col("end"))).select("cls", "b", "rank", "start")
    inside = own.join(F.broadcast(hit.select("cls", "b").distinct()), ["cls", "b"], "left_semi").withColumn("i", F.row_number().over(Window.partitionBy("cls", "b").orderBy("_g")))
    found = inside.join(F.broadcast(hit), ["cls", "b"]).filter(F.col("i") + F.col("start") == F.col("rank")).select("cls", "rank", "_g")
    return {(r["cls"], r["rank"]): bytes(r["_g"]) for r in found.collect()}  # a row for each of `wanted`


def shards(spark: SparkSession, docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), n_shards: int = SHARDS) -> DataFrame:
    """``columns`` of ``docs`` and size, text_crc32, law, shard, slot, grown_shard."""
    own = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    names: dict[str, str] = {}
    for c in columns:
        name = c
        while name in own or name in names.values() or (name != c and name in columns):
            name = f"input_{name}"
        names[c] = name
    space = Space(spark, "shards")
    text = F.col("text").cast("string")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).alias("_row"), F.col("doc_id").alias("_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b"")).alias("_g"))
    keyed = keyed.withColumn("_h", F.xxhash64(F.lit("slot"), F.col("_id"), F.col("_g"))).drop("_id")
    groups = space.save(keyed.groupBy("_g").agg(F.sum("size").alias("s"), F.count("*").alias("n")))
    total = groups.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.count("*").alias("groups")).first()
    pieces = n_shards * PIECES
    alone = (F.col("s") >= max(1, -(-(total["s"] or 0) // pieces))) | (F.col("n") >= max(2, -(-(total["n"] or 0) // pieces)))
    large = groups.filter(alone).select("_g", "s").collect()  # at most 2 * pieces rows: their sizes and their rows sum to the totals at most
    small = groups.filter(~alone).select("_g", size_class(F.col("s")).alias("cls"))
    classes = small.groupBy("cls").agg(F.count("*").alias("n")).collect()  # bounded by FINE and LEADING
    found = pack([(r["s"], 1) for r in large] + [(r["cls"], r["n"]) for r in classes], n_shards)
    runs = {r["cls"]: parts for r, parts in zip(classes, found[len(large) :], strict=True)}
    cuts = _cuts(spark, small, runs, total["groups"])
    deal = []
    for cls, parts in runs.items():
        rank, low = 0, None
        for i, (b, k) in enumerate(parts):
            rank += k
            high = cuts[cls, rank] if i < len(parts) - 1 else None
            deal.append((cls, low, high, b))
            low = high
    of_class = spark.createDataFrame(deal, "cls long, low binary, high binary, _small int")
    of_large = spark.createDataFrame([(bytes(r["_g"]), parts[0][0]) for r, parts in zip(large, found, strict=False)], "_g binary, _large int")
    inside = (F.col("low").isNull() | (F.col("_g") > F.col("low"))) & (F.col("high").isNull() | (F.col("_g") <= F.col("high")))
    light = small.join(F.broadcast(of_class), "cls").filter(inside).select(F.col("_g").alias("_k"), "_small")
    # groups with many rows are found in the broadcast; their rows are dealt by a hash that is no group's
    rows = keyed.join(F.broadcast(of_large), "_g", "left").withColumn("_k", F.when(F.col("_large").isNull(), F.col("_g")).otherwise(F.unhex(F.sha1(F.col("_h").cast("string").cast("binary")))))
    rows = rows.join(light, "_k", "left")
    buckets = max(1, math.ceil((total["n"] or 0) / n_shards / SLOT_ROWS))
    rows = rows.select("_row", "_h", "size", "text_crc32", F.coalesce("_large", "_small").alias("shard"), F.pmod("_h", F.lit(buckets)).cast("int").alias("_b"))
    counts = space.save(rows.groupBy("shard", "_b").agg(F.count("*").alias("n")))
    offsets = counts.withColumn("_o", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "_b", "_o")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("shard", "_b").orderBy("_h", "text_crc32", "size"))).join(offsets, ["shard", "_b"])
    return rows.select("_row.*", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_o") + F.col("_n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
