"""Operator 10, sharding: best-fit-decreasing bin packing of indivisible groups.

Groups of equal texts are placed by size, largest first, into the bin with the
tightest remaining capacity that still holds them; bins are kept in a balanced
tree ordered by remaining capacity.

One pass over all groups would be one task, so packing has two levels. Small
groups are packed in parallel into bundles, bins of ``1 / GRAIN`` of a shard.
Bundles and large groups, at most a fixed number of them for any table size,
are then packed into the shards with the smallest capacity that suffices.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import partitions, staged

#: Bundles a shard; groups above this share of a shard are packed on their own.
GRAIN = 128


class CapacityTree:
    """AA tree of (remaining capacity, bin): balanced search for the tightest bin."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root = None  # a node is [key, level, left, right]

    @staticmethod
    def _skew(n):
        left = n[2]
        if left is not None and left[1] == n[1]:
            n[2], left[3] = left[3], n
            return left
        return n

    @staticmethod
    def _split(n):
        right = n[3]
        if right is not None and right[3] is not None and right[3][1] == n[1]:
            n[3], right[2] = right[2], n
            right[1] += 1
            return right
        return n

    def insert(self, key: tuple[int, int]) -> None:
        def put(n):
            if n is None:
                return [key, 1, None, None]
            side = 2 if key < n[0] else 3
            n[side] = put(n[side])
            return self._split(self._skew(n))

        self.root = put(self.root)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The smallest key whose remaining capacity is at least ``size``."""
        found, n = None, self.root
        while n is not None:
            if n[0][0] >= size:
                found, n = n[0], n[2]
            else:
                n = n[3]
        return found

    def remove(self, key: tuple[int, int]) -> None:
        def level(n):
            return 0 if n is None else n[1]

        def take(n, key):
            if n is None:
                return None
            if key < n[0]:
                n[2] = take(n[2], key)
            elif key > n[0]:
                n[3] = take(n[3], key)
            elif n[2] is None and n[3] is None:
                return None
            elif n[2] is None:
                heir = n[3]
                while heir[2] is not None:
                    heir = heir[2]
                n[0] = heir[0]
                n[3] = take(n[3], heir[0])
            else:
                heir = n[2]
                while heir[3] is not None:
                    heir = heir[3]
                n[0] = heir[0]
                n[2] = take(n[2], heir[0])
            low = min(level(n[2]), level(n[3])) + 1
            if low < n[1]:
                n[1] = low
                if level(n[3]) > low:
                    n[3][1] = low
            n = self._skew(n)
            if n[3] is not None:
                n[3] = self._skew(n[3])
                if n[3][3] is not None:
                    n[3][3] = self._skew(n[3][3])
            n = self._split(n)
            if n[3] is not None:
                n[3] = self._split(n[3])
            return n

        self.root = take(self.root, key)


def best_fit_decreasing(sizes: Sequence[int], capacity: int, bins: int | None = None) -> list[int] | None:
    """The bin of each size; sizes must come largest first.

    New bins open when nothing fits, or, with ``bins`` given, all bins are open
    from the start and None tells that they do not suffice. A size above the
    capacity gets a bin of its own.
    """
    tree, opened, placed = CapacityTree(), 0, []
    for _ in range(bins or 0):
        tree.insert((capacity, opened))
        opened += 1
    for size in sizes:
        spot = tree.tightest(size)
        if spot is None:
            if bins is not None:
                return None
            spot, opened = (max(capacity, size), opened), opened + 1
        else:
            tree.remove(spot)
        placed.append(spot[1])
        if spot[0] > size:
            tree.insert((spot[0] - size, spot[1]))
        elif bins is not None:
            tree.insert((0, spot[1]))
    return placed


def into_shards(sizes: Sequence[int], shards: int) -> list[int]:
    """Spread sizes, largest first, over a fixed number of shards, as evenly as best fit can.

    A size above the mean of what is left takes a shard alone. For the rest the
    smallest workable capacity is searched.
    """
    alone, rest = 0, sum(sizes)
    while alone < len(sizes) and alone < shards - 1 and sizes[alone] * (shards - alone) > rest:
        rest -= sizes[alone]
        alone += 1
    left = list(sizes[alone:])
    if not left:
        return list(range(alone))
    bins = shards - alone
    low = max(-(-rest // bins), left[0])
    high, best = low, None
    while best is None:
        best = best_fit_decreasing(left, high, bins)
        if best is None:
            low, high = high + 1, high + max(1, high // 64)
    while low < high:
        middle = (low + high) // 2
        tried = best_fit_decreasing(left, middle, bins)
        if tried is None:
            low = middle + 1
        else:
            best, high = tried, middle
    return list(range(alone)) + [alone + b for b in levelled(left, best, bins)]


def levelled(sizes: Sequence[int], placed: list[int], bins: int) -> list[int]:
    """Move items from the fullest to the emptiest bin while that narrows the gap between the two."""
    placed = list(placed)
    load, inside = [0] * bins, [[] for _ in range(bins)]
    for item in reversed(range(len(sizes))):  # smallest first, so each bin's list ascends
        load[placed[item]] += sizes[item]
        inside[placed[item]].append((sizes[item], item))
    for _ in range(len(sizes)):
        full, empty = max(range(bins), key=load.__getitem__), min(range(bins), key=load.__getitem__)
        gap = load[full] - load[empty]
        at = bisect.bisect_right(inside[full], (gap // 2, len(sizes))) - 1
        at = max(at, 0)
        if not inside[full] or not 0 < inside[full][at][0] < gap:
            break
        size, item = inside[full].pop(at)
        bisect.insort(inside[empty], (size, item))
        placed[item] = empty
        load[full] -= size
        load[empty] += size
    return placed


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(["bytes", "part", "key"], ascending=[False, True, True], kind="stable")


def pack_groups(groups: DataFrame, capacity: int, parts: int) -> DataFrame:
    """Pack (key, bytes) groups into bins of a fixed capacity in parallel; returns key, bytes, part, bin.

    Each part packs its own groups and leaves at most one bin less than half
    full, so the bins number at most ``2 * total / capacity + parts``.
    """

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = _sorted(frame)
        return frame.assign(bin=best_fit_decreasing(frame["bytes"].tolist(), capacity))

    return (
        groups.select("key", "bytes", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"))
        .groupBy("part")
        .applyInPandas(pack, "key string, bytes long, part int, bin int")
    )


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` shards of near equal bytes; equal texts stay together.

    Returns one row per input row: id, size (UTF-8 bytes + 8), text_crc32, law
    (``bytes``), shard, slot (gapless from 0 in each shard) and grown_shard (null).

    Null and empty texts are one group of size 8 rows. Null and repeated ids
    and repeated rows are kept row by row. A group larger than a mean shard
    fills a shard alone. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = staged(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.sha2(text.cast("binary"), 256).alias("key"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    capacity = max(1, -(-total // (shards * GRAIN)))
    # at most shards * GRAIN groups are this large
    large = groups.filter(F.col("bytes") >= capacity).select("key", "bytes", F.lit(-1).alias("part"), F.lit(-1).alias("bin"))
    small = pack_groups(groups.filter(F.col("bytes") < capacity), capacity, parts)
    placed = staged(small.unionByName(large), "shard-groups")
    bundles = (
        placed.filter("part >= 0")
        .groupBy("part", "bin")
        .agg(F.sum("bytes").alias("bytes"))
        .select(F.lit("").alias("key"), "bytes", "part", "bin")
        .unionByName(placed.filter("part < 0"))
    )

    def spread(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "part", "bin", "key"], ascending=[False, True, True, True], kind="stable")
        return frame.assign(shard=into_shards(frame["bytes"].tolist(), shards)).drop(columns="bytes")

    units = staged(
        bundles.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(
            lambda frame: spread(frame[["key", "bytes", "part", "bin"]]), "key string, part int, bin int, shard int"
        ),
        "shard-units",
    )
    of_group = (
        placed.filter("part >= 0")
        .join(units.filter("part >= 0").drop("key"), ["part", "bin"])
        .select("key", "shard")
        .unionByName(units.filter("part < 0").select("key", "shard"))
    )
    return _with_slots(rows.join(of_group, "key"), parts).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _with_slots(rows: DataFrame, parts: int) -> DataFrame:
    """Number rows in each shard: each shard is cut into parts, whose offsets come from their counts."""
    rows = staged(rows.withColumn("salt", F.pmod(F.xxhash64("id", "key"), F.lit(parts)).cast("int")), "shard-dealt")
    counts = rows.groupBy("shard", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    at = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("id", "key")) - 1
    return rows.withColumn("at", at).join(offsets, ["shard", "salt"]).withColumn("slot", F.col("at") + F.col("offset"))
