"""Blocks of texts on disk, their words as arrays, and rounds of fingerprints between blocks and buckets.

The texts are written once, bucketed by block, so no round shuffles them: each
block sends distinct fingerprints to the buckets of their values and gets one
answer back for each, in the same order (as in ``suffixes``).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import partitions, shared_path
from quern.llm.suffixes import _BASE, _mix

#: Bytes of words hashed at a time.
PIECE = 1 << 18


def blocked(docs: DataFrame, text: Column, block_bytes: int, **columns: Column) -> DataFrame:
    """(block, row, text as bytes, columns), bucketed by block; a block holds about ``block_bytes`` of text at the average length.

    A null text is empty. The table's name is dropped at once; its files stay
    in the shared folder until the application ends.
    """
    spark = docs.sparkSession
    text = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    bits = max(1, int(block_bytes * (rows or 1) / max(1, size or 0, rows))).bit_length() - 1
    path = shared_path(spark, "blocks")
    name = "quern_blocks_" + path.rsplit("-", 1)[1]
    row = F.monotonically_increasing_id()
    rows_in = docs.select(F.shiftright(row, min(bits, 32)).alias("block"), row.alias("row"), text.alias("text"), *[c.alias(n) for n, c in columns.items()])
    writer = rows_in.write.format("parquet").bucketBy(partitions(spark), "block").sortBy("block")
    try:
        writer.option("compression", "zstd").option("path", path).saveAsTable(name)
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def in_row_order(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.argsort(table.column("row").to_numpy())))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """A random number per byte value; none for the space after each word."""
    letters = np.array([_mix(b) for b in range(256)], np.uint64)
    letters[32] = 0
    return letters


@lru_cache(maxsize=64)
def _powers(bits: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full((1 << bits) - 1, _BASE, np.uint64)])


class Words:
    """The words of texts in order: ``said`` holds each word's bytes and one space, ``at`` where each starts.

    ``breaks`` are bytes that part words and also end a phrase; ``ends_phrase``
    tells the words before one, and a text's last word.
    """

    def __init__(self, texts: list[bytes], gaps: bytes, breaks: bytes = b"") -> None:
        kind = np.zeros(256, np.uint8)
        kind[list(gaps)] = 1
        kind[list(breaks)] = 2
        after = breaks[:1] or gaps[:1]
        raw = np.frombuffer(b"".join([t + after for t in texts]), np.uint8)
        sort = kind[raw]
        inside = sort == 0
        before = np.zeros(len(raw), bool)
        before[1:] = inside[:-1]
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
        self.lengths = ends - starts
        self.at = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        self.said = raw[inside | before]
        self.said[self.at + self.lengths] = 32
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.of_text = np.searchsorted(text_ends, starts, side="right")
        self.counts = np.bincount(self.of_text, minlength=len(texts))
        self.last = np.cumsum(self.counts)
        if breaks:
            parted = np.flatnonzero(sort == 2)
            self.ends_phrase = np.searchsorted(parted, np.r_[starts[1:], len(raw)]) > np.searchsorted(parted, ends)

    def __len__(self) -> int:
        return len(self.at)

    def hashes(self) -> np.ndarray:
        """A 64-bit fingerprint per word."""
        out = np.zeros(len(self), np.uint64)
        if not len(self):
            return out
        letters, power = _letters(), _powers(int(self.lengths.max()).bit_length() + 1)
        edges = np.unique(np.r_[np.searchsorted(self.at, np.arange(0, len(self.said), PIECE)), len(self)])
        for a, b in zip(edges[:-1], edges[1:]):
            low, high = self.at[a], self.at[b - 1] + self.lengths[b - 1] + 1
            place = np.arange(low, high) - np.repeat(self.at[a:b], self.lengths[a:b] + 1)
            out[a:b] = np.add.reduceat(letters[self.said[low:high]] * power[place], self.at[a:b] - low)
        return mixed(out)

    def part(self, first: int, past: int) -> bytes:
        """Words ``first`` up to ``past``, one space between them."""
        return self.said[self.at[first] : self.at[past - 1] + self.lengths[past - 1]].tobytes()


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of ``n`` consecutive words from each word on that has so many from it."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out *= np.uint64(_BASE)
        out += hashes[k : k + size]
    return mixed(out)


def heads(ranked: np.ndarray) -> np.ndarray:
    """Where each group of equal values starts."""
    return np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An ascending order (equal keys in any), the start of each group in it, the distinct keys, and each key's place among them."""
    order = np.argsort(keys)
    ranked = keys[order]
    first = heads(ranked)
    group = np.zeros(len(keys), np.int64)
    group[first[1:]] = 1
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(group)
    return order, first, ranked[first], inverse


def bucket_edges(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, first, past) of the ascending keys."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    first = heads(bucket)
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(first, np.r_[first[1:], len(keys)])]
