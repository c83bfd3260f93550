"""Operator 1, exact substring dedup: blockwise suffix sorting over a difference cover.

A byte goes when a string of ``min_len`` bytes around it also starts somewhere
else in the corpus. Sorting all suffixes would keep every position at once, so
the suffixes are handled the way difference-cover sorting does:

* A difference cover D modulo v is a small set of residues such that any two
  positions i, j have a shift below v at which both fall into D. The positions
  in D are the cover sample.
* Cover-sample ranks: sample suffixes are told apart by their first
  ``min_len - v + 1`` bytes. If two suffixes agree in ``min_len`` bytes, two
  sample suffixes near them tie here. A suffix without a tied sample near it
  needs no sorting at all.
* Suffixes are dealt into buckets, and one bucket is sorted at a time. Ties
  that the bytes leave are settled by the ranks of the sample.

Only equality of ``min_len`` bytes counts here, never order beyond it, so ranks
are 64-bit fingerprints: equal strings have equal ranks. Both the sample's tie
and the suffix's own have to agree, with different window widths.

Four rounds go between text blocks and suffix buckets. The texts are written
once, bucketed by block, so no round shuffles them; only fingerprints travel,
and one bit for each of them comes back.

1. Which sample suffixes tie in ``min_len - v + 1`` bytes?
2. Which of those tie in ``min_len`` bytes? Their bytes are removed.
3. Which tied samples lie near a suffix that round 2 leaves open, anywhere?
4. Suffixes next to those: which tie in ``min_len`` bytes? Their bytes go too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import partitions, shared_path, staged

#: Rows of a text block: 2 to this power.
BLOCK_BITS = 11
#: Bytes hashed at a time.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def cover_for(min_len: int) -> tuple[int, np.ndarray]:
    """A modulus v below ``min_len / 2`` and a difference cover of it (Colbourn and Ling's steps)."""
    r = 0
    while 24 * (r + 1) ** 2 + 36 * (r + 1) + 13 <= min_len // 2:
        r += 1
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    v = min(24 * r * r + 36 * r + 13, max(1, min_len // 2))
    cover = np.unique(np.concatenate([[0], np.cumsum(steps)]) % v)
    if len(np.unique((cover[:, None] - cover[None, :]) % v)) != v:
        raise ValueError(f"no difference cover modulo {v}")
    return v, cover


def _mix(x: int) -> int:
    x = (x + _BASE) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


@lru_cache(maxsize=4)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte value; powers of the base and of its inverse."""
    letters = np.array([_mix(b) for b in range(256)], np.uint64)
    power = np.cumprod(np.r_[np.uint64(1), np.full(length, _BASE, np.uint64)])
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(length, pow(_BASE, -1, 1 << 64), np.uint64)])
    return letters, power, inverse


def fingerprints(text: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """64-bit fingerprints of the ``width`` bytes from each of the ascending ``starts``."""
    letters, power, inverse = _powers(PIECE + width)
    out = np.empty(len(starts), np.uint64)
    edges = np.searchsorted(starts, np.arange(0, len(text) + PIECE, PIECE))
    for n, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if a == b:
            continue
        low = n * PIECE
        piece = text[low : low + PIECE + width]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(letters[piece] * power[: len(piece)], out=sums[1:])
        at = starts[a:b] - low
        h = (sums[at + width] - sums[at]) * inverse[at]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out[a:b] = h ^ (h >> np.uint64(32))
    return out


class Block:
    """The texts of one block, in a fixed order, as one array of bytes."""

    def __init__(self, table: pa.Table, min_len: int) -> None:
        ids, texts = table.column("id").to_pylist(), table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, texts[i]))
        self.rows = order
        self.texts = [texts[i] for i in order]
        self.number = table.column("block")[0].as_py() if len(ids) else None
        self.text = np.frombuffer(b"".join(self.texts), np.uint8)
        self.lengths = np.fromiter(map(len, self.texts), np.int64, len(order))
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.min_len = min_len
        self.v, self.cover = cover_for(min_len)
        self.width = min_len - self.v + 1

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        """Cover-sample positions of all texts that are long enough, and the text of each."""
        longest = int(self.lengths.max(initial=0))
        pattern = (np.arange(0, longest + self.v, self.v)[:, None] + self.cover[None, :]).ravel()
        long = np.flatnonzero(self.lengths >= self.min_len)
        counts = np.searchsorted(pattern, self.lengths[long] - self.width + 1)
        if not len(long):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        positions = np.concatenate([pattern[:n] + self.starts[t] for t, n in zip(long, counts)])
        return positions, np.repeat(long, counts)

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """Which bytes lie in a window of ``min_len`` bytes from one of the starts."""
        depth = np.zeros(len(self.text) + 1, np.int32)
        np.add.at(depth, starts, 1)
        np.subtract.at(depth, starts + self.min_len, 1)
        return np.cumsum(depth[:-1], dtype=np.int32) > 0

    def open_starts(self, covered: np.ndarray) -> np.ndarray:
        """Sums over starts whose window fits its text and is not wholly covered."""
        free = np.zeros(len(self.text) + 1, np.int64)
        np.cumsum(~covered, out=free[1:])
        n = len(self.text)
        is_open = np.zeros(n, bool)
        if n >= self.min_len:
            is_open[: n - self.min_len + 1] = free[self.min_len :] > free[: n - self.min_len + 1]
        last = np.repeat(self.ends - self.min_len, self.lengths)
        is_open &= np.arange(n) <= last
        sums = np.zeros(n + 1, np.int64)
        np.cumsum(is_open, out=sums[1:])
        return sums

    def near(self, samples: np.ndarray, of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-last start whose window holds the sample's window, for each sample."""
        first = np.maximum(self.starts[of_text], samples - self.v + 1)
        past = np.minimum(samples, self.ends[of_text] - self.min_len) + 1
        return first, np.maximum(first, past)


# -- messages --------------------------------------------------------------------------------------
MESSAGE = "block long, bucket int, keys binary, own binary"
_MESSAGE = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("own", pa.binary())])


def _send(block: int, keys: np.ndarray, own: np.ndarray, buckets: int, narrow: bool, state: bytes) -> pa.Table:
    """One row per bucket with the block's distinct ascending keys, and one without ``own`` that brings the block's state along."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(keys)] if len(keys) else np.zeros(1, int)
    rows = {"block": [block], "bucket": [block % buckets], "keys": [state], "own": [None]}
    kind = "<u4" if narrow else "<u8"
    for a, b in zip(edges[:-1], edges[1:]):
        rows["block"].append(block)
        rows["bucket"].append(int(bucket[a]))
        rows["keys"].append((keys[a:b] & np.uint64(0xFFFFFFFF) if narrow else keys[a:b]).astype(kind).tobytes())
        rows["own"].append(np.packbits(own[a:b]).tobytes())
    return pa.table(rows, schema=_MESSAGE)


def _settle(narrow: bool, ties: bool) -> Callable[[pa.Table], pa.Table]:
    """Sort one bucket; every key learns whether it occurs twice (``ties``) or is marked by any block."""

    def settle(table: pa.Table) -> pa.Table:
        states = table.filter(pc.is_null(table.column("own")))
        states = states.set_column(1, "bucket", pa.array([-1] * states.num_rows, pa.int32()))
        table = table.filter(pc.is_valid(table.column("own")))
        if not table.num_rows:
            return states.cast(_MESSAGE)
        blocks, sent, own = (table.column(c).to_pylist() for c in ("block", "keys", "own"))
        parts = [np.frombuffer(k, "<u4" if narrow else "<u8") for k in sent]
        sizes = [len(p) for p in parts]
        keys = np.concatenate(parts)
        marked = np.concatenate([np.unpackbits(np.frombuffer(o, np.uint8), count=n) for o, n in zip(own, sizes)]).astype(bool)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        first = np.r_[True, ranked[1:] != ranked[:-1]]
        group = np.cumsum(first) - 1
        hit = np.bincount(group, marked[order]) > 0
        if ties:
            hit |= np.bincount(group) > 1
        answer = np.empty(len(keys), bool)
        answer[order] = hit[group]
        cuts = np.cumsum([0, *sizes])
        bits = [np.packbits(answer[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        answers = {"block": blocks, "bucket": table.column("bucket").to_pylist(), "keys": bits, "own": [None] * len(bits)}
        return pa.concat_tables([pa.table(answers, schema=_MESSAGE), states.cast(_MESSAGE)])

    return settle


def _answers(table: pa.Table) -> tuple[bytes, list[tuple[int, bytes]]]:
    """The state that a block left, and the answers by bucket."""
    rows = sorted(zip(table.column("bucket").to_pylist(), table.column("keys").to_pylist()))
    return (rows[0][1], rows[1:]) if rows and rows[0][0] == -1 else (b"", rows)


def _bits(replies: list[tuple[int, bytes]], keys: np.ndarray, buckets: int) -> np.ndarray:
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    sizes = np.bincount(bucket.astype(np.int64), minlength=buckets)
    parts = [np.unpackbits(np.frombuffer(bits, np.uint8), count=int(sizes[b])) for b, bits in replies]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _pack(*flags: np.ndarray) -> bytes:
    return b"".join(np.packbits(f).tobytes() for f in flags)


def _unpack(state: bytes, *counts: int) -> list[np.ndarray]:
    out, at = [], 0
    for n in counts:
        size = -(-n // 8)
        out.append(np.unpackbits(np.frombuffer(state[at : at + size], np.uint8), count=n).astype(bool))
        at += size
    return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    unique, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return unique, inverse, counts


class Rounds:
    """What a block does in each round; earlier results come back as bits, positions are worked out again."""

    def __init__(self, min_len: int, buckets: int) -> None:
        self.min_len, self.buckets = min_len, buckets

    def first(self, table: pa.Table) -> pa.Table:
        block = Block(table, self.min_len)
        samples, _ = block.sample()
        keys, _, counts = _distinct(fingerprints(block.text, samples, block.width))
        return _send(block.number, keys, counts > 1, self.buckets, True, b"")

    def _tied(self, block: Block, replies: list) -> np.ndarray:
        samples, _ = block.sample()
        keys, inverse, _ = _distinct(fingerprints(block.text, samples, block.width))
        return _bits(replies, keys, self.buckets)[inverse] if len(keys) else np.zeros(0, bool)

    def _whole(self, block: Block, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tied samples with room for a whole window, and their texts."""
        samples, of_text = block.sample()
        fits = tied & (samples + self.min_len <= block.ends[of_text])
        return samples[fits], of_text[fits]

    def second(self, table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, self.min_len)
        _, replies = _answers(answers)
        tied = self._tied(block, replies)
        starts, _ = self._whole(block, tied)
        keys, _, counts = _distinct(fingerprints(block.text, starts, self.min_len))
        return _send(block.number, keys, counts > 1, self.buckets, False, _pack(tied))

    def third(self, table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, self.min_len)
        state, replies = _answers(answers)
        samples, of_text = block.sample()
        (tied,) = _unpack(state, len(samples))
        starts, _ = self._whole(block, tied)
        keys, inverse, _ = _distinct(fingerprints(block.text, starts, self.min_len))
        gone = _bits(replies, keys, self.buckets)[inverse] if len(keys) else np.zeros(0, bool)
        sums = block.open_starts(block.covered(starts[gone]))
        first, past = block.near(samples[tied], of_text[tied])
        wanted = sums[past] > sums[first]
        keys, inverse, _ = _distinct(fingerprints(block.text, samples[tied], block.width))
        own = np.zeros(len(keys), bool)
        own[inverse[wanted]] = True
        return _send(block.number, keys, own, self.buckets, True, _pack(tied, gone))

    def _edges(self, block: Block, samples: np.ndarray, of_text: np.ndarray) -> np.ndarray:
        """All starts near the given samples, ascending."""
        first, past = block.near(samples, of_text)
        depth = np.zeros(len(block.text) + 2, np.int32)
        np.add.at(depth, first, 1)
        np.subtract.at(depth, past, 1)
        return np.flatnonzero(np.cumsum(depth)[:-1] > 0)

    def fourth(self, table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, self.min_len)
        state, replies = _answers(answers)
        samples, of_text = block.sample()
        (tied,) = _unpack(state, len(samples))
        starts, _ = self._whole(block, tied)
        tied, gone = _unpack(state, len(samples), len(starts))
        keys, inverse, _ = _distinct(fingerprints(block.text, samples[tied], block.width))
        wanted = _bits(replies, keys, self.buckets)[inverse] if len(keys) else np.zeros(0, bool)
        edges = self._edges(block, samples[tied][wanted], of_text[tied][wanted])
        keys, _, counts = _distinct(fingerprints(block.text, edges, self.min_len))
        return _send(block.number, keys, counts > 1, self.buckets, False, _pack(tied, gone, wanted))

    def removed(self, block: Block, answers: pa.Table) -> np.ndarray:
        state, replies = _answers(answers)
        samples, of_text = block.sample()
        (tied,) = _unpack(state, len(samples))
        starts, _ = self._whole(block, tied)
        tied, gone, wanted = _unpack(state, len(samples), len(starts), int(tied.sum()))
        edges = self._edges(block, samples[tied][wanted], of_text[tied][wanted])
        keys, inverse, _ = _distinct(fingerprints(block.text, edges, self.min_len))
        more = _bits(replies, keys, self.buckets)[inverse] if len(keys) else np.zeros(0, bool)
        return block.covered(np.concatenate([starts[gone], edges[more]]))


def remove_repeats(
    docs: DataFrame, min_len: int = 400, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False
) -> DataFrame:
    """Remove every byte that lies in a ``min_len``-byte string which also starts anywhere else.

    Texts count as UTF-8 bytes, matches never cross documents, and overlaps
    count. Returns one row per input row: id, n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256 and, with ``keep_text``, the bytes kept.

    A null text is empty. Texts shorter than ``min_len`` lose nothing. Repeated
    rows are copies of each other and lose what they share; null and repeated
    ids are kept row by row. An empty table gives no rows; other columns are
    ignored. A task holds one block of 2048 texts and one bucket at a time.
    """
    spark = docs.sparkSession
    buckets = partitions(spark)
    name = "quern_blocks_" + shared_path(spark, "suffixes").rsplit("-", 1)[1]
    (
        docs.select(
            F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block"),
            F.col(id_col).alias("id"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
        )
        .write.format("parquet")
        .bucketBy(buckets, "block")
        .sortBy("block")
        .option("compression", "zstd")
        .option("path", shared_path(spark, "blocks"))
        .saveAsTable(name)
    )
    blocks = spark.table(name)
    rounds = Rounds(min_len, buckets)

    def settled(sent: DataFrame, narrow: bool, ties: bool) -> DataFrame:
        """One round: sort each bucket and hand the answers back beside the blocks' states. Only these few bits are kept."""
        return staged(sent.groupBy("bucket").applyInArrow(_settle(narrow, ties), MESSAGE), "suffix-round")

    def next_round(answers: DataFrame, step: Callable, schema: str = MESSAGE) -> DataFrame:
        return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda texts, replies: step(texts, replies), schema)

    answers = settled(blocks.groupBy("block").applyInArrow(lambda texts: rounds.first(texts), MESSAGE), True, True)
    answers = settled(next_round(answers, rounds.second), False, True)
    answers = settled(next_round(answers, rounds.third), True, False)
    answers = settled(next_round(answers, rounds.fourth), False, True)
    result = staged(
        next_round(
            answers,
            _result(rounds, keep_text),
            f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
            + (", kept binary" if keep_text else ""),
        ),
        "suffix-result",
    )
    spark.sql(f"DROP TABLE {name}")
    return result.withColumnRenamed("id", id_col)


def _result(rounds: Rounds, keep_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def result(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, rounds.min_len)
        gone = rounds.removed(block, answers)
        n_removed, n_spans, digests, kept = [], [], [], []
        for text, a, b in zip(block.texts, block.starts.tolist(), block.ends.tolist()):
            mask = gone[a:b]
            removed = int(np.count_nonzero(mask))
            rest = text if not removed else block.text[a:b][~mask].tobytes()
            n_removed.append(removed)
            n_spans.append(int(np.count_nonzero(mask[1:] & ~mask[:-1]) + mask[0]) if removed else 0)
            digests.append(hashlib.sha256(rest).hexdigest())
            if keep_text:
                kept.append(rest)
        columns = {
            "id": table.column("id").take(pa.array(block.rows)),
            "n_bytes": pa.array(block.lengths),
            "n_removed": pa.array(n_removed, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
        }
        return pa.table(columns | ({"kept": pa.array(kept, pa.binary())} if keep_text else {}))

    return result
