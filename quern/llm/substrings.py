"""Operator 12, substring dedup by repeated-phrase automata.

A window is ``WINDOW`` consecutive words (``[^\\x20\\x09-\\x0D]+``) of one
document. Each word covered by a window whose word sequence also starts in a
document with a smaller doc_id is removed; windows are judged on the input.

The texts are written once in blocks (``blocks``) and never shuffled.

1. Which windows tie in 37 bits or more of their fingerprints? Each block sends
   four bytes for each distinct window; one bit comes back.
2. Those that tie send whole 64-bit fingerprints with the smallest doc_id of
   the block that holds them. Windows held by two ids or more are the recurring
   phrases; the answer names the block of the first holder, the smallest id.
3. A document's runs of windows that an earlier id holds are cut where their
   content says so (the same place in every copy), and each distinct run of a
   block goes as text to the block of its first holder.
4. That block builds Aho-Corasick automata of the phrases it holds first, at
   most about ``SHARD_BYTES`` of phrase text each, over words as letters, and
   streams the runs through them: each match is one exact occurrence. One bit
   for each window goes back, and the words under the matches go.

The only inexact step is grouping by a 64-bit fingerprint: two different
windows with equal fingerprints would share one first holder (about one pair
in 10^19 among 10^9 windows); the automaton still matches texts exactly.

Edge cases: a null text has no words (n_words 0, kept_sha256 of the empty
string); texts under ``WINDOW`` words lose nothing and cause no removal;
documents with a null doc_id neither lose words nor cause removals (no id is
smaller or larger than null); repeated rows with one doc_id do not remove each
other but both lose what an earlier id holds; an empty table gives no rows.
Only the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import Words, blocked, bucket_edges, grams, grouped, heads, in_row_order
from quern.llm.common import SPACES, partitions, staged
from quern.llm.suffixes import _MESSAGE, MESSAGE, _answers, _bits, _send, _settle

#: Fixed by the contract: words per window.
WINDOW = 13

#: Phrase text per automaton and document text per block.
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20
#: Runs are cut after windows whose fingerprint ends in this many zero bits, one in 32.
CUT_BITS = 5
#: First letters of words in an automaton; SHARD_BYTES hold under 2 million words, so second letters stay below the surrogates.
FAN = 64

ROUTE = "block long, sender long, body binary, phrases binary"
_ROUTE = pa.schema([("block", pa.int64()), ("sender", pa.int64()), ("body", pa.binary()), ("phrases", pa.binary())])
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


class Block:
    """The documents of one block in row order, their words and the windows of those with an id."""

    def __init__(self, table: pa.Table) -> None:
        table = in_row_order(table)
        self.number = table.column("block")[0].as_py()
        self.ids = table.column("doc_id")
        self.words = words = Words(table.column("text").to_pylist(), SPACES.encode())
        known = np.asarray(pc.is_valid(self.ids))
        self.known, rank = np.unique(np.asarray(pc.fill_null(self.ids, 0), np.int64), return_inverse=True)
        index = np.arange(len(words))
        self.starts = index[(index + WINDOW <= words.last[words.of_text]) & known[words.of_text]]
        self.rank = rank[words.of_text[self.starts]]

    def windows(self) -> None:
        """Distinct fingerprints ascending, each window's place among them, the smallest and largest id (by rank) that holds each."""
        hashes = grams(self.words.hashes(), WINDOW)
        self.all = hashes[self.starts]
        order, first, self.keys, self.inverse = grouped(self.all)
        ranks = self.rank[order]
        self.least = np.minimum.reduceat(ranks, first) if len(first) else ranks
        self.most = np.maximum.reduceat(ranks, first) if len(first) else ranks


def _ids_out(ids: np.ndarray, several: np.ndarray) -> bytes:
    """Ids as the narrowest offsets from their smallest, and one bit each."""
    low = ids.min()
    offsets = ids.astype(np.uint64) - np.uint64(low.astype(np.uint64))
    kind = np.min_scalar_type(offsets.max())
    return low.tobytes() + bytes([kind.itemsize]) + offsets.astype(kind).tobytes() + np.packbits(several).tobytes()


def _ids_in(sent: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = sent[8]
    offsets = np.frombuffer(sent, f"<u{size}", n, 9).astype(np.uint64)
    low = np.frombuffer(sent, "<i8", 1)[0].astype(np.uint64)
    bits = np.frombuffer(sent, np.uint8, offset=9 + n * size)
    return (offsets + low).astype(np.int64), np.unpackbits(bits, count=n).astype(bool)


def _first_holders(table: pa.Table) -> pa.Table:
    """Sort one bucket: each fingerprint learns the block of its first holder (times 2, plus 1 if that id is smaller than its own), or -1 if one id holds it."""
    states = table.filter(pc.is_null(table.column("own")))
    states = states.set_column(1, "bucket", pa.array([-1] * states.num_rows, pa.int32()))
    table = table.filter(pc.is_valid(table.column("own")))
    if not table.num_rows:
        return states.cast(_MESSAGE)
    blocks, sent, own = (table.column(c).to_pylist() for c in ("block", "keys", "own"))
    parts = [np.frombuffer(k, "<u8") for k in sent]
    held = [_ids_in(o, len(p)) for o, p in zip(own, parts)]
    keys, ids, several = np.concatenate(parts), np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    source = np.repeat(np.array(blocks, np.int64), [len(p) for p in parts])
    order = np.lexsort((source, ids, keys))
    first = heads(keys[order])
    sizes = np.diff(np.r_[first, len(keys)])
    ids = ids[order]
    recurs = (np.maximum.reduceat(ids, first) > ids[first]) | np.logical_or.reduceat(several[order], first)
    code = np.repeat(source[order][first] * 2, sizes) + (ids > np.repeat(ids[first], sizes))
    answer = np.empty(len(keys), np.int64)
    answer[order] = np.where(np.repeat(recurs, sizes), code, -1)
    replies = [a.tobytes() for a in np.split(answer, np.cumsum([len(p) for p in parts])[:-1])]
    answers = {"block": blocks, "bucket": table.column("bucket").to_pylist(), "keys": replies, "own": [None] * len(blocks)}
    return pa.concat_tables([pa.table(answers, schema=_MESSAGE), states.cast(_MESSAGE)])


def _tied(buckets: int):
    """Round 1: distinct windows, four bytes each."""

    def step(table: pa.Table) -> pa.Table:
        block = Block(table)
        block.windows()
        return _send(block.number, block.keys, block.least < block.most, buckets, True, b"")

    return step


def _holders(buckets: int):
    """Round 2: those that tie, whole, with the smallest id here."""

    def step(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table)
        block.windows()
        tied = _bits(_answers(answers)[1], block.keys, buckets)
        keys, ids = block.keys[tied], block.known[block.least[tied]]
        several = (block.least < block.most)[tied]
        rows = {"block": [block.number], "bucket": [block.number % buckets], "keys": [np.packbits(tied).tobytes()], "own": [None]}
        for bucket, a, b in bucket_edges(keys, buckets):
            rows["block"].append(block.number)
            rows["bucket"].append(bucket)
            rows["keys"].append(keys[a:b].astype("<u8").tobytes())
            rows["own"].append(_ids_out(ids[a:b], several[a:b]))
        return pa.table(rows, schema=_MESSAGE)

    return step


def _route(table: pa.Table, answers: pa.Table) -> pa.Table:
    """Round 3: runs to the blocks of their first holders; phrases held first here and the runs' places stay."""
    block = Block(table)
    block.windows()
    state, replies = _answers(answers)
    tied = np.unpackbits(np.frombuffer(state, np.uint8), count=len(block.keys)).astype(bool)
    codes = np.full(len(block.keys), -1, np.int64)
    codes[tied] = np.frombuffer(b"".join(r for _, r in replies), "<i8")
    code, own = codes[block.inverse], block.least[block.inverse]
    source = code >> 1
    firsts = np.flatnonzero((code >= 0) & (source == block.number) & (block.rank == own))
    firsts = np.sort(firsts[np.unique(block.inverse[firsts], return_index=True)[1]])
    lost = np.flatnonzero((code >= 0) & ((code & 1 == 1) | (block.rank > own)))
    cut = np.zeros(len(lost), bool)
    if len(lost):
        cut[0] = True
        cut[1:] = (np.diff(block.starts[lost]) != 1) | (np.diff(source[lost]) != 0)
        cut[1:] |= block.all[lost[:-1]] & np.uint64((1 << CUT_BITS) - 1) == 0
    begins = np.flatnonzero(cut)
    lengths = np.diff(np.r_[begins, len(lost)])
    begins, to = lost[begins], source[lost[begins]]
    order = np.argsort(to, kind="stable")
    begins, lengths, to = begins[order], lengths[order], to[order]
    rows = {"block": [block.number], "sender": [None], "body": [b""], "phrases": [firsts.astype("<u4").tobytes()]}
    places = np.zeros(len(begins), np.int64)
    asked, at = [], 0
    edges = heads(to)
    for a, b in zip(edges, np.r_[edges[1:], len(to)]):
        known: dict[bytes, int] = {}
        before = at
        for k in range(a, b):
            s = block.starts[begins[k]]
            text = block.words.part(s, s + lengths[k] - 1 + WINDOW)
            place = known.get(text)
            if place is None:
                place = known[text] = at
                at += int(lengths[k])
            places[k] = place
        asked += [int(to[a]), at - before]
        rows["block"].append(int(to[a]))
        rows["sender"].append(block.number)
        rows["body"].append(b"\n".join(known))
        rows["phrases"].append(None)
    rows["body"][0] = np.concatenate([[len(begins)], begins, lengths, places, asked]).astype("<i8").tobytes()
    return pa.table(rows, schema=_ROUTE)


class _Letters(dict):
    """Two letters per word in order of arrival, so that no node has many children; letter 0 is for words of no phrase."""

    def __missing__(self, word: bytes) -> str:
        high, low = divmod(len(self), FAN)
        self[word] = letters = chr(1 + low) + chr(1 + FAN + high)
        return letters


def _automata(block: Block, firsts: np.ndarray, shard_bytes: int):
    """Automata of the windows at ``firsts`` with their words' letters, each of about ``shard_bytes`` of phrases."""
    import ahocorasick

    words = block.words
    starts = block.starts[firsts]
    sizes = words.at[starts + WINDOW - 1] + words.lengths[starts + WINDOW - 1] - words.at[starts]
    shard = (np.cumsum(sizes) - sizes) // shard_bytes
    edges = heads(shard)
    for a, b in zip(edges, np.r_[edges[1:], len(starts)]):
        letters = _Letters()
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        runs = np.r_[a, a + 1 + np.flatnonzero(np.diff(starts[a:b]) != 1), b]
        for c, d in zip(runs[:-1], runs[1:]):
            run = words.part(starts[c], starts[d - 1] + WINDOW).split(b" ")
            spelt = "".join([letters[w] for w in run])
            for k in range(d - c):
                automaton.add_word(spelt[2 * k : 2 * (k + WINDOW)])
        automaton.make_automaton()
        yield automaton, letters


def _confirm(shard_bytes: int):
    """Round 4: runs through the automata of the phrases held first here; a bit back for each window of each run."""

    def step(table: pa.Table, messages: pa.Table) -> pa.Table:
        block = Block(table)
        kept = messages.filter(pc.is_null(messages.column("sender")))
        asked = messages.filter(pc.is_valid(messages.column("sender")))
        firsts = np.frombuffer(b"".join(kept.column("phrases").to_pylist()), "<u4").astype(np.int64)
        bodies = [body.replace(b"\n", b" \n ").split(b" ") for body in asked.column("body").to_pylist()]
        found = [np.zeros(len(body), bool) for body in bodies]
        for automaton, letters in _automata(block, firsts, shard_bytes):
            for body, hit in zip(bodies, found):
                spelt = "".join([letters.get(w, "\0\0") for w in body])
                hit[[end >> 1 for end, _ in automaton.iter(spelt)]] = True
        replies = []
        for body, hit in zip(bodies, found):
            # a window is told by its last word: the first words of a run end none
            parted = np.flatnonzero(np.array([w == b"\n" for w in body]))
            ends = np.ones(len(body), bool)
            ends[parted] = False
            ends[(np.r_[0, parted + 1][:, None] + np.arange(WINDOW - 1)).ravel()] = False
            replies.append(np.packbits(hit[ends]).tobytes())
        rows = {
            "block": asked.column("sender").to_pylist() + [block.number] * kept.num_rows,
            "sender": [block.number] * len(replies) + [None] * kept.num_rows,
            "body": replies + kept.column("body").to_pylist(),
            "phrases": [None] * (len(replies) + kept.num_rows),
        }
        return pa.table(rows, schema=_ROUTE)

    return step


def _covered(block: Block, messages: pa.Table) -> np.ndarray:
    """Which words lie under a confirmed window."""
    own, bits = None, {}
    for sender, body in zip(messages.column("sender").to_pylist(), messages.column("body").to_pylist()):
        if sender is None:
            own = np.frombuffer(body, "<i8")
        else:
            bits[sender] = body
    depth = np.zeros(len(block.words) + 1, np.int64)
    if own is None or not own[0]:
        return depth[:-1] > 0
    n = int(own[0])
    begins, lengths, places, asked = own[1 : n + 1], own[n + 1 : 2 * n + 1], own[2 * n + 1 : 3 * n + 1], own[3 * n + 1 :].reshape(-1, 2)
    hit = np.concatenate([np.unpackbits(np.frombuffer(bits[to], np.uint8), count=count) for to, count in asked.tolist()]).astype(bool)
    each = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    windows = (np.repeat(begins, lengths) + each)[hit[np.repeat(places, lengths) + each]]
    starts = block.starts[windows]
    depth += np.bincount(starts, minlength=len(depth)) - np.bincount(starts + WINDOW, minlength=len(depth))
    return np.cumsum(depth[:-1]) > 0


def _result(table: pa.Table, messages: pa.Table) -> pa.Table:
    block = Block(table)
    words = block.words
    gone = _covered(block, messages)
    keep = ~gone
    said = words.said[np.repeat(keep, words.lengths + 1)]
    sizes = np.bincount(words.of_text[keep], words.lengths[keep] + 1, minlength=len(words.counts)).astype(np.int64)
    ends = np.cumsum(sizes)
    kept = [said[a : max(a, b - 1)].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist())]
    return pa.table(
        {
            "doc_id": block.ids,
            "n_words": pa.array(words.counts.astype(np.int64)),
            "n_removed": pa.array(np.bincount(words.of_text[gone], minlength=len(words.counts)).astype(np.int64)),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        }
    )


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and the kept text (``kept``)."""
    buckets = partitions(docs.sparkSession)
    blocks = blocked(docs, F.col(text_col), BLOCK_BYTES, doc_id=F.col(id_col).cast("long"))
    by_block = blocks.groupBy("block")

    def settled(sent: DataFrame, settle) -> DataFrame:
        return staged(sent.groupBy("bucket").applyInArrow(settle, MESSAGE), "substr-round")

    def cogrouped(answers: DataFrame, step, schema: str) -> DataFrame:
        return by_block.cogroup(answers.groupBy("block")).applyInArrow(step, schema)

    answers = settled(by_block.applyInArrow(_tied(buckets), MESSAGE), _settle(True, True))
    answers = settled(cogrouped(answers, _holders(buckets), MESSAGE), _first_holders)
    confirmed = staged(cogrouped(cogrouped(answers, _route, ROUTE), _confirm(SHARD_BYTES), ROUTE), "substr-confirmed")
    return cogrouped(confirmed, _result, RESULT)


def oracle() -> str:
    """All windows in DuckDB SQL, grouped by their words."""
    return f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
win AS (
  SELECT doc_id, r, i, w[i:i + {WINDOW - 1}] AS g
  FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
firsts AS (SELECT g, min(doc_id) AS f FROM win GROUP BY g),
cov AS (
  SELECT r, list(DISTINCT k) AS ks FROM (
    SELECT win.r, unnest(range(win.i, win.i + {WINDOW})) AS k
    FROM win JOIN firsts USING (g) WHERE win.doc_id > firsts.f)
  GROUP BY r),
k AS (
  SELECT d.doc_id, len(d.w) AS n_words,
         CASE WHEN cov.ks IS NULL THEN d.w ELSE list_filter(d.w, lambda x, j: NOT list_contains(cov.ks, j)) END AS kept
  FROM d LEFT JOIN cov USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_words - len(kept) AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256, array_to_string(kept, ' ') AS kept
FROM k
"""
