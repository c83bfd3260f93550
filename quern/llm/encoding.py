"""Operator 3, BPE encoding and decoding through a minimal acyclic transducer.

Frequent words are compiled into a minimal acyclic automaton whose transitions
carry numbers; the sum along a word's path is the word's rank, which points at
its token ids. Equal suffixes share their states. The automaton is one file of
flat arrays that each worker maps into memory. Words that it lacks are merged
exactly by the tokenizer's rules.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import shared_path, staged
from quern.session import write_bytes

#: Words of the automaton: those seen most often. A bound on a cache, results do not depend on it.
LEXICON_WORDS = 300_000
#: Words and pieces that a worker remembers at most.
CACHE_WORDS = 400_000
#: Characters handled at a time.
BATCH_CHARS = 4_000_000


# -- text to words ---------------------------------------------------------------------------------
def byte_letters() -> dict[int, str]:
    """Bytes as printable letters: printable Latin-1 stands for itself, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Tokenizer:
    """The rules of a tokenizer file with word ends: normal form, lower case, word pattern, ranked merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"]:
            raise ValueError("not a lower-case tokenizer with word ends")
        self.suffix: str = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.special_pattern = re.compile("|".join(map(re.escape, special))) if special else None
        self.tokens = {i: t for t, i in {**self.vocab, **special}.items()}

    def chunks(self, text: str) -> list[str]:
        """Normalised pieces between white space."""
        if text.isascii():
            text = text.lower()
        else:
            text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ").lower()  # one letter at a time: no final form
        if _ODD_SPACE.search(text):
            return [c for c in _SPACE.split(text) if c]
        return text.split()

    def cut(self, chunk: str) -> list[str]:
        """The words of a piece; most pieces are letters, perhaps with one mark at the end."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk]
            if chunk[:-1].isalpha() and not chunk[-1].isdigit():
                return [chunk[:-1], chunk[-1]]
        elif chunk[0] == MARK:
            return [chunk]
        return self.words(chunk)

    def words(self, chunk: str) -> list[str]:
        if chunk.isascii() or not any(unicodedata.category(c) == "Cn" for c in chunk):
            return self.pattern.findall(chunk)
        # characters newer than the tokenizer's tables are no letters to it, as private ones are not
        stand_in = "".join("\ue000" if unicodedata.category(c) == "Cn" else c for c in chunk)
        return [chunk[m.start() : m.end()] for m in self.pattern.finditer(stand_in)]

    def merge(self, word: str) -> list[int]:
        """Token ids of a word: the best ranked pair is merged, leftmost first, until none is left."""
        parts = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        if not parts:
            return []
        parts[-1] += self.suffix
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get((parts[i], parts[i + 1]))
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.vocab[p] for p in parts if p in self.vocab]


#: Starts the pieces that stand for special tokens; a lone surrogate occurs in no text.
MARK = "\udc00"
# str.split also cuts at these four, which are no white space to the pattern
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"[\p{White_Space}]+")


# -- the transducer --------------------------------------------------------------------------------
def compile_transducer(words: list[bytes]) -> bytes:
    """A minimal acyclic automaton of sorted distinct words as one block of little-endian 32-bit numbers.

    States are built from sorted words, and a state equal to an earlier one is
    replaced by it, so suffixes are shared. A transition holds byte, target and
    the number of words that sort before its branch.
    """
    register: dict[tuple, int] = {}
    final, edges, below = [False], [[]], [0]  # finished states; state 0 is unused
    path: list[list] = [[False, []]]  # states along the newest word: final, [(byte, state)]

    def freeze(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(final)
            final.append(state[0])
            edges.append(state[1])
            below.append(int(state[0]) + sum(below[t] for _, t in state[1]))
        return register[key]

    def shrink(depth: int, word: bytes) -> None:
        while len(path) > depth + 1:
            number = freeze(path.pop())
            path[-1][1].append((word[len(path) - 1], number))

    last = b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        shrink(common, last)
        path += [[False, []] for _ in range(len(word) - common)]
        path[-1][0] = True
        last = word
    shrink(0, last)
    root = freeze(path[0])
    counts = [len(e) for e in edges]
    first = np.zeros(len(final) + 1, np.int32)
    np.cumsum(counts, out=first[1:])
    labels, targets, outputs = [], [], []
    for state, out in enumerate(edges):
        number = int(final[state])
        for byte, target in out:
            labels.append(byte)
            targets.append(target)
            outputs.append(number)
            number += below[target]
    head = np.array([len(final), len(labels), root, len(words)], "<i4")
    arrays = [head, first, np.array(final, "<i4"), *(np.array(a, "<i4") for a in (labels, targets, outputs))]
    return b"".join(np.ascontiguousarray(a, "<i4").tobytes() for a in arrays)


def pack_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """Automaton and ids in one block: the rank of a word points at its ids."""
    words = sorted(entries)
    body = compile_transducer(words)
    offsets = np.zeros(len(words) + 1, "<i4")
    np.cumsum([len(entries[w]) for w in words], out=offsets[1:])
    ids = np.array([i for w in words for i in entries[w]], "<i4")
    return np.array([len(body) // 4], "<i4").tobytes() + body + offsets.tobytes() + ids.tobytes()


class Lexicon:
    """A mapped lexicon file; :meth:`ranks` walks many words at once."""

    def __init__(self, numbers: np.ndarray) -> None:
        self.size = int(numbers[0])
        body, tail = numbers[1 : 1 + self.size], numbers[1 + self.size :]
        states, edges, self.root, self.words = (int(x) for x in body[:4])
        cuts = np.cumsum([4, states + 1, states, edges, edges, edges])
        self.first, self.final, labels, self.targets, self.outputs = (
            body[a:b] for a, b in zip(cuts[:-1], cuts[1:])
        )
        owner = np.repeat(np.arange(states, dtype=np.int64), np.diff(self.first))
        self.keys = owner * 256 + labels  # sorted: labels ascend within a state
        self.offsets, self.ids = tail[: self.words + 1], tail[self.words + 1 :]

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, "<i4", "r"))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for words the automaton does not accept."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state = np.full(n, self.root, np.int64)
        rank = np.zeros(n, np.int64)
        live = np.arange(n)
        depth = 0
        while len(live):
            done = lengths[live] == depth
            ended = live[done]
            rank[ended[self.final[state[ended]] == 0]] = -1
            live = live[~done]
            if not len(live):
                break
            key = state[live] * 256 + data[starts[live] + depth]
            at = np.searchsorted(self.keys, key)
            ok = at < len(self.keys)
            ok[ok] = self.keys[at[ok]] == key[ok]
            rank[live[~ok]] = -1
            live, at = live[ok], at[ok]
            rank[live] += self.outputs[at]
            state[live] = self.targets[at]
            depth += 1
        return rank


# -- jobs ------------------------------------------------------------------------------------------
@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def count_words(docs: DataFrame, text_col: str, path: str) -> DataFrame:
    """(word, n) over all texts; each task sends a word once per batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = tokenizer(path)
        for batch in batches:
            chunks: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    chunks.update(rules.chunks(text))
            total: dict[str, int] = {}
            for chunk, n in chunks.items():
                for word in rules.cut(chunk):
                    total[word] = total.get(word, 0) + n
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
            )

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, text_col: str, path: str, words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of all texts into a file on every executor; returns the file's name.

    At most ``words`` words reach the driver, so the file's size is bounded.
    """
    spark = docs.sparkSession
    rules = tokenizer(path)
    counted = staged(count_words(docs, text_col, path).filter("n > 1"), "word-counts")
    # counts fall into few classes of like size; the cut is the lowest class that keeps the lexicon within its bound
    level = F.floor(F.log2("n") * 16).cast("int")
    classes = counted.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()
    cut, held = 1 << 20, 0
    for row in sorted(classes, reverse=True):
        if held + row["words"] > words:
            break
        cut, held = row["level"], held + row["words"]
    often = counted.filter(level >= cut).select("word")
    entries = {row[0].encode("utf-8", "surrogatepass"): rules.merge(row[0]) for row in often.toLocalIterator()}
    block = pack_lexicon(entries)
    target = shared_path(spark, "lexicon") + f"-{hashlib.sha256(block).hexdigest()[:16]}.fst"
    write_bytes(spark, target, block)
    spark.sparkContext.addFile(target)
    return target.rsplit("/", 1)[1]


class _Index(dict):
    """Numbers keys in the order they are first asked for; ``new`` collects them."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        self.new.append(key)
        return number


class _Lists:
    """Lists of numbers by index, kept flat and appended in bulk."""

    def __init__(self) -> None:
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.values = np.zeros(0, np.int64)

    def extend(self, lengths: np.ndarray, values: np.ndarray) -> None:
        starts = len(self.values) + np.cumsum(lengths) - lengths
        self.lengths = np.concatenate([self.lengths, lengths])
        self.starts = np.concatenate([self.starts, starts])
        self.values = np.concatenate([self.values, values])

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of ``index`` one after another, and each one's length."""
        return gather(self.starts, self.lengths, self.values, index)


def gather(
    starts: np.ndarray, lengths: np.ndarray, values: np.ndarray, index: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    size = lengths[index]
    shift = starts[index] - (np.cumsum(size) - size)
    return values[np.repeat(shift, size) + np.arange(int(size.sum()))], size


class Encoder:
    """Texts to ids: pieces are cut into words once, words looked up in the automaton, unknown ones merged."""

    def __init__(self, rules: Tokenizer, lexicon: Lexicon) -> None:
        self.rules, self.lexicon = rules, lexicon
        self.reset()

    def reset(self) -> None:
        self.chunks, self.words = _Index(), _Index()
        self.chunk_words, self.word_ids = _Lists(), _Lists()

    def _learn(self) -> None:
        """Ids of the pieces that were not met before."""
        words = self.words
        cut = [self.rules.cut(c) for c in self.chunks.new]
        lengths = np.fromiter(map(len, cut), np.int64, len(cut))
        codes = np.fromiter((words[w] for ws in cut for w in ws), np.int64, int(lengths.sum()))
        self.chunk_words.extend(lengths, codes)
        self.chunks.new.clear()
        new, words.new = words.new, []
        special = self.rules.special
        rank = self.lexicon.ranks([w.encode("utf-8", "surrogatepass") for w in new])
        offsets = self.lexicon.offsets.astype(np.int64)
        merged = {
            int(i): [special[new[i][1:]]] if new[i][0] == MARK and new[i][1:] in special else self.rules.merge(new[i])
            for i in np.flatnonzero(rank < 0)
        }
        lengths = np.where(rank >= 0, offsets[rank + 1] - offsets[rank], 0)
        for i, ids in merged.items():
            lengths[i] = len(ids)
        known = np.flatnonzero(rank >= 0)
        values = np.zeros(int(lengths.sum()), np.int64)
        starts = np.cumsum(lengths) - lengths
        found, size = gather(offsets[:-1], np.diff(offsets), self.lexicon.ids, rank[known])
        at = np.repeat(starts[known] - (np.cumsum(size) - size), size) + np.arange(len(found))
        values[at] = found
        for i, ids in merged.items():
            values[starts[i] : starts[i] + len(ids)] = ids
        self.word_ids.extend(lengths, values)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        if len(self.chunks) > CACHE_WORDS:
            self.reset()
        number = self.chunks.__getitem__
        coded = [np.array(list(map(number, self._pieces(t))), np.int64) for t in texts]
        if self.chunks.new:
            self._learn()
        out = []
        for code in coded:
            words, _ = self.chunk_words.gather(code)
            ids, _ = self.word_ids.gather(words)
            out.append(ids.astype(np.int32))
        return out

    def _pieces(self, text: str) -> list[str]:
        special = self.rules.special_pattern
        if special is None or "<|" not in text or not special.search(text):
            return self.rules.chunks(text)
        out, at = [], 0
        for m in special.finditer(text):  # their strings are tokens of their own, as the library takes them
            out += self.rules.chunks(text[at : m.start()])
            out.append(MARK + m.group())
            at = m.end()
        return out + self.rules.chunks(text[at:])


class Decoder:
    """Ids to text as a tokenizer without a decoder does: tokens joined by single spaces."""

    def __init__(self, rules: Tokenizer) -> None:
        top = max(rules.tokens) + 1
        self.tokens = np.array([rules.tokens.get(i, "") for i in range(top)], object)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.tokens[ids].tolist())


ENCODED = "ids array<int>"


def encode(
    docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = False
) -> DataFrame:
    """Encode whole texts; returns the ``keep`` columns and ``ids``.

    With ``digests``, the columns n_tokens, ids_sha256 and decoded_sha256 take
    the place of the ids; the decoded text is made from the ids. Null and empty
    texts have no tokens. Repeated rows and null ids are kept row by row; an
    empty table gives no rows. Columns outside ``keep`` are ignored.
    """
    name = build_lexicon(docs, text_col, path)
    columns = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    source = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *columns)
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else ENCODED
    schema = ", ".join([f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + [added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = tokenizer(path)
        encoder, decoder = Encoder(rules, Lexicon.mapped(SparkFiles.get(name))), Decoder(rules)
        for batch in batches:
            at, step = 0, max(1, batch.num_rows)
            lengths = [len(x) for x in batch.column(0).to_pylist()]
            while at < batch.num_rows:
                size, step = 0, 0
                while at + step < batch.num_rows and (step == 0 or size + lengths[at + step] <= BATCH_CHARS):
                    size += lengths[at + step]
                    step += 1
                part = batch.slice(at, step)
                yield _encoded(part, encoder, decoder, digests)
                at += step

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *out.columns[len(keep) :])


def _encoded(part: pa.RecordBatch, encoder: Encoder, decoder: Decoder, digests: bool) -> pa.RecordBatch:
    ids = encoder.encode(part.column(0).to_pylist())
    kept = list(part.columns[1:])
    names = [f"k{i}" for i in range(len(kept))]
    if not digests:
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(offsets, pa.array(flat))], names=[*names, "ids"])
    texts = [decoder.decode(x) for x in ids]
    return pa.RecordBatch.from_arrays(
        [
            *kept,
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts], pa.string()),
        ],
        names=[*names, "n_tokens", "ids_sha256", "decoded_sha256"],
    )
