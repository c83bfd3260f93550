"""Operator 7, near-duplicates by DartMinHash over weighted five-word shingles.

A text is a weighted set: each shingle weighs as often as it occurs. The
region under the weights is cut into units, copy c of shingle h being one, and
darts fall on a unit at the times of a Poisson process that depends on the
unit alone. A text only looks at darts before ``theta``, set so that a fixed
expected number of darts hits it whatever its length; each dart belongs to one
of ``COORDINATES`` coordinates, and the earliest dart of a coordinate is its
value. A text that misses a coordinate looks at twice the time. Two texts share
a value with the probability of their weighted Jaccard similarity.

Bands of values propose links, each member to one leader per band. Proposed
links are checked on the exact weighted similarity: first every text's most
frequent leader, then the links between what those leave apart. Last, the other
members of a band that still lie apart are compared with each other, in tiles
of two bounded blocks that return one link per text, never pairs.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import staged
from quern.llm.links import components
from quern.llm.vectors import local_roots

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 25
ROWS = 5
COORDINATES = BANDS * ROWS
#: Darts expected on a text: all coordinates are hit nearly always.
DARTS = COORDINATES * np.log(COORDINATES) + 2 * COORDINATES
#: Darts taken at a time, by the number taken before.
THROWS = (1, 1, 2, 2, 4, 4, 4, 4, 8, 8, 8, 8, 8, 8, 8, 8, 32)
#: Words handled at a time, and words remembered.
BATCH_WORDS = 800_000
MEMORY_WORDS = 400_000
#: Texts of a block of a band's members, and their shingles (a longer text stands alone); shingles compared at a time.
BLOCK = 256
BLOCK_UNITS = 2_000_000
STRIP = 2048


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_ODD = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) & (1 << 64) - 1 | 1 for i in range(SHINGLE)], np.uint64)
_STEP = np.uint64(0xA0761D6478BD642F)


class _Words(dict):
    """Word to index, with the hash of each."""

    def __init__(self) -> None:
        self.hashes = array("Q")

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return number


def units(texts: list[bytes], words: _Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The units of each text's weighted shingle set: hashes, and the index of their text (ascending).

    A text of fewer than five words is one shingle; without words it has none.
    ``words`` keeps hashes of words between calls.
    """
    words = _Words() if words is None else words
    number = words.__getitem__
    coded = [list(map(number, t.split())) for t in texts]
    counts = np.fromiter(map(len, coded), np.int64, len(coded))
    n = int(counts.sum())
    codes = np.fromiter(chain.from_iterable(coded), np.int64, n)
    line = np.frombuffer(words.hashes, np.uint64)[codes]
    starts = np.cumsum(counts) - counts
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    first = np.cumsum(sizes) - sizes
    of_text = np.repeat(np.arange(len(coded)), sizes)
    line = np.concatenate([line, np.zeros(SHINGLE, np.uint64)])
    at = np.arange(len(of_text)) + np.repeat(starts - first, sizes)
    h = np.zeros(len(of_text), np.uint64)
    for k in range(SHINGLE):
        h += line[at + k] * _ODD[k]
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        a, c = int(starts[i]), int(counts[i])
        h[first[i]] = np.sum(line[a : a + c] * _ODD[:c], dtype=np.uint64) + np.uint64(c)
    h = mix(h)
    # number the copies of a shingle within its text
    key = mix(h + of_text.astype(np.uint64) * _STEP)
    order = np.argsort(key)
    ranked = key[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]] if len(ranked) else np.zeros(0, bool)
    if not new.all():
        at = np.arange(len(ranked))
        copy = np.empty(len(ranked), np.int64)
        copy[order] = at - np.maximum.accumulate(np.where(new, at, 0))
        repeated = copy > 0
        h[repeated] = mix(h[repeated] + copy[repeated].astype(np.uint64) * _STEP)
    return h, of_text


def signatures(unit: np.ndarray, of_text: np.ndarray, n: int) -> np.ndarray:
    """(n, COORDINATES) values; rows of texts without units stay 0."""
    values = np.zeros((n, COORDINATES), np.uint64)
    weight = np.bincount(of_text, minlength=n)
    theta = np.where(weight > 0, DARTS / np.maximum(weight, 1), 0.0)
    todo = weight > 0
    while todo.any():
        mine = todo[of_text]
        u, t = unit[mine], of_text[mine]
        when, throw = np.zeros(len(u)), 0
        owner, place, time, name = [], [], [], []
        while len(u):
            many = THROWS[min(throw, len(THROWS) - 1)]  # units that are still live after a few darts take many
            salt = np.arange(2 * throw + 1, 2 * (throw + many) + 1, 2, dtype=np.uint64) * _STEP
            dart = mix(u[:, None] + salt[None, :])
            times = np.cumsum(-np.log1p((dart >> np.uint64(11)).astype(np.float64) * -(2.0**-53)), axis=1)
            times += when[:, None]
            row, col = np.nonzero(times < theta[t][:, None])
            owner.append(t[row])
            name.append(mix(dart[row, col] + _STEP))
            place.append((name[-1] % np.uint64(COORDINATES)).astype(np.int64))
            time.append(times[row, col])
            live = times[:, -1] < theta[t]
            u, t, when = u[live], t[live], times[live, -1]
            throw += many
        owner, place, time, name = (np.concatenate(x) for x in (owner, place, time, name))
        late_first = np.argsort(-time)
        cell = (owner * COORDINATES + place)[late_first]
        hit = np.zeros(n * COORDINATES, bool)
        hit[cell] = True
        values.reshape(-1)[cell] = name[late_first]  # the earliest is written last
        todo = todo & ~hit.reshape(n, COORDINATES).all(axis=1)
        theta = np.where(todo, theta * 2, theta)
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    """(n, BANDS) hashes of the rows of each band."""
    keys = np.zeros((len(values), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys + values[:, r::ROWS] * _ODD[r])
    return mix(keys + np.arange(BANDS, dtype=np.uint64) * _STEP)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """Parts of batches with a bounded number of words (a longer text stands alone), and their units."""
    words = _Words()
    for batch in batches:
        texts = batch.column(0).to_pylist()
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= BATCH_WORDS * 6):
                size += len(texts[b])
                b += 1
            yield batch.slice(a, b - a), b - a, *units(texts[a:b], words)
            if len(words) > MEMORY_WORDS:
                words = _Words()
            a = b


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, n, unit, of_text in _slices(batches):
        keys = band_keys(signatures(unit, of_text, n))
        some = np.bincount(of_text, minlength=n) > 0
        flat = pa.array(keys[some].astype(np.int64).reshape(-1))
        offsets = np.zeros(n + 1, np.int32)
        np.cumsum(some * BANDS, out=offsets[1:])
        yield pa.RecordBatch.from_arrays([part.column(1), pa.ListArray.from_arrays(offsets, flat)], names=["cls", "bands"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, n, unit, of_text in _slices(batches):
        cuts = np.searchsorted(of_text, np.arange(n + 1))
        sets = [np.sort(unit[a:b]).astype("<u8").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([part.column(1), pa.array(sets, pa.binary())], names=["cls", "grams"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("ga").to_pylist(), batch.column("gb").to_pylist()
        score = np.empty(len(left))
        for i, (a, b) in enumerate(zip(left, right)):
            x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
            together = len(x) + len(y)
            if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
                score[i] = 0.0  # sizes alone rule it out
                continue
            merged = np.concatenate([x, y])
            merged.sort()
            both = int(np.count_nonzero(merged[1:] == merged[:-1]))
            score[i] = both / (together - both) if together else 0.0
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(score)], names=["a", "b", "score"]
        )


def common_units(sets: list[np.ndarray], cut: int) -> np.ndarray:
    """Number of units that each of the first ``cut`` sets shares with each of the others; with all others if there are none."""
    n = len(sets)
    right = slice(cut, n) if cut < n else slice(0, n)
    total = np.zeros((cut, n - cut if cut < n else n))
    _, unit, texts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of_text = np.repeat(np.arange(n), [len(x) for x in sets])
    shared = texts[unit] > 1
    unit, of_text = unit[shared], of_text[shared]
    order = np.argsort(unit, kind="stable")
    unit, of_text = unit[order], of_text[order]
    column = np.cumsum(np.r_[False, unit[1:] != unit[:-1]]) if len(unit) else unit
    ends = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + STRIP, STRIP))
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        has = np.zeros((n, STRIP), np.float32)
        has[of_text[a:b], column[a:b] - k * STRIP] = 1
        total += has[:cut] @ has[right].T
    return total


def _tile(table: pa.Table) -> pa.Table:
    """Links of the texts of two blocks (or one) to the smallest text each reaches by similar pairs of different roots."""
    table = table.sort_by([("block", "ascending"), ("cls", "ascending")]).combine_chunks()
    first, last = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    cut = table.column("block").to_pylist().index(last) if first != last else table.num_rows
    sets = [np.frombuffer(x, "<u8") for x in table.column("grams").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    root = table.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
    both = common_units(sets, cut)
    right = slice(cut, None) if first != last else slice(None)
    score = both / (sizes[:cut, None] + sizes[None, right] - both)
    i, j = np.nonzero((score >= SIMILARITY) & (root[:cut, None] != root[None, right]))
    if first != last:
        j = j + cut
    some = np.union1d(i, j)
    cls = table.column("cls")
    return pa.table({"a": cls.take(pa.array(some)), "b": cls.take(pa.array(local_roots(len(sets), i, j)[some]))})


def text_class(text_col: str) -> Column:
    """16 bytes that tell different texts apart."""
    return F.unhex(F.md5(F.col(text_col).cast("string").cast("binary")))


def _short(col: str) -> Column:
    """A number for a class; two classes may share one."""
    return F.xxhash64(col)


def _verified(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """Of (a, b) pairs those whose exact weighted similarity reaches the threshold."""
    joined = pairs.join(grams.select(F.col("cls").alias("a"), F.col("grams").alias("ga")), "a")
    joined = joined.join(grams.select(F.col("cls").alias("b"), F.col("grams").alias("gb")), "b")
    scored = joined.select("a", "b", "ga", "gb").mapInArrow(_similar, "a binary, b binary, score double")
    return scored.filter(F.col("score") >= SIMILARITY).select("a", "b")


def _apart(members: DataFrame) -> DataFrame:
    """(band, i, j, block, cls, root): members of bands with several roots, once for each tile of two blocks.

    The members of a root that fills blocks have blocks of their own, which do
    not meet each other; the other roots of a band are dealt into common ones.
    """
    need = lambda n, units: F.ceil(F.greatest(n / F.lit(BLOCK), units / F.lit(BLOCK_UNITS))).cast("long")
    parts = members.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("units").alias("units"))
    parts = staged(parts.withColumn("own", need(F.col("n"), F.col("units"))), "minhash-parts")
    few = lambda c: F.coalesce(F.sum(F.when(F.col("own") == 1, F.col(c))), F.lit(0))
    bands = parts.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), need(few("n"), few("units")).alias("blocks"))
    bands = bands.filter("low < high").select("band", "blocks")
    dealt = members.join(parts.join(bands.hint("merge"), "band").select("band", "root", "own", "blocks").hint("merge"), ["band", "root"])
    alone = F.when(F.col("own") > 1, F.col("root"))
    block = F.when(
        F.col("own") > 1, F.concat_ws(":", F.hex("root"), F.pmod(F.xxhash64("cls"), F.col("own")).cast("string"))
    ).otherwise(F.pmod(F.xxhash64("root"), F.col("blocks")).cast("string"))
    dealt = staged(dealt.select("band", "cls", "root", alone.alias("alone"), block.alias("block")), "minhash-dealt")
    blocks = dealt.select("band", "block", "alone").distinct()
    i = blocks.select("band", F.col("block").alias("i"), F.col("alone").alias("ai"))
    j = blocks.select("band", F.col("block").alias("j"), F.col("alone").alias("aj"))
    tiles = i.join(j, "band").filter("i <= j and (ai is null or aj is null or ai != aj)").select("band", "i", "j")
    tiles = staged(tiles, "minhash-tiles")
    sides = tiles.withColumn("block", F.col("i")).unionByName(tiles.filter("i != j").withColumn("block", F.col("j")))
    return dealt.join(sides, ["band", "block"]).select("band", "i", "j", "block", "cls", "root")


def class_roots(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(cls, root) of all text classes that are linked to another one."""
    texts = docs.filter(F.col(text_col).isNotNull()).select(
        F.col(text_col).cast("string").cast("binary").alias("text"), text_class(text_col).alias("cls")
    )
    signed = staged(texts.mapInArrow(_bands, "cls binary, bands array<bigint>"), "minhash-bands")
    # short names are enough to meet; the classes are looked up for pairs, so names that clash cost a check only
    keys = signed.select(_short("cls").alias("key"), F.explode("bands").alias("band"))
    # a leader per band, smallest after mixing with the band: bands of the same texts have different leaders
    mixed = F.col("key").bitwiseXOR(F.col("band"))
    leaders = (
        keys.groupBy("band")
        .agg(F.min(mixed).alias("lead"), F.min("key").alias("low"), F.max("key").alias("high"))
        .filter("low < high")
        .select("band", F.col("lead").bitwiseXOR(F.col("band")).alias("lead"))
    )
    # leaders grow with the texts: never broadcast, so the plan is the same at every size
    hits = staged(
        keys.join(leaders.hint("merge"), "band").filter("key != lead").select("band", "key", "lead"), "minhash-hits"
    )
    met = staged(
        hits.select(F.least("key", "lead").alias("ka"), F.greatest("key", "lead").alias("kb"))
        .groupBy("ka", "kb")
        .agg(F.count(F.lit(1)).alias("n")),
        "minhash-pairs",
    )
    ends = met.select(F.col("ka").alias("key")).unionByName(met.select(F.col("kb").alias("key"))).distinct()
    names = staged(
        signed.select(_short("cls").alias("key"), "cls").join(ends.hint("merge"), "key").distinct(), "minhash-names"
    )
    proposed = met.join(names.select(F.col("key").alias("ka"), F.col("cls").alias("a")).hint("merge"), "ka")
    proposed = proposed.join(names.select(F.col("key").alias("kb"), F.col("cls").alias("b")).hint("merge"), "kb")
    proposed = staged(proposed.select("a", "b", "n"), "minhash-pairs")
    involved = proposed.select(F.col("a").alias("cls")).unionByName(proposed.select(F.col("b").alias("cls"))).distinct()
    grams = staged(
        texts.dropDuplicates(["cls"])
        .join(involved.hint("merge"), "cls", "left_semi")
        .select("text", "cls")
        .mapInArrow(_grams, "cls binary, grams binary"),
        "minhash-grams",
    )
    # the pair that shares most bands, for either side of it
    ends = proposed.select(F.col("a").alias("e"), "a", "b", "n").unionByName(
        proposed.select(F.col("b").alias("e"), "a", "b", "n")
    )
    best = (
        ends.groupBy("e")
        .agg(F.max(F.struct("n", "a", "b")).alias("x"))
        .select(F.col("x.a").alias("a"), F.col("x.b").alias("b"))
        .distinct()
    )
    best = staged(best, "minhash-best")
    links = staged(_verified(best, grams), "minhash-links")
    roots = staged(components(links), "minhash-roots")
    rest = proposed.join(best, ["a", "b"], "left_anti").select("a", "b")
    side = lambda c, r: roots.select(F.col("node").alias(c), F.col("root").alias(r))
    rest = rest.join(side("a", "ra"), "a", "left").join(side("b", "rb"), "b", "left")
    apart = rest.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    more = staged(_verified(apart.select("a", "b"), grams), "minhash-links")
    # the other members of a band never met each other; those that the first links leave apart do now
    known = names.join(grams.select("cls", (F.length("grams") / 8).alias("units")).hint("merge"), "cls")
    known = known.join(roots.withColumnRenamed("node", "cls").hint("merge"), "cls", "left")
    known = known.select("key", "cls", F.coalesce("root", "cls").alias("root"), "units")
    members = hits.select("band", "key").distinct().join(known.hint("merge"), "key").select("band", "cls", "root", "units")
    tiles = _apart(staged(members, "minhash-members")).join(grams.hint("merge"), "cls")
    across = tiles.groupBy("band", "i", "j").applyInArrow(_tile, "a binary, b binary")
    links = links.unionByName(more).unionByName(staged(across, "minhash-across"))
    return components(links).select(F.col("node").alias("cls"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, group_id (smallest id of its group), group_size and kept (it is that id).

    Texts are in one group if they are equal or linked by weighted similarity
    of at least 0.8 over five-word shingles, directly or through others. Equal
    texts share one class, so copies are never paired. Empty texts equal each
    other; null texts stay alone and are kept. Rows with the smallest id of a
    group are all kept if it repeats. Null ids come after all others. An empty
    table gives no rows; other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(text_class(text_col), F.unhex(F.md5(F.concat(F.lit("null"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))))).alias("cls"),
    )
    roots = class_roots(docs, text_col)
    rows = staged(
        rows.join(roots, "cls", "left").select("id", F.coalesce("root", "cls").alias("root")), "minhash-rows"
    )
    groups = rows.groupBy("root").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    return rows.join(groups, "root").select(
        F.col("id").alias(id_col),
        F.col("first").alias("group_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("first")).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with all its columns: the one with the smallest id.

    Copies of a text are first reduced to their smallest id within each task.
    Rows without a text are kept.
    """
    columns = docs.columns
    some = docs.filter(F.col(text_col).isNotNull())
    order = F.struct(F.col(id_col).isNull(), F.col(id_col))
    one = (
        some.select(text_class(text_col).alias("cls"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), order.alias("o"))
        .groupBy("cls")
        .agg(F.min_by("row", "o").alias("row"), F.min("o").alias("o"))
    )
    roots = staged(class_roots(docs, text_col), "minhash-classes")
    linked = one.select("cls", "o").join(roots, "cls")
    first = linked.groupBy("root").agg(F.min(F.struct("o", "cls")).alias("x")).select(F.col("x.cls").alias("cls"))
    gone = staged(roots.select("cls").join(first, "cls", "left_anti"), "minhash-gone")
    kept = one.join(gone, "cls", "left_anti").select("row.*")
    return kept.unionByName(docs.filter(F.col(text_col).isNull()))


def oracle() -> str:
    """DuckDB SQL for :func:`near_duplicates` of ``documents``: all pairs that share a shingle, compared exactly."""
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS t, text FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
w AS (SELECT t, regexp_extract_all(text, '{word}') AS ws FROM t),
grams AS (
  SELECT t, g, count(*) AS n FROM (
    SELECT t, ws[i:i + 4] AS g FROM (SELECT t, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
    UNION ALL SELECT t, ws FROM w WHERE len(ws) BETWEEN 1 AND 4) GROUP BY ALL
),
sizes AS (SELECT t, sum(n) AS n FROM grams GROUP BY t),
common AS (
  SELECT a.t AS a, b.t AS b, sum(least(a.n, b.n)) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.t <> b.t GROUP BY ALL
),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.t = c.a JOIN sizes y ON y.t = c.b
  WHERE c.n::DOUBLE / (x.n + y.n - c.n) >= {SIMILARITY}
),
reach AS (SELECT t AS a, t AS b FROM t UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
roots AS (SELECT a AS t, min(b) AS root FROM reach GROUP BY a),
placed AS (SELECT doc_id, root FROM documents JOIN t USING (text) JOIN roots USING (t)),
groups AS (SELECT root, min(doc_id) AS group_id, count(*) AS group_size FROM placed GROUP BY root)
SELECT doc_id, group_id, group_size, doc_id = group_id AS kept FROM placed JOIN groups USING (root)
UNION ALL SELECT doc_id, doc_id, 1, true FROM documents WHERE text IS NULL
"""
