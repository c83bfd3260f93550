"""Operator 13, phrase collocation mining over a weighted de Bruijn graph.

Texts are lower-cased in A-Z, cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and
the pieces into words ``[^\\x20\\x09]+``; all counts are per lang (null:
``und``).

The graph: nodes are phrases of ``LONGEST - 1`` words, edges the phrases of
``LONGEST`` words that join their two overlapping nodes, weighted by how often
they occur. No phrase with ``f >= MIN_COUNT`` holds a pair of words with
``f < MIN_COUNT``, so the pieces are first cut at such pairs: blocks of texts
(``blocks``) send each distinct pair's fingerprint and count, one bit comes
back, and each block writes its distinct cut pieces with their counts. Only
edges and piece ends are counted from these: each piece adds its last 1 to
``LONGEST - 1`` words as end corrections. Every shorter count follows from the
level above by flow: ``f(g) = sum of f(g w) over words w + (pieces that end
with g)``, one aggregation per level. These counts are whole for single words
and for every phrase with ``f >= MIN_COUNT``; others may be missing or too low,
never too high. Equal fingerprints of two pairs only keep a pair that could go.

Candidates are phrases of 2 to ``LONGEST`` words with ``f >= MIN_COUNT``. A
unary step of the graph, an extension by one word to the left or right that
carries a candidate's whole count, compacts the candidate into the longer
phrase: it is dropped (a longer container with the same count always has such
a one-word step inside it, so one step suffices). A candidate's score is its
lowest ``floor(1000 a n / (l r))`` over its cuts, ties to the first cut, in
exact decimal arithmetic.

Edge cases: a null text is empty and adds no words; a null lang counts as
``und``; empty pieces add nothing; repeated rows count twice; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import NGram
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.blocks import Words, blocked, bucket_edges, grams, grouped, mixed
from quern.llm.common import partitions, staged
from quern.llm.suffixes import _bits

#: Fixed by the contract.
PIECE = r"[.,;:!?\x0A-\x0D]"
GAP = r"[\x20\x09]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
LONGEST = 5
MIN_COUNT = 100
TOP = 2000


#: Text per block.
BLOCK_BYTES = 4 << 20

PAIRS = "block long, bucket int, keys binary, counts binary"
_PAIRS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
PIECES = "lang string, piece string, c long"
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


class Block:
    """The lower-cased words of one block by lang, and its pairs of neighbours within pieces."""

    def __init__(self, table: pa.Table) -> None:
        langs = table.column("lang").to_pylist()
        order = sorted(range(len(langs)), key=langs.__getitem__)
        texts = table.column("text").to_pylist()
        self.number = table.column("block")[0].as_py()
        self.langs = [langs[i] for i in order]
        self.words = words = Words([texts[i].translate(_LOWERED) for i in order], b" \t", b"\n.,;:!?\x0b\x0c\r")
        own = {lang: int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little") for lang in set(langs)}
        lang = np.array([own[x] for x in self.langs], np.uint64)
        self.pairs = np.flatnonzero(~words.ends_phrase)
        keys = mixed(grams(words.hashes(), 2)[self.pairs] ^ lang[words.of_text[self.pairs]])
        _, first, self.keys, self.inverse = grouped(keys)
        self.counts = np.diff(np.r_[first, len(keys)])


def _sent(buckets: int, least: int):
    """Distinct pairs of a block, four bytes each, with their counts up to ``least``."""
    kind = np.min_scalar_type(least)

    def step(table: pa.Table) -> pa.Table:
        block = Block(table)
        counts = np.minimum(block.counts, least).astype(kind)
        rows = {"block": [], "bucket": [], "keys": [], "counts": []}
        for bucket, a, b in bucket_edges(block.keys, buckets):
            rows["block"].append(block.number)
            rows["bucket"].append(bucket)
            rows["keys"].append((block.keys[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
            rows["counts"].append(counts[a:b].tobytes())
        return pa.table(rows, schema=_PAIRS)

    return step


def _weighed(least: int):
    """Add up one bucket's counts; a bit for each pair that reaches ``least``."""
    kind = np.min_scalar_type(least)

    def settle(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(k, "<u4") for k in table.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(c, kind) for c in table.column("counts").to_pylist()])
        _, _, distinct, inverse = grouped(np.concatenate(parts))
        enough = (np.bincount(inverse, counts, minlength=len(distinct)) >= least)[inverse]
        bits = [np.packbits(e).tobytes() for e in np.split(enough, np.cumsum([len(p) for p in parts])[:-1])]
        rows = {"block": table.column("block"), "bucket": table.column("bucket"), "keys": bits, "counts": [None] * len(bits)}
        return pa.table(rows, schema=_PAIRS)

    return settle


def _cut(buckets: int):
    """A block's pieces, cut at pairs that do not reach the count, each distinct one with its count."""

    def step(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table)
        words = block.words
        replies = sorted(zip(answers.column("bucket").to_pylist(), answers.column("keys").to_pylist()))
        joined = _bits(replies, block.keys, buckets)[block.inverse]
        said = words.said
        after = words.at + words.lengths
        said[after] = 10
        said[after[block.pairs[joined]]] = 32
        out = {"lang": [], "piece": [], "c": []}
        bounds = np.r_[0, after + 1]
        firsts = [k for k, lang in enumerate(block.langs) if k == 0 or lang != block.langs[k - 1]]
        for k, past in zip(firsts, [*firsts[1:], len(block.langs)]):
            text = said[bounds[words.last[k] - words.counts[k]] : bounds[words.last[past - 1]]].tobytes()
            found = Counter(text.split(b"\n")[:-1])
            out["lang"] += [block.langs[k]] * len(found)
            out["piece"] += found.keys()
            out["c"] += found.values()
        pieces = pa.array(out["piece"], pa.binary()).cast(pa.string())
        return pa.table({"lang": pa.array(out["lang"], pa.string()), "piece": pieces, "c": pa.array(out["c"], pa.int64())})

    return step


def cut_pieces(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, piece, c): the pieces cut at pairs of words with fewer than MIN_COUNT occurrences, words one space apart, with counts."""
    buckets = partitions(docs.sparkSession)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    blocks = blocked(docs, F.col(text_col), BLOCK_BYTES, lang=lang).groupBy("block")
    sent = blocks.applyInArrow(_sent(buckets, MIN_COUNT), PAIRS)
    answers = staged(sent.groupBy("bucket").applyInArrow(_weighed(MIN_COUNT), PAIRS), "phrases-pairs")
    pieces = blocks.cogroup(answers.groupBy("block")).applyInArrow(_cut(buckets), PIECES)
    return pieces.groupBy("lang", "piece").agg(F.sum("c").alias("c"))


def counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, k, gram, f) for words and phrases of up to LONGEST words, derived level by level from the edges; whole from MIN_COUNT on."""
    pieces = staged(cut_pieces(docs, lang_col, text_col), "phrases-pieces")
    pieces = pieces.select("lang", F.split("piece", " ").alias("words"), "c")
    # edges: compiled n-grams of the whole piece; piece ends: plain slices, no lambdas
    size = F.size("words")
    edges = NGram(n=LONGEST, inputCol="words", outputCol="__edges").transform(pieces.filter(size >= LONGEST))
    edges = edges.select("lang", F.lit(LONGEST).alias("k"), F.explode("__edges").alias("gram"), "c")
    ends = pieces.select(
        "lang",
        F.explode(
            F.array(*[F.when(size >= k, F.struct(F.lit(k).alias("k"), F.array_join(F.slice("words", -k, k), " ").alias("gram")))
                      for k in range(1, LONGEST)])
        ).alias("e"),
        "c",
    ).filter(F.col("e").isNotNull()).select("lang", "e.k", "e.gram", "c")
    counted = staged(
        edges.unionByName(ends).groupBy("lang", "k", "gram").agg(F.sum("c").alias("c")),
        "phrases-edges",
    )
    level = counted.filter(F.col("k") == LONGEST).select("lang", "gram", F.col("c").alias("f"))
    levels = [level.withColumn("k", F.lit(LONGEST))]
    for k in range(LONGEST - 1, 0, -1):
        flow = level.select("lang", F.substring_index("gram", " ", k).alias("gram"), "f")
        ends = counted.filter(F.col("k") == k).select("lang", "gram", F.col("c").alias("f"))
        level = staged(flow.unionByName(ends).groupBy("lang", "gram").agg(F.sum("f").alias("f")), f"phrases-level{k}")
        levels.append(level.withColumn("k", F.lit(k)))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.select("lang", "k", "gram", "f")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each lang's first TOP phrases: lang, rank, phrase, a, l, r, n, score (longs)."""
    every = counts(docs, lang_col, text_col)
    words = every.filter("k = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = staged(every.filter(F.col("f") >= MIN_COUNT), "phrases-frequent")
    cands = frequent.filter("k >= 2").select("lang", F.col("gram").alias("phrase"), "k", F.col("f").alias("a"))
    # unary steps: a one-word extension with the same count compacts the shorter phrase away
    steps = cands.filter(F.col("k") >= 3).select(
        "lang",
        "a",
        F.explode(
            F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))
        ).alias("phrase"),
    )
    kept = cands.join(steps.distinct(), ["lang", "phrase", "a"], "left_anti")
    cuts = kept.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("j"))
    cuts = cuts.select(
        "*",
        F.expr("substring_index(phrase, ' ', j)").alias("left"),
        F.expr("substring_index(phrase, ' ', j - k)").alias("right"),
    )
    look = frequent.select("lang", F.col("gram").alias("g"), "f")
    cuts = (
        cuts.join(look.withColumnsRenamed({"g": "left", "f": "l"}), ["lang", "left"])
        .join(look.withColumnsRenamed({"g": "right", "f": "r"}), ["lang", "right"])
        .join(words, "lang")
    )
    exact = F.expr(
        "CAST((CAST(a AS DECIMAL(20,0)) * CAST(n AS DECIMAL(20,0)) * 1000) div (CAST(l AS DECIMAL(20,0)) * CAST(r AS DECIMAL(20,0))) AS BIGINT)"
    )
    cuts = cuts.withColumn("score", exact)
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "j", "l", "r")).alias("cut"))
    scored = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    return top.select(
        "lang", F.col("rank").cast("long"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")]
    )


def oracle() -> str:
    """Every phrase counted directly from the text in DuckDB SQL."""
    return f"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]') AS ps
  FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w
      FROM (SELECT lang, unnest(ps) AS piece FROM d)),
pos AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) > 0),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, w, i, unnest(range(1, {LONGEST + 1})) AS k FROM pos) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
nw AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a FROM f WHERE k >= 2 AND f >= {MIN_COUNT}),
kept AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c AS q WHERE q.lang = c.lang AND q.k = c.k + 1 AND q.a = c.a
      AND (array_to_string(string_split(q.phrase, ' ')[1:c.k], ' ') = c.phrase
           OR array_to_string(string_split(q.phrase, ' ')[2:q.k], ' ') = c.phrase))),
cuts AS (
  SELECT kept.lang, kept.phrase, kept.k, kept.a, j,
         array_to_string(string_split(kept.phrase, ' ')[1:j], ' ') AS lp,
         array_to_string(string_split(kept.phrase, ' ')[j + 1:kept.k], ' ') AS rp
  FROM (SELECT *, unnest(range(1, k)) AS j FROM kept) AS kept),
s AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, lf.f AS l, rf.f AS r, nw.n, j,
         CAST((CAST(cuts.a AS HUGEINT) * nw.n * 1000) // (CAST(lf.f AS HUGEINT) * rf.f) AS BIGINT) AS score
  FROM cuts JOIN f AS lf ON lf.lang = cuts.lang AND lf.phrase = cuts.lp
            JOIN f AS rf ON rf.lang = cuts.lang AND rf.phrase = cuts.rp
            JOIN nw ON nw.lang = cuts.lang),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM s),
r AS (SELECT lang, phrase, a, l, r, n, score,
             row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
      FROM low WHERE o = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, score
FROM r WHERE rank <= {TOP}
"""
