"""Operator 11, ranked lexical search: term-at-a-time accumulators inside document-at-a-time skipping.

The index is a forward index: one row per document with a term, holding its
terms and their counts, made in the task that reads the document and written
to the shared folder; the corpus figures N (documents with a term) and L (all
their terms) are observed while it is written. For every query item:

1. Short lists (the item's rarest lists, their lengths summing to at most
   ``SHORT_SHARE`` of N) are read term at a time and summed into
   accumulators per (item, document).
2. The ``TOP`` best accumulators are scored exactly over all lists; the worst
   of them is a lower bound ``theta`` of the fiftieth best final score (no
   weight is negative).
3. Long lists are ordered by their upper bound (weight times the largest term
   factor of the list). The longest prefix whose bounds sum below ``theta``
   is non-essential: a document in none of the other lists and without an
   accumulator cannot reach the top.
4. Document at a time: each task walks its block of the forward index with
   the accumulators of each document riding beside it as one more iterator.
   A document is a candidate for an item if it has an accumulator or an
   essential term; candidates are scored exactly over all long lists (numpy,
   per Arrow batch), all others are skipped. A task sends on only its best
   ``TOP`` per item, and a last ranking over those picks the result.

The query side (items and their terms) is what the driver plans with, one
pass of at most ``ITEMS_PER_PASS`` items at a time; tables of it are
broadcast only under a counted bound, joined by shuffle beyond.

Scoring (fixed by the contract): terms are maximal runs of
``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]`` with only A-Z lower-cased;
``w = floor(1000 * ln((2N + 2) / (2 df + 1)))`` in doubles;
``m = 50 + (50 n N) div L``; a term adds ``w * ((10^9 tf) div (1000 tf + 20 m))``.

Edge cases: a null text has no terms and is neither counted nor found; a null
or empty item finds nothing; every input row is a document of its own, so
repeated rows are counted and found twice (both carry their doc_id); a null
doc_id is kept and sorts after all ids among equal scores; an empty table of
documents or items gives no rows. Columns other than the id and text columns
are not read, so clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quern.llm.common import staged

#: Fixed by the contract: the term pattern, the size of a result list.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
TOP = 50

#: A list is short when it holds at most this share of all documents.
SHORT_SHARE = 0.01
#: Tables of the query side are broadcast up to this many rows, joined by shuffle beyond.
BROADCAST_TERMS = 200_000
BROADCAST_ROWS = 2_000_000
#: Items scored in one pass over the forward index; more items take more passes.
ITEMS_PER_PASS = 500
#: Documents scored at once inside a task.
DOCS_PER_STEP = 1000


def terms(text: Column) -> Column:
    """All terms of a text, in order, repeats kept; null for a null text."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), 0)


@dataclass(frozen=True)
class Index:
    forward: DataFrame  # row, doc_id, n, terms, tfs
    n_docs: int  # N
    n_terms: int  # L


def _forward(batches):
    """(row, doc_id, n, terms, tfs) of every document with a term, counted in the task that reads it.

    Slices of ``DOCS_PER_STEP`` documents go out one by one, so a worker holds
    the terms of one slice at a time.
    """
    import re
    from collections import Counter

    import pyarrow as pa

    term = re.compile(TERM)
    lower = str.maketrans(UPPER, LOWER)
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS_PER_STEP):
            piece = batch.slice(at, DOCS_PER_STEP)
            rows, ids, ns, terms, tfs = [], [], [], [], []
            for row, doc_id, text in zip(piece.column("row").to_pylist(), piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                found = term.findall(text.translate(lower)) if text is not None else []
                if not found:
                    continue
                counted = Counter(found)
                rows.append(row), ids.append(doc_id), ns.append(len(found))
                terms.append(list(counted)), tfs.append(list(counted.values()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()),
                     pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int64()))],
                    ["row", "doc_id", "n", "terms", "tfs"],
                )


FORWARD = "row long, doc_id long, n long, terms array<string>, tfs array<long>"
TOPS = "q long, row long, doc_id long, score long"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """One row of (term, tf) lists per document with a term, in the task that reads it; N and L observed meanwhile."""
    seen = Observation("corpus")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text")
    )
    forward = rows.mapInArrow(_forward, FORWARD).observe(seen, F.count(F.lit(1)).alias("N"), F.sum("n").alias("L"))
    forward = staged(forward, "search-forward")
    if forward.isEmpty():  # an observation of no rows holds no figures
        return Index(forward, 0, 0)
    figures = seen.get
    return Index(forward, int(figures.get("N") or 0), int(figures.get("L") or 0))


def _maybe_broadcast(small: DataFrame, bound: int) -> DataFrame:
    """``small`` marked for broadcast when it has at most ``bound`` rows; joined by shuffle beyond."""
    return F.broadcast(small) if small.count() <= bound else small


def _factor(tf, n, n_docs: int, n_terms: int):
    """The term factor ``(10^9 tf) div (1000 tf + 20 m)`` on int64 arrays."""
    m = 50 + (50 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _daat(plan: dict):
    """Document at a time over slices of the forward index, accumulators as one more iterator per document.

    ``plan`` holds, per item of the pass, its long terms with weights, which of
    them are essential, and its threshold. A document is a candidate for an
    item if it has an accumulator or an essential term of it; only candidates
    are scored, exactly, over all long terms. Each task keeps its best ``TOP``
    per item across its slices and sends nothing else. Arrow arrays all the
    way: no Python object per term.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        qs, vocab = plan["qs"], pa.array(plan["terms"], pa.string())
        pair_q, pair_t, pair_w, pair_e = (np.asarray(plan[k]) for k in ("pair_q", "pair_t", "pair_w", "pair_e"))
        theta = np.asarray(plan["theta"], dtype=np.int64)
        order = np.argsort(pair_t, kind="stable")
        pair_q, pair_t, pair_w, pair_e = pair_q[order], pair_t[order], pair_w[order].astype(np.int64), pair_e[order].astype(bool)
        starts = np.searchsorted(pair_t, np.arange(len(vocab) + 1))
        n_items = len(qs)
        kept = [np.zeros((0, 4), np.int64) for _ in range(n_items)]  # score, null id, id, row

        def flat_of(column):
            return column.flatten(), np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy())

        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_PER_STEP):
                piece = batch.slice(at, DOCS_PER_STEP)
                rows = piece.column("row").to_numpy()
                ids = piece.column("doc_id")
                no_id = pc.is_null(ids).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = pc.fill_null(ids, 0).to_numpy()
                ns = piece.column("n").to_numpy()
                score = np.zeros((piece.num_rows, n_items), dtype=np.int64)
                cand = np.zeros((piece.num_rows, n_items), dtype=bool)
                acc, acc_doc = flat_of(piece.column("acc"))
                if len(acc):
                    aq, ap = acc.field("q").to_numpy(), acc.field("part").to_numpy()
                    np.add.at(score, (acc_doc, aq), ap)
                    cand[acc_doc, aq] = True
                terms, doc = flat_of(piece.column("terms"))
                tfs = piece.column("tfs").flatten().to_numpy()
                tid = pc.fill_null(pc.index_in(terms, value_set=vocab), -1).to_numpy()
                hit = tid >= 0
                doc, tid, tfs = doc[hit], tid[hit], tfs[hit]
                if len(tid):
                    f = _factor(tfs.astype(np.int64), ns[doc].astype(np.int64), plan["N"], plan["L"])
                    reach = starts[tid + 1] - starts[tid]
                    first = np.repeat(starts[tid], reach)
                    at_pair = first + (np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach))
                    dd, ff = np.repeat(doc, reach), np.repeat(f, reach)
                    qq, ww, ee = pair_q[at_pair], pair_w[at_pair], pair_e[at_pair]
                    cand[dd[ee], qq[ee]] = True
                    on = cand[dd, qq]
                    np.add.at(score, (dd[on], qq[on]), ww[on] * ff[on])
                hit_d, hit_q = np.nonzero(cand & (score > 0) & (score >= theta[None, :]))
                for q in np.unique(hit_q):
                    sel = hit_d[hit_q == q]
                    both = np.concatenate([kept[q], np.stack([score[sel, q], no_id[sel], ids[sel], rows[sel]], axis=1)])
                    best = np.lexsort((both[:, 3], both[:, 2], both[:, 1], -both[:, 0]))[:TOP]
                    kept[q] = both[best]
        out = [(qs[q], r) for q in range(n_items) for r in kept[q]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([q for q, _ in out], pa.int64()),
                pa.array([int(r[3]) for _, r in out], pa.int64()),
                pa.array([None if r[1] else int(r[2]) for _, r in out], pa.int64()),
                pa.array([int(r[0]) for _, r in out], pa.int64()),
            ],
            ["q", "row", "doc_id", "score"],
        )

    return run


def rank(index: Index, items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``TOP`` best documents with a score above 0 for every item: item_id, rank, doc_id, score."""
    n_docs, n_terms = index.n_docs, max(index.n_terms, 1)
    fwd = index.forward
    m = F.expr(f"50 + (50 * n * {n_docs}L) div {n_terms}L")
    factor = F.expr("(1000000000L * tf) div (1000L * tf + 20L * __m)")

    numbered = staged(
        items.select(
            F.col(id_col).cast("long").alias("item_id"),
            F.monotonically_increasing_id().alias("q"),
            F.array_distinct(terms(F.col(text_col))).alias("t"),
        ),
        "search-items",
    )
    asked = numbered.select("q", F.explode("t").alias("term"))
    vocab = _maybe_broadcast(asked.select("term").distinct(), BROADCAST_TERMS)
    post = fwd.select("row", "doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(
        "row", "doc_id", "n", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf")
    )
    post = post.join(vocab, "term").withColumn("__m", m).withColumn("f", factor).drop("__m")
    stats = (
        post.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.max("f").alias("max_f"))
        .withColumn("w", F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * n_docs + 2.0)) / (F.col("df") * 2.0 + 1.0))).cast("long"))
        .withColumn("bound", F.col("w") * F.col("max_f"))
    )
    # per item: its rarest lists, their lengths summing to at most SHORT_SHARE of N, are short
    rarest = Window.partitionBy("q").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, 0)
    asked = asked.join(stats, "term").withColumn("__upto", F.sum("df").over(rarest))
    asked = staged(asked.withColumn("short", F.col("__upto") <= F.lit(SHORT_SHARE * n_docs)).drop("__upto"), "search-asked")

    # 1. term at a time over the short lists
    short = _maybe_broadcast(asked.filter("short").select("q", "term", "w"), BROADCAST_TERMS)
    acc = staged(
        post.join(short, "term").groupBy("q", "row").agg(F.sum(F.col("w") * F.col("f")).alias("part")),
        "search-acc",
    )
    # 2. the best accumulators, scored exactly over all lists, bound the fiftieth score from below
    best = Window.partitionBy("q").orderBy(F.desc("part"), "row")
    seeds = acc.withColumn("__k", F.row_number().over(best)).filter(F.col("__k") <= TOP).select("q", "row")
    seeds = _maybe_broadcast(staged(seeds, "search-seeds"), BROADCAST_ROWS)
    exact = post.join(seeds, "row").join(asked.select("q", "term", "w"), ["q", "term"])
    theta = staged(
        exact.groupBy("q", "row").agg(F.sum(F.col("w") * F.col("f")).alias("score"))
        .groupBy("q").agg(F.when(F.count(F.lit(1)) >= TOP, F.min("score")).otherwise(F.lit(0)).alias("theta")),
        "search-theta",
    )
    # 3. long lists by bound; the prefix whose bounds sum below theta is not essential
    longs = asked.filter("NOT short").join(theta, "q", "left").fillna(0, ["theta"])
    climb = Window.partitionBy("q").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    longs = longs.withColumn("essential", F.sum("bound").over(climb) >= F.col("theta"))
    longs = staged(longs.select("q", "term", "w", "essential"), "search-long")
    # 4. document at a time, the accumulators of a document riding with it
    per_doc = acc.groupBy("row").agg(F.collect_list(F.struct("q", "part")).alias("acc"))
    rows = fwd.join(_maybe_broadcast(per_doc, BROADCAST_ROWS), "row", "left")
    q_ids = sorted(r.q for r in numbered.select("q").collect())  # one number per item
    tops = None
    for at in range(0, len(q_ids), ITEMS_PER_PASS):
        block = q_ids[at : at + ITEMS_PER_PASS]
        where = {q: k for k, q in enumerate(block)}
        # the query side of one pass: its items' long terms and thresholds, at most ITEMS_PER_PASS items
        chosen = longs.filter(F.col("q").isin(block)).collect()
        thetas = {r.q: r.theta for r in theta.filter(F.col("q").isin(block)).collect()}
        term_id: dict[str, int] = {}
        for r in chosen:
            term_id.setdefault(r.term, len(term_id))
        plan = {
            "qs": block,
            "terms": list(term_id),
            "pair_q": [where[r.q] for r in chosen],
            "pair_t": [term_id[r.term] for r in chosen],
            "pair_w": [int(r.w) for r in chosen],
            "pair_e": [bool(r.essential) for r in chosen],
            "theta": [int(thetas.get(q, 0)) for q in block],
            "N": n_docs,
            "L": n_terms,
        }
        local = F.transform("acc", lambda e: F.struct(e["q"].alias("q"), e["part"].alias("part")))
        mine = rows.withColumn("acc", F.filter(local, lambda e: e["q"].isin(block)) if len(block) < len(q_ids) else F.col("acc"))
        mine = mine.withColumn("acc", F.transform("acc", lambda e: F.struct(_index_of(e["q"], block).alias("q"), e["part"].alias("part"))))
        part = mine.select("row", "doc_id", "n", "terms", "tfs", "acc").mapInArrow(_daat(plan), TOPS)
        tops = part if tops is None else tops.unionByName(part)
    if tops is None:  # no items
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    # 5. the best TOP per item; the limit is taken before the shuffle as well
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    top = tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    return top.join(numbered.select("q", "item_id"), "q").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def _index_of(q, block: list[int]):
    """Position of q in the pass's block of items, as a column."""
    return F.array_position(F.array(*[F.lit(x) for x in block]), q).cast("int") - 1


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rank all documents for every item (see the module's text)."""
    return rank(build_index(docs), items)


def oracle() -> str:
    """The plain term-at-a-time form in DuckDB SQL, over all lists."""
    return f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS t
  FROM documents),
dn AS (SELECT doc_id, row_, t, len(t) AS n FROM d WHERE len(t) > 0),
c AS (SELECT count(*) AS big_n, sum(n) AS big_l FROM dn),
p AS (SELECT row_, doc_id, n, term, count(*) AS tf FROM (SELECT row_, doc_id, n, unnest(t) AS term FROM dn) GROUP BY ALL),
q AS (
  SELECT DISTINCT item_id, q_, term FROM (
    SELECT item_id, row_number() OVER () AS q_,
           unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term
    FROM benchmark)),
s AS (
  SELECT p.term, CAST(floor(1000.0 * ln((2.0 * c.big_n + 2.0) / (2.0 * count(*) + 1.0))) AS BIGINT) AS w
  FROM p, c WHERE p.term IN (SELECT term FROM q) GROUP BY p.term, c.big_n),
sc AS (
  SELECT q.q_, q.item_id, p.row_, p.doc_id,
         CAST(sum(s.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * p.n * c.big_n) // c.big_l)))) AS BIGINT) AS score
  FROM q JOIN p ON p.term = q.term JOIN s ON s.term = q.term, c
  GROUP BY q.q_, q.item_id, p.row_, p.doc_id),
r AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY q_ ORDER BY score DESC, doc_id ASC NULLS LAST, row_) AS rank
  FROM sc WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {TOP}
"""
