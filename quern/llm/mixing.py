"""Operator 9, mixing sources to target weights: pivotal dependent rounding.

Every document of a source shall be taken ``target / source size`` times. The
whole part is certain; the fraction is rounded by the pivotal method: two
documents meet, mass moves from one to the other so that the expected words of
both together stay as they are, until one of them is certain. A random choice
between the two directions keeps every document's own expectation. So a
source's words miss its target by less than one document.

Chunks of documents are rounded in parallel and leave one fractional document
per source; these meet again in groups of ``FANOUT`` chunks, and so on up a
reduction tree of known height. Documents that hold much of their source are
rounded first and pass what they miss on to the others.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import global_row_number, partitions, staged, uniform, word_count

FANOUT = 64
SEED = 20_241
NEAR = 1e-9
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: Documents with this part of their source or more are rounded first.
LARGE = 500


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Target per source from (source, source_size).

    Sources weigh in code point order, null last. They share all words by
    weight; none gets more than ``most`` times its size, the excess is shared
    again by weight until none is above. Only sums reach the driver.
    """
    ranked = global_row_number(sizes, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = staged(ranked.select("source", "source_size", weight.alias("weight")), "mix-sources")
    limit = F.col("source_size") * F.lit(most)
    total, weigh = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    share = (total or 0) / (weigh or 1)
    while True:  # the share only rises, and each turn caps at least one more source
        capped = limit <= F.col("weight") * F.lit(share)
        held, open_weight = ranked.agg(
            F.sum(F.when(capped, limit).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))
        ).first()
        if not open_weight or (total - held) / open_weight <= share:
            break
        share = (total - held) / open_weight
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(float(share)))
    return ranked.select("source", "source_size", target.alias("target"))


def pivotal(size: np.ndarray, part: np.ndarray, coin: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Round fractions in order; returns 0/1 for all but one, that one's index (-1: none) and its fraction."""
    taken = np.zeros(len(size), np.int64)
    held, mass = -1, 0.0
    sizes, parts, coins = size.tolist(), part.tolist(), coin.tolist()
    for i, b in enumerate(parts):
        if b <= NEAR or b >= 1 - NEAR:
            taken[i] = b > 0.5
            continue
        if held < 0:
            held, mass = i, b
            continue
        sa, sb = sizes[held], sizes[i]
        up = min(sa * (1 - mass), sb * b)  # words that may move to the held document
        down = min(sa * mass, sb * (1 - b))
        if coins[i] * (up + down) < down:
            a, b = mass + up / sa, b - up / sb
        else:
            a, b = mass - down / sa, b + down / sb
        if a <= NEAR or a >= 1 - NEAR:
            taken[held] = a > 0.5
            if b <= NEAR or b >= 1 - NEAR:
                taken[i] = b > 0.5
                held = -1
            else:
                held, mass = i, b
        else:
            taken[i] = b > 0.5
            mass = a
    return taken, held, mass


def _round(frame: pd.DataFrame, order: list[str], level: int) -> pd.DataFrame:
    """Round one group per source: ``extra`` is 0 or 1, or null for the one document left, whose fraction is kept."""
    # largest first: the document left in the end is then a small one
    keys, up = ["source", "weight", *order], [True, False] + [True] * len(order)
    frame = frame.sort_values(keys, ascending=up, kind="stable", na_position="last", ignore_index=True)
    code = pd.factorize(frame["source"], use_na_sentinel=False)[0]
    edges = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True]) if len(code) else np.array([], int)
    extra = np.zeros(len(frame))
    part = frame["part"].to_numpy(float).copy()
    size, coin = frame["weight"].to_numpy(float), frame["coin"].to_numpy(float)
    coin = (coin * (2 * level + 1) * 0.618033988749895 + coin) % 1.0 if level else coin
    for a, b in zip(edges[:-1], edges[1:]):
        done, held, mass = pivotal(size[a:b], part[a:b], coin[a:b])
        extra[a:b] = done
        if held >= 0:
            extra[a + held], part[a + held] = np.nan, mass
    return frame.assign(extra=pd.array(np.where(np.isnan(extra), -1, extra).astype(np.int64)), part=part)


def _climb(level: int, top: bool, order: tuple[str, ...] = ("chunk", "id_hash")) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One level of the reduction tree; at the top a coin decides about the last document of a source."""

    def climb(frame: pd.DataFrame) -> pd.DataFrame:
        out = _round(frame.drop(columns=["deal", "step"]), list(order), level)
        if top:
            last = out["extra"] < 0
            out.loc[last, "extra"] = (out.loc[last, "coin"] < out.loc[last, "part"]).astype(int)
        return out

    return climb


ITEM = "source string, chunk int, id_hash long, weight long, part double, coin double, extra long"


def copies_of_large(items: DataFrame, seed: int) -> DataFrame:
    """Round the documents that hold at least ``1 / LARGE`` of their source, at most ``LARGE`` per source.

    They go first, so that the words their rounding misses can be passed on to
    the small documents of the source.
    """
    deal = F.pmod(F.xxhash64("source"), F.lit(partitions(items.sparkSession))).cast("int")
    whole = F.floor(F.col("share") + F.lit(NEAR))
    rows = items.select(
        "source",
        "id_hash",
        "weight",
        "share",
        F.greatest(F.lit(0.0), F.col("share") - whole).alias("part"),
        uniform(F.col("id_hash"), F.col("source"), seed=seed).alias("coin"),
        whole.cast("long").alias("whole"),
        deal.alias("deal"),
        F.lit(0).alias("step"),
    )
    item = "source string, id_hash long, weight long, share double, part double, coin double, whole long, extra long"
    rounded = rows.groupBy("deal").applyInPandas(_climb(0, True, ("coin", "id_hash")), item)
    rounded = rounded.select("source", "id_hash", "weight", "share", (F.col("whole") + F.col("extra")).alias("copies"))
    return staged(rounded, "mix-large")


def copies(items: DataFrame, seed: int = SEED) -> DataFrame:
    """Whole copies for distinct (source, id_hash, weight, share) items; adds ``copies`` by source and id_hash.

    ``share`` is the expected number of copies, ``weight`` the words of the item.
    """
    spark = items.sparkSession
    chunks = partitions(spark)
    whole = F.floor(F.col("share") + F.lit(NEAR))
    first = items.select(
        "source",
        F.pmod(F.xxhash64("id_hash", F.lit(seed)), F.lit(chunks)).cast("int").alias("chunk"),
        "id_hash",
        "weight",
        F.greatest(F.lit(0.0), F.col("share") - whole).alias("part"),
        uniform(F.col("id_hash"), F.col("source"), seed=seed).alias("coin"),
        whole.cast("long").alias("whole"),
    )

    def start(frame: pd.DataFrame) -> pd.DataFrame:
        empty = frame["weight"] <= 0  # nothing to keep in balance: an independent choice
        frame.loc[empty, "part"] = (frame.loc[empty, "coin"] < frame.loc[empty, "part"]).astype(float)
        return _round(frame, ["coin", "id_hash"], 0)

    leaves = staged(first.groupBy("chunk").applyInPandas(start, ITEM + ", whole long"), "mix-leaves")
    open_items = leaves.filter("extra < 0").drop("whole")
    decided, width, level = [], chunks, 0
    while True:
        level += 1
        width = -(-width // FANOUT)

        step = (
            open_items.withColumn("step", F.floor(F.col("chunk") / FANOUT**level).cast("int"))
            .withColumn("deal", F.pmod(F.xxhash64("source"), F.lit(chunks)).cast("int"))
            .groupBy("deal", "step")
            .applyInPandas(_climb(level, width == 1), ITEM)
        )
        step = staged(step, "mix-level")
        decided.append(step.filter("extra >= 0"))
        if width == 1:
            break
        open_items = step.filter("extra < 0")
    late = decided[0]
    for more in decided[1:]:
        late = late.unionByName(more)
    sure = leaves.filter("extra >= 0").select("source", "id_hash", (F.col("whole") + F.col("extra")).alias("copies"))
    late = late.select("source", "id_hash", F.col("extra").alias("late"))
    waiting = leaves.filter("extra < 0").select("source", "id_hash", "whole").alias("l")
    same = F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l.id_hash") == F.col("r.id_hash"))
    solved = waiting.join(late.alias("r"), same).select(
        "l.source", "l.id_hash", (F.col("whole") + F.col("late")).alias("copies")
    )
    return sure.unionByName(solved)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED
) -> DataFrame:
    """How often each distinct document is taken: source, doc, size, source_size, target, copies.

    ``doc`` is a 64-bit key of id and text (:func:`doc_key`); rows that repeat
    in id, text and source are one document with one decision, which holds for
    each of them, and weigh as many times. Null texts have size 0, a null
    source is a source, last in order. Documents of size 0 are taken by an
    independent coin. An empty table gives no rows; other columns are ignored.
    """
    slim = staged(
        docs.select(
            F.col(source_col).cast("string").alias("source"),
            doc_key(id_col, text_col).alias("id_hash"),
            word_count(F.col(text_col).cast("string")).alias("size"),
        )
        .groupBy("source", "id_hash", "size")
        .agg(F.count(F.lit(1)).alias("n")),
        "mix-slim",
    )
    sizes = slim.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = staged(source_targets(sizes), "mix-targets")
    near = slim.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    weight = F.col("size") * F.col("n")
    items = near.select("d.source", "id_hash", weight.alias("weight"), share.alias("share"), "source_size")
    large = copies_of_large(items.filter(F.col("weight") * LARGE >= F.col("source_size")).filter("weight > 0"), seed)
    passed_on = large.groupBy("source").agg(
        F.sum(F.col("weight") * (F.col("share") - F.col("copies"))).alias("rest"), F.sum("weight").alias("held")
    )
    small = items.filter((F.col("weight") * LARGE < F.col("source_size")) | (F.col("weight") <= 0)).alias("i")
    small = small.join(passed_on.alias("p"), F.col("i.source").eqNullSafe(F.col("p.source")), "left")
    moved = F.col("share") + F.coalesce(F.try_divide("rest", F.col("source_size") - F.col("held")), F.lit(0.0))
    small = small.select(
        "i.source", "id_hash", "weight", F.least(F.greatest(moved, F.lit(0.0)), F.lit(float(MOST_COPIES))).alias("share")
    )
    chosen = copies(small, seed).unionByName(large.select("source", "id_hash", "copies"))
    plain = near.select("d.source", "id_hash", "size", "source_size", "target").alias("a")
    same = F.col("a.source").eqNullSafe(F.col("c.source")) & (F.col("a.id_hash") == F.col("c.id_hash"))
    return plain.join(chosen.alias("c"), same).select(
        "a.source", F.col("a.id_hash").alias("doc"), "size", "source_size", "target", "copies"
    )


def doc_key(id_col: str, text_col: str):
    """64-bit key of a document's id and text; nulls count as values of their own."""
    columns = [F.col(id_col), F.col(id_col).isNull(), F.col(text_col), F.col(text_col).isNull()]
    return F.xxhash64(*columns)


def apply_mix(
    docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """Rows of ``docs``, each as often as it is taken; columns stay as they are."""
    columns = docs.columns
    keyed = docs.withColumn("__doc", doc_key(id_col, text_col)).alias("d")
    same = F.col("d.__doc").eqNullSafe(F.col("m.doc")) & F.col(f"d.{source_col}").cast("string").eqNullSafe(F.col("m.source"))
    times = decided.filter("copies > 0").alias("m")
    repeated = keyed.join(times, same).select(
        *[F.col(f"d.`{c}`") for c in columns], F.explode(F.sequence(F.lit(1), F.col("m.copies").cast("int"))).alias("__nth")
    )
    return repeated.drop("__nth")
