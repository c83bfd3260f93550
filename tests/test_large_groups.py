"""One group holds most rows: results must equal plain windows and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.functions.keys import keep_all
from quern.operators import retrieval as V
from quern.operators import sequences as S


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 7 holds two thirds of the rows, one key is NULL, some instants repeat."""
    return (
        spark.range(6000)
        .withColumn("k", F.expr("CASE WHEN id % 3 < 2 THEN 7 WHEN id % 30 = 2 THEN NULL ELSE id % 11 END"))
        .withColumn("ts", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id % 1999 AS INT))"))
        .withColumn("hour", F.date_trunc("hour", "ts"))
        .withColumn("none", F.lit(1))
        .withColumn("v", F.expr("IF(id % 13 = 0, NULL, id % 100)"))
        .withColumn("is_source", F.expr("id % 5 = 0"))
    )


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("bucket", [["hour"], ["none"], ["hour", "ts"], ["ts"]])
def test_previous_row(skewed, bucket):
    got = S.previous_row(skewed, ["k"], bucket, ["ts", "id"], ["v", "id"])
    plain = skewed.withColumn("previous", F.lag(F.struct("v", "id")).over(W.partitionBy("k").orderBy("ts", "id")))
    same(got, plain.select(got.columns))


@pytest.mark.parametrize("bucket", [["hour"], ["none"], ["hour", "ts"], ["ts"]])
def test_running_totals(skewed, bucket):
    got = S.running_totals(skewed, ["k"], bucket, ["ts", "id"], {"s": F.col("v"), "n": F.lit(1)})
    w = W.partitionBy("k").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0)
    same(got, skewed.withColumns({"s": F.sum("v").over(w), "n": F.sum(F.lit(1)).over(w)}))


@pytest.mark.parametrize("bucket", [["hour"], ["none"], ["hour", "ts"], ["ts"]])
def test_latest_before(skewed, bucket):
    got = S.latest_before(skewed, ["k"], bucket, "ts", F.col("is_source"), ["id"])
    rows = [(r.id, r.k, r.ts, r.is_source) for r in skewed.collect()]
    sources = {}
    for i, k, ts, is_source in rows:
        if is_source:
            sources.setdefault(k, []).append((ts, i))
    for r in got.select("id", "k", "ts", "latest").collect():
        best = max((s for s in sources.get(r.k, []) if s[0] < r.ts), default=None)
        assert (None if r.latest is None else (r.latest.ts, r.latest.id)) == best


def test_all_rows_at_one_instant(spark):
    """A group in one bucket of time is cut again along the rest of its order."""
    rows = spark.range(5000).select("id", F.lit(1).alias("k"), F.lit(7).alias("ts"), (F.col("id") % 10).alias("v"))
    rows = rows.withColumn("block", F.floor(F.col("id") / 500))
    w = W.partitionBy("k").orderBy("ts", "id")
    got = S.running_totals(rows, ["k"], ["ts", "block"], ["ts", "id"], {"s": F.col("v")})
    same(got, rows.withColumn("s", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0))))
    got = S.previous_row(rows, ["k"], ["ts", "block"], ["ts", "id"], ["id"])
    same(got, rows.withColumn("previous", F.when(F.lag("id").over(w).isNotNull(), F.struct(F.lag("id").over(w).alias("id")))))


def test_two_scans_and_no_broadcast(skewed):
    plan = S.running_totals(skewed, ["k"], ["hour"], ["ts", "id"], {"s": F.col("v")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0") == 2 and "Broadcast" not in plan


def test_range_join_against_brute_force(spark):
    points = spark.range(500).select(F.col("id"), (F.col("id") * 0.37 - 20).alias("x"))
    ranges = spark.range(40).select(
        F.col("id").alias("r"), (F.col("id") * 5 - 30).cast("double").alias("lo"), (F.col("id") * 5 - 30 + F.col("id") % 9).cast("double").alias("hi")
    )
    got = {(r.id, r.r) for r in S.range_join(points, ranges, "x", "lo", "hi", 4.0).collect()}
    brute = {
        (p.id, r.r) for p in points.collect() for r in ranges.collect() if r.lo <= p.x < r.hi
    }
    assert got == brute and got


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    data = rng.integers(-3, 4, (300, 4)).astype(float)  # many equal and zero vectors
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(999, None)]
    return data, spark.createDataFrame(rows, "item_id long, embedding array<float>").repartition(5)


@pytest.mark.parametrize("questions", [20, 7])
@pytest.mark.parametrize("k", [1, 5, 400])
def test_similar_items_against_brute_force(spark, vectors, questions, k, monkeypatch):
    monkeypatch.setattr(V, "QUESTIONS", questions)
    monkeypatch.setattr(V, "ITEMS", 64)
    data, items = vectors
    queries = items.filter("item_id < 20").withColumnRenamed("item_id", "query_id")
    got = {}
    for r in V.similar_items(queries, items, k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.item_id, r.similarity))
    norm = np.linalg.norm(data, axis=1, keepdims=True)
    unit = np.divide(data, norm, out=np.zeros_like(data), where=norm > 0)
    for q in range(20):
        score = np.round(unit @ unit[q], 6)
        order = np.lexsort((np.arange(300), -score))[:k]
        assert [(i, s) for _, i, s in sorted(got[q])] == [(int(i), pytest.approx(score[i])) for i in order]


def test_no_task_holds_all_questions_or_items(spark, vectors, monkeypatch):
    """Every vector asks: blocks of questions meet chunks of items, and all of them give what one of each gives."""
    _, items = vectors
    asked = items.withColumnRenamed("item_id", "query_id")
    want = sorted(map(tuple, V.similar_items(asked, items, 5).collect()))
    search = V._search

    def limited(asked, given, k):
        assert asked.num_rows <= 100 and given.num_rows <= 100
        return search(asked, given, k)

    monkeypatch.setattr(V, "_search", limited)
    monkeypatch.setattr(V, "BLOCK_ROWS", 50, raising=False)
    assert sorted(map(tuple, V.similar_items(asked, items, 5).collect())) == want
    assert len(want) == 300 * 5


def test_similar_items_edges(spark, vectors):
    _, items = vectors
    none = items.limit(0).withColumnRenamed("item_id", "query_id")
    assert V.similar_items(none, items).count() == 0
    one = items.filter("item_id = 3").withColumnRenamed("item_id", "query_id")
    assert V.similar_items(one, items.limit(0)).count() == 0
    allowed = spark.createDataFrame([(5,), (6,), (6,)], "item_id long")
    assert {r.item_id for r in V.similar_allowed(one, items, allowed, 5).collect()} == {5, 6}


def test_keep_all_equals_a_left_join(spark):
    kept = spark.createDataFrame([(1,), (2,), (2,), (None,), (9,)], "k int")
    other = spark.range(50).select(F.expr("IF(id < 40, 2, CAST(id % 3 AS INT))").alias("k"), F.col("id").alias("v"))
    same(keep_all(kept, other, ["k"]), kept.join(other, "k", "left"))


def test_vectors_of_other_width_or_with_nulls_are_set_aside(spark):
    items = spark.createDataFrame(
        [(1, [1.0, 0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0, 0.0, 0.0]), (4, [1.0, None, 0.0, 0.0]), (5, [0.0, 1.0, 0.0, 0.0])],
        "item_id long, embedding array<double>",
    )
    asked = spark.createDataFrame([(9, [1.0, 0.0, 0.0, 0.0]), (8, [1.0, None, 0.0, 0.0])], "query_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.item_id, r.similarity) for r in V.similar_items(asked, items, 5).collect())
    assert got == [(9, 1, 1, 1.0), (9, 2, 5, 0.0)]
    assert V.unusable(items).filter("NOT usable").select("item_id").collect() == [(4,)]
