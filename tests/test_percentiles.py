import random

import pytest
from pyspark.sql import functions as F

from quern.operators import workflow as G
from quern.plans import load_all

EPS = 0.02  # above the sketch's 99 % rank error at k = 200


def ranks_hold(values, q, v):
    """The exact rank interval of v, widened by EPS, holds q."""
    n = len(values)
    below = sum(x < v for x in values) / n
    upto = sum(x <= v for x in values) / n
    return below - EPS <= q <= upto + EPS


def test_against_exact_ranks(spark):
    rng = random.Random(4)
    rows = []
    for day in range(20):
        for _ in range(2000):
            kind = rng.choice(["a", "b", "c"])
            value = int(rng.lognormvariate(3 if kind == "a" else 5, 1.2)) if kind != "c" else rng.randint(1, 5)
            rows.append((kind, f"2024-01-{day + 1:02d}", value))
    rows += [("a", "2024-01-01", None), ("d", "2024-01-03", None)]
    nodes = spark.createDataFrame(rows, "node_type string, start_time string, duration_ms long").withColumn("start_time", F.to_date("start_time"))
    got = {r.node_type: r for r in G.duration_percentiles(G.duration_sketches(nodes)).collect()}
    for kind in ("a", "b", "c"):
        values = [r[2] for r in rows if r[0] == kind and r[2] is not None]
        for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
            assert ranks_hold(values, q, got[kind][name]), (kind, name)
        assert got[kind].calls == sum(1 for r in rows if r[0] == kind)
    assert got["d"].calls == 1 and got["d"].p50 is None


def test_query_on_table(spark, sf_dir):
    found = {r.node_type: r for r in load_all().QUERIES["g02_duration_percentiles"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_linenumber") % 5).alias("m"), F.floor("l_quantity").cast("long").alias("v")
    ).collect()
    names = {1: "sql_generation", 2: "sql_validation", 3: "sql_execution", 4: "result_processing", 0: "error_handling"}
    for m, name in names.items():
        values = [r.v for r in rows if r.m == m]
        assert found[name].calls == len(values)
        for q, col in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
            assert ranks_hold(values, q, found[name][col])
