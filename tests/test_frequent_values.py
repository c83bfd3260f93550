import random

import pytest

from quern.operators import catalog as C


@pytest.mark.parametrize("counters", [2, 8, 64])
def test_same_as_exact(spark, counters):
    rng = random.Random(9)
    rows = [
        (rng.choice("aaaaabbbcd") + rng.choice("xy"), rng.randint(0, 1000), rng.choice([1.5, 2.5, None]), None if i % 7 == 0 else "hot")
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "skewed string, flat long, few double, nulls string").repartition(6)
    got = {r.column_name: r.sample_values for r in C.frequent_values(df, 5, counters).collect()}
    want = {r.column_name: r.sample_values for r in C.sample_values(df, 5).collect()}
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "a string, b long")
    assert C.frequent_values(df, 5).count() == C.sample_values(df, 5).count() == 0
