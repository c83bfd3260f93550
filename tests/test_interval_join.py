import random

import pytest

from quern.operators import sequences as S


def brute(left, right):
    return sorted(
        (a[0], b[0])
        for a in left
        for b in right
        if None not in (a[1], a[2], b[1], b[2]) and a[1] < b[2] and b[1] < a[2]
    )


def run(spark, left, right, base=1.0):
    l = spark.createDataFrame(left, "id long, s long, e long")
    r = spark.createDataFrame(right, "rid long, rs long, re long")
    out = S.interval_join(l, r, ("s", "e"), ("rs", "re"), base=base)
    assert out.columns == ["id", "s", "e", "rid", "rs", "re"]
    return sorted((x.id, x.rid) for x in out.collect())


@pytest.mark.parametrize("cell_rows", [S.CELL_ROWS, 3])
def test_against_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(S, "CELL_ROWS", cell_rows)
    rng = random.Random(7)

    def table(n, first):
        rows = []
        for k in range(n):
            s = rng.randint(0, 1000)
            rows.append((first + k, s, s + rng.choice([0, 1, 2, 5, 17, 64, 300])))
        return rows

    left = table(80, 0) + [(900, -5, 5000), (901, 10, 10), (902, 30, 20), (903, None, 40), (904, 40, None), (905, 100, 200)]
    right = table(80, 1000) + [(1900, 200, 300), (1901, 50, 100), (1902, 100, 200), (1903, None, None)]
    right += [(2000 + k, 500, 500 + k % 3 + 1) for k in range(40)]  # a hot instant
    got = run(spark, left, right)
    assert got == brute(left, right)
    assert (900, 1900) in got and (905, 1902) in got  # spans everything; equal starts
    assert (905, 1901) not in got and (905, 1900) not in got  # touching ends do not overlap


def test_no_cover_and_empty(spark):
    assert run(spark, [(1, 5, 5), (2, None, 3)], [(10, 0, 9)]) == brute([(1, 5, 5), (2, None, 3)], [(10, 0, 9)])
    assert run(spark, [(1, 5, 5)], [(10, 7, 7)]) == []
    assert run(spark, [], [(10, 0, 9)]) == []


def test_fractional_base(spark):
    left = [(1, 0, 3), (2, 2, 1000)]
    right = [(10, 1, 2), (11, 999, 1001), (12, 3, 4)]
    assert run(spark, left, right, base=0.25) == brute(left, right)


@pytest.mark.parametrize("cell_rows", [S.CELL_ROWS, 40, 7])
def test_totals_without_pairs(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(S, "CELL_ROWS", cell_rows)
    rng = random.Random(11)

    def table(n, first):
        return [(first + k // 2, s, s + rng.choice([-3, 0, 0, 1, 2, 5, 17, 64, 300])) for k in range(n) for s in [rng.randint(0, 200)]]

    left = table(150, 0) + [(900, -5, 5000), (901, 10, 10), (903, None, 40), (904, 40, None), (None, 50, 60)]
    right = table(120, 1000) + [(1900, 0, 300), (1902, 100, 100), (1903, None, None), (None, 20, 90)]
    right += [(2000 + k, 100, 101 + k % 3) for k in range(60)]  # a hot instant
    want = {}
    for a in left:
        for b in right:
            if None not in (a[1], a[2], b[1], b[2]) and a[1] < b[2] and b[1] < a[2]:
                want.setdefault(a[0], []).append(b[0])
    want = {k: (len(v), min((x for x in v if x is not None), default=None)) for k, v in want.items()}
    l = spark.createDataFrame(left, "id long, s long, e long")
    r = spark.createDataFrame(right, "rid long, rs long, re long")
    got = S.interval_join(l, r, ("s", "e"), ("rs", "re"), totals=(["id"], "rid"))
    assert got.columns == ["id", "n", "first"]
    assert {x.id: (x.n, x.first) for x in got.collect()} == want


def test_totals_of_dense_intervals(spark):
    n = 30_000  # 900 million pairs
    l = spark.range(n).selectExpr("CAST(id AS STRING) AS id", "id AS s", f"id + {2 * n} AS e")
    r = spark.range(n).selectExpr("id AS rid", "id AS rs", f"id + {2 * n} AS re")
    got = S.interval_join(l, r, ("s", "e"), ("rs", "re"), totals=(["id"], "rid"))
    assert [tuple(x) for x in got.selectExpr("min(n)", "max(n)", "count(*)", "max(first)").collect()] == [(n, n, n, 0)]
