from collections import Counter

import numpy as np
import pytest

from quern.llm import mixing


def brute_targets(sizes):
    """Water filling by hand: (source, size) in order, weights 1, 2, 3 in turn."""
    total, weight = sum(s for _, s in sizes), {n: i % 3 + 1 for i, (n, _) in enumerate(sizes)}
    left, open_names, target = total, dict(sizes), {}
    while open_names:
        share = left / sum(weight[n] for n in open_names)
        full = [n for n, s in open_names.items() if 3 * s <= share * weight[n] * (1 + 1e-12)]
        if not full:
            return target | {n: share * weight[n] for n in open_names}
        for n in full:
            target[n] = 3.0 * open_names.pop(n)
            left -= target[n]
    return target


@pytest.mark.parametrize("sizes", [[("a", 10), ("b", 1), ("c", 500), ("d", 0), (None, 30)], [("a", 5)], [("a", 0), ("b", 0)], [("x", 1), ("y", 1), ("z", 1000)]])
def test_targets(spark, sizes):
    df = spark.createDataFrame(sizes, "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_pivotal_keeps_words_and_expectation():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 200, 60).astype(float)
    part = rng.random(60)
    runs = []
    for seed in range(4000):
        coin = np.random.default_rng(seed).random(60)
        taken, held, mass = mixing.pivotal(size, part, coin)
        exact = taken.astype(float)
        if held >= 0:
            exact[held] = mass
        assert (exact * size).sum() == pytest.approx((part * size).sum())
        runs.append(exact)
    assert np.abs(np.mean(runs, axis=0) - part).max() < 5 * 0.5 / np.sqrt(4000)


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(1, 60)), f"s{'aaaaaab'[i % 7]}{i % 2}") for i in range(600)]
    rows += [(1000, "huge " * 3000, "sb0"), (1001, None, None), (1002, "a b", None), (1003, "", "sb1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and mixing.mix(df).exceptAll(mixing.mix(df)).count() == 0
    taken, target, largest = Counter(), {}, Counter()
    for r in got:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.copies <= 3
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s]
    assert sum(target.values()) == pytest.approx(sum(r.size for r in got))


def test_rows(docs, rows, no_docs):
    decided = mixing.mix(docs)
    mixed = mixing.apply_mix(docs, decided)
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 6 and set(copies) <= {r[0] for r in rows}  # repeated rows: twice three times
    assert mixing.mix(no_docs).collect() == [] == mixing.apply_mix(no_docs, mixing.mix(no_docs)).collect()
