import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import sharding


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 40)), max_size=200))
def test_tree_finds_the_tightest(steps):
    tree, keys = sharding.CapacityTree(), set()
    for n, (add, x) in enumerate(steps):
        fits = sorted(k for k in keys if k[0] >= x)
        assert tree.tightest(x) == (fits[0] if fits else None)
        if add:
            tree.insert((x, n))
            keys.add((x, n))
        elif fits:
            tree.remove(fits[0])
            keys.remove(fits[0])


def test_best_fit_decreasing_as_by_hand():
    rng = random.Random(3)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 60) for _ in range(rng.randint(0, 80))), reverse=True)
        room, placed = [], []
        for s in sizes:
            fits = [(r, b) for b, r in enumerate(room) if r >= s]
            if fits:
                b = min(fits)[1]
            else:
                room.append(60)
                b = len(room) - 1
            room[b] -= s
            placed.append(b)
        assert sharding.best_fit_decreasing(sizes, 60) == placed


@pytest.mark.parametrize("sizes, shards", [([100, 1, 1, 1, 1], 3), ([5] * 10, 3), ([], 4), ([7], 24), ([50, 50, 2, 2], 2)])
def test_into_shards(sizes, shards):
    placed = sharding.into_shards(sizes, shards)
    load = Counter()
    for s, b in zip(sizes, placed):
        assert 0 <= b < shards
        load[b] += s
    mean = sum(sizes) / shards
    assert max(load.values(), default=0) <= max(mean + max(sizes, default=0), max(sizes, default=0))


def check(rows, got, shards=24):
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, home = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        home[(r.size, r.text_crc32)].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in home.values())


def test_table(docs, rows, no_docs):
    check([r[:2] for r in rows], sharding.shard_documents(docs).collect())
    assert sharding.shard_documents(no_docs).collect() == []


def test_near_equal_bytes(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 400) + str(i % 2500)) for i in range(4000)] + [(i, "copy" * 20) for i in range(4000, 4300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(df).collect()
    check(rows, got)
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    mean = sum(load.values()) / 24
    assert len(load) == 24 and max(load.values()) - min(load.values()) < 0.02 * mean


def test_group_above_a_shard(spark):
    rows = [(i, "hot" * 50) for i in range(300)] + [(1000 + i, f"text {i} " * 5) for i in range(600)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, got)
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    rest = sorted(load.values())[:-1]
    assert len(load) == 24 and max(rest) - min(rest) < 0.1 * max(rest)
