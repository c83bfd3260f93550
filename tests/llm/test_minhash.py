import random
from collections import Counter

import numpy as np
import pytest

from quern.llm import minhash
from quern.llm.links import components


def weights(text):
    words = (text or "").encode().split()
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def similarity(a, b):
    both = (a & b).total()
    return both / max(1, a.total() + b.total() - both)


def brute_groups(rows):
    """Smallest id of each row's group; ids with null last."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [weights(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] is None or rows[j][1] is None:
                continue
            if rows[i][1] == rows[j][1] or similarity(bags[i], bags[j]) >= minhash.SIMILARITY:
                parent[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    least = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return [least[find(i)] for i in range(len(rows))]


def test_collisions_follow_the_weighted_similarity():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(4000)]
    a = [rng.choice(words) for _ in range(300)] + ["x", "y"] * 60
    for change in (5, 20, 60):
        b = list(a)
        for _ in range(change):
            b[rng.randrange(len(b))] = rng.choice(words)
        texts = [" ".join(a).encode(), " ".join(b).encode()]
        unit, of_text = minhash.units(texts)
        values = minhash.signatures(unit, of_text, 2)
        want = similarity(weights(texts[0].decode()), weights(texts[1].decode()))
        assert abs((values[0] == values[1]).mean() - want) < 4 * (0.25 / minhash.COORDINATES) ** 0.5


def test_values_do_not_depend_on_the_batch():
    texts = [b"a b c d e f g", b"one", b"", b"q " * 5000, b"a b c d e f h"]
    unit, of_text = minhash.units(texts)
    together = minhash.signatures(unit, of_text, len(texts))
    for i, t in enumerate(texts):
        alone = minhash.signatures(*minhash.units([t]), 1)
        assert (alone[0] == together[i]).all()
    assert (together[3] != 0).all() and (together[2] == 0).all()


def test_against_brute_force(docs, rows):
    got = minhash.near_duplicates(docs).collect()
    want = brute_groups([r[:2] for r in rows])
    assert Counter((r.doc_id, r.group_id) for r in got) == Counter((r[0], g) for r, g in zip(rows, want))
    assert all(r.kept == (r.doc_id == r.group_id) for r in got)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len({(g, t is None) for g, (_, t, *_) in zip(want, rows)}) and len(set(texts)) == len(texts)


def test_large_near_group(spark):
    """Hundreds of near copies and of exact copies are two groups; nothing is paired with everything."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(300):
        text = list(base)
        text[rng.randrange(120)] = f"v{i}"
        texts.append(" ".join(text))
    texts += ["another text that is copied many times over and over"] * 200
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = minhash.near_duplicates(df).collect()
    assert Counter((r.group_id, r.group_size) for r in got) == {(0, 300): 300, (300, 200): 200}


@pytest.mark.parametrize("block", [minhash.BLOCK, 8])
def test_near_copies_inside_a_family(spark, monkeypatch, block):
    """Texts on one template at 0.74 are apart; pairs among them at 0.82 are found, whoever leads their bands."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template = fresh(344)
    texts = []
    for _ in range(40):
        twin = fresh(20)
        texts += [" ".join(template + twin + fresh(40)) for _ in range(2)]
    bags = [weights(t) for t in texts[:3]]
    assert 0.81 < similarity(bags[0], bags[1]) < 0.83 and 0.73 < similarity(bags[0], bags[2]) < 0.75
    # twenty near copies of one of them fill blocks of their own
    words = texts[0].split()
    texts += [" ".join(words[:i] + ["other"] + words[i + 1 :]) for i in range(100, 120)]
    rows = list(enumerate(texts))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_groups(rows)
    assert {r.doc_id: r.group_id for r in got} == dict(enumerate(want))


def test_common_units():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 6000)).astype("<u8")) for _ in range(9)] + [np.zeros(0, "<u8")]
    want = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    other = ~np.eye(len(sets), dtype=bool)  # a text is not compared with itself
    assert (minhash.common_units(sets, len(sets)) == want)[other].all()
    assert (minhash.common_units(sets, 4) == want[:4, 4:]).all()
    assert (minhash.common_units(sets[-1:], 1) == 0).all()


def test_empty(no_docs):
    assert minhash.near_duplicates(no_docs).collect() == [] == minhash.keep_one(no_docs).collect()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(500 + i, 501 + i) for i in range(60)]
    edges += [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
