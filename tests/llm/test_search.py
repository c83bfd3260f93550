import math
import re
from collections import Counter

import pytest

from quern.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall((text or "").translate(str.maketrans(search.UPPER, search.LOWER)))


def brute(docs, items, top=50):
    """Score every document for every item by the contract, plainly."""
    bags = [(d, Counter(words(t)), len(words(t))) for d, t in docs]
    bags = [b for b in bags if b[2] > 0]
    n_docs, n_terms = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        asked = set(words(text))
        scored = []
        for at, (d, bag, n) in enumerate(bags):
            m = 50 + (50 * n * n_docs) // n_terms
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m))
                for t in asked
                if t in bag
            )
            if s > 0:
                scored.append((-s, d is None, d or 0, at, d, s))
        scored.sort()
        out += [(item, k + 1, x[4], x[5]) for k, x in enumerate(scored[:top])]
    return out


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(tuple(r) for r in search.search(d, i).collect())


def key(rows):
    return sorted(rows, key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("short_share,broadcast", [(0.01, True), (0.5, True), (1.0, True), (0.01, False)])
def test_against_brute_force(spark, rows, monkeypatch, short_share, broadcast):
    monkeypatch.setattr(search, "SHORT_SHARE", short_share)
    if not broadcast:  # the shuffle joins, and several passes of items
        monkeypatch.setattr(search, "BROADCAST_TERMS", 0)
        monkeypatch.setattr(search, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(search, "ITEMS_PER_PASS", 2)
    docs = [(r[0], r[1]) for r in rows]
    texts = [t for _, t in docs if t]
    items = [(0, texts[0][:200]), (1, texts[10][:300]), (2, None), (3, ""), (4, "Word WORD word"), (5, "écrit λόγος 漢字"), (6, texts[4][:40])]
    got = run(spark, docs, items)
    assert key(got) == key(brute(docs, items))
    assert {r[0] for r in got} >= {0, 1, 4}


def test_pruning_keeps_the_top(spark, monkeypatch):
    """Many documents, a common word and rare ones: long lists are probed, results stay exact."""
    monkeypatch.setattr(search, "SHORT_SHARE", 0.05)
    docs = [(i, f"the cat {'rare%d ' % (i % 97)} and the dog {'the ' * (i % 5)} x{i % 13}") for i in range(400)]
    docs += [(None, "the cat"), (7, "the cat rare7 rare7")]
    items = [(1, "The cat rare7 rare8 x3 and"), (2, "the"), (3, "rare1 rare2 rare3 rare4")]
    got = run(spark, docs, items)
    assert key(got) == key(brute(docs, items))
    counted = Counter(r[0] for r in got)
    assert counted[1] == counted[2] == 50 and 0 < counted[3] <= 50


def test_empty_tables(spark, no_docs):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.search(no_docs, items).count() == 0
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert search.search(docs, items.limit(0)).count() == 0


def test_clashing_columns(spark, docs):
    items = docs.select(F_col_doc := "doc_id", "text", "lang", "source").withColumnRenamed(F_col_doc, "item_id").limit(3)
    got = search.search(docs, items).collect()
    assert all(r.rank >= 1 and r.score > 0 for r in got)
