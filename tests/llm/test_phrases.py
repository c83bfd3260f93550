import random
import re
from collections import Counter

import pytest

from quern.llm import phrases

LOWER = str.maketrans(phrases.UPPER, phrases.LOWER)


def brute(docs, min_count, top=2000):
    """Count every phrase of 1 to 5 words directly and apply the contract."""
    f, n = {}, Counter()
    for lang, text in docs:
        lang = lang or "und"
        c = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, 6):
                    if i + k <= len(w):
                        c[" ".join(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if a >= min_count and len(p.split(" ")) >= 2}
        rows = []
        for p, a in cands.items():
            w = p.split(" ")
            if any(q != p and a == b and len(q.split(" ")) > len(w) and f" {p} " in f" {q} " for q, b in cands.items()):
                continue
            cuts = [((1000 * a * n[lang]) // (c[" ".join(w[:j])] * c[" ".join(w[j:])]), j) for j in range(1, len(w))]
            s, j = min(cuts)
            rows.append((-s, -a, p.encode(), p, a, c[" ".join(w[:j])], c[" ".join(w[j:])], s))
        rows.sort()
        out += [(lang, k + 1, r[3], r[4], r[5], r[6], n[lang], r[7]) for k, r in enumerate(rows[:top])]
    return sorted(out)


def run(spark, docs):
    df = spark.createDataFrame(docs, "lang string, text string")
    return sorted(tuple(r) for r in phrases.collocations(df).collect())


@pytest.fixture
def low(monkeypatch):
    monkeypatch.setattr(phrases, "MIN_COUNT", 3)


def test_against_brute_force(spark, low):
    rng = random.Random(11)
    vocab = ["new", "york", "city", "the", "of", "big", "apple", "état", "ß", "New", "YORK"]
    docs = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        text = ""
        for w in words:
            text += w + rng.choice([" ", " ", "\t", ". ", ",", "\n", "  ", " "])
        docs.append((rng.choice(["en", "de", None]), text))
    docs += [("en", "new york city. new york city; new york city! New York City?")] * 3
    docs += [("en", None), ("en", ""), (None, "...,,,")]
    assert run(spark, docs) == brute(docs, 3)


def test_containers_drop_and_top(spark, low, monkeypatch):
    monkeypatch.setattr(phrases, "TOP", 3)
    docs = [("en", "a b c d e f"), ("en", "a b c d e f"), ("en", "a b c d e f"), ("en", "a b x"), ("en", "a b y")]
    got = run(spark, docs)
    assert got == brute(docs, 3, top=3)
    assert {r[2] for r in got} <= {"a b", "a b c d e", "b c d e f"}


def test_empty(spark, low):
    assert run(spark, []) == []
    assert run(spark, [("en", None)]) == []


def test_clashing_columns(docs, low):
    out = phrases.collocations(docs.withColumnRenamed("source", "piece").withColumn("g", docs["doc_id"]))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_edges_only_where_pairs_recur(spark, low, monkeypatch):
    """Pairs below MIN_COUNT cut the pieces, so what is staged holds single words and the few phrases that recur."""
    sizes = {}

    def noted(df, purpose, staged=phrases.staged):
        out = staged(df, purpose)
        sizes[purpose] = out.count()
        return out

    monkeypatch.setattr(phrases, "staged", noted)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 400, raising=False)
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(60)]
    docs = [("en", " ".join(rng.sample(vocab, 40)) + ". New  york\tcity hall") for _ in range(3)]
    docs += [("de", " ".join(rng.sample(vocab, 40)) + "! new york city hall") for _ in range(2)]
    got = run(spark, docs)
    assert got == brute(docs, 3)
    assert ("en", 1, "new york city hall") in [r[:3] for r in got]
    assert sizes["phrases-edges"] <= 2 * 64 + 10
