import hashlib
import random
import re

import pytest

from quern.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, n=13):
    """Every window of every document against every window of documents with smaller ids."""
    split = [(d, WORD.findall(t or "")) for d, t in docs]
    firsts = {}
    for d, w in split:
        if d is None:
            continue
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            firsts[g] = d if g not in firsts else min(firsts[g], d)
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - n + 1):
                if firsts[tuple(w[i : i + n])] < d:
                    gone.update(range(i, i + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((tuple(r)[:4] for r in substrings.remove_repeated_windows(df).collect()), key=repr)


def test_fixture_against_brute_force(docs, rows):
    got = sorted((tuple(r)[:4] for r in substrings.remove_repeated_windows(docs).collect()), key=repr)
    assert got == brute([(r[0], r[1]) for r in rows])
    assert any(r[2] > 0 for r in got)


@pytest.mark.parametrize("shard_bytes", [substrings.SHARD_BYTES, 300])
def test_shared_passages_and_small_shards(spark, monkeypatch, shard_bytes):
    """Passages at any offset, spaced differently, overlapping, inside words, in copies; many shards and blocks."""
    monkeypatch.setattr(substrings, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 500)
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(40)] + ["ab", "abab", "λ", "🙂x"]
    passage = " ".join(rng.choice(vocab) for _ in range(30))
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(30)]
    docs += [(100, "x " + passage), (50, passage.replace(" ", "\n\t ", 5) + " tail"), (70, "ab" + passage + "ab")]
    docs += [(80, passage + " " + passage), (80, passage), (None, passage), (90, None), (91, "")]
    docs += [(200, docs[3][1]), (201, docs[3][1])]
    assert run(spark, docs) == brute(docs)


def test_empty_and_short(spark):
    assert run(spark, []) == []
    docs = [(1, "a b c"), (2, "a b c"), (3, None)]
    assert run(spark, docs) == brute(docs) == sorted([(1, 3, 0, hashlib.sha256(b"a b c").hexdigest()), (2, 3, 0, hashlib.sha256(b"a b c").hexdigest()), (3, 0, 0, hashlib.sha256(b"").hexdigest())], key=repr)


def test_clashing_columns(docs):
    """Columns named like inner ones (size, spans, id) do no harm."""
    out = substrings.remove_repeated_windows(docs.withColumnRenamed("lang", "words").withColumn("row", docs["doc_id"]))
    assert out.columns[:4] == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert out.count() == docs.count()


def test_no_row_per_window_is_staged(spark, monkeypatch):
    """Copies and near copies: blocks and buckets exchange a few messages, never one row per window."""
    sizes = {}

    def noted(df, purpose, staged=substrings.staged):
        out = staged(df, purpose)
        sizes[purpose] = out.count()
        return out

    monkeypatch.setattr(substrings, "staged", noted)
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 4000)
    rng = random.Random(8)
    text = [f"w{rng.randint(0, 99)}" for _ in range(400)]
    docs = [(k, " ".join(text[:k * 9] + [f"other{k}"] + text[k * 9:])) for k in range(40)]
    assert run(spark, docs) == brute(docs)
    assert max(sizes.values()) < 1000


def test_many_words_in_small_automata(spark, monkeypatch):
    """More words than first letters, ids far apart and below zero, one id in several blocks."""
    monkeypatch.setattr(substrings, "SHARD_BYTES", 5000)
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 2000)
    rng = random.Random(9)
    text = [f"{rng.randint(0, 10**6):x}é" for _ in range(3000)]
    ids = [-(2**62), 2**62, 0, 7, 7, -5]
    docs = [(i, "\n".join(text[a : a + 700])) for i in ids for a in range(0, 3000, rng.randint(500, 900))]
    assert run(spark, docs) == brute(docs)
