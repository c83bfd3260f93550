import hashlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import suffixes


def brute(texts, width):
    """(bytes, removed, spans, digest) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + width] for d in data for k in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - width + 1):
            if seen[d[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("width", [2, 10, 50, 100, 400, 1000])
def test_cover_meets_every_shift(width):
    v, cover = suffixes.cover_for(width)
    assert 1 <= v <= max(1, width // 2)
    assert {(a - b) % v for a in cover.tolist() for b in cover.tolist()} == set(range(v))


def test_fingerprints_across_pieces(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 64)
    suffixes._powers.cache_clear()
    text = np.frombuffer(b"abcdefghij" * 40, np.uint8)
    prints = suffixes.fingerprints(text, np.arange(0, 370), 30)
    suffixes._powers.cache_clear()
    assert len(set(prints.tolist())) == 10 and (prints[:360] == prints[10:370]).all()


@pytest.mark.parametrize("width", [400, 60, 12])
def test_against_brute_force(docs, rows, width):
    got = suffixes.remove_repeats(docs, width, keep_text=True).collect()
    want = Counter((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], width)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_edges_whose_partner_is_covered(spark):
    """A match that only sticks out over a fully covered one, shifted against it."""
    rng = np.random.default_rng(3)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    core = letters(900)
    texts = [core + letters(300), letters(77) + core, letters(5) + core[250:800] + letters(9), core[:401], core[1:401], core * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.remove_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 400)


def test_empty(no_docs):
    assert suffixes.remove_repeats(no_docs).collect() == []


def test_query_returns_the_remaining_text(spark, tmp_path):
    """The registered query shows what is left of each text, and n_bytes stays the length of the input."""
    from quern.llm.queries import QUERIES

    passage = "".join(f"{k * 7919 % 100003:05d} " for k in range(80))
    docs = [(1, "first " + passage + "end"), (2, "é" + passage + "è"), (3, "alone"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op1_suffix_dedup"](spark, str(tmp_path)).collect()}
    # the space before the passage differs from the é, so it stays
    assert {k: r["kept_text"] for k, r in got.items()} == {1: "first end", 2: "éè", 3: "alone", 4: ""}
    assert {k: (r["n_bytes"], r["n_removed"]) for k, r in got.items()} == {1: (489, 480), 2: (484, 480), 3: (5, 0), 4: (0, 0)}
    for r in got.values():
        assert r["kept_sha256"] == hashlib.sha256(r["kept_text"].encode()).hexdigest()
