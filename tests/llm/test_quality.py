import re
from collections import Counter

import pytest

from quern.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    inside = [0] * len(words)
    for k in range(len(words) - 4):
        if windows[tuple(words[k : k + 5])] > 1:
            inside[k : k + 5] = [1] * 5
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, repeat = len(words), sum(inside)
    failed = n < 10 or 100 * repeat > 20 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, failed


EXTRA = [
    "a b c d e a b c d e", "x " * 30, "a a a a a a", "l one\nl one\n\n\nl one\n  \n", "| # a\x0bb\x0cc\rd", "   x\u0085y",
    "This This is is a a test test of of words words and and more more",
]


def test_against_brute_force(docs, rows, spark):
    got = quality.quality_metrics(docs).collect()
    assert Counter((r.doc_id, *r[1:7]) for r in got) == Counter((r[0], *brute(r[1])) for r in rows)
    assert not any(r.kept for r in got if r.base_failed)
    more = spark.createDataFrame(list(enumerate(EXTRA)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:7] for r in quality.quality_metrics(more).collect()}
    assert got == {i: brute(t) for i, t in enumerate(EXTRA)}


def test_order_changes_no_verdict(docs):
    for rules in (quality.RULES, tuple(reversed(quality.RULES))):
        kept = [r.doc_id for r in quality.keep_good(docs, rules=rules).collect()]
        assert sorted(kept, key=str) == sorted((r.doc_id for r in quality.quality_metrics(docs).collect() if r.kept), key=str)


def test_cascade_asks_by_rejection_per_cost(spark):
    df = spark.createDataFrame([("A#B " * 30,)] * 50 + [("plain words of a text " * 2 + "and so on",)] * 5, "text string")
    first = quality.cascade_order(df)[0]
    assert first.name in ("symbols", "repetition", "upper_case", "echoes")  # the others reject nothing here
    assert set(quality.cascade_order(df)) == set(quality.RULES)


def test_labelled_documents(spark, sf_dir):
    """Good documents stay, junk goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.quality_metrics(spark.read.parquet(f"{sf_dir}/documents.parquet")).join(labels, "doc_id")
    rows = judged.filter("NOT base_failed").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(junk) <= 0.1 * len(junk)


def test_columns_and_empty(docs, no_docs):
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.keep_good(no_docs).collect() == [] == quality.quality_metrics(no_docs).collect()


@pytest.mark.parametrize("keep", [("doc_id",), ("id", "cls")])
def test_keep(docs, keep):
    assert quality.quality_metrics(docs, keep=keep).columns[: len(keep)] == list(keep)
