import re
from collections import Counter

import pytest

from quern.llm import licences

TEXTS = [
    "Some words.\nLicensed under the Apache License, Version 2.0.\nMore words.",
    "Intro\n\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
    "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nEnd",
    "RELEASED UNDER THE MIT LICENSE!!",
    "licensed under nothing at all",
    "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.",
    "license\n\n\n \nlicensed", "", None, "\n\n\n",
]


def brute(text):
    def words(t):
        return [w for w in re.split("[^a-z0-9]+", t.lower()) if w]

    grams = lambda t: {(a, b) for a, b in zip(words(t), words(t)[1:])}
    pieces = [("line", i, p) for i, p in enumerate((text or "").split("\n"))]
    pieces += [("paragraph", i, p) for i, p in enumerate(p for p in re.split("\n[ \t]*\n", text or "") if "\n" in p)]
    out = {}
    for kind, i, p in pieces:
        a = grams(p)
        for licence, template in licences.TEMPLATES:
            b = grams(template)
            dice = 2 * len(a & b) / (len(a) + len(b)) if a else 0
            if dice >= licences.THRESHOLD:
                out[(kind, i, licence)] = max(dice, out.get((kind, i, licence), 0))
    return {(*k, round(v, 9)) for k, v in out.items()}


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, words string")
    got = {tuple(r) for r in licences.scan_licences(df).collect()}
    assert got == {(i, *m) for i, t in enumerate(TEXTS) for m in brute(t)}
    assert {m[3] for m in got} >= {"Apache-2.0", "GPL-3.0", "MIT", "CC-BY-NC-4.0"}


def test_bounds_never_lose_a_match():
    """Any segment that reaches the threshold has an allowed size and an anchor."""
    for _, template in licences.TEMPLATES:
        grams = licences.bigrams_of(template)
        anchors = licences.anchors_of(template, licences.THRESHOLD)
        free = [g for g in grams if not set(g.split(" ")) & set(anchors)]
        best = max(2 * len(free) / (len(free) + len(grams)), 0)  # the best match without an anchor
        assert best < licences.THRESHOLD


@pytest.mark.parametrize("repeat", [1, 2])
def test_rows_one_by_one(spark, docs, no_docs, repeat):
    df = spark.createDataFrame([(None, TEXTS[2])] * repeat, "doc_id long, text string")
    assert Counter(r.licence for r in licences.scan_licences(df).collect()) == {"MIT": repeat}
    assert licences.scan_licences(docs).collect() == [] == licences.scan_licences(no_docs).collect()
