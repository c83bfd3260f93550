import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import pii

# The base kinds as plain patterns, without the library's shortcuts.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(sum(map(int, str(d))) for d in doubled) % 10 == 0


def base_spans(text):
    found = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and plain_luhn(digits):
            found.append((m.start(), 2, m.end(), "card"))
    found += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]
    return [(s, e, k) for s, _, e, k in sorted(found)]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab.@+-%_ ()0123456789é\n", max_size=60))
def test_base_spans_as_plain_patterns(text):
    assert [(s, e, k) for s, e, k, _ in pii.find_spans(text) if k in pii.BASE] == base_spans(text)


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("4111 1111 1111 1111", ["card"]),
        ("4111 1111 1111 1112", []),
        ("IBAN GB82 WEST 1234 5698 7654 32 please", ["iban"]),
        ("IBAN GB83 WEST 1234 5698 7654 32 please", []),
        ("1.2.3.4.5.6.7.8 and 1.2.3.256", ["ip", "ip"]),
        ("ssn 123-45-6789", ["ssn"]),
        ("part 123-45-6789", []),
        ("call (212) 555-0100", ["local_phone"]),
        ("code (212) 555-0100", []),
        ("born 1980-02-11", ["birth_date"]),
        ("+1 (017) 555-7713 a.b@c.de", ["phone", "email"]),
    ],
)
def test_checks_and_context(text, kinds):
    assert [k for _, _, k, _ in pii.find_spans(text)] == kinds


def test_long_runs_are_linear():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "@a" * 50_000, "+1 " * 50_000, "1-" * 100_000, "1." * 100_000, "a.@" * 50_000):
        pii.find_spans(text)


def test_redact():
    text = "mail a.b@c.de or +1 (017) 555-7713."
    assert pii.redact(text, pii.find_spans(text)) == "mail [email] or [phone]."


def test_table(docs, rows, no_docs, spark):
    got = pii.find_pii(docs, spans_col="spans", redacted_col="text").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)  # nothing to redact
    assert got[0].__fields__[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    df = spark.createDataFrame([(1, "x a@b.cd", "q")], "doc_id long, text string, text2 string")
    row = pii.find_pii(df, redacted_col="clean").first()
    assert (row.text, row.clean, row.spans[0].start, row.spans[0].end) == ("x a@b.cd", "x [email]", 2, 8)
    assert pii.find_pii(no_docs).collect() == []
