"""Operator 5, personal data: patterns propose spans, checksums confirm them, context words adjust the score.

A kind has a pattern, a validator and a base score. A proposal that its
validator rejects is dropped. The score of the rest rises when one of the
kind's context words stands near, and a span is kept from ``THRESHOLD`` on.
Email, ip, card and phone start at the threshold, so they need no context;
kinds without a strong checksum do.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
CONTEXT_CHARS = 60
CONTEXT_BONUS = 0.35

# Patterns start only where a leftmost match can start and use possessive
# repeats, so that very long runs cost one pass.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_BIRTH = re.compile(r"(?<![0-9])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9][./][01]?[0-9][./](?:19|20)[0-9]{2})(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if place % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    text = iban.replace(" ", "")
    if not 15 <= len(text) <= 34:
        return False
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(filter("0123456789".__contains__, text))


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _card_ok(text: str) -> bool:
    digits = _digits(text)
    return 14 <= len(digits) <= 19 and luhn(digits)


def _ssn_ok(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def find_emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern, each found from its @ so that long words cost one pass."""
    end, at = 0, text.find("@")
    while at >= 0:
        part = text[end:at]
        start = end + len(part.rstrip(_LOCAL))
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", end)


def _all(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text))


@dataclass(frozen=True)
class Kind:
    name: str
    propose: Callable[[str], Iterator[tuple[int, int]]]
    valid: Callable[[str], bool]
    score: float
    context: tuple[str, ...]
    base: bool = False
    trigger: str = "digit"


KINDS = (
    Kind("email", find_emails, lambda s: True, 0.9, ("mail", "contact", "write"), True, "@"),
    Kind("ip", _all(_IP), _octets, 0.6, ("ip", "server", "host", "address"), True),
    Kind("card", _all(_CARD), _card_ok, 0.7, ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"), True),
    Kind("phone", _all(_PHONE), lambda s: 10 <= len(_digits(s)) <= 15, 0.6, ("phone", "tel", "call", "mobile"), True, "+"),
    Kind("iban", _all(_IBAN), mod97, 0.7, ("iban", "account", "bank", "konto", "compte", "cuenta")),
    Kind("ssn", _all(_SSN), _ssn_ok, 0.3, ("ssn", "social security", "taxpayer")),
    Kind("local_phone", _all(_LOCAL_PHONE), lambda s: True, 0.2, ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono")),
    Kind("birth_date", _all(_BIRTH), lambda s: True, 0.2, ("born", "birth", "geboren", "naissance", "nacimiento")),
)
BASE = tuple(k.name for k in KINDS if k.base)
_ORDER = {k.name: i for i, k in enumerate(KINDS)}
_WORDS = {k.name: re.compile(r"\b(?:" + "|".join(map(re.escape, k.context)) + r")", re.I) for k in KINDS}
_ANY_DIGIT = re.compile("[0-9]")


def find_spans(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) by start, then kind as listed; positions are code points, ends exclusive."""
    if not _ANY_DIGIT.search(text) and "@" not in text:
        return []
    found = []
    for kind in KINDS:
        if kind.trigger in "@+" and kind.trigger not in text:
            continue
        for start, end in kind.propose(text):
            if not kind.valid(text[start:end]):
                continue
            score = kind.score
            near = text[max(0, start - CONTEXT_CHARS) : start] + "\n" + text[end : end + CONTEXT_CHARS // 2]
            if _WORDS[kind.name].search(near):
                score = min(1.0, score + CONTEXT_BONUS)
            if score >= THRESHOLD:
                found.append((start, end, kind.name, score))
    found.sort(key=lambda s: (s[0], _ORDER[s[2]], s[1]))
    return found


def redact(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    """Replace spans by their kind in brackets; spans that overlap become one, named after the first."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind, _ = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], f"[{kind}]"]
        at = end
    out.append(text[at:])
    return "".join(out)


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_SPAN_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
)


def find_pii(docs: DataFrame, text_col: str = "text", spans_col: str = "spans", redacted_col: str | None = None) -> DataFrame:
    """Add the spans of every text, and with ``redacted_col`` the text without them.

    All columns stay; a column already named ``spans_col`` is replaced, and
    ``redacted_col`` may be ``text_col`` itself. A null text has no spans and
    stays null. Texts are read whole. Repeated rows are handled one by one and
    an empty table stays empty.
    """
    others = [c for c in docs.columns if c not in (spans_col, redacted_col)]
    source = docs.select(F.col(text_col).cast("string").alias("__text"), *[F.col(f"`{c}`") for c in others])
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__text"]
        + [f"`{spans_col}` {SPANS}"]
        + ([f"`{redacted_col}` string"] if redacted_col else [])
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, clean = [], []
            for text in batch.column(0).to_pylist():
                found = find_spans(text) if text else []
                spans.append([{"kind": k, "start": s, "end": e, "score": v} for s, e, k, v in found])
                if redacted_col:
                    clean.append(redact(text, found) if found else text)
            arrays = [*batch.columns[1:], pa.array(spans, _SPAN_ARROW)] + ([pa.array(clean, pa.string())] if redacted_col else [])
            yield pa.RecordBatch.from_arrays(arrays, names=[*others, spans_col] + ([redacted_col] if redacted_col else []))

    out = source.mapInArrow(scan, schema)
    kept = [c for c in docs.columns if c in out.columns]
    return out.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`") for c in out.columns if c not in kept])
