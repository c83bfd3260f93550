import hashlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from quern.llm import encoding
from quern.llm.queries import TOKENIZER_FILE

ODD = [
    "", "  ", "a\x1cb c\x85d", "ΑΣ ΣΑΣ", "İstanbul", "<|endoftext|> x <|startoftext|>y <|ENDOFTEXT|>", "it's I'LL we'Re '' 's",
    "é 가각", "½ ² ٣ Ⅷ 12345 a1b2", "🙂👍🏽 x﻿y", "a​b", "ẞ ß ﬁ", "x" * 3000, "\x00a\x00", "!!!…—", "don't,stop",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(TOKENIZER_FILE)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_transducer_is_minimal_and_ranks_words():
    words = sorted({f"{a}{b}{c}".encode() for a in ("walk", "talk", "") for b in ("ing", "ed", "s") for c in ("", "!")} | {b"", b"\xff"})
    lexicon = encoding.Lexicon(np.frombuffer(encoding.pack_lexicon({w: [i, i] for i, w in enumerate(words)}), "<i4"))
    assert lexicon.ranks(words).tolist() == list(range(len(words)))
    assert lexicon.ranks([b"walk", b"x", b"walkings", b"wal"]).tolist() == [-1] * 4
    # walk / talk share every state after their first letter
    states = {tuple(sorted(w[len(p) :] for w in words if w.startswith(p))) for w in words for p in [w[:k] for k in range(len(w) + 1)]}
    assert len(lexicon.final) - 1 == len(states)


def test_words_and_merges_as_the_library(library):
    rules = encoding.Tokenizer(TOKENIZER_FILE)
    known = {w.encode(): rules.merge(w) for w in ("don", "stop", "12", "x")}
    encoder = encoding.Encoder(rules, encoding.Lexicon(np.frombuffer(encoding.pack_lexicon(known), "<i4")))
    decoder = encoding.Decoder(rules)
    for text, ids in zip(ODD, encoder.encode(ODD)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert decoder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_table(docs, rows, library):
    got = encoding.encode(docs, TOKENIZER_FILE, digests=True).collect()
    want = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, "<u4").tobytes()
        want[(r[0], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want
    plain = encoding.encode(docs, TOKENIZER_FILE, keep=("doc_id", "id")).collect()
    assert Counter(len(r.ids) for r in plain) == Counter(r.n_tokens for r in got)


def test_empty(no_docs):
    assert encoding.encode(no_docs, TOKENIZER_FILE).collect() == []
