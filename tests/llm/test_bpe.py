import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import bpe


@pytest.fixture(scope="module")
def enc():
    return bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)


def test_parts_give_the_ids_of_the_whole(enc):
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "1", " ", "  ", "\n", "\t", "'s", "'", "!", "\x1c", " ", "中", "🙂", "ll", "\x85"]
    for _ in range(200):
        text = "".join(rng.choice(alphabet) for _ in range(400))
        parts = [p for p in bpe.safe_parts(text, 20)]
        assert "".join(parts) == text
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_long_white_space(enc, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_SPACE", 8)
    monkeypatch.setattr(bpe, "_SPACE_RUN", bpe.re.compile(bpe._SPACE_RUN.pattern.replace("4096", "8")))
    odd = ("a \x1c" + " " * 50 + "x", " " * 20 + "\x1d" + " " * 20, "a" + " " * 20 + "\x1e\x1f" + "\n" * 20 + "\x1c", "\x1c" * 30 + " " * 30)
    for text in (*odd, " " * 50 + "a", "a" + " " * 50, "a" + " " * 50 + "b", "x\n" + "\n" * 30 + " y", " " * 9, "a" + "\t" * 20 + "1" + " " * 12 + "'s"):
        assert bpe.encode(enc, text, 10) == enc.encode_ordinary(text)
    many = bpe.encode(enc, "a" + " " * 1_000_000 + "b")
    table = bpe.token_bytes(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    assert bpe.decode(table, many) == b"a" + b" " * 1_000_000 + b"b"


def test_controls_in_long_white_space(enc):
    text = "a \x1c" + " " * 3_000_000 + "x"
    ids = bpe.encode(enc, text)
    assert bpe.decode(bpe.token_bytes(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN), ids) == text.encode()
    short = "a \x1c" + " " * 5_000 + "x"
    assert bpe.encode(enc, short) == enc.encode_ordinary(short)


def test_documents(enc, odd_docs):
    rows = bpe.encode_documents(odd_docs).collect()
    want = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=repr)
    assert len(rows) == len(want)
    got = sorted(((r.id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in rows), key=repr)
    expected = []
    for i, t in want:
        ids = enc.encode_ordinary(t)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), ids))
    assert got == sorted(expected, key=repr)


def test_no_documents(no_docs):
    assert bpe.encode_documents(no_docs).count() == 0
