import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing

PATH = public_tokenizers.path(packing.VOCABULARY)


def whole():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_words_give_the_ids_of_the_text():
    odd = ["", "A", "x's", "it's, 'tis.", "İstanbul Σας ΑΣ ß ﬁ", "<|endoftext|> a<|endoftext|>b", "a\x1cb\x85c d", "12 3a4 b5.", "½² x²", "tab\tsep\r\nx  ", "Ǆ ǅ ŉ ſ K Å ẞ", "á ́x", "don't.,", "  ", "a" * 3000 + " b", "🙂🙂 x🙂.", None]
    encoder = packing.WordEncoder(PATH)
    for _ in range(2):  # the second time from memory
        got = encoder.encode(pa.array(odd, pa.string()))
        assert [g.tolist() for g in got] == [whole().encode(t or "", add_special_tokens=False).ids for t in odd]


@given(st.integers(1, 30_000))
def test_cuts(n):
    lengths = packing.cut_lengths(n)
    assert sum(lengths) == n and all(0 < x <= packing.CAPACITY for x in lengths)
    # Every piece but the last fills bins of its class but for a few ids; the last wastes at most the given share.
    for x in lengths:
        k = packing.CAPACITY // x
        assert packing.CAPACITY - k * x <= max(k, packing.WASTE * packing.CAPACITY)


def check(docs, rows):
    texts = sorted((t or "" for t in (r.text for r in docs.collect())), key=str)
    tokenizer = whole()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by_doc[r.id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    total = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts)
    assert sum(r.length for r in rows) == total
    return by_doc, total, len(by_sequence)


def test_every_id_once(make_docs):
    docs = make_docs([(i, f"word{i} and more, " * (i * 7 % 400)) for i in range(120)])
    rows = packing.pack_documents(docs).collect()
    by_doc, total, sequences = check(docs, rows)
    text = {r.doc_id: r.text for r in docs.collect()}
    for (doc, n), pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        ids = [i for r in pieces for i in r.ids]
        assert [r.start for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces])[:-1]) and len(ids) == n
        assert ids == [*whole().encode(text[doc], add_special_tokens=False).ids, packing.END_ID]
    # Three workers, one short sequence each.
    assert 1 - total / (sequences * packing.CAPACITY) < 0.04


def test_odd_documents(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs).collect()
    check(odd_docs, rows)
    assert sum(r.doc_tokens == 1 for r in rows) == 4  # two nulls, an empty and a blank text
    assert packing.pack_documents(no_docs).count() == 0
