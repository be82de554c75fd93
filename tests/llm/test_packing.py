import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from songloom.llm import packing
from songloom.llm.queries import tokenizer_file

CAPACITY = 64


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_file())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END]


def check(pieces, rows, tokenizer, capacity):
    """Pieces hold every id of every row once, and sequences have neither gaps nor overlaps."""
    want = sorted(
        ((i, k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()))
         for i, t in rows for ids in [ids_of(tokenizer, t)]
         for k, (start, length) in enumerate(packing.cut(len(ids), capacity))), key=repr)
    assert sorted(((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces), key=repr) == want
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_every_id_once_and_nearly_full(documents, odd_rows, tokenizer):
    rows = odd_rows + [(100 + i, "some words of a text, " * (i % 23)) for i in range(400)]
    df = documents(rows, extra=True).repartition(3)
    pieces = packing.pack(df, tokenizer_file(), capacity=CAPACITY, open_bins=8).collect()
    used = check(pieces, rows, tokenizer, CAPACITY)
    assert used <= 1.03 * sum(p.length for p in pieces) / CAPACITY + 2
    assert packing.pack(df.limit(0), tokenizer_file()).count() == 0


def test_tokens_come_along(documents, odd_rows, tokenizer):
    got = packing.pack(documents(odd_rows), tokenizer_file(), capacity=CAPACITY, with_ids=True).collect()
    assert all(zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length for p in got)


def test_ids_are_the_librarys(tokenizer):
    own = packing.UnitTokenizer(tokenizer_file())
    texts = [
        "", " ", "  a", "a  b", "a \n b", "a\n\nb c", "tab\tx y ", "don't we'll", "x <|endoftext|> y", "1234 5,6.7 %%% ***",
        "naïve Straße 日本 語", " a   b", "a\x1cb c\x85 d", "\U0001f600 \U0001f600\U0001f600 é é",
    ]
    assert not own.whole and own.ranked
    got = [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_best_fit_closes_the_fullest():
    packer = packing.BestFit(10, 2)
    assert [packer.place(n) for n in (6, 5, 4)] == [(0, 0), (1, 0), (0, 6)]
    assert packer.open() == {1}
    assert packer.place(7) == (2, 0) and packer.place(8) == (3, 0)
    assert packer.open() == {1, 2}
    assert packer.place(3) == (2, 7) and packer.place(5) == (1, 5)
    assert packer.open() == set()


def test_only_long_documents_are_cut():
    assert list(packing.cut(5, 10)) == [(0, 5)] and list(packing.cut(10, 10)) == [(0, 10)]
    assert list(packing.cut(25, 10)) == [(0, 5), (5, 10), (15, 10)]
    assert list(packing.cut(20, 10)) == [(0, 10), (10, 10)]
