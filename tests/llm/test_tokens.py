"""BPE against the public library, and packing against its rules."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from voxelweave.llm import bpe, packing, tokens

PARTS = [" ", "  ", "\n", "\t", "\x1c", "\x85", "a", "B", "1", "é", "ß", "中", "🎉", "'s", "'", "!", "<|endoftext|>", "\r", "the", "and", "²", "Ⅷ", "̀", "‍", "﻿", "٣"]


@pytest.fixture(scope="module")
def library(vocabulary):
    return pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary)


@pytest.fixture(scope="module")
def own(vocabulary):
    return bpe.ByteBpe(open(vocabulary, encoding="utf-8").read())


def texts():
    r = random.Random(1)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(3000)] + ["a" * 5000, "ab" * 3000 + " x", " " * 5000, "", " ", "\n \n x", "the" * 4000, "ein Wörterbuch über Größe " * 500]


def test_same_ids_as_the_library(own, library, vocabulary):
    ts = texts()
    want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(ts, add_special_tokens=False)]
    assert own.encode(ts) == want
    ids = packing.coder(open(vocabulary, encoding="utf-8").read())
    assert [np.array(ids(t), "<u4").tobytes() for t in ts] == want
    assert [own.decode(x) for x in want] == [library.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in want] == ts


@given(st.text(max_size=40))
@settings(max_examples=150, deadline=None)
def test_round_trip(own, library, text):
    assert own.decode(own.encode([text])[0]) == text
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_broken_ids_decode_as_the_library_does(own, library):
    r = random.Random(2)
    for _ in range(200):
        ids = [r.randint(0, 255) for _ in range(r.randint(1, 6))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_caches_change_nothing(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    ts = texts()[:200]
    for t in ts:
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_operators(spark, docs_of, vocabulary, library):
    ts = ["Hello world", None, "", "x" * 3000, "a b", "a b"]
    df = docs_of(ts, ids=[0, 1, 2, 3, 4, 4], n_tokens="clash")
    got = tokens.round_trip(df, vocabulary).collect()
    assert len(got) == 6
    for row in got:
        text = ts[row.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df, vocabulary), vocabulary).collect()}
    assert back[0] == "Hello world" and back[1] == "" and back[3] == "x" * 3000
    assert tokens.round_trip(df.limit(0), vocabulary).count() == 0


def test_pack(spark, docs_of, vocabulary, library):
    r = random.Random(3)
    ts = [" ".join("word" for _ in range(r.randint(0, 90))) for _ in range(300)] + [None, "", "long " * 500, "long " * 500]
    df = docs_of(ts, ids=[*range(303), 302], sequence_id=5)
    got = packing.pack(df, vocabulary, 64, group_rows=100).toPandas()
    assert not got.isna().any().any()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 64
    for d, g in got[got.doc_id != 302].groupby("doc_id"):
        g = g.sort_values("piece")
        ids = np.array([*library.encode(ts[d] or "", add_special_tokens=False).ids, 0], "<u4")
        assert g.piece.tolist() == list(range(len(g))) and g.start.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() == len(ids)
        assert all(x == 64 for x in g.length.tolist()[1:]) and [zlib.crc32(ids[s : s + n]) for s, n in zip(g.start, g.length, strict=True)] == g.ids_crc32.tolist()
    least = -(-got.length.sum() // 64)
    assert got.sequence_id.nunique() <= least * 1.06 + 2
    assert packing.pack(df.limit(0), vocabulary).count() == 0


def test_sum_of_squares_takes_the_best_place():
    r = np.random.default_rng(0)
    sizes, cap = r.integers(1, 21, 120), 20
    where, offset, fill = packing.sum_of_squares(sizes, cap)
    fills, squares = [], lambda f: sum(f.count(x) ** 2 for x in set(f) if x < cap)
    for s, b, o in zip(sizes.tolist(), where.tolist(), offset.tolist(), strict=True):
        options = []
        for k in range(len(fills) + 1):
            f = [*fills, 0] if k == len(fills) else list(fills)
            if f[k] + s <= cap:
                f[k] += s
                options.append(squares(f))
        fills = [*fills, 0] if b == len(fills) else fills
        assert fills[b] == o and fills[b] + s <= cap
        fills[b] += s
        assert squares(fills) == min(options)
    assert fills == fill.tolist()
