"""Operator 12 against a plain version that hashes every run by itself."""

import hashlib
import math
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from voxelweave.llm import importance as op


def runs(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i - k : i]) for i in range(1, len(words) + 1) for k in range(n, 0, -1) if i >= k]


def plain(docs, target, n=1, buckets=10_000, percent=10, min_words=20, seed="2024:"):
    b = lambda t: [zlib.crc32(f.encode()) % buckets for f in runs(t, n)[1]]
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for k in b(text):
                counts[k] += 1
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (sum(s) + buckets) / ((s[k] + 1) * (sum(t) + buckets))))
    out = []
    for i, text in docs:
        mine = [gain(k) for k in b(text)]
        h = int(hashlib.sha256(f"{seed}{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(mine) // len(mine) if mine else 0
        out.append([i, len(mine), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, runs(text, n)[0]])
    some = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(some[: len(some) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


TEXTS = ["The quick brown FOX jumps over the lazy dog " * 3, "a b c d e f g h i j k l m n o p q r s t u v", "", None, "été ÉTÉ naïve, 北京 42_x-y\tz\n" * 9, "one two", "w " * 500, "x1 " * 19]


@pytest.mark.parametrize("n,buckets", [(1, 10_000), (3, 50), (2, 100_000)])
def test_against_plain(spark, docs_of, n, buckets):
    texts = [TEXTS[i % len(TEXTS)] if i % 5 else f"word{i} " * (15 + i % 9) for i in range(120)]
    docs = docs_of(texts, weight="q", score=1, features="f", n_words=0)
    target = spark.createDataFrame([(t,) for t in ["The lazy dog sleeps", "42 naïve words", None]], "text string")
    got = sorted((tuple(r) for r in op.resample(docs.repartition(4), target, n=n, buckets=buckets, percent=30).collect()), key=repr)
    assert got == plain(list(enumerate(texts)), ["The lazy dog sleeps", "42 naïve words"], n=n, buckets=buckets, percent=30)


def test_ties_repeats_and_rows_without_id(spark, docs_of):
    texts = ["same words here " * 8] * 30
    ids = [5] * 10 + [None] * 5 + list(range(15))
    got = sorted((tuple(r) for r in op.resample(docs_of(texts, ids), docs_of([])).collect()), key=repr)
    assert got == plain(list(zip(ids, texts)), [])
    everything = op.resample(docs_of(texts, ids), docs_of([]), percent=100)
    assert sorted(r["rank"] for r in everything.collect()) == list(range(1, 31))


def test_empty_tables(spark, docs_of):
    assert op.resample(docs_of([]), docs_of(["a"])).collect() == []
    assert [r["rank"] for r in op.resample(docs_of(["short", None]), docs_of([])).collect()] == [None, None]


def test_very_long_text(spark, docs_of):
    texts = ["lorem ipsum dolor " * 200_000, "lorem " * 30]
    got = sorted((tuple(r) for r in op.resample(docs_of(texts), docs_of(["ipsum"]), percent=50).collect()), key=repr)
    assert got == plain(list(enumerate(texts)), ["ipsum"], percent=50)


def test_ranks_over_many_ranges(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(30).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"), (F.pmod(F.xxhash64("id"), F.lit(40))).alias("score"))
    got = [tuple(r) for r in op.ranked(rows.repartition(5), F.col("n_features") >= 20, 777).filter("rank is not null").orderBy("rank").select("score", "doc_id", "rank").collect()]
    want = sorted(((r["score"], r["doc_id"]) for r in rows.collect()), key=lambda r: (-r[0], r[1]))[:777]
    assert got == [(s, i, k + 1) for k, (s, i) in enumerate(want)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.integers(1, 4))
def test_ring(text, n):
    text = text.encode("utf-8", "ignore").decode()
    assert list(op.ring(op.words_of(text), n)) == [zlib.crc32(f.encode()) for f in runs(text, n)[1]]
