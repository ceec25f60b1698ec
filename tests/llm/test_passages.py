"""Operator 13: passages by hand, gradients by differences, planted bags, held-out labels."""

import zlib

import duckdb
import numpy as np
import pytest

from voxelweave.llm import passages as op

FIXTURE = "/root/testdata/sf0.01"


def test_passages_cover_whole_texts():
    texts = ["", None or "", "one", "w " * 48, "w " * 49, " \t\n ", "a" * 3000, "word " * 10_000]
    x, n = op.describe(texts)
    assert n.tolist() == [1, 1, 1, 1, 2, 1, 1, 209] and len(x) == n.sum() and np.isfinite(x).all()
    assert not x[0].any() and not x[6 - 1 + 1].any()  # empty and white texts


def test_a_passage_by_hand():
    x, _ = op.describe(["Ab cd! CD 12 ##"])
    kinds = x[0, : op.KINDS]  # white 4, upper 3, lower 3, digits 2, stops 1, others 2 of 15
    assert np.allclose(kinds * 15, [4, 3, 3, 2, 1, 0, 2, 0])
    marks = x[0, op.KINDS + 3 : op.KINDS + 3 + op.WORD_MARKS] * 5
    assert np.allclose(marks, [1, 1, 2, 1, 1, 1, 1, 0])
    assert np.isclose(x[0, op.KINDS], 5 / op.WORDS)


def test_repetition_is_of_one_text():
    text = "p q r s t u v"
    x, _ = op.describe([text, text])
    assert not x[:, -op.PAIRS - 2].any()
    x, _ = op.describe([f"{text} {text}"])
    assert np.isclose(x[0, -op.PAIRS - 2] * 14, 3) and np.isclose(x[0, -op.PAIRS - 1] * 14, 7)


def test_groups_do_not_change_passages(monkeypatch):
    texts = ["Some words | and ### marks\n" * k for k in (1, 3, 40, 200)]
    whole, sizes = op.describe(texts)
    monkeypatch.setattr(op, "BLOCK", 500)
    small, again = op.describe(texts)
    alone = np.concatenate([op.describe([t])[0] for t in texts])
    assert np.array_equal(sizes, again) and np.allclose(whole, small) and np.allclose(whole, alone)


def test_gradients():
    rng = np.random.default_rng(0)
    m, sizes, y = op.Attention(1), np.array([3, 1, 4]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(size=(8, op.SIZE))

    def loss():
        s = m.forward(x, sizes)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean() + 0.5e-2 * sum((v**2).sum() for v in m.parameters.values())

    got = m.gradients(x, sizes, y, 1e-2)
    for name, v in m.parameters.items():
        for at in [tuple(rng.integers(0, s) for s in v.shape) for _ in range(4)]:
            old, h = v[at], 1e-5
            v[at] = old + h
            up = loss()
            v[at] = old - h
            down = loss()
            v[at] = old
            assert np.isclose(got[name][at], (up - down) / (2 * h), atol=1e-6), (name, at)


def test_attention_finds_the_passage_that_decides():
    rng = np.random.default_rng(5)
    sizes = rng.integers(2, 9, 400)
    x, y, where = [], [], []
    for n in sizes:
        bag, label = rng.normal(size=(n, op.SIZE)), rng.integers(0, 2)
        k = rng.integers(0, n)
        if not label:
            bag[k, :3] += 6
        x.append(bag), y.append(label), where.append(k)
    x, y = np.concatenate(x), np.array(y, float)
    score, top = op.Attention().fit(x, sizes, y, epochs=30).score(x, sizes)
    bad = y == 0
    assert ((score >= 0.5) == (y == 1)).mean() > 0.97 and (top[bad] == np.array(where)[bad]).mean() > 0.9


def test_held_out_labels(spark):
    read = lambda t: spark.read.parquet(f"{FIXTURE}/{t}.parquet")
    rows = op.quality_scores(read("documents"), read("labels")).collect()
    labels = dict(duckdb.sql(f"select doc_id, quality from '{FIXTURE}/labels.parquet'").fetchall())
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p for p, q in held if q) >= 0.97 * sum(q for _, q in held)
    assert sum(1 - p for p, q in held if not q) >= 0.7 * sum(1 - q for _, q in held)


def test_held_out_labels_teach_nothing(spark, docs_of):
    texts = [("clean words stand here " if i % 3 else "### $$$ | %%% ") * (3 + i % 7) + f"w{i}" for i in range(120)]
    labels = [(i, int(i % 3 > 0)) for i in range(120)]
    other = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    made = [op.quality_scores(docs_of(texts, lang_score="x", score="y", quality=7), spark.createDataFrame(v, "doc_id long, quality int")).orderBy("doc_id").collect() for v in (labels, other)]
    assert made[0] == made[1]
    assert all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in made[0])


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0), ([(None, 1), (1, None)], 0.5)])
def test_labels_alike_or_none(spark, docs_of, labels, score):
    rows = op.quality_scores(docs_of(["a", None, "b " * 99]), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert [r["score"] for r in rows] == [score] * 3 and {r["predicted"] for r in rows} == {int(score >= 0.3)}


def test_repeats_nulls_long_and_empty(spark, docs_of):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    texts = ["good clean words " * 9 if i % 2 else "| ### | " * 9 for i in range(60)] + ["", None, "same", "same", "long text of words " * 300_000]
    rows = op.quality_scores(docs_of(texts, [*range(60), None, 60, 61, 61, 62]), labels).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(rows) == 65 and by[None][0]["score"] == by[60][0]["score"] and by[61][0] == by[61][1]
    assert by[62][0]["n_passages"] == 25_000
    assert op.quality_scores(docs_of([]), labels).collect() == []
