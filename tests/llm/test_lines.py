"""Line dedup against a plain count."""

import random
from collections import defaultdict

import pytest

from voxelweave.llm import line_dedup

WS = " \t\n\x0b\x0c\r"


def brute(rows, min_chars, min_docs):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WS))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                held[key(line)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or key(x) not in gone or gone[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def cases():
    r = random.Random(5)
    lines = [f"{'Ab é'[k % 4]}line {k} " + "x" * (k % 5) for k in range(14)] + ["", "  ", "\tABline 4 ", "abLINE 4"]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(1, 9)))) for i in range(40)]
    return rows + [(40, None), (41, ""), (None, rows[0][1]), (0, rows[1][1]), (3, rows[3][1]), (3, rows[3][1])]


@pytest.mark.parametrize("limit", [10_000, 0])
def test_against_brute_force(spark, limit):
    rows = cases()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_dropped string")
    got = line_dedup.line_dedup(df, 6, 5, limit).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, 6, 5)))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.line_dedup(df).count() == 0


def test_long_text(spark):
    text = "\n".join(f"line number {k} of a very long text, which is its own" for k in range(20_000))
    df = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(df).collect()}
    assert got == {0: 20_000, 1: 20_000, 2: 20_000, 3: 20_000, 4: 20_000, 5: 0}
