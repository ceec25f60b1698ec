"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from voxelweave.llm import components, ngram_join, shingles


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return sorted((str(d), len(s), str(min(ids[find(i)]) if d is not None else None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def mutated(r, words, rate):
    return " ".join(f"w{r.randint(0, 999)}" if r.random() < rate else w for w in words)


def corpus(seed):
    r = random.Random(seed)
    common = [f"c{k}" for k in range(50)]
    rows = []
    for _ in range(12):  # groups of near copies of all sizes, some around the threshold
        base = [f"w{r.randint(0, 999)}" for _ in range(r.choice([2, 3, 5, 9, 30, 80, 300]))]
        rows += [mutated(r, base, r.choice([0, 0.002, 0.01, 0.02, 0.04])) for _ in range(r.randint(1, 9))]
    rows += [" ".join([*common, *(f"w{r.randint(0, 999)}" for _ in range(r.randint(0, 40)))]) for _ in range(25)]
    rows += [" ".join(["same"] * r.randint(1, 30)) for _ in range(6)] + ["", " \n ", None, "ONE two THREE", "one TWO three"]
    r.shuffle(rows)
    return [*enumerate(rows), (3, rows[3]), (5, "another text with an id that is taken already here"), (None, rows[4])]


@pytest.mark.parametrize(("seed", "width", "percent", "limit"), [(1, 4, 85, 10_000), (2, 5, 80, 0), (3, 1, 85, 10_000)])
def test_against_all_pairs(spark, seed, width, percent, limit, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "LARGE", 2)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, node int").repartition(3)
    got = ngram_join.jaccard_groups(df, width, percent, limit).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, width, percent)


def test_empty(spark):
    assert ngram_join.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_sets_share_their_bound():
    schemes, rng, seen = shingles.Schemes(85), np.random.default_rng(0), 0
    for trial in range(1500):
        s = int(rng.integers(1, 120)) if trial % 4 else int(rng.integers(100, 800))
        a = np.unique(shingles.mix(rng.integers(0, 2**63, s).astype(np.uint64)))
        kept = a[rng.permutation(len(a))[int(rng.integers(0, len(a) // 6 + 2)) :]]
        b = np.unique(np.concatenate([kept, shingles.mix(rng.integers(0, 2**63, int(rng.integers(0, len(a) // 6 + 2))).astype(np.uint64))]))
        if shingles.similar(a, b, 85):
            seen += 1
            (ka, la), (kb, lb) = shingles.signatures(a, schemes), shingles.signatures(b, schemes)
            both, la, lb = np.intersect1d(ka, kb), dict(la), dict(lb)
            assert any(((both & np.uint64(255)) == k).sum() >= max(la[k], lb[k]) for k in set(la) & set(lb))
    assert seen > 300


def test_pairs_by_matrix(monkeypatch):
    monkeypatch.setattr(ngram_join, "CELLS", 500)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    make = lambda: np.unique(np.concatenate([base[rng.permutation(100)[: int(rng.integers(80, 100))]], rng.integers(0, 2**63, 5).astype(np.uint64)]))
    a, b = [make() for _ in range(20)], [make() for _ in range(15)]
    want = {(i, j) for i in range(20) for j in range(15) if shingles.similar(a[i], b[j], 80)}
    assert {tuple(x) for x in ngram_join.similar_pairs(a, b, 80).tolist()} == want and want


def test_chunks_keep_what_is_shared():
    """What parts find from the chunks of several tasks, against counting all."""
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64) & np.uint64(0xFFFFFFFFFFFFFF00) | rng.integers(0, 5, 400).astype(np.uint64)
    for bits in (0, 1, 4, 11):
        want, rows = {}, []
        for chunk in range(5):
            nodes = [int(x) for x in rng.integers(-(2**62), 2**62, 30)] + [77]  # 77: an exact copy in every chunk
            found = [np.unique(rng.choice(pool[: 300 if n != 77 else 400], 20)) if n != 77 else pool[300:320] for n in nodes]
            for n, f in zip(nodes, found, strict=True):
                for s in f.tolist():
                    want.setdefault(s, set()).add(n)
            rows += ngram_join.packed(nodes, found, bits)
        code = lambda s: ((s >> (64 - bits)) << 40 | (s & 255) << 32 | ((s << bits) & (2**64 - 1)) >> 32) if bits else (s & 255) << 32 | s >> 32
        got, parts = set(), {}
        for r in rows:
            parts.setdefault(r[0], []).append(r)
        for part in parts.values():
            out = ngram_join.meet(part)
            got |= set(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
        assert got == {(np.uint64(code(s)).astype(np.int64).item(), n) for s, x in want.items() if len(x) > 1 for n in x}
        assert all(len(r[4]) == (8 if r[1] else 5) * len(r[3]) // 2 for r in rows)


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, few):
    r = random.Random(0)
    edges = [(k, k + 1) for k in range(60)] + [(100 + r.randint(0, 40), 100 + r.randint(0, 40)) for _ in range(30)]
    found = components.components(spark.createDataFrame(edges, "a long, b long"), task_links=few)
    got = {x.node: x.comp for x in found.collect()}
    top = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    parts = lambda labels: {frozenset(n for n in labels if labels[n] == c) for c in labels.values()}
    assert parts(got) == parts(top) and all(got[c] == c for c in got.values())
    more = components.components(spark.createDataFrame([(60, edges[60][0])], "a long, b long"), found, few)
    joined = {x.node: x.comp for x in more.collect()}
    assert joined[0] == joined[edges[60][0]] and len(set(joined.values())) == len(set(got.values())) - 1
