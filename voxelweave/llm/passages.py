"""Quality by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage is described by numbers (kinds of
characters and words, repetition, hashed pairs of bytes) and encoded by one tanh layer; gated attention weighs the
encoded passages, and a logistic unit scores their weighted sum. All parameters are learned together from the labels of
documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded, groups_of_texts, short_batches, strings, text_of

WORDS = 48  #: Words of a passage; the last one of a text has what is left.
PAIRS = 64  #: Buckets of hashed pairs of neighbouring bytes.
BLOCK = 1 << 20  #: Bytes that are described at once, one longer passage excepted.
#: Kinds of bytes: white space, upper, lower, digit, stops, quotes and brackets, other ASCII, beyond ASCII.
KINDS = 8
_KIND = np.full(256, 6, np.uint8)
_KIND[[32, *range(9, 14)]] = 0
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[[ord(c) for c in ".,;:?!"]], _KIND[[ord(c) for c in "'\"()[]{}-"]] = 4, 5
_KIND[128:] = 7
WORD_MARKS = 8
SIZE = KINDS + 3 + WORD_MARKS + 2 + PAIRS
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each word: a polynomial of its bytes modulo 2^64, from prefix sums."""
    inverse = pow(int(_BASE), -1, 1 << 64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(int(_BASE), len(data)), out=sums[1:])
    return (sums[end] - sums[begin]) * _powers(inverse, len(data) + 1)[begin]


def _again(keys: np.ndarray) -> np.ndarray:
    """Which keys came before."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    ranked = keys[order]
    out[order[1:]] = ranked[1:] == ranked[:-1]
    return out


def describe(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of SIZE numbers for each passage, and how many passages each text has (at least one, of zeros)."""
    encoded = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    borders = np.cumsum([len(b) + 1 for b in encoded])
    inner = np.concatenate([[False], _KIND[data] != 0])
    flips = np.flatnonzero(inner[1:] != inner[:-1])
    begin, end = flips[::2], flips[1::2]
    doc = np.searchsorted(borders, begin, side="right")
    n_words = np.bincount(doc, minlength=len(texts))
    n_passages = np.maximum(1, -(-n_words // WORDS))
    first_word, first_passage = np.cumsum(n_words) - n_words, np.cumsum(n_passages) - n_passages
    at = first_passage[doc] + (np.arange(len(begin)) - first_word[doc]) // WORDS  # the passage of each word
    total = int(n_passages.sum())
    out = np.zeros((total, SIZE), np.float32)
    if not len(begin):
        return out, n_passages
    per = np.bincount(at, minlength=total)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))  # the first word of each passage with words
    full = at[starts]
    from_byte, to_byte = begin[starts], end[np.append(starts[1:], len(begin)) - 1]
    hashes = np.empty(len(begin), np.uint64)
    marks = np.zeros((len(begin), WORD_MARKS), np.float32)
    k = 0
    while k < len(full):
        stop = max(k + 1, int(np.searchsorted(to_byte, from_byte[k] + BLOCK)))
        lo, hi, w = int(from_byte[k]), int(to_byte[stop - 1]), slice(starts[k], starts[stop] if stop < len(starts) else len(begin))
        piece = data[lo:hi]
        b, e = begin[w] - lo, end[w] - lo
        hashes[w] = _word_hashes(piece, b, e)
        kinds = _KIND[piece]
        count = np.zeros((len(b), KINDS), np.int64)
        for j in range(1, KINDS):
            sums = np.concatenate([[0], np.cumsum(kinds == j)])
            count[:, j] = sums[e] - sums[b]
        letters, length = count[:, 1] + count[:, 2] + count[:, 7], e - b
        last = kinds[e - 1]
        marks[w] = np.stack([letters + count[:, 3] == 0, (count[:, 1] == letters) & (letters > 1), count[:, 1] > 0, last == 4, last == 6, count[:, 6] > 0, count[:, 3] > 0, length > 15], axis=1)
        rows = stop - k  # bytes between two passages belong to none, numbered `rows`
        ends = np.stack([from_byte[k:stop] - lo, to_byte[k:stop] - lo], axis=1).ravel()
        number = np.repeat(np.stack([np.arange(rows), np.full(rows, rows)], axis=1).ravel()[:-1], np.diff(ends))
        by_kind = np.bincount(number * KINDS + kinds, minlength=(rows + 1) * KINDS).reshape(-1, KINDS)[:rows]
        out[full[k:stop], :KINDS] = by_kind / by_kind.sum(1, keepdims=True)
        pair = (piece[:-1].astype(np.int64) * 37 + piece[1:] * 11) % PAIRS
        within = np.where(number[:-1] == number[1:], number[:-1], rows)
        by_pair = np.bincount(within * PAIRS + pair, minlength=(rows + 1) * PAIRS).reshape(-1, PAIRS)[:rows]
        out[full[k:stop], -PAIRS:] = np.sqrt(by_pair / np.maximum(by_pair.sum(1, keepdims=True), 1))
        k = stop

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(at, weights=x, minlength=total) / np.maximum(per, 1)

    length = (end - begin).astype(float)
    out[:, KINDS] = per / WORDS
    out[:, KINDS + 1] = np.log1p(mean(length))
    out[:, KINDS + 2] = np.log1p(np.sqrt(np.maximum(mean(length**2) - mean(length) ** 2, 0)))
    for j in range(WORD_MARKS):
        out[:, KINDS + 3 + j] = mean(marks[:, j])
    five = sum((hashes[j : len(hashes) - 4 + j] * _STEP ** np.uint64(j + 1) for j in range(5)), np.uint64(0)) if len(hashes) > 4 else np.zeros(0, np.uint64)
    one_text = doc[4:] == doc[:-4]
    repeated = np.zeros(len(begin))
    repeated[: len(five)][one_text] = _again(five[one_text] ^ (doc[:-4][one_text].astype(np.uint64) * _BASE))
    out[:, -PAIRS - 2] = mean(repeated)
    out[:, -PAIRS - 1] = mean(_again(hashes ^ (at.astype(np.uint64) * _STEP)))
    return out, n_passages


class Attention:
    """Encoder, gated attention and score; `parameters` are learned together."""

    HIDDEN, GATE = 32, 16

    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        shape = {"W": (SIZE, self.HIDDEN), "b": (self.HIDDEN,), "V": (self.HIDDEN, self.GATE), "U": (self.HIDDEN, self.GATE), "w": (self.GATE,), "u": (self.HIDDEN,), "c": (1,)}
        self.parameters = {k: rng.normal(0, s[0] ** -0.5, s) if k not in "bc" else np.zeros(s) for k, s in shape.items()}
        self.middle, self.spread = np.zeros(SIZE), np.ones(SIZE)

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        """Everything from passages x, of which text i has sizes[i] neighbouring ones, to the scores of texts."""
        p, first = self.parameters, np.cumsum(sizes) - sizes
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = (t * g) @ p["w"]
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
        a /= np.repeat(np.add.reduceat(a, first), sizes)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ p["u"] + p["c"], -30, 30)))
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "score": score}

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, ridge: float) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of texts with labels y, plus the ridge."""
        p, f, first = self.parameters, self.forward(x, sizes), np.cumsum(sizes) - sizes
        d = (f["score"] - y) / len(y)
        out = {"u": f["z"].T @ d, "c": np.array([d.sum()])}
        dz = np.repeat(d[:, None] * p["u"], sizes, axis=0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), sizes))
        out["w"] = (f["t"] * f["g"]).T @ de
        dt, dg = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        out["V"], out["U"] = f["h"].T @ dt, f["h"].T @ dg
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        out["W"], out["b"] = x.T @ dh, dh.sum(0)
        return {k: out[k] + ridge * p[k] for k in p}

    def fit(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.004, ridge: float = 1e-4, seed: int = 0) -> "Attention":
        """Adam over shuffled batches of texts; the rate falls to a twentieth."""
        self.middle, self.spread = x.mean(0, dtype=float), np.maximum(x.std(0, dtype=float), 1e-3)
        x = np.clip((x - self.middle) / self.spread, -8, 8)
        first, rng = np.cumsum(sizes) - sizes, np.random.default_rng(seed)
        mean, square, step = {k: np.zeros_like(v) for k, v in self.parameters.items()}, {k: np.zeros_like(v) for k, v in self.parameters.items()}, 0
        steps = epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(y), batch):
                mine = order[k : k + batch]
                rows = np.concatenate([np.arange(first[i], first[i] + sizes[i]) for i in mine])
                step += 1
                for name, g in self.gradients(x[rows], sizes[mine], y[mine], ridge).items():
                    mean[name] = 0.9 * mean[name] + 0.1 * g
                    square[name] = 0.99 * square[name] + 0.01 * g**2
                    now = rate * (0.05 + 0.95 * (1 - step / steps))
                    self.parameters[name] -= now * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's score, and the number of the passage that weighs most in it."""
        f = self.forward(np.clip((x - self.middle) / self.spread, -8, 8), sizes)
        first = np.cumsum(sizes) - sizes
        return f["score"].round(9), np.array([f["a"][s : s + n].argmax() for s, n in zip(first, sizes)], np.int32)


def is_training(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) != 0


def _described(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Groups of rows with their passages; a group holds a bounded number of characters, one longer text excepted."""
    for batch in batches:
        texts = strings(batch.column(column))
        for a, b in groups_of_texts(texts, BLOCK):
            yield batch.slice(a, b - a), *describe(texts[a:b])


def training_rows(texts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages, their numbers for each text, and labels of (text, quality); of a text with more than `most` passages, evenly spaced ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, sizes in _described(batches, 0):
            cells = []
            for s, n in zip(np.cumsum(sizes) - sizes, sizes):
                cells.append(x[s + np.unique(np.linspace(0, n - 1, min(n, most)).round().astype(int))].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary()), batch.column(1), batch.column(2)], names=["cells", "quality", "doc_id"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = sorted(texts.select("text", "quality", "doc_id").mapInArrow(run, f"cells binary, quality int, doc_id {kind}").toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["cells"]))  # bounded by label_rows
    cells = [np.frombuffer(r["cells"], np.float32).reshape(-1, SIZE) for r in rows]
    return np.concatenate([np.zeros((0, SIZE), np.float32), *cells]), np.array([len(c) for c in cells], int), np.array([r["quality"] for r in rows], float)


def quality_scores(docs: DataFrame, labels: DataFrame, label_rows: int = 8000, passages: int = 32, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1, the chance of quality), predicted (1 from the threshold on), n_passages and top_passage.

    The model is fitted on about `label_rows` labelled training rows, drawn by a hash of doc_id, and in these on at most
    `passages` evenly spaced passages of a text. Labels of held-out rows are never read into anything, and a score looks
    at nothing but the text, all of it. top_passage is the passage (from 0) that the attention weighs most.

    A null text counts as empty: one passage of zeros. Rows with a null label or doc_id teach nothing; of several labels
    of one doc_id the lowest counts. Rows with one doc_id each have their own score; equal texts have equal scores.
    Where the training labels are all alike, every score is that label, and 0.5 where there are none. No rows give no
    rows. Other columns aren't looked at.
    """
    short_batches(docs.sparkSession)
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & is_training(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    sizes = {r[0]: r[1] for r in usable.groupBy("quality").count().collect()}
    count = sum(sizes.values())
    slim = docs.select("doc_id", text_of(docs).alias("text"))
    held_out = ~is_training(F.coalesce(F.col("doc_id"), F.lit(0)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    model = None
    if len(sizes) > 1:
        share = min(1.0, label_rows / count)
        drawn = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
        known = slim.join(bounded(drawn, min(count, 2 * label_rows)), "doc_id").dropDuplicates(["doc_id", "text"])
        x, n, y = training_rows(known, passages)
        if len(set(y)) > 1:
            model = Attention().fit(x, n, y)
    constant = float(next(iter(sizes))) if len(sizes) == 1 else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, n in _described(batches, 1):
            score, top = model.score(x, n) if model else (np.full(len(n), constant), np.zeros(len(n), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(top, pa.int32())], names=["doc_id", "score", "n_passages", "top_passage"])

    out = slim.mapInArrow(run, f"doc_id {kind}, score double, n_passages long, top_passage int")
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages", "top_passage")
