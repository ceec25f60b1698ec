"""Toxicity by weak supervision.

Entries of a lexicon (beginnings of words that toxic training documents use far more often) and patterns over them
vote on every document. A generative label model takes accuracies and correlations of the voters from their second
moments over all documents: voters that depend on the label alone have a covariance matrix of rank one off its
diagonal, and pairs that depart from it are correlated and share one vote. Its posteriors train a linear classifier,
which scores every text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded, cut, short_batches, strings, text_hash, text_of

SHORTEST, LONGEST = 4, 8  #: Characters of an entry; whole words of two or three are entries too, with a space at the end.
WORD = re.compile(r"[^\W\d_]+")
#: Look-alikes of letters inside words.
LOOKS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
MASKED = re.compile(r"[^\W_]*[0134579@$][^\W_]*(?:[@$][^\W_]*)*")
SPELLED = re.compile(r"\b(?:[^\W\d_][ .\-_*]){3,}[^\W\d_]\b")
PATTERNS = ["no entry", "two hits", "four hits", "two entries", "one word in 200", "one word in 50", "masked", "spelled"]


def is_training(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1


def beginnings(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return {w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)} | {f"{w} " for w in words if 1 < len(w) < SHORTEST}


def count_beginnings(texts: DataFrame, known: set[str] | None) -> DataFrame:
    """word, n: in how many of the texts a word begins so, for all beginnings or the known ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in strings(batch.column(0)):
                found = beginnings(text)
                counts.update(found if known is None else found & known)
            if len(counts) > 300_000:  # hand on what there is, to bound memory
                yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def choose_entries(rows: list[tuple[str, int, int]], toxic: int, clean: int, entries: int) -> list[str]:
    """Of beginnings with their counts in toxic and clean documents, those that tell most by a likelihood ratio.

    A beginning that starts with a chosen one, or the other way round, says the same and is left out.
    """
    def gain(a: int, b: int) -> float:
        total, n = toxic + clean, a + b
        cells = ((a, n * toxic / total), (b, n * clean / total), (toxic - a, (total - n) * toxic / total), (clean - b, (total - n) * clean / total))
        return sum(2 * x * math.log(x / e) for x, e in cells if x > 0 and e > 0)

    good = [(gain(a, b), len(w), w) for w, a, b in rows if (a + 0.5) / (toxic + 1) > 4 * (b + 0.5) / (clean + 1)]
    chosen: list[str] = []
    for g, _, w in sorted(good, key=lambda x: (-x[0], x[1], x[2])):
        if g < 15 or len(chosen) == entries:
            break
        if not any(w.startswith(c) or c.startswith(w) for c in chosen):
            chosen.append(w)
    return sorted(chosen)


class Voters:
    """Votes (0 or 1) of each entry and pattern on a text, and two densities."""

    def __init__(self, lexicon: list[str]) -> None:
        self.lexicon = lexicon
        self.short: dict[str, list[int]] = {}
        for k, w in enumerate(lexicon):
            self.short.setdefault(w.rstrip(" ")[:SHORTEST], []).append(k)  # a word of three can't begin like one of four
        self.size = len(lexicon) + len(PATTERNS)

    def hits(self, words: list[str]) -> list[int]:
        short, lexicon = self.short, self.lexicon
        return [k for w in words if w[:SHORTEST] in short for k in short[w[:SHORTEST]] if f"{w} ".startswith(lexicon[k])]

    def __call__(self, text: str) -> tuple[list[int], list[float]]:
        low = text.lower()
        words = WORD.findall(low)
        found = self.hits(words)
        masked = self.hits([x for w in MASKED.findall(low) if (x := w.translate(LOOKS)).isalpha()]) if any(c in low for c in "0134579@$") else []
        spelled = self.hits([re.sub(r"[^\w]|_", "", w) for w in SPELLED.findall(low)])
        distinct, share = set(found) | set(masked) | set(spelled), len(found) / max(len(words), 1)
        votes = [0] * self.size
        for k in distinct:
            votes[k] = 1
        votes[len(self.lexicon) :] = map(int, (not distinct, len(found) >= 2, len(found) >= 4, len(distinct) >= 2, share >= 0.005, share >= 0.02, bool(masked), bool(spelled)))
        return votes, [math.log1p(len(found)), min(share, 0.1) * 20]


def label_model(n: int, sums: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(vote | toxic), P(vote | clean) and which pairs are correlated, from counts of joint votes over n documents.

    sums[i, j] counts the documents on which both i and j vote. With a share of toxic documents, an independent pair
    has covariance d_i d_j; d is fitted to the pairs that aren't taken as correlated, twice over.
    """
    mean = np.diag(sums) / max(n, 1)
    cov = sums / max(n, 1) - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    use = ~np.eye(len(mean), dtype=bool)
    d = spread * 0.1
    linked = np.zeros_like(use)
    for _ in range(3):
        for _ in range(60):
            d = 0.5 * d + 0.5 * (use * cov) @ d / np.maximum((use * (d**2)[None, :]).sum(1), 1e-12)
        rest = np.abs(cov - np.outer(d, d)) / np.outer(spread, spread)
        linked = (rest > np.maximum(0.25, 4 / math.sqrt(max(n, 1)))) & ~np.eye(len(mean), dtype=bool)
        use = ~np.eye(len(mean), dtype=bool) & ~linked
    if d[: len(d) - len(PATTERNS)].sum() < 0:
        d = -d
    toxic = np.clip(mean + d * math.sqrt((1 - share) / share), 1e-3, 1 - 1e-3)
    clean = np.clip(mean - d * math.sqrt(share / (1 - share)), 1e-4, 1 - 1e-3)
    return toxic, clean, linked


def posteriors(votes: np.ndarray, share: float, toxic: np.ndarray, clean: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """P(toxic | votes); voters that are correlated and vote together share their weight."""
    weight = 1 / (1 + (votes @ linked))
    said = votes * weight
    odds = math.log(share / (1 - share)) + said @ np.log(toxic / clean)
    silent = np.log((1 - toxic) / (1 - clean)) / (1 + linked.sum(1))
    return 1 / (1 + np.exp(-np.clip(odds + (1 - votes) @ silent, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a linear classifier for soft labels, the constant last, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, label_rows: int = 40_000, entries: int = 128, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from the threshold on) and text_hash of each row of docs.

    All labelled training rows give the lexicon and the share of toxic documents; the classifier is fitted on at most
    about `label_rows` of them, drawn by a hash of doc_id. Labels of held-out rows are never read into anything. The
    label model's moments cover all documents. A null text counts as empty and is scored as one; without labelled
    toxic rows every score is 0. Rows with a null label or doc_id teach nothing; rows with equal doc_ids each get
    their own score. Other columns aren't looked at; no rows give no rows.
    """
    spark = docs.sparkSession
    short_batches(spark)
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & is_training(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = cut(usable)
    sizes = {r[0]: r[1] for r in usable.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    part = min(1.0, label_rows / max(toxic + clean, 1))
    drawn = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20))  # bounded by label_rows
    slim = docs.select("doc_id", text_of(docs).alias("text"), text_hash(docs).alias("text_hash"))
    of = lambda value: slim.join(bounded(usable.filter(F.col("toxic") == value).select("doc_id"), sizes[value]), "doc_id")
    lexicon: list[str] = []
    if toxic and clean:
        least = max(3, math.ceil(toxic / 200))  # so that there are few beginnings, whatever the number of documents
        counted = dict(count_beginnings(of(1), None).filter(F.col("n") >= least).toLocalIterator())
        other = dict(count_beginnings(of(0), set(counted)).toLocalIterator())
        lexicon = choose_entries([(w, n, other.get(w, 0)) for w, n in counted.items()], toxic, clean, entries)
    held_out = ~is_training(F.coalesce("doc_id", F.lit(0)))
    if not lexicon:
        return docs.select("doc_id", held_out.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), text_hash(docs).alias("text_hash"))
    size = len(lexicon) + len(PATTERNS)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(lexicon)
        for batch in batches:
            found = [voters(text) for text in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bytes(v) for v, _ in found], pa.binary()), pa.array([x for _, x in found], pa.list_(pa.float64())), batch.column(2)], names=["doc_id", "votes", "extra", "text_hash"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    voted = cut(slim.mapInArrow(vote, f"doc_id {id_type}, votes binary, extra array<double>, text_hash long"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((size, size), np.int64), 0
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, size).astype(np.float32)
            total += (v.T @ v).astype(np.int64)
            rows += len(v)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int64()), pa.array(np.append(j, -1), pa.int64()), pa.array(np.append(total[i, j], rows), pa.int64())], names=["i", "j", "n"])

    sums, n = np.zeros((size, size)), 0
    for i, j, k in voted.select("votes").mapInArrow(moments, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # size ** 2 + 1 rows
        if i < 0:
            n = k
        else:
            sums[i, j] = k
    share = toxic / (toxic + clean)
    model = label_model(n, sums, share)
    rows = voted.join(F.broadcast(drawn.select("doc_id").distinct()), "doc_id").select("votes", "extra").toArrow()  # bounded by label_rows
    x = np.frombuffer(b"".join(rows.column(0).to_pylist()), np.uint8).reshape(-1, size).astype(float)
    extra = np.array(rows.column(1).to_pylist(), float).reshape(-1, 2)
    w = logistic(np.hstack([x, extra]), posteriors(x, share, *model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, size)
            z = np.hstack([v, np.array(batch.column(2).to_pylist(), float).reshape(-1, 2), np.ones((len(v), 1))]) @ w
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64()), batch.column(3)], names=["doc_id", "score", "text_hash"])

    scored = voted.mapInArrow(score, f"doc_id {id_type}, score double, text_hash long")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_hash")
