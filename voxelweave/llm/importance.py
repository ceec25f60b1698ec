"""Importance resampling towards a target's distribution of hashed word runs.

A ring of running CRC states reads a text once: it holds the state of each of the last n starts, extends all of them by
a space and the next word, and emits one bucket for each run of 1 to n words that ends there. Bucket counts of all
documents and of all target texts give each bucket's gain; a document's weight is the floored mean of its gains, and
the rows that keep the highest weights plus seeded Gumbel noise are drawn.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded, cut, short_batches, strings, text_of

#: Words as UTF-8: letters and digits of ASCII, and all bytes of other characters.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Words of a text that are held at once.
PIECE = 1 << 20


def words_of(text: str) -> Iterator[bytes]:
    return (m.group() for m in WORD.finditer(text.encode().translate(LOWER)))


def ring(words: Iterator[bytes], n: int) -> Iterator[int]:
    """CRC32 of each run of 1 to n words, joined by one space, in order of its last word, longest run first."""
    if n == 1:
        yield from map(crc32, words)
        return
    states: list[int] = []
    for word in words:
        spaced = b" " + word
        states = [crc32(spaced, s) for s in states[1 - n :]]
        states.append(crc32(word))
        yield from states


def buckets_of(text: str, n: int, buckets: int) -> tuple[int, np.ndarray]:
    """How many words a text has, and the bucket of each of its features; numbers take at most four bytes each."""
    count, parts, held = 0, [], []

    def counted() -> Iterator[bytes]:
        nonlocal count
        for word in words_of(text):
            count += 1
            yield word

    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    for state in ring(counted(), n):
        held.append(state)
        if len(held) == PIECE:
            parts.append((np.array(held, np.uint32) % buckets).astype(kind))
            held.clear()
    parts.append((np.array(held, np.uint32) % buckets).astype(kind))
    return count, np.concatenate(parts)


def emitted(docs: DataFrame, key: str | None, n: int, buckets: int) -> DataFrame:
    """doc_id (where there is a key), n_words and features of each row: one scan of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [buckets_of(t, n, buckets) for t in strings(batch.column(0))]
            columns = [pa.array([c for c, _ in found], pa.int64()), pa.array([b.tobytes() for _, b in found], pa.binary()), *batch.columns[1:]]
            yield pa.RecordBatch.from_arrays(columns, names=["n_words", "features", *(["doc_id"] if key else [])])

    keys = [F.col(key).alias("doc_id")] if key else []
    kind = f", doc_id {docs.schema[key].dataType.simpleString()}" if key else ""
    return docs.select(text_of(docs).alias("text"), *keys).mapInArrow(run, f"n_words long, features binary{kind}")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket; each task sends one row, its counts of all buckets."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                counts += np.bincount(np.frombuffer(data, kind), minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray, buckets: int) -> np.ndarray:
    """floor(1000 * log of the smoothed ratio of the target's share of each bucket to the source's), in doubles."""
    all_s, all_t = float(source.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1) * all_s / ((s + 1) * all_t))) for s, t in zip(map(float, source), map(float, target))], np.int64)


def noise(doc_id: Column, seed: str) -> Column:
    """floor(-1000 * ln(-ln(u))) for u from the first 32 bits of the id's hash: Gumbel noise that every run repeats."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted(rows: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the mean gain of a row's features rounded down."""
    kind = np.uint16 if len(gains) <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(b, kind) for b in batch.column(2).to_pylist()]
            mean = [int(gains[b].sum()) // len(b) if len(b) else 0 for b in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(b) for b in found], pa.int64()), pa.array(mean, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.select("doc_id", "n_words", "features").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, eligible: Column, take: int) -> DataFrame:
    """rows with rank: 1, 2, 3... for the `take` eligible ones of highest score, ties to the smaller doc_id; else null.

    Nothing is sorted in one task. Scores are whole thousandths of logs of bounded ratios and noise, so there are some
    ten thousand of them, and their counts tell the lowest score that can be drawn. Only rows from it on are sorted, in
    ranges; one number for each range, how many rows lie before it, goes into the ranks.
    """
    spark = rows.sparkSession
    left, lowest = take, None
    for r in sorted(rows.filter(eligible).groupBy("score").count().collect(), key=lambda r: -r["score"]):
        if left <= 0:
            break
        lowest, left = r["score"], left - r["count"]
    none = F.lit(None).cast("long")
    if lowest is None:
        return rows.withColumn("rank", none)
    near = F.coalesce(eligible & (F.col("score") >= lowest), F.lit(False))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = rows.filter(near).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.withColumns({"range": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before, at = [], 0
    for part, count in sorted((r["range"], r["count"]) for r in placed.groupBy("range").count().collect()):  # one for each task
        before.append((part, at))
        at += count
    starts = spark.createDataFrame(before, "range int, start long")
    place = F.col("start") + F.col("place") + 1
    sorted_rows = placed.join(bounded(starts, len(before)), "range").select(*rows.columns, F.when(place <= take, place).alias("rank"))
    return sorted_rows.unionByName(rows.filter(~near).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: str = "2024:") -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of each row of docs.

    Features are all runs of 1 to n consecutive words of the lower-cased text (A-Z only), repeats counted. Of the rows
    with at least `min_words` words, floor(percent of them) with the highest scores are drawn; of equal scores the
    smaller doc_id goes first, a null one last.

    A null or empty text has no features and weight 0. A row without a doc_id takes the noise of an empty id. Rows with
    equal doc_ids are each weighed and ranked. Without target texts all gains come from smoothing alone. No rows give
    no rows. Other columns aren't looked at.
    """
    if n < 1 or buckets < 1:
        raise ValueError("n and buckets must be positive")
    short_batches(docs.sparkSession)
    rows = cut(emitted(docs, "doc_id", n, buckets))
    gains = gains_of(bucket_counts(rows, buckets), bucket_counts(emitted(target, None, n, buckets), buckets), buckets)
    scored = cut(weighted(rows, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    eligible = F.col("n_words") >= min_words
    take = scored.filter(eligible).count() * percent // 100
    return ranked(scored, eligible, take).select("doc_id", "n_features", "weight", "score", "rank")
