"""Sum-of-squares packing of tokenised documents into sequences.

Pieces are dealt by a hash of their key into groups of bounded size, so no source or group of copies can fill one
task. Each group is packed on its own: a piece goes where the sum over residual gaps of the squared number of open
sequences becomes smallest. Then the open sequences of many groups are emptied and their pieces packed once more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import byte_alphabet
from .common import cut, groups_of_texts, short_batches, strings, text_of


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, in the order given, and the final fill of each sequence.

    N[g] open sequences have gap g. Moving one from gap g to g - s changes the sum of squares by
    2 (N[g - s] - N[g]) + 2, a perfect fit by 1 - 2 N[g], a new sequence by 2 N[capacity - s] + 1.
    Ties go to the smallest gap.
    """
    counts = np.zeros(capacity + 1, np.int64)
    open_ = [[] for _ in range(capacity + 1)]
    where, offset, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for k, s in enumerate(sizes.tolist()):
        best, gap = (2 * counts[capacity - s] + 1 if s < capacity else 0), capacity
        if s < capacity:
            gain = counts[s:capacity] - counts[: capacity - s]
            gain[0] = counts[s]
            here = counts[s:capacity] > 0
            change = np.where(here, 2 - 2 * gain, 1 << 60)
            if here[0]:
                change[0] = 1 - 2 * counts[s]
            at = int(change.argmin())
            if change[at] <= best:
                gap = at + s
        if gap == capacity:
            b = len(fill)
            fill.append(0)
        else:
            b = open_[gap].pop()
            counts[gap] -= 1
        where[k], offset[k] = b, fill[b]
        fill[b] += s
        if rest := gap - s:
            counts[rest] += 1
            open_[rest].append(b)
    return where, offset, np.array(fill, np.int64)


_coders: dict[int, tuple] = {}


def coder(spec: str):
    """ids(text) of a byte-level BPE vocabulary by a compiled library, special tokens' strings as their ids."""
    if (key := hash(spec)) not in _coders:
        import json
        import re

        import tiktoken

        from .bpe import PATTERN

        spec_ = json.loads(spec)
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec_["model"]["vocab"].items()}
        specials = {x["content"]: x["id"] for x in spec_["added_tokens"]}
        plain = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        split = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None

        def ids(text: str) -> list[int]:
            if not specials or not any(x in text for x in specials):
                return plain.encode_ordinary(text)
            out = []
            for k, part in enumerate(split.split(text)):
                out += [specials[part]] if k % 2 else plain.encode_ordinary(part)
            return out

        _coders.clear()
        _coders[key] = (ids,)
    return _coders[key][0]


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: all are full but the first one."""
    first = n if n <= capacity else (n - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each row's text; no tokens are kept."""
    spark = docs.sparkSession
    short_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = coder(spec.value)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), strings(batch.column(1))
            for begin, end in groups_of_texts(texts):
                rows = []
                for doc_id, text in zip(doc_ids[begin:end], texts[begin:end], strict=True):
                    ids = np.array([*ids_of(text), end_id], "<u4")
                    rows += [(doc_id, p, at, n, zlib.crc32(ids[at : at + n])) for p, (at, n) in enumerate(pieces_of(len(ids), capacity))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, group_rows: int = 60_000, end_id: int = 0) -> DataFrame:
    """Pieces of all rows with the sequence and the place that each one has.

    A null text counts as empty: its document is the end id alone. Rows with the same doc_id are packed as separate
    documents. No rows give no sequences. Columns of docs other than doc_id and text aren't looked at. The two steps
    are: groups of about `group_rows` pieces dealt by hash, then all pieces from sequences with room left, in
    groups again. Full pieces fill a sequence each and skip both.
    """
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, tokenizer, capacity, end_id).withColumn("row", F.monotonically_increasing_id()))
    n = pieces.filter(F.col("length") < capacity).count()
    groups = max(1, -(-n // group_rows))
    key = F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(groups)).cast("int")
    whole = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": F.col("row") * 4, "offset": F.lit(0).cast("long")})
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, room long"

    def packed(level: int, descending: bool):
        def run(key, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["length", "row"], ascending=[False, True]) if descending else frame.iloc[np.argsort(frame["row"].to_numpy(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")]
            where, offset, fill = sum_of_squares(frame["length"].to_numpy(np.int64), capacity)
            first = np.full(len(fill), -1, np.int64)
            rows = frame["row"].to_numpy(np.int64)
            first[where[::-1]] = rows[::-1]  # the first piece of a sequence names it
            return frame[columns].assign(sequence_id=first[where] * 4 + level, offset=offset, room=capacity - fill[where])

        return run

    once = cut(pieces.filter(F.col("length") < capacity).withColumn("deal", key).groupBy("deal").applyInPandas(packed(1, False), schema))
    left = once.filter("room > 0")
    again = max(1, -(-left.count() // group_rows))
    twice = left.select(*columns, F.pmod(F.xxhash64("row"), F.lit(again)).cast("int").alias("deal")).groupBy("deal").applyInPandas(packed(2, True), schema)
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return whole.select(*out).unionByName(once.filter("room = 0").select(*out)).unionByName(twice.select(*out))
