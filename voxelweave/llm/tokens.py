"""BPE encoding and decoding of whole texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import groups_of_texts, short_batches, strings, text_of


def _spec(docs: DataFrame, tokenizer: str):
    with open(tokenizer, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())  # bounded by the vocabulary


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids, an array, of each row's whole text; a null text has no ids. No rows give no rows."""
    short_batches(docs.sparkSession)
    spec = _spec(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.shared(spec.value)
        for batch in batches:
            texts = strings(batch.column(1))
            for begin, end in groups_of_texts(texts):
                found = [np.frombuffer(x, "<u4") for x in coder.encode(texts[begin:end])]
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(offsets, np.concatenate(found).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), ids], names=["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of rows of ids, special tokens' strings kept; null ids give the empty text."""
    spec = _spec(tokens, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.shared(spec.value)
        for batch in batches:
            texts = [coder.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(tokens["doc_id"].cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text that they decode to, in one pass.

    Null and empty texts have no ids. Rows with equal doc_ids stay separate rows. Other columns aren't looked at.
    """
    short_batches(docs.sparkSession)
    spec = _spec(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.shared(spec.value)
        digits = [str(i) for i in range(len(coder.bytes_of))]
        for batch in batches:
            doc_ids, texts = batch.column(0), strings(batch.column(1))
            for begin, end in groups_of_texts(texts):
                sizes, ids_sha, text_sha = [], [], []
                for raw in coder.encode(texts[begin:end]):
                    ids = np.frombuffer(raw, "<u4").tolist()
                    sizes.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(coder.decode_ids(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(begin, end - begin), pa.array(sizes, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
