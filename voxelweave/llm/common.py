"""Helpers that the text operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows that a broadcast side may have; beyond it the join shuffles both sides.
BROADCAST_ROWS = 200_000
#: Characters of text that a Python step holds at once, one longer text excepted.
CHUNK_CHARS = 2_000_000
#: Rows of an Arrow batch: texts are long, so batches are short.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    plain_reads(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_reads(spark: SparkSession) -> None:
    """Read Parquet without vectored reads.

    Those fill a buffer outside the heap for each thread of an unbounded pool, as large as its longest read, and keep it.
    """
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small unless the session already asks for smaller ones."""
    plain_reads(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Where none is set, local mode gets a private one; a cluster has no folder that all its machines see, so this raises.
    """
    if place := spark.conf.get("spark.checkpoint.dir", None):
        return place
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="shared-")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and forget its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def text_hash(df: DataFrame) -> Column:
    """64 bits of a row's text; null counts as empty. With doc_id it tells rows apart that have one doc_id."""
    return F.xxhash64(text_of(df))


def replace_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns, in place of any that have the same names."""
    return df.withColumns(columns)


def groups_of_texts(texts: Iterable[str], chars: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts that have about so many characters together."""
    begin = total = 0
    at = -1
    for at, x in enumerate(texts):
        if total and total + len(x) > chars:
            yield begin, at
            begin, total = at, 0
        total += len(x)
    if at >= begin:
        yield begin, at + 1


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Values of a string column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]
