"""A corpus pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxelweave.llm import line_dedup as lines, ngram_join, packing, pii, toxicity
from voxelweave.llm.common import bounded, cut, plain_reads, shared_folder, table, text_hash
from voxelweave.llm.queries import vocabulary


def _as_before(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns that docs has, with n_chars, where there is one, for the text as it is now."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _joined(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs with or without the rows that have a doc_id (null is one too) and text_hash of rows, sent to all tasks if counted few."""
    rows = cut(rows.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (text_hash(docs) == F.col("__hash"))
    return docs.join(bounded(rows, rows.count()), same, how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Each row is judged by its own text, so of rows with equal doc_ids, or with none, only those go whose text is
    rejected. A null or empty text has the score of a text without votes and stays. No rows give no rows.
    """
    return _joined(docs, toxicity.toxicity(docs, table(spark, sf_dir, "labels")).filter("predicted = 1"), "left_anti")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; a document that is left without text stays, empty.

    A null text becomes empty. Rows with equal doc_ids count as one document; rows without one stay whole. No rows
    give no rows.
    """
    return _as_before(lines.line_dedup(docs), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays.

    Of rows with equal doc_ids and texts one stays; of rows with equal doc_ids and different texts each is judged by
    its own text. Rows without words link with nothing and stay unless they are repeated; rows without a doc_id stay.
    No rows give no rows.
    """
    groups = cut(ngram_join.jaccard_groups(docs, width=5, percent=80).select("doc_id", "component_id", "text_hash"))
    out = _joined(docs, groups.filter("doc_id <> component_id"), "left_anti")
    again = cut(groups.filter("doc_id = component_id").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    if again.limit(1).count():
        out = _joined(out, again, "left_anti").unionByName(_joined(out, again, "left_semi").withColumn("__hash", text_hash(out)).dropDuplicates(["doc_id", "__hash"]).drop("__hash"))
    return out.select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes the name of its kind; all rows stay, and a null text becomes empty."""
    return _as_before(pii.mask(docs), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 2048 tokens.

    A null or empty text is one piece of the end token alone; repeated rows are packed each. No rows give no rows.
    """
    return packing.pack(docs, vocabulary(), capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_shared_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", mask_personal_data),
    ("best-fit packing", pack_sequences),
]

#: SQL has no place for the classifier, the tagger, the tokenizer and the packing; tests hold the stages against their parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one written to the shared folder and read again.

    A stage's folder is deleted when the next one is written; the last one's is what the result reads.
    """
    plain_reads(spark)
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            files.delete(path(f"{place}/{k - 1}"), True)
    return docs
