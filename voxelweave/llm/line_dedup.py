"""Line dedup: lines that many documents share are dropped from all of them but one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import BROADCAST_ROWS, bounded, cut, plain_reads, replace_columns, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case; other letters stay as they are."""
    bare = F.btrim(line, F.lit(SPACES))
    plain = F.octet_length(bare) == F.char_length(bare)  # then lower() has only A-Z to change, and is faster
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def fingerprint(key: Column) -> tuple[Column, Column]:
    """128 bits of a key: two hashes that start from different seeds."""
    return F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """__id, __h1, __h2 of each line that is long enough; rows without a doc_id have no part in the counts."""
    lines = docs.select(docs["doc_id"].alias("__id"), F.explode(F.split(text_of(docs), "\n")).alias("__line"))
    lines = lines.filter(F.col("__id").isNotNull() & (F.octet_length("__line") >= min_chars))
    keys = lines.select("__id", line_key(F.col("__line")).alias("__key")).filter(F.char_length("__key") >= min_chars)
    h1, h2 = fingerprint(F.col("__key"))
    return keys.select("__id", h1.alias("__h1"), h2.alias("__h2"))


#: Keys to drop, for each row that a broadcast side may have otherwise: a key is 16 bytes.
KEYS = 4
#: Ways in which the rows of one key are dealt where both sides of a join are shuffled.
SALTS = 32


def of_keys(lines: DataFrame, keys: DataFrame, rows: int, broadcast_rows: int) -> DataFrame:
    """lines with these keys, which are sent to all tasks if they are few; if not, a common key is dealt by documents."""
    if rows <= broadcast_rows:
        return lines.join(F.broadcast(keys), ["__h1", "__h2"])
    salted = keys.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int")).join(salted, ["__h1", "__h2", "__salt"]).drop("__salt")


def shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """__id, __h1, __h2 of the lines to drop, once for each document and key."""
    plain_reads(docs.sparkSession)
    keys = line_keys(docs, min_chars)
    # Rows are counted first, for that can be summed before the shuffle; it can't miss a key in many documents.
    often = keys.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("a"), F.max("__id").alias("b"))
    often = cut(often.filter((F.col("n") >= min_docs) & (F.col("a") < F.col("b"))).select("__h1", "__h2"))
    held = of_keys(keys, often, often.count(), broadcast_rows).groupBy("__h1", "__h2", "__id").agg(F.count(F.lit(1)).alias("n"))
    held = cut(held.drop("n"))
    drop = held.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("n"), F.max("__id").alias("__keep")).filter(F.col("n") >= min_docs).drop("n")
    drop = cut(drop)
    return of_keys(held, drop, drop.count(), broadcast_rows).filter(F.col("__id") != F.col("__keep")).select("__id", "__h1", "__h2")


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with its text without the dropped lines, and n_lines, n_dropped (long) beside it.

    A line's key has at least `min_chars` code points and stands in at least `min_docs` documents (distinct
    doc_ids); its lines go from all documents but that with the largest doc_id. Null and empty texts have one empty
    line and stay. Rows without a doc_id stay whole. Rows with equal doc_ids count as one document, and the same keys
    go from each. Columns named n_lines or n_dropped are replaced; no rows give no rows.
    """
    drops = shared_lines(docs, min_chars, min_docs, broadcast_rows).groupBy("__id").agg(F.collect_list(F.struct("__h1", "__h2")).alias("__drop"))
    drops = cut(drops)
    keys = drops.agg(F.sum(F.size("__drop"))).first()[0] or 0  # their bytes are bounded by this, not by the rows
    lines = F.split(text_of(docs), "\n")
    out = docs.withColumns({"__text": text_of(docs), "__lines": lines})
    out = out.join(bounded(drops, keys, broadcast_rows * KEYS), out["doc_id"] == drops["__id"], "left")

    def stays(line: Column) -> Column:
        h1, h2 = fingerprint(line_key(line))
        return ~F.array_contains(F.col("__drop"), F.struct(h1.alias("__h1"), h2.alias("__h2"))) | (F.char_length(line) < min_chars)

    kept = F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(F.filter("__lines", stays))
    out = out.withColumn("__kept", kept)
    out = replace_columns(
        out,
        text=F.when(F.col("__drop").isNull(), F.col("__text")).otherwise(F.array_join("__kept", "\n")),
        n_lines=F.size("__lines").cast("long"),
        n_dropped=(F.size("__lines") - F.size("__kept")).cast("long"),
    )
    return out.drop("__id", "__drop", "__text", "__lines", "__kept")
