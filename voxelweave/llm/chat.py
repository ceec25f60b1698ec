"""Chat messages without their quotes, in the order of replies that the quotes show.

Quoted passages are parsed by nesting level and normalised, and their hashes are joined to those of what messages say
themselves. A message replies to the message that its passages of the lowest level come from; it stands in the reply
order below that one, by turn. Joins are on a conversation and a hash, with one row for each on the originals' side,
so a long conversation or a passage that is quoted often is spread or summed up before it meets others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, short_batches, strings

MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
#: A line that only says who is quoted belongs to the quote below it.
INTRODUCTION = re.compile(r"^\s*(?:on\b.{0,200}\bwrote|.{0,80}\b(?:wrote|schrieb|écrit|escribió))\s*:\s*$", re.IGNORECASE)
SPACE = re.compile(r"\s+")
#: Words that a single line needs so as to be looked up on its own.
LINE_WORDS = 4


def levels(text: str) -> list[tuple[int, str]]:
    """Level of quotation (0: own words) and content of each line; lines that introduce a quote are dropped."""
    out: list[tuple[int, str]] = []
    lines = text.split("\n")
    for k, line in enumerate(lines):
        m = MARKS.match(line)
        if m:
            out.append((m.group(1).count(">"), line[m.end() :]))
        elif not (INTRODUCTION.match(line) and any(MARKS.match(x) for x in lines[k + 1 : k + 3] if x.strip())):
            out.append((0, line))
    return out


def normal(text: str) -> str:
    return SPACE.sub(" ", text).strip().lower()


def own_text(found: list[tuple[int, str]]) -> str:
    """Lines of level 0; empty lines at the ends and next to each other go with the quotes that they surrounded."""
    quoted = any(level for level, _ in found)
    lines = [x for level, x in found if not level]
    text = "\n".join(lines)
    return re.sub(r"\n\s*\n(?:\s*\n)+", "\n\n", text).strip() if quoted else text


def hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def own_keys(own: str) -> set[int]:
    """Hashes of what can be quoted: the whole, its paragraphs, and its lines of some length."""
    parts = [own, *re.split(r"\n\s*\n", own), *(x for x in own.split("\n") if len(x.split()) >= LINE_WORDS)]
    return {hashed(n) for x in parts if (n := normal(x))}


def quoted_keys(found: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """(level, hash) of each quoted passage: neighbouring lines of one level, as a whole and, if long enough, by line."""
    out, k = set(), 0
    while k < len(found):
        level, end = found[k][0], k
        while end < len(found) and found[end][0] == level:
            end += 1
        if level:
            lines = [x for _, x in found[k:end]]
            for x in ["\n".join(lines), *re.split(r"\n\s*\n", "\n".join(lines)), *(x for x in lines if len(x.split()) >= LINE_WORDS)]:
                if n := normal(x):
                    out.add((level, hashed(n)))
        k = end
    return sorted(out)


def parsed(messages: DataFrame) -> DataFrame:
    short_batches(messages.sparkSession)
    rows = messages.select("conv_id", "turn", "role", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, keys, quotes, depth, count = [], [], [], [], []
            for text in strings(batch.column(3)):
                found = levels(text)
                own.append(own_text(found))
                keys.append(sorted(own_keys(own[-1])))
                q = quoted_keys(found)
                quotes.append([h for _, h in q])
                depth.append([level for level, _ in q])
                count.append(sum(level > 0 for level, _ in found))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(own, pa.string()), pa.array(keys, pa.list_(pa.int64())), pa.array(quotes, pa.list_(pa.int64())), pa.array(depth, pa.list_(pa.int64())), pa.array(count, pa.int64())], names=["conv_id", "turn", "role", "own", "keys", "quotes", "levels", "n_quoted"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in ("conv_id", "turn", "role"))
    return rows.mapInArrow(run, f"{kinds}, own string, keys array<bigint>, quotes array<bigint>, levels array<bigint>, n_quoted bigint")


def paths(parents: DataFrame) -> DataFrame:
    """conv_id, turn, path: turns from the first message that replies to nothing down to this one, by doubling steps."""
    at = cut(parents.select("conv_id", "turn", F.col("parent_turn").alias("top"), F.array("turn").alias("path")))
    while at.filter("top IS NOT NULL").limit(1).count():
        up = at.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("over"), F.col("path").alias("head"))
        at = at.join(up, ["conv_id", "top"], "left").select("conv_id", "turn", F.col("over").alias("top"), F.when(F.col("head").isNull(), F.col("path")).otherwise(F.concat("head", "path")).alias("path"))
        at = cut(at)
    return at.select("conv_id", "turn", "path")


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row for each message: conv_id, turn, role, parent_turn, reply_path, n_quoted lines, n_linked passages, own.

    Rows sorted by conv_id and reply_path are the conversation in reply order: a reply comes after what it replies to,
    replies to one message by turn. The parent is the latest of the messages that first said a passage which this one
    quotes at its lowest linked level; only earlier turns count, so there are no circles. A message without a linked
    quote starts a thread at its own turn. Null texts count as empty. Of rows with equal conv_id and turn any may be
    the original; each stays a row, with the parent that the quotes of all of them give. Rows without conv_id or turn
    link nothing and have a path of their turn. Other columns aren't looked at; no rows give no rows.
    """
    found = cut(parsed(messages))
    known = found.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    first = known.select("conv_id", "turn", F.explode("keys").alias("key")).groupBy("conv_id", "key").agg(F.min("turn").alias("origin"))
    asked = known.filter(F.size("quotes") > 0).select("conv_id", "turn", F.explode(F.arrays_zip("quotes", "levels")).alias("q"))
    asked = asked.select("conv_id", "turn", F.col("q.quotes").alias("key"), F.col("q.levels").alias("level"))
    hits = asked.join(first, ["conv_id", "key"]).filter("origin < turn")
    best = hits.groupBy("conv_id", "turn").agg(F.max_by("origin", F.struct(-F.col("level"), F.col("origin"))).alias("parent_turn"), F.count(F.lit(1)).alias("n_linked"))
    best = cut(best)
    if best.limit(1).count():
        ends = best.select("conv_id", "turn", "parent_turn")
        roots = ends.select("conv_id", F.col("parent_turn").alias("turn")).distinct().join(ends.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
        tree = ends.unionByName(roots.withColumn("parent_turn", F.lit(None).cast(ends.schema["parent_turn"].dataType)))
        best = best.join(paths(tree), ["conv_id", "turn"])
        out = found.join(best, ["conv_id", "turn"], "left")
    else:
        out = found.withColumns({"parent_turn": F.lit(None).cast(found.schema["turn"].dataType), "n_linked": F.lit(0), "path": F.lit(None).cast(f"array<{found.schema['turn'].dataType.simpleString()}>")})
    return out.select("conv_id", "turn", "role", "parent_turn", F.coalesce("path", F.array("turn")).alias("reply_path"), "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "own")


def formatted(messages: DataFrame, start: str = "<|", end: str = "|>") -> DataFrame:
    """link_quotes with `chat`: the message without quotes under its role, as a chat template has it."""
    out = link_quotes(messages)
    return out.withColumn("chat", F.concat(F.lit(start), F.coalesce("role", F.lit("")), F.lit(end + "\n"), "own", F.lit("\n")))


def digests(messages: DataFrame) -> DataFrame:
    out = formatted(messages)
    return out.select("conv_id", "turn", "role", "parent_turn", F.array_join(F.col("reply_path").cast("array<string>"), "/").alias("reply_path"), "n_quoted", "n_linked", F.sha2("chat", 256).alias("chat_sha256"))
