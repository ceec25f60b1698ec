"""Jaccard join of documents on word n-grams, and the groups that its links form.

Exact copies of a set are one node. Nodes that share a signature (see `shingles.signatures`) are candidates. A similar
set shares at least a known number of a node's signatures, and only those that several nodes have can be shared: a node
with fewer of these has no similar one, and of the others only so many of its rarest signatures are searched that one of
the shared ones must be among them. Within a bucket every node is compared
with the bucket's centre first, so a bucket of n nodes gives n pairs; what is linked thereby needs no further
comparison. Nodes that share a bucket but are in different components after that are compared in blocks: each block of
nodes meets each other block that it shares a bucket with once, and what is similar between them comes from one product
of matrices. So no link between components is lost, and no pairs are listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import shingles
from .common import BROADCAST_ROWS, bounded, cut, short_batches, text_hash, text_of
from .components import components

#: Classes of copies that a task remembers so as to sign each of them once; forgetting one only repeats its rows.
SEEN = 100_000
#: Signatures of a chunk that a task sends at once, and what stands for "several nodes of the chunk" among their places.
CHUNK, MARK = 1_000_000, 65_535
#: Signatures of a part, about.
PART = 1_000_000
#: Nodes and hashes of a block, about, and nodes of a component in one home from which it has blocks of its own.
BLOCK, BLOCK_HASHES, LARGE = 512, 500_000, 256
#: Cells of the matrix of a comparison that are held at once.
CELLS = 4_000_000


def sketches(docs: DataFrame, width: int, percent: int, seed: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node, check (128 bits of the set), and its bounds, once for each task and set."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, schemes, seen = shingles.Words(seed), shingles.Schemes(percent), set()
        for batch in batches:
            sizes, nodes, checks, bounds = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = shingles.shingle_set(text or b"", words, width)
                sizes.append(len(hashes))
                node, check = shingles.set_hash(hashes) if len(hashes) and doc_id is not None else (None, None)
                nodes.append(node)
                checks.append(check)
                if node is not None and (node, check) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add((node, check))
                    bounds.append([k << 32 | n for k, n in shingles.bounds(hashes, schemes)])
                else:
                    bounds.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(bounds, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "node", "check", "bounds"],
            )

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("text"), text_hash(docs).alias("text_hash"))
    return slim.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node long, check long, bounds array<long>")


def packed(nodes: list[int], found: list[np.ndarray], bits: int) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
    """(part, kind, nodes, places among them, signatures) of the signatures of a chunk of nodes, part by part.

    A signature that the chunk has once is sent to its part with its node. One that it has more often is known to be
    shared: its rows go out as they are (kind 1), and its part gets one mark, so that a part has at most one entry of
    any signature from a chunk. Within a part a signature is 32 bits of its hash and its list, in the order of both.
    """
    if not sum(map(len, found)):
        return
    s = np.concatenate(found)
    k = np.repeat(np.arange(len(nodes)), [len(x) for x in found])
    part = s >> np.uint64(64 - bits) if bits else np.zeros(len(s), np.uint64)
    offset = (s << np.uint64(bits)) >> np.uint64(32)
    key = part << np.uint64(40) | (s & np.uint64(0xFF)) << np.uint64(32) | offset
    order = np.argsort(key, kind="stable")
    key, k = key[order], k[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    last = np.ones(len(key), bool)
    last[:-1] = first[1:]
    shared = ~(first & last)
    ids = np.array(nodes, np.int64)

    def blob(part: int, kind: int, key: np.ndarray, k: np.ndarray) -> tuple[int, int, bytes, bytes, bytes]:
        used, place = np.unique(k, return_inverse=True)
        held = ids[used[used < MARK]]
        place = np.where(k == MARK, MARK, place)
        wide = key if kind else (key & np.uint64(0xFF00000000)) >> np.uint64(32)
        # one plane for each byte: those of high bytes hardly change in sorted order, and so take little room
        planes = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T
        columns = wide.tobytes() if kind else wide.astype(np.uint8).tobytes() + planes.tobytes()
        return part, kind, held.tobytes(), place.astype(np.uint16).tobytes(), columns

    if shared.any():
        yield blob(nodes[0] & (1 << bits) - 1, 1, key[shared], k[shared])
    key, k = key[first], np.where(shared, MARK, k)[first]
    parts = (key >> np.uint64(40)).astype(np.int64)
    edges = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))
    for a, b in zip(edges, np.append(edges[1:], len(parts)), strict=True):
        yield blob(int(parts[a]), 0, key[a:b], k[a:b])


def unpacked(part: int, kind: int, nodes: bytes, places: bytes, columns: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, nodes, and whether the entry is a mark."""
    ids, place = np.frombuffer(nodes, np.int64), np.frombuffer(places, np.uint16)
    mark = place == MARK
    if kind:
        key = np.frombuffer(columns, np.uint64)
    else:
        n = len(place)
        flat = np.frombuffer(columns, np.uint8)
        offset = np.ascontiguousarray(flat[n:].reshape(4, n).T).view(np.uint32).ravel()
        key = np.uint64(part << 40) | flat[:n].astype(np.uint64) << np.uint64(32) | offset
    return key.view(np.int64), np.append(ids, 0)[np.where(mark, len(ids), place)], mark


def meet(rows: list[tuple]) -> pa.RecordBatch:
    """signature, node of what chunks have sent to one part, where several nodes have the signature."""
    s, x, mark = (np.concatenate(c) for c in zip(*(unpacked(*r) for r in rows if not r[1]), strict=True)) if any(not r[1] for r in rows) else (np.empty(0, np.int64),) * 3
    order = np.lexsort((x, s))
    s, x, mark = s[order], x[order], mark[order].astype(bool)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    marked = np.zeros(len(begin), bool)
    marked[group[mark]] = True
    end = np.append(begin[1:], len(s)) - 1
    several = marked | (x[begin] != x[end]) if len(begin) else marked
    again = ~new & np.append(False, x[1:] == x[:-1]) if len(s) else new
    put = several[group] & ~mark & ~again if len(s) else new
    direct = [unpacked(*r)[:2] for r in rows if r[1]]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, *(d[i] for d in direct)]), pa.int64()) for i, a in enumerate((s[put], x[put]))], names=["signature", "node"])


def bucket_rows(docs: DataFrame, width: int, percent: int, seed: int, bits: int) -> DataFrame:
    """signature, node of signatures that several nodes have; a row may come more than once.

    Tasks send the signatures of their sets in chunks to 2 ** bits parts by ranges of hashes. A part has at most one
    entry of a signature from each chunk, so a frequent one costs no task more than there are chunks.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, schemes, seen = shingles.Words(seed), shingles.Schemes(percent), set()
        nodes: list[int] = []
        found: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            rows = list(zip(*packed(nodes, found, bits), strict=True)) or [[]] * 5
            nodes.clear()
            found.clear()
            if len(seen) >= SEEN:
                seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], strict=True)], names=["part", "kind", "nodes", "places", "columns"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                hashes = shingles.shingle_set(text, words, width)
                if not len(hashes) or (key := shingles.set_hash(hashes)) in seen:
                    continue
                seen.add(key)
                nodes.append(key[0])
                found.append(shingles.signatures(hashes, schemes)[0])
                held += len(found[-1])
                if held >= CHUNK or len(nodes) == MARK:
                    yield flush()
                    held = 0
        yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if rows and row[0] != rows[0][0]:
                    yield meet(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield meet(rows)

    slim = docs.filter(docs["doc_id"].cast("long").isNotNull()).select(text_of(docs).cast("binary").alias("text"))
    sent = slim.mapInArrow(send, "part long, kind long, nodes binary, places binary, columns binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(gather, "signature long, node long")


def members_of(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """signature, node of the buckets to search.

    Of each list of a node, v signatures are held by others too, and a similar set shares `least` of them at least.
    In the order of bucket sizes, the first of the shared ones is then among the first v - least + 1 of either node.
    """
    sizes = rows.groupBy("signature").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    held = rows.join(sizes, "signature").withColumn("list", F.shiftright("signature", 32).bitwiseAND(0xFF))
    bound = classes.select("node", F.explode("bounds").alias("b")).select("node", F.shiftright("b", 32).alias("list"), F.col("b").bitwiseAND(0xFFFFFFFF).alias("least"))
    mine = Window.partitionBy("node", "list")  # the signatures of one set
    ranked = held.join(bound, ["node", "list"]).withColumns({"v": F.count(F.lit(1)).over(mine), "r": F.row_number().over(mine.orderBy("size", "signature"))})
    kept = cut(ranked.filter("r <= v - least + 1").select("signature", "node"))
    again = kept.groupBy("signature").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("signature")
    return cut(kept.join(again, "signature"))


def sets_of(docs: DataFrame, wanted: DataFrame, n_wanted: int, width: int, seed: int, broadcast_rows: int) -> DataFrame:
    """node, n and the set of each wanted node, from the text of the document that stands for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shingles.Words(seed)
        for batch in batches:
            nodes, sizes, sets = [], [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = shingles.shingle_set(text, words, width)
                if len(hashes) and shingles.set_hash(hashes)[0] == node:
                    nodes.append(node)
                    sizes.append(len(hashes))
                    sets.append(hashes.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "n", "set"])

    slim = docs.select(docs["doc_id"].cast("long").alias("first_id"), text_of(docs).cast("binary").alias("text"))
    texts = slim.join(bounded(wanted, n_wanted, broadcast_rows), "first_id").select("node", "text")
    found = texts.mapInArrow(run, "node long, n long, set binary")
    return found.groupBy("node").agg(F.first("n").alias("n"), F.first("set").alias("set"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs a, b that are similar; pairs whose sizes rule it out are dropped before their sets are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (2, 3))
            keep = [shingles.similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    sizes = sets.select("node", "n")
    near = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    near = near.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b")
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    return near.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def centers(members: DataFrame) -> DataFrame:
    """signature, best (score, node): of each bucket the node that meets most others in all its buckets.

    An original has its segments in common with all its copies, while two copies differ where either was changed.
    """
    sizes = members.groupBy("signature").agg(F.count(F.lit(1)).alias("size"))
    scores = members.join(sizes, "signature").groupBy("node").agg(F.sum("size").alias("score"))
    return members.join(scores, "node").groupBy("signature").agg(F.max(F.struct("score", "node")).alias("best"))


def divided(members: DataFrame, labels: DataFrame) -> DataFrame:
    """signature, node, comp of the buckets whose nodes are in several components."""
    now = members.join(labels, "node", "left").select("signature", "node", F.coalesce("comp", "node").alias("comp"))
    several = now.groupBy("signature").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("signature")
    return cut(now.join(several, "signature"))


def similar_pairs(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of a are similar to which of b, as pairs of positions, from the sizes of all intersections.

    Only hashes that both sides have matter; they are taken in slices, so that memory is bounded for long sets.
    """
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    fa, fb = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(fa, fb)
    both = np.zeros((len(a), len(b)), np.float32)
    parts = []
    for flat, sizes in ((fa, na), (fb, nb)):
        at = np.minimum(np.searchsorted(common, flat), max(len(common) - 1, 0))
        ok = common[at] == flat if len(common) else np.zeros(len(flat), bool)
        order = np.argsort(at[ok], kind="stable")
        parts.append((np.repeat(np.arange(len(sizes)), sizes)[ok][order], at[ok][order]))
    step = max(1, CELLS // max(len(a) + len(b), 1))
    for low in range(0, len(common), step):
        cells = []
        for (rows, columns), n in zip(parts, (len(a), len(b)), strict=True):
            x, y = np.searchsorted(columns, [low, low + step])
            m = np.zeros((n, min(step, len(common) - low)), np.float32)
            m[rows[x:y], columns[x:y] - low] = 1
            cells.append(m)
        both += cells[0] @ cells[1].T
    both = np.rint(both).astype(np.int64)
    return np.argwhere(100 * both >= percent * (na[:, None] + nb[None, :] - both))


def block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b between nodes of different components that share a bucket.

    A node's home is the centre that meets most nodes of those of its buckets and of the buckets of its neighbours, so
    that near copies have few homes. The nodes of a home are dealt into blocks by hash; a component with many nodes
    there has blocks of its own, which needn't meet each other. Blocks that hold nodes of one bucket meet: both send
    their sets to one task, which reads them in order of the meeting.
    """
    at = centers(members)
    for _ in range(2):
        home = cut(members.join(at, "signature").groupBy("node").agg(F.max("best").alias("best"), F.first("comp").alias("comp")))
        at = members.join(home.select("node", "best"), "node").groupBy("signature").agg(F.max("best").alias("best"))
    home = home.select("node", "comp", F.col("best.node").alias("home"))
    home = home.join(sets.select("node", F.col("n").alias("hashes")), "node")
    of = home.groupBy("home", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("hashes").alias("hashes")).withColumn("own", F.when(F.col("k") >= LARGE, F.col("comp")))
    needed = F.greatest(F.sum("k") / BLOCK, F.sum("hashes") / BLOCK_HASHES)
    many = of.groupBy("home", "own").agg(F.ceil(needed).cast("long").alias("parts"))
    dealt = home.join(of.select("home", "comp", "own"), ["home", "comp"])
    dealt = dealt.join(many.select("home", F.col("own").alias("o"), "parts"), "home").filter(F.col("own").eqNullSafe(F.col("o")))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    blocks = cut(dealt.select("node", "comp", "own", F.xxhash64("home", F.coalesce("own", F.lit(0)), part).alias("block")))
    held = members.select("signature", "node").join(blocks, "node").select("signature", "block", "own").distinct()
    x, y = held.toDF("signature", "x", "ox"), held.toDF("signature", "y", "oy")
    meet = x.join(y, "signature").filter("x <= y AND (ox IS NULL OR oy IS NULL OR ox <> oy)").select("x", "y").distinct()
    meet = cut(meet.withColumn("meeting", F.xxhash64("x", "y")))
    first = meet.select("meeting", F.col("x").alias("block"), F.lit(0).alias("side"))
    second = meet.select("meeting", F.col("y").alias("block"), F.lit(1).alias("side"))
    sent = first.union(second).join(blocks.select("block", "node", "comp"), "block").join(sets.select("node", "set"), "node")
    sent = sent.select("meeting", "side", "node", "comp", "set").repartition("meeting").sortWithinPartitions("meeting", "side")

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        sides = [[r for r in rows if r[1] == k] for k in (0, 1)]
        a, b = [], []
        if all(sides):
            found = similar_pairs(*[[np.frombuffer(r[4], np.uint64) for r in side] for side in sides], percent)
            for i, j in found.tolist():
                if sides[0][i][3] != sides[1][j][3]:
                    a.append(sides[0][i][2])
                    b.append(sides[1][j][2])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if rows and row[0] != rows[0][0]:
                    yield compare(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield compare(rows)

    return sent.mapInArrow(run, "a long, b long")


def node_components(members: DataFrame, stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, comp of all nodes that have a link. stars: the pairs a, b to begin with."""
    labels = components(cut(verified(stars, sets, percent)))
    members = divided(members, labels)
    links = cut(block_links(members, sets, percent))
    return components(links, labels)


def part_bits(total: int, tasks: int) -> int:
    """Bits of the number of parts: about PART signatures each, and twice as many as tasks at least."""
    return min(20, max(total // PART, 2 * tasks, 1).bit_length())


def with_components(known: DataFrame, top: DataFrame, rows: int) -> DataFrame:
    """known with the component of its node, which top has (node, n rows of it, component).

    Nodes with more than a thousandth of all rows, fewer than a thousand by that, are sent to all tasks, so that no
    task gets all rows of one. Rows that need no other join meet by a key of their own, which no node has.
    """
    hot = top.filter(F.col("n") * 1000 > rows).select("node", F.col("component").alias("hot"))
    out = known.join(F.broadcast(hot), "node", "left")
    out = out.withColumn("key", F.when(F.col("hot").isNull() & F.col("node").isNotNull(), F.col("node")).otherwise(F.xxhash64("doc_id", F.lit(1))))
    rest = top.filter(F.col("n") * 1000 <= rows).select(F.col("node").alias("key"), "component")
    return out.join(rest, "key", "left").withColumn("component", F.coalesce("hot", "component"))


def jaccard_groups(docs: DataFrame, width: int = 4, percent: int = 85, broadcast_rows: int = BROADCAST_ROWS, seed: int = 0) -> DataFrame:
    """doc_id, n_shingles, component_id, and text_hash of each row of docs.

    Two documents link when the Jaccard similarity of their sets of `width`-word shingles is percent / 100 or more;
    component_id is the smallest doc_id that links reach. A null text counts as empty; a document without words is
    linked with nothing. A row without a doc_id is linked with nothing and has no component. Rows with equal doc_ids
    are separate documents, told apart by text_hash where their texts differ. Other columns aren't looked at; no rows
    give no rows.
    """
    while True:
        known = cut(sketches(docs, width, percent, seed))
        classes = known.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("check").alias("c1"), F.max("check").alias("c2"), F.max("bounds").alias("bounds"), F.first("n_shingles").alias("size"), F.count(F.lit(1)).alias("n"))
        classes = cut(classes)
        total, rows, clash = classes.agg(F.sum("size"), F.sum("n"), F.max(F.col("c1") != F.col("c2"))).first()
        if not clash:
            break
        seed += 1  # two sets have one 64-bit hash: all hashes are drawn anew
    bits = part_bits(int(total or 0), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    members = members_of(cut(bucket_rows(docs, width, percent, seed, bits).distinct()), classes)
    stars = cut(ordered(members.join(centers(members), "signature").select("node", F.col("best.node").alias("center")), "node", "center"))
    wanted = cut(members.select("node").distinct().join(classes, "node").select("node", "first_id"))
    sets = cut(sets_of(docs, wanted, wanted.count(), width, seed, broadcast_rows))
    labels = node_components(members, stars, sets, percent)
    named = labels.join(classes, "node").groupBy("comp").agg(F.min("first_id").alias("least"))
    linked = labels.join(named, "comp").select("node", "least")
    top = classes.join(linked, "node", "left").filter("n > 1 OR least IS NOT NULL").select("node", "n", F.coalesce("least", "first_id").alias("component"))
    out = with_components(known, cut(top), int(rows or 0))
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "text_hash")
