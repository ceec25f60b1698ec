"""Queries of the text operators over the shared tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import centroids, chat, html_text, importance, line_dedup, ngram_join, packing, passages, pii, quality, tokens, toxicity, transport
from .common import table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(table(spark, sf_dir, "conversations"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op6_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.digests(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"), width=4, percent=85).drop("text_hash")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), capacity=2048)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.digests(table(spark, sf_dir, "pages"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quoting(messages: DataFrame) -> DataFrame:
    """messages with quotes: each but the first quotes one up to three turns before it, and what that one quotes.

    The table's own messages quote nothing; with these the links of op3's operator can be held against SQL.
    """
    before = F.greatest(F.col("turn") - 1 - (F.col("conv_id") + F.col("turn")) % 3, F.lit(0))
    m = messages.select("conv_id", "turn", "role", "text", F.when(F.col("turn") > 0, before).alias("p"))
    said = m.select("conv_id", F.col("turn").alias("p"), F.col("text").alias("t1"), F.col("p").alias("pp"))
    again = m.select("conv_id", F.col("turn").alias("pp"), F.col("text").alias("t2"))
    both = m.join(said, ["conv_id", "p"], "left").join(again, ["conv_id", "pp"], "left")
    marked = lambda t, mark: F.concat(F.lit(mark), F.regexp_replace(t, "\n", "\n" + mark), F.lit("\n"))
    quote = F.concat(F.coalesce(marked("t2", "> > "), F.lit("")), F.coalesce(marked("t1", "> "), F.lit("")))
    return both.select("conv_id", "turn", "role", F.concat(quote, "text").alias("text"))


def chat_quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's operator over messages that quote: who replies to whom (-1: nobody), the reply order, and own words."""
    out = chat.digests(quoting(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "turn", "role", F.coalesce("parent_turn", F.lit(-1)).cast("long").alias("parent_turn"), "reply_path", "n_quoted", "chat_sha256")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts and the base verdict of op5."""
    return quality.quality(table(spark, sf_dir, "documents")).select("doc_id", *quality.COLUMNS, "base_failed")


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many base spans of each kind op4 finds."""
    return pii.find(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def transport_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digest of the payloads that op6 reads back."""
    return transport.digests(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    more = [chat_quoted_replies, quality_counts, pii_base_spans, transport_payloads]
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and callable(f)} | {f.__name__: f for f in more}


#: White space at both ends, as a set of characters for DuckDB's trim.
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = line_dedup.UPPER, line_dedup.LOWER

OP1 = f"""
WITH lines AS (
  SELECT doc_id, t.pos AS pos, t.line AS line, translate(trim(t.line, {_WS}), '{_UPPER}', '{_LOWER}') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(range(1, len(d.ls) + 1)) AS pos, unnest(d.ls) AS line) t),
shared AS (
  SELECT k, max(doc_id) AS keep FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.*, s.k IS NOT NULL AND l.doc_id <> s.keep AS gone FROM lines l LEFT JOIN shared s ON l.k = s.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


#: Words of a text, lower case for A-Z; then each document's distinct shingles.
OP7 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
k AS (SELECT g, min(doc_id) AS node FROM (SELECT doc_id, list_sort(g) AS g FROM s) GROUP BY g),
e AS (SELECT node, len(g) AS n, unnest(g) AS t FROM k),
p AS MATERIALIZED (
  SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.t = b.t AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT a AS x, a AS y FROM p UNION SELECT r.x, p.b FROM r JOIN p ON r.y = p.a),
c AS (SELECT x, min(y) AS least FROM r GROUP BY x)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles,
  CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE coalesce(c.least, k.node) END AS component_id
FROM s JOIN k ON list_sort(s.g) = k.g LEFT JOIN c ON c.x = k.node
"""


CHAT = """
WITH RECURSIVE a AS (
  SELECT conv_id, turn, role, text, CASE WHEN turn > 0 THEN greatest(turn - 1 - (conv_id + turn) % 3, 0) END AS p FROM conversations),
m AS (
  SELECT a.*, b.turn AS parent, len(string_split(b.text, chr(10))) AS n1, len(string_split(c.text, chr(10))) AS n2
  FROM a LEFT JOIN a b ON b.conv_id = a.conv_id AND b.turn = a.p LEFT JOIN a c ON c.conv_id = b.conv_id AND c.turn = b.p),
r AS (
  SELECT conv_id, turn, turn::VARCHAR AS path FROM m WHERE parent IS NULL
  UNION ALL SELECT m.conv_id, m.turn, r.path || '/' || m.turn FROM m JOIN r ON m.conv_id = r.conv_id AND m.parent = r.turn)
SELECT m.conv_id, m.turn, m.role, coalesce(m.parent, -1)::BIGINT AS parent_turn, r.path AS reply_path, (coalesce(n1, 0) + coalesce(n2, 0))::BIGINT AS n_quoted,
  sha256('<|' || m.role || '|>' || chr(10) || m.text || chr(10)) AS chat_sha256
FROM m JOIN r USING (conv_id, turn)
"""

_NOT = "[^ \\t\\n\\x0B\\f\\r]"
#: Words of each text, its lines with a word, and the places of words in windows of five that come twice.
QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_NOT}+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_NOT}')) AS ls FROM d),
v AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS five
  FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, five FROM g WHERE five IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
p AS (SELECT DISTINCT g.doc_id, g.i + k AS place FROM g JOIN again USING (doc_id, five), range(5) t(k)),
n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n.n, 0)::BIGINT AS n_repeat_words, len(ws) < 10 OR 100 * coalesce(n.n, 0) > 20 * len(ws) AS base_failed
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""

_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
#: The base patterns as they stand; matches that fail their rule are dropped.
PII = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+') AS e,
  regexp_extract_all(t, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)') AS i, regexp_extract_all(t, '[0-9]([ -]?[0-9])+') AS c,
  regexp_extract_all(t, '\\+[0-9][ ().0-9-]+[0-9]') AS f FROM d)
SELECT doc_id, len(e)::BIGINT AS n_email,
  len(list_filter(i, lambda x: list_max(list_transform(string_split(x, '.'), lambda y: y::HUGEINT)) <= 255))::BIGINT AS n_ip,
  len(list_filter(list_transform(c, lambda x: {_DIGITS}), lambda x: length(x) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(x) + 1),
    lambda j: CASE WHEN (length(x) - j) % 2 = 0 THEN x[j]::INT WHEN x[j]::INT > 4 THEN 2 * x[j]::INT - 9 ELSE 2 * x[j]::INT END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(list_transform(f, lambda x: {_DIGITS}), lambda x: length(x) BETWEEN 9 AND 15))::BIGINT AS n_phone
FROM k
"""

TRANSPORT = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, b, octet_length(b)::BIGINT AS n, greatest(64, (octet_length(b) + 63) // 64 * 64)::BIGINT AS m FROM d)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(b || encode(repeat(chr(0), (m - n)::INT))) AS payload_sha256 FROM n
"""




def _rounds(n: int = 10) -> str:
    """One common table for each round's assignment and one for the centroids that it leaves."""
    near = """a{k} AS MATERIALIZED (SELECT r, vec_id, x, arg_min(c, d * 64 + c) AS c, min(d) AS d FROM (
  SELECT v.r, v.vec_id, v.x, m.c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - m.x[i]) * (v.x[i] - m.x[i]))) AS d FROM v, m{k} m) GROUP BY ALL)"""
    near = near.replace("GROUP BY ALL", "GROUP BY r, vec_id, x")
    mean = """m{j} AS MATERIALIZED (SELECT m.c, coalesce(n.x, m.x) AS x FROM m{k} m LEFT JOIN (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
    SELECT c, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM a{k}, range(1, 65) t(i) GROUP BY c, i) GROUP BY c) n USING (c))"""
    return ",\n".join(near.format(k=k) + ",\n" + mean.format(k=k, j=k + 1) for k in range(n)) + ",\n" + near.format(k=n)


CLUSTERS = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::HUGEINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 8)),
{_rounds()}
SELECT vec_id, a.c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m.x, ',')) AS centroid_sha256 FROM a10 a JOIN m10 m ON a.c = m.c
"""

#: CRC32 of each distinct word by the 256 remainders of its polynomial, a step for each byte.
RESAMPLED = f"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i::BIGINT AS v FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
remainders AS MATERIALIZED (SELECT list(v ORDER BY i) AS r FROM bits WHERE k = 8),
words AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w
  FROM (SELECT doc_id, text FROM documents UNION ALL SELECT NULL, text FROM benchmark)),
once AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM words),
hashed AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)),
    lambda crc, b: xor(crc >> 8, r[xor(crc & 255, b) + 1])), 4294967295) % 10000 AS b FROM once, remainders),
f AS MATERIALIZED (SELECT doc_id, b FROM words JOIN hashed USING (w)),
sizes AS (SELECT count(*) FILTER (WHERE doc_id IS NOT NULL) AS s, count(*) FILTER (WHERE doc_id IS NULL) AS t FROM f),
gains AS (
  SELECT b, floor(1000 * ln((f.t + 1)::DOUBLE * (sizes.s + 10000)::DOUBLE / ((f.s + 1)::DOUBLE * (sizes.t + 10000)::DOUBLE)))::BIGINT AS g
  FROM (SELECT b, count(*) FILTER (WHERE doc_id IS NOT NULL) AS s, count(*) FILTER (WHERE doc_id IS NULL) AS t FROM f GROUP BY b) f, sizes),
means AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS total FROM f JOIN gains USING (b) WHERE doc_id IS NOT NULL GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || sha256('2024:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM documents d LEFT JOIN means USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, 10 * count(*) OVER () // 100 AS take FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN r <= take THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1, "op7_ngram_jaccard_join": OP7, "chat_quoted_replies": CHAT, "quality_counts": QUALITY, "pii_base_spans": PII, "transport_payloads": TRANSPORT, "op11_centroid_clustering": CLUSTERS, "op12_importance_resampling": RESAMPLED}
