"""Registered queries of the training-data operators: each over its whole table, with the SQL that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import bpe, embeddings, fingerprints, html_text, language, minhash, mixing, prefix_trie, repair, token_counts, token_files, top_products, warc
from touchline.llm.common import table


def embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"))


def minhash_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(table(spark, sf_dir, "documents"))


#: Shares of the mixed tokens.
WEIGHTS = {"high": 0.8, "low": 0.12, "toxic": 0.08}


def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.quality_domains(table(spark, sf_dir, "labels"))
    got = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text"), labels, WEIGHTS)
    return got.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "domain", "posteriors", "rate")


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), files=True)


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def language_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def top_products_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products.top_products(table(spark, sf_dir, "embeddings"))


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(table(spark, sf_dir, "conversations"))


#: Cosines of all pairs, then the smallest id reachable.
EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), r AS (
  SELECT vec_id AS node, vec_id AS seen FROM v
  UNION
  SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a
)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.low AS component_id, v.vec_id = c.low AS kept
FROM v JOIN (SELECT node, min(seen) AS low FROM r GROUP BY node) c ON c.node = v.vec_id
"""

#: Base32 of the SHA-1: eight groups of 20 bits, four letters each.
WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha1(t) AS h FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first,
    list_transform(range(8), lambda k: CAST('0x' || substr(h, CAST(5 * k + 1 AS BIGINT), 5) AS BIGINT)) AS g FROM d
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(g, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x >> s) & 31) + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""

#: Exact Jaccard of all pairs that share a shingle, then the smallest id reachable.
MINHASH_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS t FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
    ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.low AS component_id, d.doc_id = c.low AS kept
FROM documents d JOIN (SELECT node, min(seen) AS low FROM r GROUP BY node) c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

#: Products of each query with all other rows, ranked.
TOP_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, a.r, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0
), k AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""

#: Unsigned CRC-32 of the ASCII text `s`, bit by bit.
CRC_SQL = """xor(4294967295::BIGINT, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(s, ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, x: list_reduce(list_concat([xor(c, x)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda d, y: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384::BIGINT) ELSE d >> 1 END)))"""

#: Nodes as lists of turns; members, children and subtrees by comparing prefixes.
TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS u, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), w AS (
  SELECT u, any_value(CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT)) AS words FROM t GROUP BY u
), c AS (
  SELECT conv_id, list(u ORDER BY turn NULLS FIRST, u) AS units, CAST(conv_id AS VARCHAR) AS s FROM t GROUP BY conv_id
), k AS (
  SELECT conv_id, units, conv_id - conv_id % 20 AS base, {CRC_SQL} % 4 AS h FROM c
), r AS (
  SELECT k.conv_id, list_concat(coalesce(b.units, [])[1:k.h], k.units[k.h + 1:]) AS seq FROM k LEFT JOIN c b ON b.conv_id = k.base
), p AS (
  SELECT conv_id, d AS depth, seq[1:d] AS node, d = len(seq) AS whole FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM r)
), n AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, node[1:depth - 1] AS up,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE whole), '')) AS ends_sha256
  FROM p GROUP BY node, depth
), m AS (
  SELECT up AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up
), x AS (
  SELECT n.*, coalesce(m.n_children, 0) AS n_children, CAST((n_convs - 1) * coalesce(w.words, 0) AS BIGINT) AS saved
  FROM n LEFT JOIN m ON m.node = n.node LEFT JOIN w ON w.u = n.node[n.depth]
), y AS (
  SELECT a.node, CAST(sum(b.saved) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves
  FROM x a JOIN x b ON b.node[1:a.depth] = a.node GROUP BY a.node
)
SELECT x.conv_id, x.depth, q.conv_id AS parent_conv_id, x.n_convs, x.n_children, y.n_leaves, y.saved_tokens, x.ends_sha256
FROM x JOIN y ON y.node = x.node LEFT JOIN n q ON x.depth > 0 AND q.node = x.up
"""

#: Cheapest edits of each state row by row; of equal cost the first in ASCII order, which no other is the start of.
REPAIR_SQL = f"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS s FROM conversations
), k AS (
  SELECT *, {CRC_SQL} % 20 AS k FROM o
), d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k CROSS JOIN (VALUES (1), (2)) c(copy) WHERE k <> 0 AND (copy = 1 OR k = 3)
), e AS (
  SELECT *, sha256(concat(length(role), ':', role, text)) AS g FROM d
), f AS (
  SELECT *, row_number() OVER w AS i, substr(role, 1, 1) AS a, lag(substr(role, 1, 1)) OVER w AS b,
    NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS short
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(role, 1, 1), g)
), z AS (
  SELECT *, CASE WHEN blank THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, g ORDER BY i) > 1 THEN 'duplicate' WHEN short THEN 'truncated' ELSE '' END AS fault FROM f
), totals AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE b IS NOT NULL AND b || a NOT IN ('su', 'ua', 'au')) AS illegal
  FROM z GROUP BY conv_id
), inserts AS (
  SELECT * FROM (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (2, 3, 2, 'I'), (3, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 3, 4, 'II')) x(p, q, cost, edit)
), step AS (
  SELECT * FROM (VALUES ('s', 0, 1, 'K', 0), ('u', 0, 2, 'K', 0), ('u', 1, 2, 'K', 0), ('u', 3, 2, 'K', 0), ('a', 2, 3, 'K', 0),
    (NULL, 0, 2, 'R', 2), (NULL, 1, 2, 'R', 2), (NULL, 3, 2, 'R', 2), (NULL, 2, 3, 'R', 2), (NULL, 0, 0, 'D', 3), (NULL, 1, 1, 'D', 3), (NULL, 2, 2, 'D', 3), (NULL, 3, 3, 'D', 3)) x(initial, p, q, edit, cost)
), walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit FROM totals
  UNION ALL
  SELECT conv_id, i, q, cost, audit FROM (
    SELECT walk.conv_id, z.i, step.q, walk.cost + inserts.cost + step.cost + CASE WHEN z.fault = 'truncated' AND step.edit <> 'D' THEN 1 ELSE 0 END AS cost, walk.audit || inserts.edit || step.edit AS audit
    FROM walk JOIN z ON z.conv_id IS NOT DISTINCT FROM walk.conv_id AND z.i = walk.i + 1 JOIN inserts ON inserts.p = walk.state
    JOIN step ON step.p = inserts.q AND (step.initial IS NULL OR step.initial = z.a) AND (step.edit = 'D' OR z.fault NOT IN ('blank', 'duplicate'))
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1
), finish AS (
  SELECT t.conv_id, w.cost + CASE state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END AS cost, w.audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit
  FROM totals t JOIN walk w ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.i = t.n
  QUALIFY row_number() OVER (PARTITION BY t.conv_id ORDER BY w.cost + CASE state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, w.audit) = 1
), edits AS (
  SELECT conv_id, j, audit[j] AS edit, length(replace(audit[1:j], 'I', '')) AS i, length(replace(audit[1:j], 'D', '')) AS place FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS j FROM finish)
), lines AS (
  SELECT e.conv_id, e.j, e.edit, e.place, z.role, z.text, max(CASE WHEN e.edit = 'K' AND z.a = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
  FROM edits e LEFT JOIN z ON e.edit <> 'I' AND z.conv_id IS NOT DISTINCT FROM e.conv_id AND z.i = e.i
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS t
  FROM lines WHERE edit <> 'D' GROUP BY conv_id
)
SELECT c.conv_id, coalesce(t.gaps, 0) AS gaps, coalesce(t.blank, 0) AS blank, coalesce(t.duplicate, 0) AS duplicate, coalesce(t.truncated, 0) AS truncated,
  coalesce(t.illegal, 0) AS illegal, coalesce(CAST(w.cost AS BIGINT), 0) AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(x.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN finish w ON w.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM c.conv_id
"""

QUERIES = {
    "op1_embedding_links": embedding_links,
    "op2_page_texts": page_texts,
    "op3_token_shards": token_shards,
    "op4_minhash_copies": minhash_copies,
    "op5_mixed_sources": mixed_sources,
    "op6_byte_bpe": byte_bpe,
    "op7_document_fingerprints": document_fingerprints,
    "op8_whole_token_counts": whole_token_counts,
    "op9_language_predictions": language_predictions,
    "op10_warc_records": warc_records,
    "op11_top_products": top_products_query,
    "op12_conversation_trie": conversation_trie,
    "op13_conversation_repair": conversation_repair,
}
ORACLES = {"op1_embedding_links": EMBEDDING_SQL, "op4_minhash_copies": MINHASH_SQL, "op10_warc_records": WARC_SQL, "op11_top_products": TOP_SQL, "op12_conversation_trie": TRIE_SQL, "op13_conversation_repair": REPAIR_SQL}
