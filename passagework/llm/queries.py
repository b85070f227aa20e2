"""Registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import balanced_shards, blob_ledger, bpe, content_sort, conversation_repair, cotraining, dart_minhash, pii_anchors, spaced_seeds, topk_columnar, trie_counts, warc_index, whitening

from passagework.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_warc_capture_index(spark: SparkSession, folder: str) -> DataFrame:
    found = warc_index.resolved(warc_index.round_trip(table(spark, folder, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op1_warc_capture_index"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM r
"""


@query
def op2_pii_anchor_expansion(spark: SparkSession, folder: str) -> DataFrame:
    return pii_anchors.digest(pii_anchors.find(table(spark, folder, "documents")))


@query
def op3_columnar_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").where(topk_columnar.usable(F.col("embedding")))
    vectors = rows.select("vec_id", topk_columnar.scaled(F.col("embedding")).alias("vector"))
    return topk_columnar.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


ORACLES["op3_columnar_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""


@query
def op4_bpe_merge_queue(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_balanced_label_shards(spark: SparkSession, folder: str) -> DataFrame:
    return balanced_shards.assign(table(spark, folder, "documents")).drop("digest")


@query
def op6_spaced_seed_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return spaced_seeds.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op6_spaced_seed_decontamination"] = """
WITH d AS (
  SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p
  FROM (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents)
), i AS (
  SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS q
  FROM (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM benchmark) WHERE len(w) >= 5
), m AS (
  SELECT r, doc_id, item_id, n, p - q AS o, q FROM d JOIN i USING (word)
), c AS (
  SELECT *, count(*) OVER (PARTITION BY r, item_id, n, o ORDER BY q RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS near FROM m
), g AS (
  SELECT r, doc_id, item_id, n, o, count(*) AS matched FROM c GROUP BY ALL HAVING count(*) * 5 >= n * 4 OR (n >= 13 AND max(near) >= 11)
)
SELECT doc_id, item_id, matched AS matched_words, n AS item_words, greatest(o, 0) AS first_word
FROM (SELECT *, row_number() OVER (PARTITION BY r, item_id, n ORDER BY matched DESC, greatest(o, 0)) AS k FROM g) WHERE k = 1
"""


@query
def op7_trie_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return trie_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_blob_ledger_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Two scans on one ledger: the second knows the base rules' pairs and runs only the rules that came later."""
    ledger, documents = blob_ledger.Ledger(spark, scratch_path(spark, "ledger")), table(spark, folder, "documents")
    ledger.scan(documents, rules=blob_ledger.BASE_RULES)
    paths = ledger.scan(documents)
    return blob_ledger.report(paths, ledger.findings())


@query
def op9_dart_minhash_classes(spark: SparkSession, folder: str) -> DataFrame:
    return dart_minhash.classes(table(spark, folder, "documents")).select("doc_id", "class_id", "copies")


@query
def op10_cotraining_quality(spark: SparkSession, folder: str) -> DataFrame:
    return cotraining.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op11_content_sort(spark: SparkSession, folder: str) -> DataFrame:
    return content_sort.classes(table(spark, folder, "documents"))


ORACLES["op11_content_sort"] = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW same AS (PARTITION BY t)
"""


@query
def op12_block_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


@query
def op13_branch_bound_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repair(table(spark, folder, "conversations"))


ORACLES["op13_branch_bound_repair"] = """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(
      list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS UBIGINT)),
      lambda r, b: list_reduce(range(8), lambda s, j: xor(s >> 1, (s & 1) * 3988292384), xor(r, b)), CAST(4294967295 AS UBIGINT)
    ), 4294967295) % 20 AS k FROM conversations
), d AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE k <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS x,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d
), f AS (
  SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS pair,
    CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(body, 1) IN ('.', '!', '?') THEN '.' ELSE 't' END AS fault FROM o
), w AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS t, 0 AS c, '' AS a, '' AS l FROM f GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, t, m.c, m.a, m.l FROM (
    SELECT conv_id, i, t, min({'c': c, 'a': a, 'l': l}) AS m FROM (
      SELECT w.conv_id, f.i, e.t, w.c + 3 * ins.n + e.c AS c, w.a || ins.a || e.a AS a, w.l || ins.l || e.l AS l
      FROM w
      JOIN (VALUES ('', 0, '', '', ''), ('s', 0, '', '', 's'), ('u', 0, '', '', 'u'), ('a', 0, '', '', 'a'), ('', 1, 'I', chr(10) || 'user:', 'u'), ('s', 1, 'I', chr(10) || 'user:', 'u'),
        ('u', 1, 'I', chr(10) || 'assistant:', 'a'), ('a', 1, 'I', chr(10) || 'user:', 'u'), ('', 2, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 'a'),
        ('s', 2, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 'a')) AS ins(was, n, a, l, t) ON ins.was = w.t
      JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1,
      LATERAL (
        SELECT 4 AS c, 'D' AS a, '' AS l, ins.t AS t
        UNION ALL SELECT CASE fault WHEN 't' THEN 3 ELSE 0 END, 'K', chr(10) || f.role || ':' || f.text, f.x
          WHERE fault IN ('t', '.') AND (f.x = 's' AND ins.t = '' OR f.x = CASE ins.t WHEN 'u' THEN 'a' ELSE 'u' END)
        UNION ALL SELECT CASE fault WHEN 't' THEN 6 ELSE 3 END, 'R', chr(10) || CASE ins.t WHEN 'u' THEN 'assistant:' ELSE 'user:' END || f.text, CASE ins.t WHEN 'u' THEN 'a' ELSE 'u' END
          WHERE fault IN ('t', '.')
      ) AS e
    ) GROUP BY conv_id, i, t
  )
), n AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS i FROM f GROUP BY conv_id
), b AS (
  SELECT w.conv_id, min({'c': w.c + 3 * z.n, 'a': w.a || z.a, 'l': w.l || z.l}) AS m FROM w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.i = w.i
  JOIN (VALUES ('', 0, '', ''), ('a', 0, '', ''), ('u', 1, 'I', chr(10) || 'assistant:'), ('s', 2, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')) AS z(t, n, a, l) ON z.t = w.t
  GROUP BY w.conv_id
)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(m.c, 0) AS BIGINT) AS cost, coalesce(m.a, '') AS audit, sha256(substr(coalesce(m.l, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM q.conv_id
"""
