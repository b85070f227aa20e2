"""Vectors: validity, similarity, search, fusion, cache and store."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from passagework.functions import vectors as V
from passagework.operators import blocks as B
from passagework.operators import cells as CE
from passagework.operators import chunking as C
from passagework.operators import containment as CT
from passagework.operators import embedding as E
from passagework.operators import envelopes as EN
from passagework.operators import postings as PO
from passagework.operators import similar_pairs as SP
from passagework.plans import sql_parts as S
from passagework.plans.registry import query, spread, table
from passagework.plans.text_queries import OVERLAP, SIZE
from passagework.session import scratch_path, written
from passagework.sources import vector_store as ST

SQL_UNIT = "list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))"


def embeddings(spark, folder):
    return spread(table(spark, folder, "embeddings"))


def vectors(spark, folder):
    return embeddings(spark, folder).select(F.col("vec_id").alias("id"), "embedding")


def as_queries(spark, folder):
    return embeddings(spark, folder).select(F.col("vec_id").alias("query_id"), "embedding")


def _whole(vector, scale=1e5):
    """Every value of a vector as a whole number, so that all of them are compared."""
    return F.transform(vector, lambda x: F.round(x.cast("double") * scale).cast("int"))


@query(
    "l2_normalize",
    f"""SELECT vec_id, list_transform({SQL_UNIT}, lambda x: CAST(round(x * 1e5) AS INT)) AS unit
    FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 5)) AS v FROM embeddings)""",
)
def l2_normalize(spark, folder):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 5))
    unit = embeddings(spark, folder).select("vec_id", V.l2_normalize(scaled).alias("u"))
    return unit.select("vec_id", _whole("u").alias("unit"))


@query(
    "cosine",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query(
    "vector_validity",
    """SELECT label % 3 AS kind, CASE WHEN label % 3 = 0 THEN true ELSE false END AS valid, count(*) AS vectors FROM embeddings GROUP BY 1, 2""",
)
def vector_validity(spark, folder):
    kind = F.col("label") % 3
    v = (
        F.when(kind == 1, F.slice("embedding", 1, 63))
        .when(kind == 2, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float"))))
        .otherwise(F.col("embedding"))
    )
    return embeddings(spark, folder).groupBy(kind.alias("kind"), V.is_valid_vector(v, 64).alias("valid")).agg(
        F.count("*").alias("vectors")
    )


def _sql_topk(k: int, sound: str = "true") -> str:
    return f"""SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(s, 6) AS score,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY round(s, 9) DESC, b.vec_id) AS rank
      FROM embeddings a, (SELECT * FROM embeddings WHERE {sound}) b, LATERAL (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s)) WHERE rank <= {k}"""


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


@query("exact_search", _sql_topk(5))
def exact_search(spark, folder):
    return _rounded(B.exact_topk(as_queries(spark, folder), vectors(spark, folder), 5))


@query("exact_search_grid", _sql_topk(5))
def exact_search_grid(spark, folder):
    """The way taken when the query set is too large to broadcast."""
    return _rounded(B.exact_topk(as_queries(spark, folder), vectors(spark, folder), 5, broadcast_limit=0))


SPOILED = "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN slice(embedding, 1, 9) WHEN id % 13 = 0 THEN transform(embedding, (x, i) -> IF(i = 3, double('NaN'), x)) ELSE embedding END"


def _spoiled(spark, folder):
    """Vectors of which some are null, too short or hold NaN."""
    return vectors(spark, folder).select("id", F.expr(SPOILED).alias("embedding"))


_SQL_SOUND = _sql_topk(5, "vec_id % 7 <> 0 AND vec_id % 11 <> 0 AND vec_id % 13 <> 0")


@query("exact_search_spoiled", _SQL_SOUND)
def exact_search_spoiled(spark, folder):
    return _rounded(B.exact_topk(as_queries(spark, folder), _spoiled(spark, folder), 5))


@query("exact_search_grid_spoiled", _SQL_SOUND)
def exact_search_grid_spoiled(spark, folder):
    return _rounded(B.exact_topk(as_queries(spark, folder), _spoiled(spark, folder), 5, broadcast_limit=0))


@query(
    "find_most_similar",
    """WITH q AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (
        SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label)
    SELECT * FROM (SELECT label AS query_id, vec_id AS id, round(s, 6) AS score, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) AS rank
      FROM (SELECT q.label, vec_id, list_cosine_similarity(v, embedding::DOUBLE[]) AS s FROM q, embeddings)) WHERE rank <= 5""",
)
def find_most_similar(spark, folder):
    tokens = embeddings(spark, folder).select(F.col("label").cast("bigint").alias("query_id"), "embedding")
    return _rounded(B.exact_topk(B.mean_query_vectors(tokens), vectors(spark, folder), 5))


@query("exact_search_lengths", _sql_topk(5).replace("embedding::DOUBLE[]", "embedding[1 : 24 + 8 * CAST(vec_id % 3 AS INT)]::DOUBLE[]").replace(
    "FROM embeddings a, (SELECT * FROM embeddings WHERE true) b", "FROM embeddings a JOIN embeddings b ON a.vec_id % 3 = b.vec_id % 3").replace(
    "a.embedding[1 : 24 + 8 * CAST(vec_id", "a.embedding[1 : 24 + 8 * CAST(a.vec_id").replace("b.embedding[1 : 24 + 8 * CAST(vec_id", "b.embedding[1 : 24 + 8 * CAST(b.vec_id"))
def exact_search_lengths(spark, folder):
    """Vectors of three lengths in one table; each query meets its own."""
    cut = lambda df, c: df.withColumn("embedding", F.slice("embedding", F.lit(1), (24 + 8 * (F.col(c) % 3)).cast("int")))
    return _rounded(B.exact_topk(cut(as_queries(spark, folder), "query_id"), cut(vectors(spark, folder), "id"), 5))


@query(
    "vector_report",
    """SELECT verdict, length, count(*) AS vectors FROM (SELECT CASE WHEN vec_id % 7 = 0 THEN 'no vector' WHEN vec_id % 11 <> 0 AND vec_id % 13 = 0 THEN 'not finite' ELSE 'searched' END AS verdict,
      CASE WHEN vec_id % 7 = 0 THEN 0 WHEN vec_id % 11 = 0 THEN 9 ELSE len(embedding) END AS length FROM embeddings) GROUP BY ALL""",
)
def vector_report(spark, folder):
    return B.vector_report(_spoiled(spark, folder))


def cell_index(spark, folder):
    path = scratch_path(spark, "cells")
    CE.build(vectors(spark, folder), path, cells=20, iterations=5)
    return path


@query("cell_search", _sql_topk(5).replace("SELECT * FROM (SELECT a.vec_id", "SELECT query_id, id, score, rank, true AS proved FROM (SELECT a.vec_id"))
def cell_search(spark, folder):
    """Stored cells, probed until the bounds prove the result."""
    return _rounded(CE.search(as_queries(spark, folder), cell_index(spark, folder), 5, nprobe=4))


APPROX = {"nprobe": 14, "rounds": 1}  # of 20 cells: these vectors hardly cluster; recall 0.95


@query("approx_search")
def approx_search(spark, folder):
    """The bounded form; ``approx_recall`` holds it to a recall of 0.9."""
    return _rounded(CE.search(as_queries(spark, folder), cell_index(spark, folder), 5, **APPROX))


@query("approx_recall", "SELECT count(*) AS queries, true AS recall_reaches_90 FROM embeddings")
def approx_recall(spark, folder):
    found = CE.search(as_queries(spark, folder), cell_index(spark, folder), 5, **APPROX).select("query_id", "id", F.lit(1).alias("hit"))
    exact = B.exact_topk(as_queries(spark, folder), vectors(spark, folder), 5).select("query_id", "id")
    return exact.join(found, ["query_id", "id"], "left").agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") >= F.lit(0.9) * F.count("*")).alias("recall_reaches_90"))


def patches(spark, folder):
    """Multi-vector documents: a document per label, five pages each."""
    return embeddings(spark, folder).select(
        F.col("label").cast("bigint").alias("doc_id"), (F.col("vec_id") % 5 + 1).cast("int").alias("page"),
        F.col("vec_id").alias("patch_index"), "embedding",
    )


def token_queries(spark, folder):
    """A query per residue; those with an even number have vectors of 48 values, so that search cuts the pages'."""
    values = F.when(F.col("vec_id") % 2 == 0, F.slice("embedding", 1, 48)).otherwise(F.col("embedding"))
    return embeddings(spark, folder).select((F.col("vec_id") % 20).alias("query_id"), values.alias("embedding"))


SQL_MAXSIM = """q AS (SELECT query_id, list(m ORDER BY i) AS v FROM (SELECT vec_id % 20 AS query_id, i, avg(x::DOUBLE) AS m FROM (
    SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN embedding[1:48] ELSE embedding END AS e FROM embeddings)
  ) GROUP BY ALL) GROUP BY query_id),
  p AS (SELECT CAST(label AS BIGINT) AS doc_id, CAST(vec_id % 5 + 1 AS INT) AS page, embedding::DOUBLE[] AS e FROM embeddings),
  pages_scored AS (SELECT query_id, doc_id, page, max(round(list_cosine_similarity(v, e[1:len(v)]), 12)) AS score FROM q, p GROUP BY ALL)"""


@query(
    "maxsim_pages",
    f"""WITH {SQL_MAXSIM} SELECT query_id, doc_id, page, round(score, 6) AS score FROM pages_scored WHERE doc_id IN (query_id % 10, (query_id + 3) % 10)""",
)
def maxsim_pages(spark, folder):
    q = B.mean_query_vectors(token_queries(spark, folder))
    own = q.select("query_id", F.explode(F.array(F.col("query_id") % 10, (F.col("query_id") + 3) % 10)).alias("doc_id"))
    return _rounded(B.maxsim_pages(own, q, patches(spark, folder)))


SQL_VISUAL = f"""{SQL_MAXSIM}, docs AS (SELECT query_id, doc_id, max(score) AS score, arg_min(page, (-score, page)) AS page FROM pages_scored GROUP BY ALL),
  visual AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM docs)"""


@query("visual_topk", f"WITH {SQL_VISUAL} SELECT query_id, doc_id, page, round(score, 6) AS score, rank FROM visual WHERE rank <= 5")
def visual_topk(spark, folder):
    q = B.mean_query_vectors(token_queries(spark, folder))
    return _rounded(B.visual_topk(q, patches(spark, folder), 5))


@query("visual_topk_grid", f"WITH {SQL_VISUAL} SELECT query_id, doc_id, page, round(score, 6) AS score, rank FROM visual WHERE rank <= 5")
def visual_topk_grid(spark, folder):
    q = B.mean_query_vectors(token_queries(spark, folder))
    return _rounded(B.visual_topk(q, patches(spark, folder), 5, broadcast_limit=0))


@query("visual_topk_bounded", f"WITH {SQL_VISUAL} SELECT query_id, doc_id, page, round(score, 6) AS score, rank FROM visual WHERE rank <= 5")
def visual_topk_bounded(spark, folder):
    """Pages whose envelope stays below the k-th best are not multiplied."""
    q = B.mean_query_vectors(token_queries(spark, folder))
    return _rounded(EN.visual_topk(q, patches(spark, folder), 5))


@query(
    "pages_skipped",
    """SELECT count(*) AS pages, CAST(count(*) * 20 AS BIGINT) AS asked, true AS skips_counted FROM (SELECT DISTINCT label, vec_id % 5 FROM embeddings)""",
)
def pages_skipped(spark, folder):
    """How many (query, page) the envelopes leave out."""
    found = EN.bounds(B.mean_query_vectors(token_queries(spark, folder)), patches(spark, folder), 5).pages()
    return found.agg(F.count("*").alias("pages"), F.sum("asked").alias("asked"), (F.sum("queries") <= F.sum("asked")).alias("skips_counted"))


@query(
    "similarity_report",
    """SELECT expected, warning, count(*) AS pairs FROM (SELECT a.label = b.label AS expected, CASE WHEN a.label = b.label AND s < 0.7 THEN 'similar pair scores low'
        WHEN a.label <> b.label AND s > 0.5 THEN 'different pair scores high' END AS warning
      FROM embeddings a JOIN embeddings b ON b.vec_id > a.vec_id, LATERAL (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s)) GROUP BY ALL""",
)
def similarity_report(spark, folder):
    """The monitor over all labelled pairs."""
    return SP.similarity_report(embeddings(spark, folder))


@query(
    "hybrid_fuse",
    f"""WITH {SQL_VISUAL},
    w AS (SELECT query_id, list(m ORDER BY i) AS v FROM (SELECT vec_id % 20 AS query_id, i, avg(x::DOUBLE) AS m FROM (
      SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY query_id),
    t AS (SELECT query_id, vec_id AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
      SELECT query_id, vec_id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 12) AS score FROM w, embeddings)),
    u AS (SELECT query_id, 'text' AS source, id, score, score * 0.6::DOUBLE AS weighted_score, 0 AS s, rank AS r FROM t WHERE rank <= 10
      UNION ALL SELECT query_id, 'visual', doc_id, score, score * (1.0::DOUBLE - 0.6::DOUBLE), 1, rank FROM visual WHERE rank <= 10)
    SELECT query_id, source, id, round(score, 6) AS score, round(weighted_score, 6) AS weighted_score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weighted_score DESC, s, r) AS rank FROM u) WHERE rank <= 5""",
)
def hybrid_fuse(spark, folder):
    q = B.mean_query_vectors(token_queries(spark, folder))
    whole = B.mean_query_vectors(embeddings(spark, folder).select((F.col("vec_id") % 20).alias("query_id"), "embedding"))
    text = B.exact_topk(whole, vectors(spark, folder), 10)
    visual = B.visual_topk(q, patches(spark, folder), 10).withColumnRenamed("doc_id", "id")
    return _rounded(B.hybrid_fuse(text, visual, 5, 0.6)).withColumn("weighted_score", F.round("weighted_score", 6))


@query(
    "similarity_monitor",
    """SELECT expected, warning, count(*) AS pairs, round(avg(s), 6) AS mean_score FROM (
      SELECT a.label = b.label AS expected, s, CASE WHEN a.label = b.label AND s < 0.7 THEN 'similar pair scores low'
        WHEN a.label <> b.label AND s > 0.5 THEN 'different pair scores high' END AS warning
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1,
      LATERAL (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s)) GROUP BY ALL""",
)
def similarity_monitor(spark, folder):
    e = table(spark, folder, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"), F.col("label").alias("l2"))
    pairs = e.join(nxt, "vec_id").withColumn("expected", F.col("label") == F.col("l2"))
    seen = B.similarity_monitor(pairs, V.cosine(F.col("embedding"), F.col("e2")), F.col("expected"))
    return seen.groupBy("expected", "warning").agg(F.count("*").alias("pairs"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(
    "patch_explode",
    """SELECT vec_id AS doc_id, i // 4 + 1 AS page, i AS patch_index, round(list_sum(embedding[i * 8 + 1 : i * 8 + 8]::DOUBLE[]), 6) AS total
    FROM embeddings, range(8) AS r(i)""",
)
def patch_explode(spark, folder):
    nested = F.transform(
        F.sequence(F.lit(0), F.lit(1)),
        lambda p: F.transform(
            F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", p * 32 + i * 8 + 1, 8)
        ),
    )
    rows = ST.patch_explode(embeddings(spark, folder).select(F.col("vec_id").alias("doc_id"), nested.alias("pages")))
    total = F.aggregate(V.as_double(F.col("embedding")), F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", "page", "patch_index", F.round(total, 6).alias("total"))


@query(
    "append_vectors",
    f"""SELECT id, vec_id, list_transform({SQL_UNIT}, lambda x: CAST(round(x * 1e5) AS INT)) AS unit FROM (
      SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY label >= 5, label, vec_id) - 1 AS id FROM embeddings)""",
)
def append_vectors(spark, folder):
    """A stored batch, a second one appended after its ids, and both read back."""
    path, rows = scratch_path(spark, "store"), table(spark, folder, "embeddings")
    ST.write_vectors(ST.prepare_vectors(rows.where("label < 5"), 64, ["label", "vec_id"]), path)
    ST.write_vectors(ST.prepare_vectors(rows.where("label >= 5"), 64, ["label", "vec_id"], ST.read_vectors(spark, path)), path)
    return ST.read_vectors(spark, path).select("id", "vec_id", _whole("embedding").alias("unit"))


@query("embed_batch", "SELECT doc_id, CASE WHEN trim(text) = '' THEN [0, 0] ELSE [length(text), length(text) - length(replace(text, 'e', ''))] END AS counts FROM documents")
def embed_batch(spark, folder):
    """An embedder of one's own, called with lists of texts."""
    rows = E.embed_with(table(spark, folder, "documents").select("doc_id", "text"), _letters, 2)
    return rows.where("embedding_error is null").select("doc_id", F.col("embedding").cast("array<int>").alias("counts"))


def _letters(texts):
    return [[len(t), t.count("e")] for t in texts]


@query(
    "vector_table_roundtrip",
    "SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1e5) AS INT)) AS vector FROM embeddings",
)
def vector_table_roundtrip(spark, folder):
    path = scratch_path(spark, "vectors")
    stored = embeddings(spark, folder).select(F.col("vec_id").alias("id"), F.col("label").alias("cell"), "embedding")
    ST.write_vectors(stored, path, by_cell=True)
    return ST.read_vectors(spark, path).select("id", F.col("cell").alias("label"), _whole("embedding").alias("vector"))


@query(
    "vector_by_id",
    f"""SELECT o_orderkey, vec_id AS id, label, list_transform({SQL_UNIT}, lambda x: CAST(round(x * 1e5) AS INT)) AS unit
    FROM orders JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) ON vec_id = o_custkey""",
)
def vector_by_id(spark, folder):
    """Look-ups for a table of requests: an equi-join on the id."""
    asked = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    store = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label", V.l2_normalize(F.col("embedding")).alias("e"))
    return asked.join(store, "id").select("o_orderkey", "id", "label", _whole("e").alias("unit"))


@query(
    "store_stats",
    """SELECT count(*) AS text_vectors, max(len(embedding)) AS text_dimension, count(DISTINCT label) AS visual_documents, count(*) AS visual_patches,
      max(len(embedding)) AS visual_dimension, 2 * count(*) AS metadata_entries FROM embeddings""",
)
def store_stats(spark, folder):
    return ST.multimodal_stats(vectors(spark, folder), patches(spark, folder))


# ---------------------------------------------------------------- text vectors

SQL_BUCKET = "CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT) % 64"


def sql_tfidf(docs: str, fit: str, prefix: str) -> str:
    """CTEs with the unit TF-IDF vectors of ``docs`` (id, text), weights from ``fit``."""
    return f"""{prefix}_tok AS (SELECT id, {SQL_BUCKET.format('w')} AS b, count(*) AS n FROM (SELECT id, unnest({S.words('lower(text)')}) AS w FROM {docs}) GROUP BY ALL),
    {prefix}_w AS (SELECT t.id, t.b, t.n * i.idf AS x FROM {prefix}_tok t JOIN {fit} i USING (b)),
    {prefix}_v AS (SELECT id, b, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM {prefix}_w QUALIFY sum(x * x) OVER (PARTITION BY id) > 0)"""


SQL_CHUNKS = f"""chunks AS (SELECT doc_id * 1048576 + k AS id, doc_id, array_to_string(words[k * {SIZE - OVERLAP} + 1 : k * {SIZE - OVERLAP} + {SIZE}], ' ') AS text
  FROM (SELECT doc_id, words, unnest(range(0, CAST(greatest(0, ceil((len(words) - {SIZE}) / {SIZE - OVERLAP}.0)) AS BIGINT) + 1)) AS k
    FROM (SELECT doc_id, {S.words('text')} AS words FROM documents) WHERE len(words) > 0))"""
SQL_WORDS = f"""SELECT id, w, 1 + ln(count(*)) AS x FROM (SELECT id, unnest({S.words('lower(text)')}) AS w FROM {{0}}) GROUP BY ALL"""
SQL_VECTORS = f"""c_w AS ({SQL_WORDS.format('chunks')}), c_v AS (SELECT id, w, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM c_w)"""
SQL_SEARCH = f"""{SQL_CHUNKS}, {SQL_VECTORS},
  idf AS (SELECT w, ln(((SELECT count(*) FROM chunks) + 1) / (count(*) + 1)) AS idf FROM c_w GROUP BY w),
  asked AS (SELECT item_id AS id, text FROM benchmark),
  q_v AS (SELECT id, w, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM (SELECT id, w, x * idf AS x FROM ({SQL_WORDS.format('asked')}) JOIN idf USING (w)) WHERE x > 0),
  hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM (
    SELECT q_v.id AS query_id, c_v.id, sum(q_v.x * c_v.x) AS score FROM q_v JOIN c_v USING (w) GROUP BY ALL)) WHERE rank <= 5)"""


def text_chunks(spark, folder, which="true", found=None):
    """Chunks of all documents; with ``found`` (ids of chunks), of the documents that these lie in."""
    docs = spread(table(spark, folder, "documents").where(which))
    if found is not None:
        docs = docs.join(found.select(F.shiftright("id", 20).alias("doc_id")).distinct(), "doc_id", "left_semi")
    chunks = docs.select("doc_id", F.posexplode(C.fixed_texts(F.col("text"), SIZE, OVERLAP)).alias("chunk_number", "content"))
    packed = F.when(F.col("chunk_number") < 1 << 20, F.shiftleft("doc_id", 20) + F.col("chunk_number"))
    return chunks.select(F.coalesce(packed, F.raise_error(F.lit("a document has too many chunks for packed ids"))).alias("id"), "doc_id", F.col("content").alias("text"))


def passages(spark, folder):
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def text_index(spark, folder):
    path = scratch_path(spark, "postings")
    PO.put(text_chunks(spark, folder), path, 0)
    return path


def text_search(spark, folder, k=5):
    return PO.search_once(passages(spark, folder), text_chunks(spark, folder), k, "text")


@query(
    "embed_text",
    f"""WITH {SQL_CHUNKS}, {SQL_VECTORS} SELECT id, count(*) AS words, md5(string_agg(w || ':' || CAST(round(x * 1e6) AS BIGINT), ' ' ORDER BY w)) AS vector_md5 FROM c_v GROUP BY id""",
)
def embed_text(spark, folder):
    """Every word of every chunk's vector and its weight."""
    v = PO.vectors(text_chunks(spark, folder))
    pairs = F.zip_with("terms", "weights", lambda t, x: F.concat(t, F.lit(":"), F.round(x * 1e6).cast("bigint")))
    return v.select("id", F.size("terms").cast("bigint").alias("words"), F.md5(F.array_join(pairs, " ")).alias("vector_md5"))


@query(
    "blocks_read",
    f"""WITH {SQL_SEARCH} SELECT count(DISTINCT query_id) AS queries, true AS some_skipped FROM hits""",
)
def blocks_read(spark, folder):
    """How many runs of postings a search leaves unread."""
    found = PO.Plan(passages(spark, folder), text_index(spark, folder), 5, "text").report()
    return found.agg(F.count("*").alias("queries"), (F.sum("blocks_read") < F.sum("blocks")).alias("some_skipped"))


@query(
    "passage_chunks",
    f"""WITH {SQL_CHUNKS}, b AS (SELECT item_id, text FROM benchmark UNION ALL SELECT item_id + 1000000, array_slice(string_split(text, ' '), 3, 5)[1] || ' ' || string_split(text, ' ')[4] FROM benchmark)
    SELECT item_id AS query_id, id FROM b JOIN chunks ON contains(chunks.text, b.text)""",
)
def passage_chunks(spark, folder):
    """The chunks that hold each passage, and those that hold two words out of its middle."""
    asked = passages(spark, folder)
    short = asked.select((F.col("query_id") + 1_000_000).alias("query_id"), F.concat_ws(" ", F.get(F.split("text", " "), F.lit(2)), F.get(F.split("text", " "), F.lit(3))).alias("text"))
    return CT.contained(asked.unionByName(short), text_chunks(spark, folder))


@query("text_search", f"WITH {SQL_SEARCH} SELECT query_id, id, round(score, 6) AS score, rank FROM hits")
def text_search_query(spark, folder):
    return _rounded(text_search(spark, folder))


SQL_CACHE = """known AS (SELECT DISTINCT md5('tfidf:' || text) AS key FROM documents WHERE lang <> 'en'),
  all_rows AS (SELECT doc_id, md5('tfidf:' || text) AS key, text FROM documents)"""


def _cached(spark, folder):
    docs = spread(table(spark, folder, "documents")).select("doc_id", "lang", "text")
    filled = docs.select("lang", E.cache_key(F.col("text"), "tfidf").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    counted = written(E.count_terms(filled).select("key", "lang", "terms"), "counted")  # the one look at the texts
    idf, once = E.fit_idf(counted), counted.select("key", "terms")
    cache = E.embed(counted.filter(F.col("lang") != "en").select("key", "terms").dropDuplicates(["key"]), idf)
    embedder = lambda m: E.embed(once.join(m.select("key"), "key", "left_semi").dropDuplicates(["key"]), idf)
    return E.cached_embed(docs.select("doc_id", "text"), cache, embedder, "tfidf")


@query(
    "embedding_cache",
    f"""WITH {SQL_CACHE}, d AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents),
    tok AS (SELECT id, {SQL_BUCKET.format('w')} AS b, count(*) AS n FROM (SELECT id, unnest({S.words('lower(text)')}) AS w FROM d) GROUP BY ALL),
    weights AS (SELECT b, ln(((SELECT count(*) FROM d) + 1) / (count(*) + 1)) AS idf FROM tok GROUP BY b),
    {sql_tfidf('d', 'weights', 'd')},
    sums AS (SELECT id, sum(x) AS total, sum(x * b) AS weighted FROM d_v GROUP BY id)
    SELECT doc_id, a.key, k.key IS NOT NULL AS was_cached, round(coalesce(total, 0), 5) AS total, round(coalesce(weighted, 0), 4) AS weighted
    FROM all_rows a LEFT JOIN known k USING (key) LEFT JOIN sums ON id = doc_id""",
)
def embedding_cache(spark, folder):
    rows, _ = _cached(spark, folder)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.transform("embedding", lambda x, b: x * b), F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", "key", "was_cached", F.round(total, 5).alias("total"), F.round(weighted, 4).alias("weighted"))


@query(
    "embedding_cache_runs",
    """SELECT doc_id, lang <> 'en' OR text IN (SELECT text FROM documents WHERE lang <> 'en') AS was_cached, length(text) AS embedding FROM documents""",
)
def embedding_cache_runs(spark, folder):
    """A cache table kept over two runs: the first fills it from all but the English texts."""
    name = "cache_" + os.path.basename(scratch_path(spark, "x"))[2:]
    docs, path = table(spark, folder, "documents").select("doc_id", "lang", "text"), scratch_path(spark, "cache")
    E.open_cache(spark, name, path)
    embedder = lambda m: m.withColumn("embedding", F.array(F.length("text").cast("double")))
    E.cached_embed_table(docs.where("lang <> 'en'"), name, embedder, "lengths")
    rows = E.cached_embed_table(docs, name, embedder, "lengths")
    return rows.select("doc_id", "was_cached", F.col("embedding")[0].cast("int").alias("embedding"))


@query(
    "cache_stats",
    f"""WITH {SQL_CACHE}, g AS (SELECT key, count(*) AS n, any_value(text) AS text FROM all_rows GROUP BY key),
    m AS (SELECT count(*) AS created, sum(len({S.words('text')})) AS tokens FROM g WHERE key NOT IN (SELECT key FROM known))
    SELECT created, (SELECT count(*) FROM documents) - created AS hits, created AS misses, tokens,
      round(((SELECT count(*) FROM documents) - created) / (SELECT count(*) FROM documents), 6) AS hit_rate FROM m""",
)
def cache_stats(spark, folder):
    return E.cache_stats(_cached(spark, folder)[0]).withColumn("hit_rate", F.round("hit_rate", 6))
