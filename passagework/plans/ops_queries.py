"""Files, evaluation, telemetry and streams."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from passagework.operators import blocks as B
from passagework.operators import chunking as C
from passagework.operators import evaluation as EV
from passagework.plans import pipeline as P
from passagework.plans import sql_parts as S
from passagework.plans.registry import query, spread, table
from passagework.plans.text_queries import OVERLAP, SIZE, SQL_CLEAN
from passagework.plans.vector_queries import SQL_CHUNKS, SQL_SEARCH, _sql_topk, as_queries, passages, patches, text_chunks, vectors
from passagework.session import scratch_path, written
from passagework.sources import files as SF
from passagework.streaming import jobs as J

EXTENSIONS = [".txt", ".PDF", ".csv", ".exe", ".docx", "", ".xlsx"]


def stored_files(spark, folder):
    """Documents in the shape of the binary file source."""
    exts = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS)).cast("int"))
    content = F.encode("text", "UTF-8")
    return spread(table(spark, folder, "documents")).select(
        "doc_id",
        F.concat(F.lit("/data/"), "source", F.lit("/doc"), "doc_id", exts).alias("path"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'").alias("modificationTime"),
        F.octet_length(content).cast("bigint").alias("length"),
        content.alias("content"),
    )


SQL_FILES = f"""(SELECT *, 'doc' || doc_id || ext AS filename, lower(ext) AS extension, octet_length(encode(text)) AS size FROM (
  SELECT *, {S.str_list(EXTENSIONS)}[1 + doc_id % {len(EXTENSIONS)}] AS ext FROM documents))"""


@query("scan_text", "SELECT '/data/' || source || '/' || filename AS path, text FROM " + SQL_FILES)
def scan_text(spark, folder):
    return SF.scan_text(stored_files(spark, folder))


@query(
    "scan_text_files",
    """SELECT '.txt' AS extension, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes, CAST(sum(length(text) + 1) AS BIGINT) AS chars,
      count(*) > 0 AS found FROM documents""",
)
def scan_text_files(spark, folder):
    """Documents written as text files of a bounded number of documents and read back as files."""
    path = scratch_path(spark, "files")
    spread(table(spark, folder, "documents")).select("text").write.option("maxRecordsPerFile", 1000).text(path)
    files = SF.read_files(spark, path, "*.txt")
    texts = SF.scan_text(files).select("path", F.length("text").alias("n_chars"))
    return SF.file_inventory(files).join(texts, "path").groupBy("extension").agg(
        F.sum("size_bytes").alias("bytes"), F.sum("n_chars").cast("bigint").alias("chars"), (F.count("*") > 0).alias("found")
    )


@query("scan_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv(spark, folder):
    path = scratch_path(spark, "csv")
    table(spark, folder, "customer").write.option("header", "true").csv(path)
    return SF.scan_csv(spark, path)


@query(
    "file_inventory",
    f"SELECT filename, extension, size AS size_bytes, round(size / 1048576.0, 2)::DOUBLE AS size_mb, md5(text) AS file_hash FROM {SQL_FILES}",
)
def file_inventory(spark, folder):
    return SF.file_inventory(stored_files(spark, folder)).drop("path", "modified_date")


_SQL_SUPPORTED = "extension IN ('.pdf', '.docx', '.doc', '.xlsx', '.xls', '.txt', '.csv')"


@query(
    "supported_only",
    f"SELECT doc_id, {_SQL_SUPPORTED} AS success, CASE WHEN NOT {_SQL_SUPPORTED} THEN 'Unsupported file format: ' || extension END AS error FROM {SQL_FILES}",
)
def supported_only(spark, folder):
    return SF.supported(stored_files(spark, folder)).select("doc_id", "success", "error")


@query(
    "visual_only_pdf",
    f"SELECT doc_id, extension = '.pdf' AS success, CASE WHEN extension <> '.pdf' THEN 'Visual mode only supports PDF files' END AS error FROM {SQL_FILES}",
)
def visual_only_pdf(spark, folder):
    return SF.visual_supported(stored_files(spark, folder)).select("doc_id", "success", "error")


UPLOAD = 8192  # bytes; smaller than the customary limit, so that real files reach it


@query(
    "upload_validation",
    f"""SELECT doc_id, CASE WHEN size > {UPLOAD} THEN 'too large (' || printf('%.1f', size / 1048576.0) || 'MB), at most {UPLOAD / 1048576:g}MB'
      WHEN size = 0 THEN 'empty' WHEN NOT {_SQL_SUPPORTED} THEN 'unsupported extension: ' || extension END AS reason FROM {SQL_FILES}""",
)
def upload_validation(spark, folder):
    return stored_files(spark, folder).select("doc_id", SF.upload_rejection(F.col("path"), F.col("length"), UPLOAD).alias("reason"))


SQL_CHUNKED = f"""CASE WHEN {_SQL_SUPPORTED} AND len({S.words('text')}) > 0 THEN CAST(greatest(0, ceil((len({S.words('text')}) - {SIZE}) / {SIZE - OVERLAP}.0)) AS BIGINT) + 1 ELSE 0 END"""


def _ingested(spark, folder):
    """Outcome of each file: the chunks it gives, and its pages of 3,000 characters where it is a page document."""
    files = SF.supported(stored_files(spark, folder))
    texts = SF.scan_text(files.filter("success")).join(files.select("path", "doc_id"), "path").select("doc_id", "text")
    chunks = C.chunk(texts, strategy="fixed", size=SIZE, overlap=OVERLAP).groupBy("doc_id").agg(F.count("*").alias("n"))
    text = files.join(chunks, "doc_id", "left").select("path", "success", F.coalesce("n", F.lit(0)).alias("chunks"), "error")
    visual = SF.visual_supported(stored_files(spark, folder))
    pages = F.ceil(F.length(F.decode("content", "UTF-8")) / 3000).cast("bigint")
    return text, visual.select("path", "success", F.when(F.col("success"), pages).otherwise(0).alias("pages"), "error")


@query(
    "ingest_report",
    f"""SELECT {_SQL_SUPPORTED} AS success, CASE WHEN NOT {_SQL_SUPPORTED} THEN 'Unsupported file format: ' || extension END AS error,
      count(*) AS files, CAST(sum({SQL_CHUNKED}) AS BIGINT) AS total_chunks FROM {SQL_FILES} GROUP BY 1, 2""",
)
def ingest_report(spark, folder):
    return SF.ingest_report(_ingested(spark, folder)[0])


@query(
    "combine_ingest",
    f"""SELECT '/data/' || source || '/' || filename AS path, {_SQL_SUPPORTED} AS text_success, extension = '.pdf' AS visual_success,
      {SQL_CHUNKED} AS text_chunks, CASE WHEN extension = '.pdf' THEN CAST(ceil(length(text) / 3000.0) AS BIGINT) ELSE 0 END AS visual_pages,
      {_SQL_SUPPORTED} AS success, CASE WHEN NOT {_SQL_SUPPORTED} THEN 'Text: Unsupported file format: ' || extension || '; Visual: Visual mode only supports PDF files' END AS error
    FROM {SQL_FILES}""",
)
def combine_ingest(spark, folder):
    return SF.combine_ingest(*_ingested(spark, folder))


@query(
    "corpus_stats",
    f"""SELECT source, count_if({_SQL_SUPPORTED}) AS files_processed, CAST(sum(CASE WHEN extension = '.pdf' THEN ceil(length(text) / 3000.0) ELSE 0 END) AS BIGINT) AS total_pages,
      count_if(NOT {_SQL_SUPPORTED}) AS errors, true AS took_time FROM {SQL_FILES} GROUP BY source""",
)
def corpus_stats(spark, folder):
    """Statistics of an ingest that is run and timed here."""
    began = time.perf_counter()
    outcome = written(SF.combine_ingest(*_ingested(spark, folder)), "ingested")
    seconds = F.lit(time.perf_counter() - began) / outcome.count()
    files = outcome.select(F.get(F.split("path", "/"), F.lit(2)).alias("source"), "success", F.col("visual_pages").alias("pages"), seconds.alias("seconds"))
    return EV.corpus_stats(files, ("source",)).withColumn("took_time", F.col("processing_time") > 0).drop("processing_time")


# ---------------------------------------------------------------- evaluation records


def evaluation_results(spark, folder):
    """Search results as the passages of evaluation records: vectors for one retriever, pages for the other."""
    a = B.exact_topk(as_queries(spark, folder), vectors(spark, folder), 5)
    b = B.visual_topk(as_queries(spark, folder), patches(spark, folder), 3).select("query_id", F.col("doc_id").alias("id"), "score", "rank")
    both = a.withColumn("retriever_type", F.lit("text")).unionByName(b.withColumn("retriever_type", F.lit("visual")))
    return both.withColumn("completeness_score", F.lit(1.0))


SQL_EVAL = f"""e AS (SELECT query_id, 'text' AS retriever_type, score FROM ({_sql_topk(5)}) UNION ALL
    SELECT query_id, 'visual', round(score, 6) FROM (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rank FROM (
      SELECT a.vec_id AS query_id, b.label, max(round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12)) AS score FROM embeddings a, embeddings b GROUP BY ALL)) WHERE rank <= 3),
  s AS (SELECT query_id, retriever_type, avg(r) AS relevance_score, max(r) AS accuracy_score, 1.0::DOUBLE AS completeness_score,
    avg(r) * 0.4::DOUBLE + 0.3::DOUBLE + max(r) * 0.3::DOUBLE AS overall_score FROM (SELECT *, round(score, 3) AS r FROM e) GROUP BY ALL)"""
_SCORES = ("relevance_score", "accuracy_score", "completeness_score", "overall_score")
_SQL_SCORES = ", ".join(f"round({c}, 6) AS {c}" for c in _SCORES)


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in _SCORES})


@query("eval_scores", f"WITH {SQL_EVAL} SELECT query_id, retriever_type, {_SQL_SCORES} FROM s")
def eval_scores(spark, folder):
    return _rounded(EV.eval_scores(evaluation_results(spark, folder).withColumn("score", F.round("score", 6))))


@query(
    "retriever_ranking",
    f"""WITH {SQL_EVAL} SELECT query_id, retriever_type, round(overall_score, 6) AS overall_score,
      row_number() OVER (PARTITION BY query_id ORDER BY overall_score DESC, retriever_type) AS place FROM s""",
)
def retriever_ranking(spark, folder):
    scores = EV.eval_scores(evaluation_results(spark, folder).withColumn("score", F.round("score", 6)))
    return EV.retriever_ranking(scores).select("query_id", "retriever_type", F.round("overall_score", 6).alias("overall_score"), "place")


@query("scan_eval_results", f"WITH {SQL_EVAL} SELECT query_id, retriever_type, count(*) AS passages, round(sum(round(score, 6)), 6) AS total FROM e GROUP BY ALL")
def scan_eval_results(spark, folder):
    """Evaluation records written as JSON and scanned back."""
    path = scratch_path(spark, "evaluations")
    results = evaluation_results(spark, folder)
    per = results.groupBy("query_id", "retriever_type").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("content"), F.round("score", 6).alias("score")))).alias("retrieval_results")
    )
    record = F.struct(
        F.col("query_id").cast("string").alias("query"), "retriever_type", "retrieval_results", F.lit(1.0).alias("completeness_score")
    )
    per.select(F.array(record).alias("evaluations")).write.json(path)
    rows = SF.evaluation_results(SF.scan_evaluations(spark, path, multi_line=False))
    return rows.groupBy(F.col("query").cast("bigint").alias("query_id"), "retriever_type").agg(
        F.count("*").alias("passages"), F.round(F.sum("score"), 6).alias("total")
    )


# ---------------------------------------------------------------- telemetry


def query_log(events):
    """Events as a log of queries."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        "ts", "user_id", "event_id", F.col("event_type").alias("kind"), (F.col("value") / 10).alias("query_time"),
        (k % 6).alias("results"), (k * 2).alias("tokens"), F.lit(0.0).alias("cost"),
    )


SQL_LOG = """(SELECT ts, user_id, event_id, event_type AS kind, value / 10 AS query_time, k % 6 AS results, k * 2 AS tokens, 0.0::DOUBLE AS cost
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
_SQL_STATS = """count(*) AS total_queries, round(sum(query_time), 4) AS total_query_time, CAST(sum(results) AS BIGINT) AS total_results_returned,
  CAST(sum(tokens) AS BIGINT) AS total_tokens_used, sum(cost) AS total_cost, round(sum(query_time) / count(*), 6) AS avg_query_time,
  round(sum(results) / count(*), 6) AS avg_results_per_query"""


def _rounded_stats(df):
    return df.withColumns(
        {"total_query_time": F.round("total_query_time", 4), "avg_query_time": F.round("avg_query_time", 6), "avg_results_per_query": F.round("avg_results_per_query", 6)}
    )


@query("query_stats", f"SELECT kind, {_SQL_STATS} FROM {SQL_LOG} GROUP BY kind")
def query_stats(spark, folder):
    return _rounded_stats(EV.query_stats(query_log(table(spark, folder, "events")), ("kind",)))


@query(
    "running_stats",
    f"""WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(query_time) AS t, sum(results) AS r, sum(tokens) AS k FROM {SQL_LOG} GROUP BY 1)
    SELECT day, CAST(sum(n) OVER w AS BIGINT) AS total_queries, round(sum(t) OVER w, 4) AS total_query_time, CAST(sum(r) OVER w AS BIGINT) AS total_results_returned,
      CAST(sum(k) OVER w AS BIGINT) AS total_tokens_used, 0.0::DOUBLE AS total_cost, round(sum(t) OVER w / sum(n) OVER w, 6) AS avg_query_time,
      round(sum(r) OVER w / sum(n) OVER w, 6) AS avg_results_per_query FROM d WINDOW w AS (ORDER BY day)""",
)
def running_stats(spark, folder):
    log = query_log(table(spark, folder, "events"))
    return _rounded_stats(EV.running_stats(log, F.date_format("ts", "yyyy-MM-dd"), "day"))


@query(
    "recent_history",
    """SELECT user_id, event_id, event_type, n AS recency FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3""",
)
def recent_history(spark, folder):
    e = table(spark, folder, "events").select("user_id", "event_id", "event_type", "ts")
    return EV.recent_history(e, "user_id", "ts", "event_id").drop("ts")


@query(
    "index_summary",
    f"""WITH {SQL_CHUNKS} SELECT (SELECT count(DISTINCT doc_id) FROM chunks) AS total_documents, (SELECT count(*) FROM chunks) AS total_chunks, true AS text_ready,
      count(DISTINCT label) AS visual_documents, count(DISTINCT (label, vec_id % 5)) AS pages_indexed, true AS visual_ready FROM embeddings""",
)
def index_summary(spark, folder):
    return EV.index_summary(text_chunks(spark, folder), patches(spark, folder))


# ---------------------------------------------------------------- streams


def arriving(spark, folder, name):
    """A table as it arrives: one file or a folder of them. A stream takes a file by a pattern only."""
    return J.read_folder(spark, f"{folder}/{name}.parque[t]", table(spark, folder, name).schema)


def event_stream(spark, folder):
    log = query_log(arriving(spark, folder, "events"))
    # The times are UTC without a zone; a watermark needs instants.
    return log.withColumn("at", F.convert_timezone(F.lit("UTC"), F.current_timezone(), "ts").cast("timestamp"))


@query(
    "stream_query_stats",
    f"""SELECT epoch(w)::BIGINT AS start_second, kind, {_SQL_STATS} FROM (SELECT *, date_trunc('day', ts) AS w FROM {SQL_LOG})
    WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY w, kind""",
)
def stream_query_stats(spark, folder):
    """Closed daily windows, as a stream writes them."""
    out = scratch_path(spark, "stats")
    J.windowed_query_stats(event_stream(spark, folder), out).awaitTermination()
    rows = spark.read.parquet(f"{out}/windows")
    return _rounded_stats(rows).withColumn("start_second", F.unix_timestamp("start")).drop("start", "end")


@query("stream_running_stats", f"SELECT kind, {_SQL_STATS} FROM {SQL_LOG} GROUP BY kind")
def stream_running_stats(spark, folder):
    out = scratch_path(spark, "running")
    J.running_query_stats(event_stream(spark, folder), out).awaitTermination()
    return _rounded_stats(J.read_running_stats(spark, out))


@query(
    "stream_sync",
    """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events
      WHERE ts > TIMESTAMP '2024-01-10 00:00:00') WHERE n = 1""",
)
def stream_sync(spark, folder):
    """The newest change per user since the last sync, brought in over several batches, with late and repeated rows."""
    out, source = scratch_path(spark, "sync"), scratch_path(spark, "changes")
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", "value")
    late = events.repartition(3, F.xxhash64("event_id"))  # every file holds old and new rows
    late.unionByName(events.where("event_id % 5 = 0")).write.parquet(source)
    changes = J.read_folder(spark, source, events.schema, files=1)
    since = F.col("ts") > F.expr("TIMESTAMP_NTZ'2024-01-10 00:00:00'")
    J.stream_sync(changes, out, "user_id", "ts", since).awaitTermination()
    return J.read_synced(spark, out).drop("ts")


@query(
    "stream_to_index",
    "WITH " + SQL_SEARCH.replace("FROM documents) WHERE len(words) > 0", f"FROM (SELECT doc_id, {SQL_CLEAN.format('text', 'length(l) + 1')} AS text FROM (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text))) WHERE len(words) > 0")
    + " SELECT query_id, id, round(score, 6) AS score, rank FROM hits",
)
def stream_to_index(spark, folder):
    """Documents stream in, their chunks are appended to an index, and the index is searched: as one built from all."""
    out, source = scratch_path(spark, "ingest"), scratch_path(spark, "arriving")
    table(spark, folder, "documents").select("doc_id", "text").repartition(3, "text").write.option("compression", "zstd").parquet(source)
    docs = J.read_folder(spark, source, table(spark, folder, "documents").select("doc_id", "text").schema, files=1)

    def append(chunks, batch):
        P.append_to_index(chunks.select((F.shiftleft("doc_id", 20) + F.col("chunk_number")).alias("id"), F.col("content").alias("text")), f"{out}/index", batch)

    J.stream_ingest(docs, out, strategy="fixed", size=SIZE, overlap=OVERLAP, then=append).awaitTermination()
    hits = P.search_index(passages(spark, folder).withColumnRenamed("text", "query"), f"{out}/index")
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "stream_ingest",
    f"""WITH d AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text), c AS (SELECT doc_id, {SQL_CLEAN.format('text', 'length(l) + 1')} AS t FROM d),
    w AS (SELECT doc_id, {S.words('t')} AS words FROM c)
    SELECT doc_id, CAST(greatest(0, ceil((len(words) - 200) / 160.0)) AS BIGINT) + 1 AS chunks FROM w WHERE len(words) > 0""",
)
def stream_ingest(spark, folder):
    out = scratch_path(spark, "ingest")
    docs = arriving(spark, folder, "documents").select("doc_id", "text")
    J.stream_ingest(docs, out, strategy="fixed", size=200, overlap=40).awaitTermination()
    return J.read_chunks(spark, out).groupBy("doc_id").agg(F.count("*").alias("chunks"))
