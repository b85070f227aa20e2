import json

from pyspark.sql import functions as F

from passagework.operators import evaluation as EV
from passagework.sources import files as SF
from passagework.streaming import jobs as J


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("café\r\nx".encode("utf-8"))
    (tmp_path / "b.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "c.exe").write_bytes(b"zz")
    files = SF.read_files(spark, str(tmp_path))
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in SF.scan_text(files).collect()}
    assert texts == {"a.TXT": "café\nx", "b.txt": "café", "c.exe": "zz"}
    inv = {r.filename: r for r in SF.file_inventory(files).collect()}
    assert inv["a.TXT"].extension == ".txt" and inv["c.exe"].size_bytes == 2
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in SF.supported(files).collect()}
    assert errors == {"a.TXT": None, "b.txt": None, "c.exe": "Unsupported file format: .exe"}


def test_upload_reasons(spark):
    rows = [("/x/a.pdf", 300 * 1024 * 1024), ("/x/a.pdf", 0), ("/x/a.bin", 5), ("/x/noext", 5), ("/x/a.csv", 5)]
    df = spark.createDataFrame(rows, "p string, n bigint")
    got = [r.x for r in df.select(SF.upload_rejection(F.col("p"), F.col("n")).alias("x")).collect()]
    assert got == ["too large (300.0MB), at most 200MB", "empty", "unsupported extension: .bin", "unsupported extension: ", None]


def test_csv_types(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Company,Revenue\nAmazon,469822000000\n")
    df = SF.scan_csv(spark, str(tmp_path))
    assert dict(df.dtypes) == {"Company": "string", "Revenue": "bigint"}


def test_evaluation_records(spark, tmp_path):
    record = {
        "query": "q", "best_retriever": "text",
        "evaluations": [
            {
                "query": "q", "retriever_type": "text", "completeness_score": 1.0,
                "retrieval_results": [{"content": "a", "score": s} for s in (0.501, 0.347, 0.32)],
            }
        ],
    }
    (tmp_path / "e.json").write_text(json.dumps(record, indent=2))
    results = SF.evaluation_results(SF.scan_evaluations(spark, str(tmp_path)))
    s = EV.eval_scores(results, ("query", "retriever_type")).first()
    assert round(s.overall_score, 5) == 0.60603 and s.accuracy_score == 0.501


def test_stream_ingest_skips_seen_content(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def put(rows):
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(src)

    def run():
        docs = J.read_folder(spark, src, spark.read.parquet(src).schema)
        J.stream_ingest(docs, out, strategy="fixed", size=3, overlap=0).awaitTermination()
        return sorted((r.doc_id, r.content) for r in J.read_chunks(spark, out).collect())

    put([(1, "a b c d"), (2, "a b c d")])
    assert run() == [(1, "a b c"), (1, "d")]
    put([(3, "a b c d"), (4, "new text")])
    assert run() == [(1, "a b c"), (1, "d"), (4, "new text")]
    assert run() == [(1, "a b c"), (1, "d"), (4, "new text")]


def test_stream_ingest_over_many_batches_of_one_run(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    texts = [["a b", "c d", "a b"], ["a b", "e f"], ["e f", "g h", None], ["c d", "g h"]]
    for n, part in enumerate(texts):
        rows = [(10 * n + k // 2, t) for k, t in enumerate(part)]
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(src)
    docs = J.read_folder(spark, src, spark.read.parquet(src).schema, files=1)
    J.stream_ingest(docs, out, strategy="fixed", size=3, overlap=0).awaitTermination()
    chunks = spark.read.parquet(f"{out}/chunks")
    assert sorted(r.content for r in chunks.collect()) == ["a b", "c d", "e f", "g h"]
    assert chunks.select("batch").distinct().count() >= 3


def test_stream_sync_keeps_the_newest(spark, tmp_path):
    """Three runs with late, repeated and equal-time rows; state is one row a key, and no log grows."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, 5, "a"), (2, 1, "b")], [(1, 7, "c"), (2, 0, "d"), (3, 2, "e")], [(1, 6, "late"), (3, 2, "f"), (2, 1, "b"), (None, 1, "n")]):
        spark.createDataFrame(rows, "id bigint, modified bigint, v string").write.mode("append").parquet(src)
        J.stream_sync(J.read_folder(spark, src, spark.read.parquet(src).schema), out, "id", "modified", F.col("modified") > 0).awaitTermination()
    state = J.read_synced(spark, out)
    want = [(None, 1, "n"), (1, 7, "c"), (2, 1, "b"), (3, 2, "f")]
    assert sorted(((r.id, r.modified, r.v) for r in state.collect()), key=str) == sorted(want, key=str)
    J.upsert(state, f"{out}/current", "id", "modified")  # a replay changes nothing
    assert sorted(((r.id, r.modified, r.v) for r in J.read_synced(spark, out).collect()), key=str) == sorted(want, key=str)


def test_upsert_replaces_only_what_changes_touch(spark, tmp_path):
    path = str(tmp_path / "state")
    J.upsert(spark.range(200).selectExpr("id", "1 as modified", "'old' as v"), path, "id", "modified", buckets=8)
    before = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "state").glob("bucket=*/part-*")}
    J.upsert(spark.createDataFrame([(5, 2, "new")], "id long, modified int, v string"), path, "id", "modified", buckets=8)
    J.upsert(spark.createDataFrame([], "id long, modified int, v string"), path, "id", "modified", buckets=8)
    after = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "state").glob("bucket=*/part-*")}
    assert len(before) == len(after) == 8 and len(set(before.items()) - set(after.items())) == 1
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 200 and [r.v for r in rows if r.id == 5] == ["new"]


def test_metrics_keep_queries_without_results(spark):
    q = spark.createDataFrame([(1, "a b"), (2, "c")], "query_id bigint, query string")
    r = spark.createDataFrame([(1, 0.5), (1, 0.7)], "query_id bigint, score double")
    got = {x.query_id: (x.total_results, round(x.avg_score, 6), x.max_score, x.tokens_used) for x in EV.query_metrics(q, r).collect()}
    assert got == {1: (2, 0.6, 0.7, 4), 2: (0, 0.0, 0.0, 2)}


def test_streams_read_tables_of_one_file_and_of_many(spark, folder, tmp_path):
    from passagework.plans.catalog import QUERIES

    for name in ("documents", "events"):
        spark.read.parquet(f"{folder}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for query in ("stream_ingest", "stream_running_stats"):
        one, many = (sorted(map(str, QUERIES[query](spark, at).collect())) for at in (folder, str(tmp_path)))
        assert one == many and one


def test_what_streams_in_is_stored_small(spark, tmp_path):
    """chunks lay beside the index in Spark's faster and larger default format."""
    spark.createDataFrame([(1, "some text"), (2, "some other text")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    docs = J.read_folder(spark, str(tmp_path / "in"), "doc_id long, text string")
    J.stream_ingest(docs, str(tmp_path / "out")).awaitTermination()
    files = list((tmp_path / "out" / "chunks").rglob("*.parquet"))
    assert files and all(f.name.endswith(".zstd.parquet") for f in files if f.is_file())
