"""Incremental jobs on Structured Streaming.

Sinks are written per micro-batch under ``batch=<id>`` with overwrite, so a batch
that is replayed after a failure replaces its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from passagework.functions.text import clean_content
from passagework.operators.chunking import chunk
from passagework.operators.evaluation import stats_columns, with_averages
from passagework.session import written

KEY = "key string, doc_id bigint"
KEYS = f"{KEY}, batch bigint"
FILES = 1000
BUCKETS = 64


def read_folder(spark: SparkSession, folder: str, schema: StructType, glob: str | None = None, fmt: str = "parquet", files: int = FILES) -> DataFrame:
    """Files as they arrive; a micro-batch takes at most ``files`` of them, so a backlog is not one batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return (reader.option("pathGlobFilter", glob) if glob else reader).format(fmt).load(folder)


def _put(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch}")


def stream_ingest(
    documents: DataFrame, out: str, strategy: str = "sentences", size: int = 1000, overlap: int = 200,
    then: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Clean and chunk documents (doc_id, text) as they arrive; content seen before is skipped.

    The seen hashes live in ``out/keys``, not in operator state, so they may grow
    with the corpus; each batch meets them in one anti-join of hashes and ids. The
    new ones are written first and only their texts move on; a batch that is
    replayed does not see its own hashes, so it puts the same chunks again. ``then`` gets the written chunks and
    the number of each batch, for instance to append them to an index; it may be called again for one batch.
    """
    spark = documents.sparkSession
    _put(spark.createDataFrame([], KEY), f"{out}/keys", -1)

    def ingest(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumn("key", F.md5("text"))
        seen = batch.sparkSession.read.schema(KEYS).parquet(f"{out}/keys").filter(F.col("batch") != batch_id)
        once = keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
        _put(once.join(seen.select("key"), "key", "left_anti"), f"{out}/keys", batch_id)
        fresh = batch.sparkSession.read.schema(KEY).parquet(f"{out}/keys/batch={batch_id}")
        new = keyed.select("key", "doc_id", "text").join(fresh, ["key", "doc_id"], "left_semi")
        new = new.dropDuplicates(["key", "doc_id"])  # one of each key; the join's keys, so texts are not dealt out again
        kept = new.withColumn("text", clean_content(F.col("text")))
        chunks = chunk(kept, strategy=strategy, size=size, overlap=overlap)
        _put(chunks, f"{out}/chunks", batch_id)
        if then is not None:
            then(batch.sparkSession.read.schema(chunks.schema).parquet(f"{out}/chunks/batch={batch_id}"), batch_id)

    return (
        documents.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def read_chunks(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/chunks").drop("batch")


def upsert(changes: DataFrame, path: str, key: str, modified: str, buckets: int = BUCKETS) -> None:
    """Brings the table at ``path`` up to date: one row for each key, the newest of what it held and what comes in.

    The table lies in folders by a hash of the key; only the folders that the changes touch are read and replaced.
    Late rows lose against newer ones, and the same changes again change nothing, so a batch may be replayed.
    Of rows of one key and time the greatest stays.
    """
    spark = changes.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = written(latest(changes, key, modified).withColumn("bucket", bucket), "changes")
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
    if not touched:
        return
    held = current(spark, path, new.schema).where(F.col("bucket").isin(touched))
    rest = [c for c in changes.columns if c != key]
    merged = latest(held.select(key, *rest).unionByName(new.select(key, *rest)), key, modified).withColumn("bucket", bucket)
    state = written(merged, "state")  # read before its folders are replaced
    # one file a folder; a folder is a bounded share of the table
    state.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def current(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table that :func:`upsert` keeps; empty before the first change."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy("bucket").parquet(path)  # the folder must be there to be read
    return spark.read.schema(schema).parquet(path)


def stream_sync(changes: DataFrame, out: str, key: str, modified: str, after: Column | None = None) -> StreamingQuery:
    """Keeps ``out/current`` as the newest row of each key; :func:`read_synced` reads it."""
    rows = changes.filter(after) if after is not None else changes
    return (
        rows.writeStream.foreachBatch(lambda batch, _: upsert(batch, out + "/current", key, modified))
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def read_synced(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/current").drop("bucket")


def latest(log: DataFrame, key: str, modified: str) -> DataFrame:
    """The newest row per key; partial maxima, so a key with very many changes is no hot group."""
    rest = [c for c in log.columns if c not in (key, modified)]
    newest = log.groupBy(key).agg(F.max(F.struct(modified, *rest)).alias("r"))
    return newest.select(key, "r.*")


def windowed_query_stats(log: DataFrame, out: str, width: str = "1 day", delay: str = "10 minutes") -> StreamingQuery:
    """Totals per tumbling window and kind, written once a window is closed by the watermark.

    ``log``: at (timestamp), kind, query_time, results, tokens, cost.
    """
    stats = (
        log.withWatermark("at", delay)
        .groupBy(F.window("at", width).alias("w"), "kind")
        .agg(*stats_columns())
        .withColumns({"start": F.col("w.start"), "end": F.col("w.end")})
        .drop("w")
    )
    return (
        with_averages(stats)
        .writeStream.format("parquet")
        .option("path", f"{out}/windows")
        .option("checkpointLocation", f"{out}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def running_query_stats(log: DataFrame, out: str) -> StreamingQuery:
    """Totals since the start per kind; each batch writes the full, small table as a version of its own."""
    stats = with_averages(log.groupBy("kind").agg(*stats_columns()))
    return (
        stats.writeStream.foreachBatch(lambda batch, batch_id: _put(batch, f"{out}/current", batch_id))
        .outputMode("complete")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def read_running_stats(spark: SparkSession, out: str) -> DataFrame:
    """The newest finished version; a version being written has no success mark yet and is not taken."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/current")
    done = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(
        spark._jvm.org.apache.hadoop.fs.Path(root, "batch=*/_SUCCESS")
    )
    newest = max(done, key=lambda f: int(f.getPath().getParent().getName().split("=")[1]))
    return spark.read.parquet(newest.getPath().getParent().toString())
