"""Dense text vectors of a fixed width (hashed TF-IDF, an option), with a cache; other embedders plug in as functions.

Text search does not use these: ``postings`` keeps every word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from passagework.functions.text import let, word_count, words
from passagework.functions.vectors import l2_normalize
from passagework.session import written

DIMENSION = 64
Embedder = Callable[[DataFrame], DataFrame]  # text -> text, embedding


def bucket(token: Column, dimension: int) -> Column:
    """Stable bucket of a token, from its md5."""
    head = F.conv(F.substring(F.md5(token), 1, 8), 16, 10)
    return (head.cast("bigint") % dimension).cast("int")


def term_counts(text: Column, dimension: int = DIMENSION) -> Column:
    """Dense token counts per bucket.

    One extra of every bucket makes each a run of the sorted array, in order.
    """
    found = F.transform(words(F.lower(text)), lambda w: bucket(w, dimension))
    everything = F.sort_array(F.concat(F.sequence(F.lit(0), F.lit(dimension - 1)), found))

    def run_sizes(s):
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))
        )
        return let(
            starts,
            lambda st: F.transform(st, lambda at, j: F.coalesce(F.get(st, j + 1), F.size(s)) - at - 1),
        )

    return let(everything, run_sizes)


def count_terms(df: DataFrame, text: str = "text", dimension: int = DIMENSION) -> DataFrame:
    """Adds ``terms``; narrow. The one heavy look at the texts: the weights and vectors only read ``terms``."""
    return df.withColumn("terms", term_counts(F.col(text), dimension))


def fit_idf(counted: DataFrame) -> DataFrame:
    """One row: the array of inverse document frequencies, ln((N + 1) / (n + 1)).

    Partial counts leave each partition, at most one row per bucket.
    """
    used = counted.select(F.posexplode("terms").alias("bucket", "n"))
    per = used.groupBy("bucket").agg(F.count("*").alias("total"), F.count_if(F.col("n") > 0).alias("with"))
    idf = per.select("bucket", F.log((F.col("total") + 1) / (F.col("with") + 1)).alias("w"))
    return idf.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "w"))), lambda s: s["w"]).alias("idf"))


def embed(counted: DataFrame, idf: DataFrame) -> DataFrame:
    """Replaces ``terms`` by ``embedding``: the unit TF-IDF vector; a blank text gets the zero vector."""
    weighted = counted.withColumn("_idf", idf.select("idf").scalar())
    vector = l2_normalize(F.zip_with("terms", "_idf", lambda n, w: n * w))
    return weighted.withColumn("embedding", vector).drop("_idf", "terms")


def embed_with(
    df: DataFrame, fn: Callable[[list[str]], list[list[float]]], dimension: int, text: str = "text", batch: int = 10
) -> DataFrame:
    """Adds ``embedding`` from any embedder that maps a list of texts to vectors, ``batch`` texts per call.

    Blank texts, and texts of a batch that fails, get the zero vector; ``embedding_error`` tells why a batch
    failed and is null otherwise, so failed rows can be kept out of an index.
    """
    added = [StructField("embedding", ArrayType(DoubleType())), StructField("embedding_error", StringType())]
    schema = StructType([*df.schema.fields, *added])
    zero = [0.0] * dimension

    def vectors(texts: list[str]) -> tuple[list[list[float]], str | None]:
        try:
            return [[float(x) for x in v] for v in fn(texts)], None
        except Exception as failed:  # the embedder is the caller's; what it raises is reported in the row
            return [zero] * len(texts), f"{type(failed).__name__}: {failed}"

    def run(frames):
        for frame in frames:
            out, errors = [zero] * len(frame), [None] * len(frame)
            filled = [i for i, t in enumerate(frame[text]) if t and t.strip()]
            for at in range(0, len(filled), batch):
                part = filled[at : at + batch]
                found, error = vectors([frame[text].iloc[i] for i in part])
                for i, v in zip(part, found):
                    out[i], errors[i] = v, error
            yield frame.assign(embedding=out, embedding_error=errors)

    return df.mapInPandas(run, schema)


def cache_key(text: Column, model: str) -> Column:
    """Null is embedded, and kept, like the empty text."""
    return F.md5(F.concat(F.lit(model + ":"), F.coalesce(text, F.lit(""))))


def cached_embed(texts: DataFrame, cache: DataFrame, embedder: Embedder, model: str) -> tuple[DataFrame, DataFrame]:
    """Vectors for all rows of ``texts`` (any columns, with ``text``) and the new cache rows.

    The embedder sees each missing text once; repeats and cached texts are looked up.
    """
    keyed = texts.withColumn("key", cache_key(F.col("text"), model))
    missing = keyed.select("key", F.coalesce("text", F.lit("")).alias("text")).join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])
    fresh = embedder(missing).select("key", "embedding")
    known = cache.select("key", "embedding", F.lit(True).alias("was_cached")).unionByName(
        fresh.withColumn("was_cached", F.lit(False))
    )
    return keyed.join(known, "key"), fresh


def open_cache(spark: SparkSession, name: str, path: str, buckets: int | None = None) -> None:
    """Creates the cache table ``name`` (key, embedding) at ``path`` if it is not there: bucketed and sorted by key.

    With fewer buckets than shuffle partitions Spark would shuffle the cache to use them all, so there are as many.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not spark.catalog.tableExists(name):
        none = spark.createDataFrame([], "key string, embedding array<double>")
        none.write.bucketBy(buckets, "key").sortBy("key").option("path", path).saveAsTable(name)


def cached_embed_table(texts: DataFrame, name: str, embedder: Embedder, model: str) -> DataFrame:
    """Like :func:`cached_embed` with a table of :func:`open_cache`, to which new vectors are added.

    Only the texts' keys are shuffled, to the buckets of the cache, which is read where it lies. Two runs at the same
    time may both add a text, so look-ups take one row for each key.
    """
    spark = texts.sparkSession
    keyed = written(texts.withColumn("key", cache_key(F.col("text"), model)), "keyed")
    known = written(known_keys(keyed, name).withColumn("was_cached", F.lit(True)), "known")
    missing = keyed.join(known, "key", "left_anti").groupBy("key").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
    fresh = written(embedder(missing).select("key", "embedding"), "fresh")
    buckets = int(spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first()["data_type"])
    fresh.repartition(buckets, "key").sortWithinPartitions("key").write.mode("append").bucketBy(buckets, "key").sortBy("key").saveAsTable(name)
    return keyed.join(known.unionByName(fresh.withColumn("was_cached", F.lit(False))), "key")


def known_keys(keyed: DataFrame, name: str) -> DataFrame:
    """key, embedding of the keys that the cache table holds."""
    asked = keyed.select("key").distinct()
    return asked.join(keyed.sparkSession.table(name).hint("merge"), "key").groupBy("key").agg(F.first("embedding").alias("embedding"))


def cache_stats(looked_up: DataFrame) -> DataFrame:
    """One row: created, hits, misses, tokens, hit_rate.

    The first row with a new text is a miss and creates a vector, later rows hit it.
    """
    per_key = looked_up.groupBy("key").agg(
        F.count("*").alias("rows"),
        F.bool_or("was_cached").alias("was_cached"),
        F.first(word_count(F.col("text"))).alias("tokens"),
    )
    misses = F.coalesce(F.sum(F.when(~F.col("was_cached"), 1).otherwise(0)), F.lit(0))
    rows = F.coalesce(F.sum("rows"), F.lit(0))
    return per_key.agg(
        misses.alias("created"),
        (rows - misses).alias("hits"),
        misses.alias("misses"),
        F.coalesce(F.sum(F.when(~F.col("was_cached"), F.col("tokens")).otherwise(0)), F.lit(0)).alias("tokens"),
        F.when(rows == 0, 0.0).otherwise((rows - misses) / rows).alias("hit_rate"),
    )
