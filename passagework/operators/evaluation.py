"""Retrieval metrics, evaluation scores and telemetry; all partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.text import word_count

QUERY = "query_id"


def query_metrics(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Per query: number, average and maximum score of its results, token and cost estimate."""
    found = results.groupBy(QUERY).agg(
        F.count("*").alias("total_results"), F.avg("score").alias("avg_score"), F.max("score").alias("max_score")
    )
    joined = queries.select(QUERY, (word_count(F.col("query")) * 2).alias("tokens_used")).join(found, QUERY, "left")
    return joined.na.fill(0, ["total_results"]).na.fill(0.0, ["avg_score", "max_score"]).withColumn(
        "cost_estimate", F.lit(0.0)
    )


_STATS = {
    "total_queries": lambda: F.count("*"),
    "total_query_time": lambda: F.sum("query_time"),
    "total_results_returned": lambda: F.sum("results"),
    "total_tokens_used": lambda: F.sum("tokens"),
    "total_cost": lambda: F.sum("cost"),
}


def stats_columns() -> list[Column]:
    """Totals of a query log: query_time, results, tokens, cost."""
    return [f().alias(n) for n, f in _STATS.items()]


def with_averages(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("total_queries"), F.lit(1))
    return stats.withColumns(
        {"avg_query_time": F.col("total_query_time") / n, "avg_results_per_query": F.col("total_results_returned") / n}
    )


def query_stats(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return with_averages(log.groupBy(*by).agg(*stats_columns()))


def running_stats(log: DataFrame, bucket: Column, name: str = "bucket") -> DataFrame:
    """Totals up to and including each time bucket.

    The log is reduced to one row per bucket first; only those rows are ordered.
    """
    per = log.groupBy(bucket.alias(name)).agg(*stats_columns())
    so_far = Window.orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return with_averages(per.select(name, *[F.sum(c).over(so_far).alias(c) for c in _STATS]))


def corpus_stats(files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Files processed, pages, errors and time of ingested files: success, pages, seconds."""
    return files.groupBy(*by).agg(
        F.count_if("success").alias("files_processed"),
        F.coalesce(F.sum("pages"), F.lit(0)).alias("total_pages"),
        F.count_if(~F.col("success")).alias("errors"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("processing_time"),
    )


def eval_scores(results: DataFrame, keys: tuple[str, ...] = (QUERY, "retriever_type"), completeness: str = "completeness_score") -> DataFrame:
    """Relevance, accuracy and overall score per query and retriever from its result scores."""
    rounded = F.round("score", 3)
    out = results.groupBy(*keys).agg(
        F.avg(rounded).alias("relevance_score"), F.max(rounded).alias("accuracy_score"), F.max(completeness).alias(completeness)
    )
    overall = F.col("relevance_score") * 0.4 + F.col(completeness) * 0.3 + F.col("accuracy_score") * 0.3
    return out.withColumn("overall_score", overall)


def retriever_ranking(scores: DataFrame, query: str = QUERY) -> DataFrame:
    """Retrievers of each query by overall score; place 1 is the best one."""
    w = Window.partitionBy(query).orderBy(F.desc("overall_score"), "retriever_type")
    return scores.withColumn("place", F.row_number().over(w))


def recent_history(log: DataFrame, user: str, at: str, tie: str, n: int = 3) -> DataFrame:
    """The last ``n`` entries per user, newest first; partitions drop older ones before the exchange."""
    w = Window.partitionBy(user).orderBy(F.desc(at), F.desc(tie))
    return log.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)


def index_summary(chunks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Documents and chunks indexed and, with page vectors, visual documents and pages."""
    text = chunks.agg(F.countDistinct("doc_id").alias("total_documents"), F.count("*").alias("total_chunks"))
    text = text.withColumn("text_ready", F.col("total_chunks") > 0)
    if pages is None:
        return text
    per_doc = pages.select("doc_id", "page").distinct().groupBy("doc_id").agg(F.count("*").alias("n"))
    visual = per_doc.agg(
        F.count("*").alias("visual_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("pages_indexed")
    ).withColumn("visual_ready", F.col("visual_documents") > 0)
    # Two one-row tables side by side.
    both = text.unionByName(visual, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
