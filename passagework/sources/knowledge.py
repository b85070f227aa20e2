"""Scans of knowledge articles and support cases.

Articles: id, title, body, created, modified, status, language, record_type.
Cases: id, case_number, subject, description, status, priority, created, closed
and, when known, product and category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions import constants as K
from passagework.functions.text import strip


def published(articles: DataFrame) -> DataFrame:
    """Articles that may be searched; plain predicates, so they reach the scan."""
    for column, value in K.ARTICLE_FILTER.items():
        articles = articles.filter(F.col(column) == value)
    return articles


def scan_articles(articles: DataFrame, limit: int | None = None) -> DataFrame:
    """The published articles, or the ``limit`` newest; an empty body is replaced by a note."""
    body = F.coalesce(F.nullif(F.col("body"), F.lit("")), F.concat(F.lit("No content available for "), "title"))
    newest = _newest(published(articles), "modified", limit)
    return newest.select(
        "id", "title", body.alias("content"), "created", "modified", "status", "language",
        F.lit(K.ARTICLE_SOURCE).alias("source"),
    )


def _newest(df: DataFrame, column: str, limit: int | None) -> DataFrame:
    return df if limit is None else df.orderBy(F.desc(column), "id").limit(limit)


def _solved(cases: DataFrame) -> DataFrame:
    return cases.filter((F.col("status") == "Closed") & (F.col("description") != ""))


def scan_closed_cases(cases: DataFrame, limit: int | None = None) -> DataFrame:
    """The closed cases with a description, which is also the solution, or the ``limit`` last closed."""
    newest = _newest(_solved(cases), "closed", limit)
    optional = [F.col(c) if c in cases.columns else F.lit("").alias(c) for c in ("product", "category")]
    return newest.select(
        "id", "case_number", F.col("subject").alias("title"), F.col("description").alias("problem"),
        F.col("description").alias("solution"), "status", "priority", "created", "closed", *optional,
        F.lit(K.CASE_SOURCE).alias("source"),
    )


def changed_articles(articles: DataFrame, last_sync: Column) -> DataFrame:
    """Online articles modified after the last sync; every language and record type."""
    return articles.filter((F.col("status") == K.ARTICLE_FILTER["status"]) & (F.col("modified") > last_sync))


def changed_cases(cases: DataFrame, last_sync: Column) -> DataFrame:
    return _solved(cases).filter(F.col("closed") > last_sync)


def incremental_scan(articles: DataFrame, cases: DataFrame, last_sync: Column) -> DataFrame:
    """Both kinds of changes in one table. Sort by (kind, changed desc) to read the newest first."""
    a = changed_articles(articles, last_sync).select(
        F.lit("article").alias("kind"), "id", "title", F.col("body").alias("content"), F.col("modified").alias("changed")
    )
    c = changed_cases(cases, last_sync).select(
        F.lit("case").alias("kind"), "id", F.col("subject").alias("title"), F.col("description").alias("content"),
        F.col("closed").alias("changed"),
    )
    return a.unionByName(c)


def _present(label: str, column: str) -> Column:
    return F.when(F.col(column) != "", F.concat(F.lit(f"{label}: "), F.col(column)))


def unify_sources(articles: DataFrame, cases: DataFrame) -> DataFrame:
    """One document shape for both scans; 'summary' and 'article_type' may be missing."""
    for c in ("summary", "article_type"):
        if c not in articles.columns:
            articles = articles.withColumn(c, F.lit(None).cast("string"))
    docs_a = articles.select(
        strip(F.concat_ws("\n\n", "title", "summary", "content")).alias("content"),
        "source", F.col("id").alias("source_id"), "title", F.lit("knowledge_article").alias("type"), "created",
        "modified", "article_type",
    )
    problem = F.coalesce(F.nullif(F.col("problem"), F.lit("")), F.lit("No problem description available"))
    solution = F.coalesce(F.nullif(F.col("solution"), F.lit("")), F.lit("No solution available"))
    context = F.concat_ws(
        ", ", _present("Product", "product"), _present("Category", "category"), _present("Priority", "priority")
    )
    docs_c = cases.select(
        strip(
            F.concat_ws(
                "\n\n", "title", F.concat(F.lit("Problem: "), problem), F.concat(F.lit("Solution: "), solution),
                F.nullif(context, F.lit("")),
            )
        ).alias("content"),
        "source", F.col("id").alias("source_id"), "title", F.lit("case_solution").alias("type"), "created", "closed",
        "priority", "product", "category",
    )
    return docs_a.unionByName(docs_c, allowMissingColumns=True)
