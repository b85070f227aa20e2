"""Whole-question pipelines: text answers, candidates of all sources, the selected answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions import constants as K
from passagework.functions.query import expand_query
from passagework.functions.text import clean_answer, strip_html
from passagework.operators import answers as A
from passagework.operators import knowledge as KB
from passagework.operators import postings as PO
from passagework.operators import selection as R
from passagework.session import written


FEW_HITS = 100_000

#: What each source has answered with, in tokens, whether it was chosen or not.
SPENT = {K.PAGE_IMAGE_SOURCE: "image_tokens", K.KNOWLEDGE_SOURCE: "knowledge_tokens", K.TEXT_SOURCE: "text_tokens"}


def _described(chunks: DataFrame) -> DataFrame:
    """id, text, filename, page; the last two are null where unknown."""
    known = {c: F.col(c) if c in chunks.columns else F.lit(None).cast("string") for c in ("filename", "page")}
    return chunks.select("id", "text", *[v.alias(c) for c, v in known.items()])


def append_to_index(chunks: DataFrame, path: str, batch: int) -> None:
    """Adds chunks (id, text and, when known, filename, page) as ``batch``; only the new texts are read.

    A batch that is put again replaces itself, so a job that died can be run again. Searches weigh words by all
    batches, so the order and the cut of the batches change no result.
    """
    kept = _described(chunks)
    kept.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/chunks/batch={batch}")
    PO.put(chunks.sparkSession.read.schema(kept.schema).parquet(f"{path}/chunks/batch={batch}"), path, batch)


def build_index(chunks: DataFrame, path: str) -> None:
    """Stores the first chunks below ``path``."""
    append_to_index(chunks, path, 0)


def _hits(queries: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``search`` finds; equal questions are searched once."""
    asks, stands = KB.once_each(queries.select("query_id", "query"), ["query"])
    return KB.for_all(written(search(asks), "hits"), stands)


def _with_contents(hits: DataFrame, contents: DataFrame) -> DataFrame:
    """Hits that are proven to be few are broadcast, and then no text is shuffled."""
    few = hits.limit(FEW_HITS + 1).count() <= FEW_HITS
    return contents.join(F.broadcast(hits) if few else hits, "id")


def search_index(queries: DataFrame, path: str, k: int = 5) -> DataFrame:
    """The k best stored chunks per query with content, filename and page; contents are read for the hits only."""
    hits = _hits(queries, lambda asks: PO.search(asks, path, k))
    stored = queries.sparkSession.read.parquet(f"{path}/chunks")
    return _with_contents(hits, stored.select("id", F.col("text").alias("content"), "filename", "page"))


def search_text(queries: DataFrame, chunks: DataFrame, k: int = 5, lookup: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The k best chunks per query with content and file; contents are joined after the ranking.

    ``queries``: query_id, query; ``chunks``: id, text and, when known, filename, page. ``lookup`` gives the chunks of
    some ids (and perhaps others), where that costs less than to make all chunks again.
    """
    hits = _hits(queries, lambda asks: PO.search_once(asks, chunks, k))
    held = chunks if lookup is None else lookup(hits.select("id"))
    return _with_contents(hits, _described(held).withColumnRenamed("text", "content"))


def text_query(queries: DataFrame, chunks: DataFrame, k: int = 5, lookup: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Question to answer with sources, for every query of the table."""
    return A.text_answers(queries, search_text(queries, chunks, k, lookup))


def knowledge_answers(queries: DataFrame, articles: DataFrame, asked: DataFrame, limit: int = 3) -> DataFrame:
    """The best article per query and its answer; searched with ``asked``, answered for ``queries``."""
    found = KB.intent_search(asked, articles, limit)
    best = KB.rescore_articles(found, queries)
    full = best.join(articles.select("article_id", "body"), "article_id")
    content = full.withColumn("content", strip_html(F.col("body")))
    return content.select(
        "query_id",
        KB.article_answer(F.col("query"), F.col("title"), F.col("content"), F.col("relevance_score")).alias("answer"),
        F.col("relevance_score").alias("score"),
    )


def gather_candidates(
    text: DataFrame | None = None, visual: DataFrame | None = None, knowledge: DataFrame | None = None
) -> DataFrame:
    """One candidate per source and query, in the order the sources are asked.

    ``text``: query_id, answer, confidence; ``visual``: query_id, rank, content, score;
    ``knowledge``: query_id, answer, score.
    """
    def side(df: DataFrame, position: int, source: str, success: Column, answer: str, score: str) -> DataFrame:
        return df.select(
            "query_id", F.lit(position).alias("position"), F.lit(source).alias("source_type"),
            success.alias("success"), F.col(answer).alias("answer"), F.col(score).alias("score"),
        )

    parts = []
    if text is not None:
        parts.append(side(text, 0, K.TEXT_SOURCE, F.col("success"), "answer", "confidence"))
    if visual is not None:
        parts.append(side(visual.filter(F.col("rank") == 1), 1, K.PAGE_IMAGE_SOURCE, F.lit(True), "content", "score"))
    if knowledge is not None:
        parts.append(side(knowledge, 2, K.KNOWLEDGE_SOURCE, F.lit(True), "answer", "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def answer_all_sources(
    queries: DataFrame, chunks: DataFrame, articles: DataFrame, visual: DataFrame | None = None, k: int = 5,
    lookup: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Ask every source, rank the candidates, return the cleaned best answer and token counts."""
    asked = queries.select("query_id", expand_query(F.col("query")).alias("query"))
    text = text_query(asked, chunks, k, lookup)
    # At most one row per source and query; written so that later filters do not compute the answers again.
    found = written(gather_candidates(text, visual, knowledge_answers(queries, articles, asked)), "candidates")
    best = R.select_best(found.join(queries, "query_id"), queries)
    used = [F.coalesce(F.sum(F.when(F.col("source_type") == s, R.estimated_tokens(F.col("answer")))), F.lit(0.0)).alias(c) for s, c in SPENT.items()]
    joined = best.join(queries, "query_id").join(found.groupBy("query_id").agg(*used), "query_id")
    cleaned = clean_answer(F.col("answer"), F.col("source_type"))
    tokens = R.token_breakdown(F.col("query"), cleaned, *(F.col(c) for c in SPENT.values()))
    return joined.select(
        "query_id", "success", "source_type", cleaned.alias("answer"), "score", "rerank_score", "combined_score",
        R.confidence_band(F.col("combined_score")).alias("confidence_band"), tokens["total_tokens"].alias("total_tokens"),
    )
