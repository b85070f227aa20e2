"""Page search that multiplies only pages which can still be among the best.

An envelope holds the least and greatest value of each dimension over the unit vectors of a page's patches, so the
best cosine of a page is at most the sum, over the dimensions, of the query's value times the bound that helps it.
Envelopes are small (two rows of numbers for a page, whatever it has of patches). They are searched first: one patch
of each page gives a lower bound for the k-th best document, and pages whose envelope stays below it for every query
are left out before any patch is read again. The rows are those of ``blocks.visual_topk``.

Where query and patch differ in length both are cut to the shorter, so a page has an envelope for each pair of
lengths that occurs. Query sets too large to broadcast go to ``blocks.visual_topk`` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.operators import blocks as B
from passagework.session import written

ENVELOPE = "doc_id bigint, page int, length int, cut int, low array<double>, high array<double>, one array<double>"
SLACK = 1e-9


def _list(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.ravel()))


def envelopes(patches: DataFrame, lengths: list[int]) -> DataFrame:
    """One row for each page, patch length and cut (the shorter of that and a query length), with one of its patches."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, m in B.by_length(batch.column("embedding")):
                docs = batch.column("doc_id").to_numpy(zero_copy_only=False)[rows]
                pages = batch.column("page").to_numpy(zero_copy_only=False)[rows]
                order = np.lexsort((pages, docs))
                docs, pages, m = docs[order], pages[order], m[order]
                starts = np.r_[0, np.flatnonzero((np.diff(docs) != 0) | (np.diff(pages) != 0)) + 1]
                if not len(rows):
                    continue
                for cut in sorted({min(n, m.shape[1]) for n in lengths}):
                    unit = B._unit(m[:, :cut])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(docs[starts]), pa.array(pages[starts].astype(np.int32)), pa.array(np.full(len(starts), m.shape[1], np.int32)), pa.array(np.full(len(starts), cut, np.int32)),
                        _list(np.minimum.reduceat(unit, starts)), _list(np.maximum.reduceat(unit, starts)), _list(unit[starts]),
                    ], names=["doc_id", "page", "length", "cut", "low", "high", "one"])

    parts = patches.select("doc_id", "page", "embedding").mapInArrow(partial, ENVELOPE)
    each = lambda f, c: F.aggregate(F.collect_list(c), F.get(F.collect_list(c), F.lit(0)), lambda a, x: F.zip_with(a, x, lambda y, z: f(y, z)))
    # as many parts of a page as partitions hold it
    return parts.groupBy("doc_id", "page", "length", "cut").agg(each(F.least, "low").alias("low"), each(F.greatest, "high").alias("high"), F.first("one").alias("one"))


def _matrices(batch: pa.RecordBatch, cut: int) -> tuple[np.ndarray, ...]:
    part = batch.filter(pa.array(batch.column("cut").to_numpy(zero_copy_only=False) == cut))
    flat = lambda c: part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, cut)
    return part.column("doc_id").to_numpy(zero_copy_only=False), part.column("page").to_numpy(zero_copy_only=False), part.column("length").to_numpy(zero_copy_only=False), flat("low"), flat("high"), flat("one")


class Bounded:
    """The pages that a small query set has to look into for its k best documents."""

    def __init__(self, head: pa.Table, patches: DataFrame, k: int):
        self.k, self.spark = k, patches.sparkSession
        self.queries = B._raw(head)  # (names, values) of each query length
        self.stored = written(envelopes(patches, [m.shape[1] for _, m in self.queries]), "envelopes")
        shared = self.spark.sparkContext.broadcast(self.queries)

        def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for names, m in shared.value:
                    for cut in {min(m.shape[1], n) for n in batch.column("length").to_pylist()}:
                        docs, pages, lengths, _, _, one = _matrices(batch, cut)
                        keep = np.minimum(lengths, m.shape[1]) == cut
                        if not keep.any():
                            continue
                        scores = B._unit(m[:, :cut]) @ one[keep].T
                        rows, cols = np.repeat(np.arange(len(names)), keep.sum()), np.tile(np.arange(keep.sum()), len(names))
                        found = B._pages_table(names[rows], docs[keep][cols], pages[keep][cols], scores.ravel())
                        yield from B._best_documents(found, k).combine_chunks().to_batches()

        best = self.stored.select("doc_id", "page", "length", "cut", "low", "high", "one").mapInArrow(lower, B.PAGE_RESULT)
        best = best.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
        ranked = B.merge_topk(best.withColumnRenamed("doc_id", "id"), k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
        floors = {r["query_id"]: r["floor"] for r in ranked.where("floor is not null").collect()}  # one number a query
        self.floors = [np.array([floors.get(i, -2.0) for i in names.tolist()]) for names, _ in self.queries]

    def pages(self) -> DataFrame:
        """doc_id, page, length, ``queries`` that may find the page among their best, ``asked``: all that were bounded."""
        shared = self.spark.sparkContext.broadcast((self.queries, self.floors))

        def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries, floors = shared.value
            for batch in batches:
                for (names, m), floor in zip(queries, floors):
                    for cut in {min(m.shape[1], n) for n in batch.column("length").to_pylist()}:
                        docs, pages, lengths, low, high, _ = _matrices(batch, cut)
                        keep = np.minimum(lengths, m.shape[1]) == cut
                        if keep.any():
                            unit = B._unit(m[:, :cut])
                            bound = np.maximum(unit, 0) @ high[keep].T + np.minimum(unit, 0) @ low[keep].T
                            open_ = (bound >= floor[:, None] - SLACK).sum(axis=0)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(docs[keep]), pa.array(pages[keep]), pa.array(lengths[keep]), pa.array(open_), pa.array(np.full(len(open_), len(names)))],
                                names=["doc_id", "page", "length", "queries", "asked"],
                            )

        found = self.stored.mapInArrow(upper, "doc_id bigint, page int, length int, queries bigint, asked bigint")
        return found.groupBy("doc_id", "page", "length").agg(F.sum("queries").alias("queries"), F.sum("asked").alias("asked"))


def visual_topk(queries: DataFrame, patches: DataFrame, k: int, broadcast_limit: int = B.BROADCAST_QUERIES) -> DataFrame:
    """Like ``blocks.visual_topk``: doc_id, page, score, rank; patches of pages that cannot be among the best are not multiplied."""
    bounded = bounds(queries, patches, k, broadcast_limit)
    if bounded is None:
        return B.visual_topk(queries, patches, k, broadcast_limit)
    needed = written(bounded.pages().where("queries > 0").select("doc_id", "page", "length"), "open-pages")
    rows = _sound(patches).withColumn("length", F.size("embedding"))
    return B.visual_topk(queries, rows.join(needed, ["doc_id", "page", "length"], "left_semi"), k, broadcast_limit)


def bounds(queries: DataFrame, patches: DataFrame, k: int, broadcast_limit: int = B.BROADCAST_QUERIES) -> Bounded | None:
    """The bounded search of a query set that is small enough to broadcast, else None."""
    head = B._small(queries.select(F.col("query_id").cast("bigint"), "embedding").where("query_id is not null"), broadcast_limit)
    return None if head is None else Bounded(head, _sound(patches), k)


def _sound(patches: DataFrame) -> DataFrame:
    return patches.select(F.col("doc_id").cast("bigint"), F.col("page").cast("int"), "embedding").where("doc_id is not null and page is not null")
