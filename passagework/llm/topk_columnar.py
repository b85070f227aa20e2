"""Exact top-k by inner product of integer vectors: columnar branch and bound.

Candidates are dealt into shards and queries into blocks, both by hash and both of bounded size; each
(block, shard) cell is one group of one task. Inside a cell the candidates lie dimension by dimension.
Partial products are added up one block of dimensions at a time; after each block the mass that remains
(the norms of the rest of both vectors) bounds what a candidate may still gain or lose, and candidates whose
upper bound is below the k-th best lower bound are compacted away. Every cell returns its k best; a window
that Spark limits before the shuffle merges them.

Each candidate is copied once per query block and each query once per shard, so data moved grows with
``vectors x blocks + queries x shards``; blocks and shards hold up to ``CELL_ROWS`` rows each.

Defined cases: rows without id, null vectors and vectors with null or non-finite components take no part;
only vectors of equal length meet; a query never meets rows of its own id; equal scores go to the smaller
id; repeated candidate rows count as often as they occur; repeated query rows give one result; an empty
table gives no rows; scores beyond 64 bits are set to the nearest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_ROWS = 65_536
DIMENSIONS = 16
QUERY_ROWS = 64
RESULT = "query_id long, query_key long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """Whether a vector has finite components only."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def scaled(vector: Column, factor: int = 64) -> Column:
    """``floor(factor * x)`` of every component."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")))


def _numbers(lists: pa.ChunkedArray, dimension: int) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in lists.chunks] or [np.empty(0, np.int64)])
    return flat.reshape(-1, dimension) if dimension else np.zeros((len(lists), 0), np.int64)


def _exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """The smallest type in which every partial product is exact."""
    most = a.shape[1] * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0))
    return np.float32 if most < 2**23 else np.float64 if most < 2**52 else object


def branch_and_bound(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """For each query: positions of its k best candidates and their scores, best first."""
    kind = _exact_type(queries, vectors)
    order = np.argsort(-np.square(vectors.astype(float)).sum(axis=0), kind="stable")
    blocks = [order[i : i + DIMENSIONS] for i in range(0, len(order), DIMENSIONS)] or [order]
    columns = [np.ascontiguousarray(vectors[:, b].T.astype(kind)) for b in blocks]
    rows = [queries[:, b].astype(kind) for b in blocks]
    rest = lambda parts, axis: np.sqrt(np.cumsum([np.square(p.astype(float)).sum(axis=axis) for p in parts][::-1], axis=0)[::-1])
    left, asked = rest(columns, 0), rest(rows, 1)
    for start in range(0, len(queries), QUERY_ROWS):
        first = rows[0][start : start + QUERY_ROWS] @ columns[0]
        for q, score in enumerate(first, start):
            alive = np.flatnonzero(ids != own[q])
            score = score[alive]
            for b in range(1, len(blocks) + 1):
                if b > 1:
                    score = score + rows[b - 1][q] @ columns[b - 1][:, alive]
                if len(alive) <= k or b == len(blocks):
                    continue
                reach = left[b][alive] * asked[b][q]
                slack = 1.0 + 1e-9 * float(np.abs(reach).max())
                now = score.astype(float)
                least = np.partition(now - reach, len(alive) - k)[len(alive) - k] - slack
                stay = now + reach >= least
                if np.count_nonzero(stay) < 0.8 * len(alive):
                    alive, score = alive[stay], score[stay]
            if len(alive) > k:
                cut = np.partition(score, len(score) - k)[len(score) - k]
                stay = score >= cut
                alive, score = alive[stay], score[stay]
            best = np.lexsort((ids[alive], -score))[:k]
            yield q, alive[best], score[best]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates of every query.

    Both inputs have ``vec_id`` and ``vector array<long>``.
    """
    spark = vectors.sparkSession
    ready = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<bigint>").alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    )
    candidates, asked = ready(vectors), ready(queries).distinct()
    n, m = candidates.count(), asked.count()
    shards = max(-(-n // cell_rows), spark.sparkContext.defaultParallelism)
    blocks = max(-(-m // cell_rows), 1)
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = candidates.select(
        every(blocks).alias("block"), dealt(shards).alias("shard"), F.lit(False).alias("asks"), "vec_id", "vector", F.lit(0).cast("long").alias("query_key")
    ).unionByName(
        asked.select(
            dealt(blocks).alias("block"), every(shards).alias("shard"), F.lit(True).alias("asks"), "vec_id", "vector", F.xxhash64("vector").alias("query_key")
        )
    )

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        q, c = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        out: list[tuple[np.ndarray, ...]] = []
        if q.num_rows and c.num_rows:
            width = len(q.column("vector")[0])
            own, ids, keys = q.column("vec_id").to_numpy(), c.column("vec_id").to_numpy(), q.column("query_key").to_numpy()
            found = branch_and_bound(_numbers(q.column("vector"), width), own, _numbers(c.column("vector"), width), ids, k)
            big = np.iinfo(np.int64)
            for i, at, score in found:
                exact = np.array([min(max(int(s), big.min), big.max) for s in score], dtype=np.int64)
                out.append((np.full(len(at), own[i]), np.full(len(at), keys[i]), ids[at], exact))
        return pa.table([np.concatenate([o[j] for o in out]) if out else np.empty(0, np.int64) for j in range(4)], names=["query_id", "query_key", "vec_id", "score"])

    found = cells.groupBy("block", "shard", F.size("vector").alias("width")).applyInArrow(search, RESULT)
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
