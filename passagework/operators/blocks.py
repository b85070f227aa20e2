"""Best matches of many query vectors in many vectors, block by block.

Vectors are cut into shards of a bounded number of rows and queries into blocks
of a bounded number of rows. Each (query block, shard) pair is one task-sized
matrix product that returns only its k best per query, so no pair of rows is
ever emitted and no group grows with the data. A query set that is proven small
is broadcast instead, and then the vectors are not shuffled at all.

Scores are inner products of unit vectors, rounded to 12 digits so that equal
vectors tie exactly; ties go to the smaller id. A query meets the vectors of its
own length; page images are cut to the shorter of both sides, pair by pair. Rows
without an id and vectors that are null, empty or not finite take no part, and
``vector_report`` counts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from passagework.functions.vectors import is_valid_vector, l2_normalize

QUERY_BLOCK = 8192  # query rows of one block
SHARD_ROWS = 16384  # vector rows of one shard
SLICE_ROWS = 8192  # vector rows multiplied at a time, at most
CELLS = 1 << 20  # scores held at a time, at most; a slice has fewer rows where a block has many queries
SLACK = 1e-11  # scores are compared with a floor before they are rounded
BROADCAST_QUERIES = 4096  # a larger query set is never broadcast ...
BROADCAST_BYTES = 64 << 20  # ... and neither are wider vectors

RESULT = "query_id bigint, id bigint, score double"
NO_CELL = -1  # vectors whose length is not that of the centroids


def by_length(column: pa.ChunkedArray | pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, float64 matrix) of the vectors of each length. Null, empty and non-finite ones are left out."""
    array = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    if not len(array):
        return []
    lengths = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        some = array if len(rows) == len(array) else array.take(pa.array(rows))
        m = some.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), d)
        sound = np.isfinite(m).all(axis=1)
        out.append((rows[sound], m[sound]))
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay zero."""
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def vector_report(vectors: DataFrame) -> DataFrame:
    """What searches do with the vectors: ``verdict`` (searched, no vector, not finite), ``length``, ``vectors``."""
    size = F.coalesce(F.size("embedding"), F.lit(0))
    length = F.when(size > 0, size).otherwise(0)
    verdict = F.when(length == 0, "no vector").when(is_valid_vector(F.col("embedding"), size), "searched").otherwise("not finite")
    return vectors.groupBy(verdict.alias("verdict"), length.alias("length")).agg(F.count("*").alias("vectors"))


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best (row, id, score) per row by score, then by smaller id."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    starts = np.r_[0, np.flatnonzero(np.diff(rows)) + 1] if len(rows) else np.zeros(0, int)
    position = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    keep = position < k
    return rows[keep], ids[keep], scores[keep]


class _Running:
    """The k best so far of each query over any number of vector batches; scores below ``least`` are left out.

    A score is looked at again only if it reaches the k-th best of its query so far.
    """

    def __init__(self, queries: np.ndarray, k: int, digits: int = 12, least: float = -np.inf):
        self.queries, self.k, self.digits = queries, k, digits
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.floor = np.full(len(queries), least)
        self.open = np.ones(len(queries), dtype=bool)  # fewer than k so far

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, min(SLICE_ROWS, CELLS // max(1, len(self.queries))))
        for at in range(0, len(ids), step):
            self.take(ids[at : at + step], self.queries @ vectors[at : at + step].T)

    def take(self, names: np.ndarray, scores: np.ndarray) -> None:
        """Scores of every query (a row each) with the vectors ``names``."""
        floor = self.floor
        if len(names) > self.k and self.open.any():
            # Everything that reaches the k-th score stays, so ties are settled by id below.
            best = np.partition(scores[self.open], len(names) - self.k, axis=1)[:, len(names) - self.k]
            floor = floor.copy()
            floor[self.open] = np.maximum(floor[self.open], best)
        rows, cols = np.nonzero(scores >= (floor - SLACK)[:, None])
        rounded = np.round(scores[rows, cols], self.digits) + 0.0
        keep = rounded >= self.floor[rows]
        if not keep.any():
            return
        new = (rows[keep], names[cols[keep]], rounded[keep])
        self.found = _best(*(np.concatenate(x) for x in zip(self.found, new)), self.k)
        held = np.bincount(self.found[0], minlength=len(self.floor))
        self.open = held < self.k
        self.floor[~self.open] = self.found[2][np.cumsum(held)[~self.open] - 1]


def _table(names: np.ndarray, running: _Running) -> pa.Table:
    rows, ids, scores = running.found
    return pa.table({"query_id": pa.array(names[rows], pa.int64()), "id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})


def merge_topk(partial: DataFrame, k: int) -> DataFrame:
    """Rank 1..k per query over the shards' own best."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _small(queries: DataFrame, limit: int) -> pa.Table | None:
    """The queries, when they are proven to be at most ``limit`` rows and few bytes; else None."""
    if not limit:
        return None
    head = queries.limit(limit + 1).toArrow()
    return head if head.num_rows <= limit and head.nbytes <= BROADCAST_BYTES else None


def _named(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """(names, unit rows) of query vectors, length by length."""
    names = table.column("query_id").to_numpy()
    return [(names[rows], _unit(m)) for rows, m in by_length(table.column("embedding")) if len(rows)]


def _broadcast_topk(head: pa.Table, vectors: DataFrame, k: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast({m.shape[1]: (names, m) for names, m in _named(head)})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {
            d: [(ids[i : i + QUERY_BLOCK], _Running(matrix[i : i + QUERY_BLOCK], k)) for i in range(0, len(ids), QUERY_BLOCK)]
            for d, (ids, matrix) in shared.value.items()
        }
        for batch in batches:
            v_ids = batch.column("id").to_numpy(zero_copy_only=False)
            for rows, m in by_length(batch.column("embedding")):
                if found := blocks.get(m.shape[1]):
                    unit = _unit(m)
                    for _, running in found:
                        running.add(v_ids[rows], unit)
        for found in blocks.values():
            for block_ids, running in found:
                yield from _table(block_ids, running).to_batches()

    return vectors.mapInArrow(search, RESULT)


def _grid_topk(queries: DataFrame, vectors: DataFrame, k: int, shards: int, query_blocks: int) -> DataFrame:
    q = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    v = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    return keyed_topk(q, v, ["shard", "qb"], k)


def keyed_topk(queries: DataFrame, vectors: DataFrame, keys: list[str], k: int) -> DataFrame:
    """k best per query and key group; both sides must be bounded per group."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        out = [pa.table({"query_id": pa.array(empty), "id": pa.array(empty), "score": pa.array(np.zeros(0))})]
        ids = right.column("id").to_numpy()
        held = {m.shape[1]: (ids[rows], m) for rows, m in by_length(right.column("embedding"))}
        for names, matrix in _named(left):
            v_ids, m = held.get(matrix.shape[1], (empty, np.zeros((0, 1))))
            for at in range(0, len(names) if len(v_ids) else 0, QUERY_BLOCK):
                running = _Running(matrix[at : at + QUERY_BLOCK], k)
                for v_at in range(0, len(v_ids), SLICE_ROWS):
                    running.add(v_ids[v_at : v_at + SLICE_ROWS], _unit(m[v_at : v_at + SLICE_ROWS]))
                out.append(_table(names[at : at + QUERY_BLOCK], running))
        return pa.concat_tables(out)

    return queries.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(search, RESULT)


def exact_topk(
    queries: DataFrame, vectors: DataFrame, k: int, broadcast_limit: int = BROADCAST_QUERIES
) -> DataFrame:
    """query_id, id, score, rank 1..k by cosine over all vectors.

    ``queries``: query_id, embedding; ``vectors``: id, embedding.
    """
    q = queries.select(F.col("query_id").cast("bigint"), "embedding").where("query_id is not null")
    v = vectors.select(F.col("id").cast("bigint"), "embedding").where("id is not null")
    head = _small(q, broadcast_limit)
    if head is not None:
        partial = _broadcast_topk(head, v, k)
    else:
        shards = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-v.count() // SHARD_ROWS))
        partial = _grid_topk(q, v, k, shards, max(1, -(-q.count() // QUERY_BLOCK)))
    return merge_topk(partial, k)


# ---------------------------------------------------------------- approximate search


def train_cells(vectors: DataFrame, cells: int = 100, seed: int = 42, iterations: int = 10, dimension: int | None = None) -> np.ndarray:
    """Centroids of k-means cells over unit vectors, shape (cells, dimension).

    ``dimension`` may be left out where all usable vectors are of one length.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    size = F.size("embedding")
    sound = vectors.filter(is_valid_vector(F.col("embedding"), size) & (size > 0))
    if dimension is None:
        lengths = sorted(r[0] for r in sound.select(size).distinct().collect())
        if len(lengths) != 1:
            raise ValueError(f"vectors of the lengths {lengths}: name the dimension to train")
        dimension = lengths[0]
    data = sound.filter(size == dimension).select(array_to_vector(l2_normalize(F.col("embedding"))).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=iterations).fit(data)
    return np.array(model.clusterCenters())


def _nearest_cells(df: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """Adds ``cells``, the n cells nearest to each unit vector: ``NO_CELL`` for other lengths, none where a vector is unusable."""
    schema = StructType(df.schema.fields + [StructField("cells", ArrayType(IntegerType()))])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (centroids**2).sum(axis=1) / 2
        for batch in batches:
            near: list = [[]] * batch.num_rows
            for rows, m in by_length(batch.column("embedding")):
                if m.shape[1] == centroids.shape[1]:
                    found = np.argsort(half[None, :] - _unit(m) @ centroids.T, axis=1, kind="stable")[:, :n].tolist()
                else:
                    found = [[NO_CELL]] * len(rows)
                for row, cells in zip(rows.tolist(), found):
                    near[row] = cells
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return df.mapInArrow(assign, schema)


def assign_cells(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds ``cell``, the nearest centroid, to use as a partition column."""
    return _nearest_cells(vectors, centroids, 1).withColumn("cell", F.get("cells", F.lit(0))).drop("cells")


def approximate_topk(
    queries: DataFrame, celled: DataFrame, centroids: np.ndarray, k: int, nprobe: int = 1
) -> DataFrame:
    """Like :func:`exact_topk` but each query looks into its ``nprobe`` nearest cells only.

    A large cell is split into shards of bounded size, whose number is read from
    a count per cell, so a cell with a third of all rows is many small tasks.
    """
    q = _nearest_cells(queries.select(F.col("query_id").cast("bigint"), "embedding").where("query_id is not null"), centroids, nprobe)
    v = celled.select(F.col("id").cast("bigint"), "embedding", "cell").where("id is not null")
    # One small row per cell: at most as many as there are centroids.
    parts = F.broadcast(
        v.groupBy("cell").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("parts"))
    )
    probes = q.withColumn("cell", F.explode("cells")).drop("cells")
    blocks = F.broadcast(
        probes.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    )
    asked = (
        probes.join(parts, "cell")
        .join(blocks, "cell")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    )
    held = (
        v.join(parts, "cell")
        .join(blocks, "cell")
        .withColumn("shard", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    keys = ["cell", "shard", "qb"]
    return merge_topk(keyed_topk(asked.drop("parts", "blocks"), held.drop("parts", "blocks"), keys, k), k)


# ---------------------------------------------------------------- several vectors per page

PAGE_RESULT = "query_id bigint, doc_id bigint, page int, score double"


def mean_query_vectors(tokens: DataFrame, dimension: int | None = None) -> DataFrame:
    """One vector per query: the mean of its token vectors, position by position."""
    v = F.slice("embedding", 1, dimension) if dimension else F.col("embedding")
    at = tokens.select("query_id", F.posexplode(v).alias("i", "x"))
    mean = at.groupBy("query_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding")
    )


def _page_scores(names: np.ndarray, queries: np.ndarray, batch: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(names, docs, pages, best score of each page for each of them), for a few queries (raw rows of one length) at a time."""
    groups = [(rows, m) for rows, m in by_length(batch.column("embedding")) if len(rows)]
    if not groups:
        return
    at = np.concatenate([rows for rows, _ in groups])
    docs = batch.column("doc_id").to_numpy(zero_copy_only=False)[at]
    pages = batch.column("page").to_numpy(zero_copy_only=False)[at]
    order = np.lexsort((pages, docs))
    docs, pages = docs[order], pages[order]
    starts = np.r_[0, np.flatnonzero((np.diff(docs) != 0) | (np.diff(pages) != 0)) + 1]
    sides = [(d, _unit(m[:, :d]).T) for m in (m for _, m in groups) for d in [min(queries.shape[1], m.shape[1])]]
    step = max(1, CELLS // len(at))
    for first in range(0, len(names), step):
        part = queries[first : first + step]
        scores = np.hstack([np.round(_unit(part[:, :d]) @ side, 12) + 0.0 for d, side in sides])
        yield names[first : first + step], docs[starts], pages[starts], np.maximum.reduceat(scores[:, order], starts, axis=1)


def _pages_table(query_id=(), doc_id=(), page=(), score=()) -> pa.Table:
    return pa.table({
        "query_id": pa.array(query_id, pa.int64()), "doc_id": pa.array(doc_id, pa.int64()),
        "page": pa.array(page, pa.int32()), "score": pa.array(score, pa.float64()),
    })


def _raw(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """(names, values) of query vectors, length by length."""
    names = table.column("query_id").to_numpy()
    return [(names[rows], m) for rows, m in by_length(table.column("embedding")) if len(rows)]


def maxsim_pages(requests: DataFrame, queries: DataFrame, patches: DataFrame) -> DataFrame:
    """Score of every page of the requested (query_id, doc_id) pairs: the best cosine of its patches.

    Patches of a document are spread over shards of bounded size, because a
    maximum of maxima is the maximum; so a document with very many patches is no hot group.
    """
    sizes = patches.groupBy("doc_id").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("parts"))
    blocks = requests.groupBy("doc_id").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    asked = (
        requests.select("query_id", "doc_id")
        .join(queries.select("query_id", "embedding"), "query_id")
        .join(sizes.join(blocks, "doc_id"), "doc_id")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    )
    held = (
        patches.select("doc_id", "page", "embedding", F.xxhash64("page", "patch_index").alias("h"))
        .join(sizes.join(blocks, "doc_id"), "doc_id")
        .withColumn("shard", F.pmod("h", F.col("parts")).cast("int"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [_pages_table()]
        for names, m in _raw(left):
            for some, docs, pages, best in _page_scores(names, m, right):
                out.append(_pages_table(np.repeat(some, len(docs)), np.tile(docs, len(some)), np.tile(pages, len(some)), best.ravel()))
        return pa.concat_tables(out)

    keys = ["doc_id", "shard", "qb"]
    left = asked.select(*keys, "query_id", "embedding")
    right = held.select(*keys, "page", "embedding")
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, PAGE_RESULT)
    return partial.groupBy("query_id", "doc_id", "page").agg(F.max("score").alias("score"))


def _best_documents(found: pa.Table, k: int) -> pa.Table:
    """The k best documents per query, each with its best score and the first page that has it."""
    if not found.num_rows:
        return found
    q, d = found.column("query_id").to_numpy(), found.column("doc_id").to_numpy()
    p, s = found.column("page").to_numpy(), found.column("score").to_numpy()
    order = np.lexsort((p, -s, d, q))
    q, d, p, s = q[order], d[order], p[order], s[order]
    new = np.r_[True, (np.diff(q) != 0) | (np.diff(d) != 0)]
    q, d, p, s = q[new], d[new], p[new], s[new]
    order = np.lexsort((d, -s, q))
    q, d, p, s = q[order], d[order], p[order], s[order]
    starts = np.r_[0, np.flatnonzero(np.diff(q)) + 1]
    keep = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)])) < k
    return pa.table(
        {
            "query_id": pa.array(q[keep], pa.int64()),
            "doc_id": pa.array(d[keep], pa.int64()),
            "page": pa.array(p[keep], pa.int32()),
            "score": pa.array(s[keep], pa.float64()),
        }
    )


def visual_topk(queries: DataFrame, patches: DataFrame, k: int, broadcast_limit: int = BROADCAST_QUERIES) -> DataFrame:
    """Per query the k documents with the best page: doc_id, page, score, rank.

    Each shard keeps, per query, its own k best documents: a document among the
    global k best is also among the k best of the shard that holds its best patch.
    """
    p = patches.select(F.col("doc_id").cast("bigint"), F.col("page").cast("int"), "embedding").where("doc_id is not null and page is not null")
    q = queries.select(F.col("query_id").cast("bigint"), "embedding").where("query_id is not null")

    def shard_best(names, queries_m, batch):
        out = [_pages_table()]
        for some, docs, pages, best in _page_scores(names, queries_m, batch):
            starts = np.r_[0, np.flatnonzero(np.diff(docs)) + 1]
            top = np.maximum.reduceat(best, starts, axis=1)
            # The first page that reaches the document's best score.
            first = np.minimum.reduceat(np.where(best == np.repeat(top, np.diff(np.r_[starts, len(docs)]), axis=1), pages[None, :], np.iinfo(np.int32).max), starts, axis=1)
            n, m = top.shape
            rows, cols = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
            rows, cols, scores = _best(rows, cols, top.ravel(), k)
            out.append(_pages_table(some[rows], docs[starts][cols], first[rows, cols], scores))
        return pa.concat_tables(out)

    head = _small(q, broadcast_limit)
    if head is not None:
        shared = p.sparkSession.sparkContext.broadcast(_raw(head))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: pa.Table | None = None
            for batch in batches:
                table = pa.Table.from_batches([batch])
                new = [shard_best(names, m, table) for names, m in shared.value]
                if new:
                    kept = _best_documents(pa.concat_tables([*([kept] if kept is not None else []), *new]), k)
            if kept is not None:
                yield from kept.combine_chunks().to_batches()

        partial = p.mapInArrow(search, PAGE_RESULT)
    else:
        shards = max(p.sparkSession.sparkContext.defaultParallelism, -(-p.count() // SHARD_ROWS))
        blocks = max(1, -(-q.count() // QUERY_BLOCK))
        left = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
            "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
        )
        # equal patches of a page meet in one shard, where one of them tells as much as all
        right = p.distinct().withColumn("shard", F.pmod(F.xxhash64("doc_id", "page", F.col("embedding")), F.lit(shards)).cast("int")).withColumn(
            "qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        )

        def search_pair(a: pa.Table, b: pa.Table) -> pa.Table:
            return pa.concat_tables([_pages_table(), *(shard_best(names, m, b) for names, m in _raw(a))])

        partial = left.groupBy("shard", "qb").cogroup(right.groupBy("shard", "qb")).applyInArrow(search_pair, PAGE_RESULT)
    best = partial.groupBy("query_id", "doc_id").agg(
        F.max("score").alias("score"), F.min(F.struct((-F.col("score")).alias("s"), "page"))["page"].alias("page")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hybrid_fuse(text: DataFrame, visual: DataFrame, k: int, text_weight: float = 0.5) -> DataFrame:
    """Weighted union of two result lists, re-ranked; each side contributes at most 2k rows.

    Both have query_id, id, score, rank. Equal scores: text first, then rank.
    """
    def side(df: DataFrame, source: str, order: int, weight: float) -> DataFrame:
        return df.filter(F.col("rank") <= 2 * k).select(
            "query_id", F.lit(source).alias("source"), "id", "score",
            (F.col("score") * weight).alias("weighted_score"), F.lit(order).alias("_s"), F.col("rank").alias("_r"),
        )

    both = side(text, "text", 0, text_weight).unionByName(side(visual, "visual", 1, 1.0 - text_weight))
    w = Window.partitionBy("query_id").orderBy(F.desc("weighted_score"), "_s", "_r")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("_s", "_r")


def similarity_monitor(pairs: DataFrame, score: Column, expected: Column) -> DataFrame:
    """Flags pairs that should be similar but score below 0.7, or should differ but score above 0.5."""
    return pairs.withColumn("score", score).withColumn(
        "warning",
        F.when(expected & (F.col("score") < 0.7), "similar pair scores low")
        .when(~expected & (F.col("score") > 0.5), "different pair scores high"),
    )
