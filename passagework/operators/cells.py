"""A stored index of vectors in cells, searched in rounds until a bound proves the result.

``build`` fits k-means on a bounded sample, assigns every vector, and stores the table partitioned by cell, with
the centre, the radius and the row count of each cell beside it. ``append`` adds vectors to the same cells.

``search`` ranks the cells for every query by distance to their centres and gives each an upper bound for the
cosine of anything in it, from centre and radius. A round reads only the folders of the cells that are asked for
in it; then a query is done when no cell left can hold a vector as good as its k-th best. Rounds double in size.
With ``rounds=None`` the result equals the exact search; with a number, ``proved`` tells which queries are exact.

Vectors of another length than the centres', and usable ones only, lie in ``NO_CELL``, which queries of other
lengths search as a whole. Null, empty and non-finite vectors are counted by ``blocks.vector_report``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from passagework.operators import blocks as B
from passagework.session import written

SAMPLE_ROWS = 256  # rows for each cell that k-means is fitted to, at most
SLACK = 1e-9  # bounds and scores are rounded apart

CELLS = "cell int, centre array<double>, radius double, rows bigint"


def _centres(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, centres, radii) of all batches; one row a cell, so bounded by their number."""
    rows = spark.read.parquet(f"{path}/cells").groupBy("cell").agg(F.max("radius").alias("radius"), F.first("centre").alias("centre")).orderBy("cell").collect()
    sized = [r for r in rows if r["cell"] != B.NO_CELL]
    return np.array([r["cell"] for r in sized]), np.array([r["centre"] for r in sized]), np.array([r["radius"] for r in sized])


def _put(vectors: DataFrame, centres: np.ndarray, path: str, batch: int) -> None:
    """Writes one batch; a batch that is put again replaces itself."""
    rows = vectors.select(F.col("id").cast("bigint").alias("id"), "embedding").where("id is not null")
    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("distance", DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (centres**2).sum(axis=1) / 2
        for part in batches:
            cells, distance = np.full(part.num_rows, -2, np.int32), np.zeros(part.num_rows)
            for at, m in B.by_length(part.column("embedding")):
                cells[at] = B.NO_CELL
                if m.shape[1] == centres.shape[1]:
                    unit = B._unit(m)
                    cells[at] = (half[None, :] - unit @ centres.T).argmin(axis=1)
                    distance[at] = np.linalg.norm(unit - centres[cells[at]], axis=1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells), pa.array(distance)], names=schema.names)

    spark, place = vectors.sparkSession, f"{path}/vectors/batch={batch}"
    # a cell's rows come together in files of a fair size, and a large cell in several
    rows.mapInArrow(assign, schema).where("cell > -2").hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(place)
    held = spark.read.schema(schema).parquet(place).groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("rows"))
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)] + [(B.NO_CELL, None)], "cell int, centre array<double>")
    facts = known.join(held, "cell", "left").select("cell", "centre", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("rows", F.lit(0)).alias("rows"))
    facts.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells/batch={batch}")


def build(vectors: DataFrame, path: str, cells: int = 100, seed: int = 42, iterations: int = 10, dimension: int | None = None) -> None:
    """Stores all vectors below ``path``; the centres are fitted to at most ``SAMPLE_ROWS * cells`` of them."""
    share = SAMPLE_ROWS * cells / max(vectors.count(), 1)
    sample = vectors if share >= 1 else vectors.sample(share, seed)
    _put(vectors, B.train_cells(sample, cells, seed, iterations, dimension), path, 0)


def append(vectors: DataFrame, path: str, batch: int) -> None:
    """Adds vectors as ``batch`` (from 1) to the cells as they are; radii grow with what comes in."""
    if batch < 1:
        raise ValueError("batches are counted from 1; 0 is what the index was built from")
    _put(vectors, _centres(vectors.sparkSession, path)[1], path, batch)


def _ranked(queries: DataFrame, cells: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> DataFrame:
    """Adds ``cells`` by distance of their centres and ``bounds``, the best cosine that each may hold."""
    schema = StructType([*queries.schema.fields, StructField("cells", ArrayType(IntegerType())), StructField("bounds", ArrayType(DoubleType()))])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            order: list = [[]] * part.num_rows
            bounds: list = [[]] * part.num_rows
            for rows, m in B.by_length(part.column("embedding")):
                if m.shape[1] != centres.shape[1]:
                    found, upper = np.full((len(rows), 1), B.NO_CELL), np.ones((len(rows), 1))
                else:
                    unit = B._unit(m)
                    inner = unit @ centres.T
                    distance = np.sqrt(np.maximum((unit**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * inner, 0))
                    near = np.argsort(distance, axis=1, kind="stable")
                    gap = np.maximum(distance - radii, 0)
                    # q.v = q.c + q.(v - c), and for unit vectors q.v = 1 - |q - v|^2 / 2; zero vectors score 0
                    upper = np.maximum(np.minimum(inner + radii, 1 - gap**2 / 2), 0)
                    found, upper = cells[near], np.take_along_axis(upper, near, axis=1)
                for row, a, b in zip(rows.tolist(), found.tolist(), upper.tolist()):
                    order[row], bounds[row] = a, b
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(order, pa.list_(pa.int32())), pa.array(bounds, pa.list_(pa.float64()))], names=schema.names)

    return queries.mapInArrow(rank, schema)


def _probe_few(head: pa.Table, stored: DataFrame, k: int) -> DataFrame:
    """Probes of a small query set: the set is broadcast and only the folders of its cells are read."""
    cells = np.array(head.column("cell"))
    names = {c: B._named(head.filter(pa.array(cells == c))) for c in np.unique(cells).tolist()}
    shared = stored.sparkSession.sparkContext.broadcast({c: {m.shape[1]: (n, m) for n, m in found} for c, found in names.items()})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running: dict = {}
        for part in batches:
            ids, at = part.column("id").to_numpy(zero_copy_only=False), part.column("cell").to_numpy(zero_copy_only=False)
            for rows, m in B.by_length(part.column("embedding")):
                unit = B._unit(m)
                for c in np.unique(at[rows]).tolist():
                    if found := shared.value.get(c, {}).get(m.shape[1]):
                        here = at[rows] == c
                        state = running.setdefault((c, m.shape[1]), (found[0], B._Running(found[1], k)))
                        state[1].add(ids[rows][here], unit[here])
        for block_ids, state in running.values():
            yield from B._table(block_ids, state).to_batches()

    # at most one value for each cell
    return stored.where(F.col("cell").isin([int(c) for c in names])).select("id", "embedding", "cell").mapInArrow(search, B.RESULT)


def probe_plan(probes: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the probes dealt into groups of bounded size; the folders to read are pruned while the query runs."""
    blocks = probes.groupBy("cell").agg(F.ceil(F.count("*") / B.QUERY_BLOCK).cast("int").alias("blocks")).where("blocks > 0")
    held = stored.join(F.broadcast(blocks), "cell")  # one small row a cell
    sizes = F.broadcast(held.groupBy("cell").agg(F.ceil(F.count("*") / B.SHARD_ROWS).cast("int").alias("parts")))
    asked = (
        probes.join(F.broadcast(blocks), "cell").join(sizes, "cell")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    )
    held = (
        held.join(sizes, "cell")
        .withColumn("shard", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    keys = ["cell", "shard", "qb"]
    return asked.select(*keys, "query_id", "embedding"), held.select(*keys, "id", "embedding")


def search(queries: DataFrame, path: str, k: int, nprobe: int = 1, rounds: int | None = None, broadcast_limit: int = B.BROADCAST_QUERIES) -> DataFrame:
    """query_id, id, score, rank 1..k and ``proved``; the first round looks into ``nprobe`` cells, each later one into twice as many."""
    spark = queries.sparkSession
    cells, centres, radii = _centres(spark, path)
    stored = spark.read.parquet(f"{path}/vectors").drop("batch", "distance")
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "embedding").where("query_id is not null")
    asked = written(_ranked(asked, cells, centres, radii).where(F.size("cells") > 0), "cell-queries")
    best, open_, at, step, turn = None, asked.withColumn("floor", F.lit(-2.0)), 0, nprobe, 0
    while at <= len(cells) and not (rounds is not None and turn == rounds):
        here = F.arrays_zip(F.slice("cells", at + 1, step).alias("cell"), F.slice("bounds", at + 1, step).alias("bound"))
        probes = open_.select("query_id", "embedding", "floor", F.inline(here)).where(F.col("bound") >= F.col("floor") - SLACK).select("query_id", "embedding", "cell")
        probes = written(probes, "cell-probes")
        head = B._small(probes, broadcast_limit)
        if head is None:
            found = B.keyed_topk(*probe_plan(probes, stored), ["cell", "shard", "qb"], k)
        elif head.num_rows:
            found = _probe_few(head, stored, k)
        else:
            found = spark.createDataFrame([], B.RESULT)
        best = written(B.merge_topk(found if best is None else found.unionByName(best), k).drop("rank"), "cell-hits")
        at, step, turn = at + step, 2 * step, turn + 1
        floors = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        rest = F.size(F.filter(F.slice("bounds", at + 1, len(cells) + 1), lambda b: b >= F.col("floor") - SLACK))
        open_ = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        open_ = written(open_.where(rest > 0), "cell-open")
        if open_.isEmpty():
            break
    # a bounded number of open queries is not assumed: an anti-join tells the proved ones
    return B.merge_topk(best, k).join(open_.select("query_id", F.lit(False).alias("proved")), "query_id", "left").withColumn("proved", F.coalesce("proved", F.lit(True)))
