"""Whitening of embeddings with MLlib's BlockMatrix.

Entries become integers ``floor(64 * c) + 1000000``. The fit list holds each distinct vector once. Rows are packed
into blocks where they lie (no shuffle) and numbered block by block; every later step reads the written blocks, so
numbers stay as they are whatever is run again. Centred blocks form a tall BlockMatrix whose transpose times
itself is the scatter; the middle dimension is cut into splits of at most ``SPLIT_BYTES``, since one result block
would else draw all blocks into one task. The driver decomposes the (dimension x dimension) covariance. For the
projection the tall column of blocks is folded into a square of blocks and multiplied by a block-diagonal
whitening matrix: then MLlib's grid of result blocks spreads over all its partitions, which for one tall column
it does not.

Sums are exact integers and centring is (n * x - S) / n, rounded once, so no digits are lost to the offset.

Defined cases: null vectors and vectors with null or non-finite entries take no part, nor do those with an entry
beyond 2**34, where integers and sums would no longer be exact; an empty vector has no components; vectors of
different lengths are whitened apart, each length by its own fit list; components whose variance is below
``LEAST_SHARE`` of the greatest (rounding only) are left out, so one distinct vector alone gives no rows; repeated
rows and null ids give rows like others; an empty table gives no rows. Signs: the entry of a component that is
greatest in size is positive.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from passagework.session import written

FACTOR, OFFSET = 64, 1_000_000
MOST = float(2**40)
BLOCK_VALUES = 65_536
SPLIT_BYTES = 64_000_000
LEAST_SHARE = 1e-10
SUM = "at int, total decimal(38,0)"
BLOCK_ROW = T.StructType([T.StructField("at", T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType())])), T.StructField("m", MatrixUDT())])


@dataclass(frozen=True)
class Fit:
    """What one length of vectors was fitted to."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray  # eigenvalues of the components kept, falling
    vectors: np.ndarray  # dimension x components
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * FACTOR) <= MOST))


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * FACTOR) + OFFSET)


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _lists(values: np.ndarray, width: int) -> pa.Array:
    rows = len(values) // width
    return pa.ListArray.from_arrays(np.arange(0, rows * width + 1, width, dtype=np.int32), pa.array(values))


def packed(rows: DataFrame, label: str) -> DataFrame:
    """Blocks of up to ``BLOCK_VALUES`` values of one length: dimension, part, seq, ids, x (row after row)."""
    id_type = rows.schema["id"].dataType
    schema = T.StructType.fromDDL("dimension int, part int, seq int").add("ids", T.ArrayType(id_type)).add("x", T.ArrayType(T.LongType()))
    arrow_id = to_arrow_type(id_type)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}
        made: dict[int, int] = {}

        def block(d: int, ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
            seq = made[d] = made.get(d, -1) + 1
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([part], pa.int32()), pa.array([seq], pa.int32()), one(ids), one(pa.array(x))], names=schema.names)

        def full(d: int, least: int) -> Iterator[pa.RecordBatch]:
            size = max(1, BLOCK_VALUES // d)
            ids = pa.concat_arrays([h[0] for h in held[d]])
            x = np.concatenate([h[1] for h in held[d]])
            at = 0
            while len(ids) - at >= max(least, 1):
                yield block(d, ids.slice(at, size), x[at * d : (at + size) * d])
                at += size
            held[d] = [(ids.slice(at), x[at * d :])] if at < len(ids) else []

        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                found = batch.filter(pa.array(lengths == d))
                held.setdefault(d, []).append((found.column(0).cast(arrow_id), _flat(found.column(1))))
                if sum(len(h[0]) for h in held[d]) >= max(1, BLOCK_VALUES // d):
                    yield from full(d, max(1, BLOCK_VALUES // d))
        for d in held:
            if held[d]:
                yield from full(d, 1)

    return written(rows.select("id", "x").mapInArrow(pack, schema), label)


def numbered(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Blocks of one dimension with ``block``, counted from 0 without gaps, and how many there are."""
    offsets, total = [], 0
    for part, n in sorted(tuple(r) for r in blocks.groupBy("part").agg(F.count("*")).collect()):  # one row for each partition
        offsets.append((part, total))
        total += n
    at = blocks.sparkSession.createDataFrame(offsets, "part int, first long")
    return blocks.join(F.broadcast(at), "part").select((F.col("first") + F.col("seq")).alias("block"), "ids", "x"), total


def totals(partials: DataFrame) -> dict[int, decimal.Decimal]:
    """``at`` and the sum of ``total`` over all tasks."""
    return {r["at"]: r["s"] for r in partials.groupBy("at").agg(F.sum("total").alias("s")).collect()}


def sums_of(blocks: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """Row count and exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, dtype=object)
        for batch in batches:
            for x in batch.column(0):
                rows = x.values.to_numpy(zero_copy_only=False).reshape(-1, d)
                n += len(rows)
                total = total + rows.sum(axis=0)
        found = [decimal.Decimal(int(v)) for v in [*total, n]]
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array(found, pa.decimal128(38, 0))], names=["at", "total"])

    found = totals(blocks.select("x").mapInArrow(add, SUM))
    return int(found[d]), tuple(int(found[k]) for k in range(d))


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exact: 64-bit integers where they suffice, else Python's."""
    middle = [round(s / n) for s in sums]
    rest = np.array([s - n * m for s, m in zip(sums, middle)], dtype=object)
    near = x - np.array(middle, dtype=np.int64)
    if int(np.abs(near).max(initial=0)) * n + int(np.abs(rest).max(initial=0)) < 2**62:
        return near * np.int64(n) - rest.astype(np.int64)
    return near.astype(object) * n - rest


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return (deviations(x, n, sums) / n).astype(np.float64)


def squares(x: np.ndarray, n: int, sums: tuple[int, ...]) -> pa.Array:
    """Exact sum of squared deviations of each row."""
    dev = deviations(x, n, sums)
    if dev.dtype != object and dev.shape[1] * int(np.abs(dev).max(initial=0)) ** 2 < 2**63:
        return pa.array(np.square(dev).sum(axis=1)).cast(pa.decimal128(38, 0))
    return pa.array([decimal.Decimal(int(v)) for v in np.square(dev.astype(object)).sum(axis=1)], pa.decimal128(38, 0))


def _matrices(at: list[tuple[int, int]], blocks: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of ``BLOCK_ROW``; values lie row after row."""
    n = len(blocks)
    places = pa.StructArray.from_arrays([pa.array([a[k] for a in at], pa.int64()) for k in (0, 1)], names=["i", "j"])
    ends = np.cumsum([0, *(b.size for b in blocks)]).astype(np.int32)
    values = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([b.ravel() for b in blocks]) if n else np.empty(0)))
    none = pa.nulls(n, pa.list_(pa.int32()))
    columns = [pa.array([1] * n, pa.int8()), *(pa.array([b.shape[k] for b in blocks], pa.int32()) for k in (0, 1)), none, none, values, pa.array([True] * n)]
    return pa.RecordBatch.from_arrays([places, pa.StructArray.from_arrays(columns, names=MatrixUDT.sqlType().names)], names=["at", "m"])


def block_matrix(blocks: DataFrame, fit_n: int, sums: tuple[int, ...], count: int, columns: int) -> BlockMatrix:
    """Centred blocks, ``columns`` side by side. The last block of a partition may have fewer rows; products allow that."""
    d = len(sums)
    size = max(1, BLOCK_VALUES // d)

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = x.values.to_numpy(zero_copy_only=False).reshape(-1, d)
                yield _matrices([(at // columns, at % columns)], [centred(rows, fit_n, sums)])

    rows = blocks.select("block", "x").mapInArrow(centre, BLOCK_ROW)
    made = callMLlibFunc("createBlockMatrix", rows, size, d, -(-count // columns) * size, columns * d)
    return BlockMatrix(made, size, d)


def product(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """``left * right`` with the middle dimension in ``splits``, which Python's own method does not pass on."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def _splits(spark: SparkSession, count: int) -> int:
    wanted = max(math.ceil(count * BLOCK_VALUES * 8 / SPLIT_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(1, min(count, wanted))


def fit(blocks: DataFrame, count: int, d: int, components: int) -> Fit:
    n, sums = sums_of(blocks, d)
    tall = block_matrix(blocks, n, sums, count, 1)
    scatter = product(tall.transpose(), tall, _splits(blocks.sparkSession, count)).toLocalMatrix().toArray()
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > LEAST_SHARE * values.max(initial=0)]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(order))]) if len(order) else np.ones(0)
    return Fit(n, sums, values[order], vectors * signs, float(np.trace(covariance)))


def project(blocks: DataFrame, count: int, model: Fit) -> DataFrame:
    """``block`` and ``z``, its whitened rows one after another."""
    spark, matrix = blocks.sparkSession, model.matrix
    d, k = matrix.shape
    side = math.isqrt(count - 1) + 1
    folded = block_matrix(blocks, model.n, model.sums, count, side)

    def diagonal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in batch.column(0).to_pylist():
                yield _matrices([(j, j)], [matrix])

    cells = spark.range(0, side, 1, _splits(spark, count)).mapInArrow(diagonal, BLOCK_ROW)  # their number of partitions sets that of the product
    whitening = BlockMatrix(callMLlibFunc("createBlockMatrix", cells, d, k, side * d, side * k), d, k)

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, m in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, columns, across = (m[name].as_py() for name in ("numRows", "numCols", "isTransposed"))
                z = m["values"].values.to_numpy(zero_copy_only=False)
                z = z if across else z.reshape(columns, rows).T.ravel()
                yield pa.RecordBatch.from_arrays([pa.array([at["_1"] * side + at["_2"]], pa.int64()), _lists(z, len(z))], names=["block", "z"])

    found = callMLlibFunc("getMatrixBlocks", product(folded, whitening)._java_matrix_wrapper._java_model)
    return found.mapInArrow(flat, "block long, z array<double>")


def identity_error(projected: DataFrame, n: int, k: int) -> float:
    """The greatest entry, in size, of the whitened fit list's covariance minus the identity."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for z in batch.column(0):
                rows = z.values.to_numpy(zero_copy_only=False).reshape(-1, k)
                total += np.vstack([rows.T @ rows, rows.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "total"])

    found = totals(projected.select("z").mapInArrow(add, "at int, total double"))
    total = np.array([found[i] for i in range((k + 1) * k)]).reshape(k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = 16, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row and component."""
    kept = embeddings.where(usable(embeddings[vector])).select(embeddings[vec_id].alias("id"), integers(embeddings[vector]).alias("x")).where("size(x) > 0")
    spark, id_type = embeddings.sparkSession, embeddings.schema[vec_id].dataType
    everything = packed(kept, "whitening-rows")
    distinct = packed(kept.select("x").distinct().withColumn("id", F.lit(None).cast("int")), "whitening-fit")
    schema = T.StructType([T.StructField("vec_id", id_type)] + list(T.StructType.fromDDL("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")))
    out = spark.createDataFrame([], schema)
    for d in sorted(r[0] for r in distinct.select("dimension").distinct().collect()):
        fit_blocks, fit_count = numbered(distinct.where(F.col("dimension") == d))
        model = fit(fit_blocks, fit_count, d, components)
        if len(model.values):
            error = identity_error(project(fit_blocks, fit_count, model), model.n, len(model.values))
            out = out.unionAll(_rows(*numbered(everything.where(F.col("dimension") == d)), model, error, schema))
    return out


def _rows(blocks: DataFrame, count: int, model: Fit, error: float, schema: T.StructType) -> DataFrame:
    """A row for each row of the blocks and component."""
    n, sums, d, k = model.n, model.sums, len(model.sums), len(model.values)
    share = model.values / model.trace
    ids_type = blocks.schema["ids"]

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, ids, x in zip(batch.column(0), batch.column(1), batch.column(2)):
                found = squares(x.values.to_numpy(zero_copy_only=False).reshape(-1, d), n, sums)
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([pa.array([at.as_py()], pa.int64()), one(ids.values), one(found)], names=["block", "ids", "deviation"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, found, z in zip(*batch.columns):
                rows = len(ids.values)
                row = pa.array(np.repeat(np.arange(rows), k))
                tiled = lambda a: pa.array(np.tile(a, rows))
                columns = [
                    ids.values.take(row), tiled(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(rows * k, n)), found.values.take(row), z.values,
                    tiled(share), pa.array(np.full(rows * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    facts = blocks.select("block", "ids", "x").mapInArrow(narrow, T.StructType([T.StructField("block", T.LongType()), ids_type, T.StructField("deviation", T.ArrayType(T.DecimalType(38, 0)))]))
    return facts.join(project(blocks, count, model), "block").select("ids", "deviation", "z").mapInArrow(expand, schema)
