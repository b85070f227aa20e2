"""How many pairs of labelled vectors are alike, without making all pairs.

Two vectors whose cosine is at least t lie at most sqrt(2 - 2t) apart on the unit sphere, and then their distances to
any third point, a pivot, differ by no more than that. Rows are ordered by their distances to a few pivots and packed
into blocks of bounded size, and blocks that lie together make shards of about ``SHARD`` values. Two shards in reach of
each other by every pivot are one task's work, so a row is copied once for each shard that its own one meets, and not once
for each block. There each pair of blocks in reach is one product, of which only counts for each pair of labels leave
the task. All other pairs are counted from the sizes of the labels.

Equal rows are one row with a weight, so very many copies make no work. Defined cases: rows without label or usable
vector take no part; only vectors of one length meet; zero vectors are alike with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.functions.vectors import is_valid_vector, l2_normalize
from passagework.operators import blocks as B
from passagework.session import written

PIVOTS = 4
ROWS = 2048
CELLS = 1 << 18  # scores held at a time, at most
BANDS = 8  # of the reach
SLACK = 1e-11  # scores are compared with the least level before they are rounded
SHARD = 1 << 23  # values of a shard's vectors, about; twice as many at most
BLOCK = "shard bigint, length int, block bigint, low array<double>, high array<double>, labels array<bigint>, weights array<bigint>, v array<double>"


def _packed(rows: DataFrame, pivots: np.ndarray, reach: float) -> DataFrame:
    """Blocks of up to ``ROWS`` rows of one length and one band of the first pivot, in shards of blocks that lie together."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    count, values = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("v").cast("bigint")), F.lit(0))).first()
    # so many shards that their pairs keep every core at work, but none of less than a block
    shards = max(1, -(-values // SHARD), min(math.isqrt(4 * cores) + 1, -(-count // ROWS)))
    schema = f"{rows.select('label', 'n', 'v').schema.simpleString()[7:-1].replace(':', ' ')}, d array<double>, band int"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, m in B.by_length(batch.column("v")):
                points = pivots[:, : m.shape[1]] if pivots.shape[1] >= m.shape[1] else np.pad(pivots, ((0, 0), (0, m.shape[1] - pivots.shape[1])))
                points = B._unit(points)
                d = np.sqrt(np.maximum(2 - 2 * m @ points.T, 0))
                part = batch.take(pa.array(at))
                lists = pa.ListArray.from_arrays(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32), pa.array(d.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array((d[:, 0] / reach * BANDS).astype(np.int32))], names=["label", "n", "v", "d", "band"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held = TaskContext.get().partitionId() << 33, 0, 0
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            bands = batch.column("band").to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.flatnonzero((np.diff(lengths) != 0) | (np.diff(bands) != 0)) + 1, len(bands)]
            for a, b in ((x, min(x + ROWS, y)) for s, y in zip(cuts, cuts[1:]) for x in range(s, y, ROWS)):
                part = batch.slice(a, b - a)
                d = part.column("d").flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                one = lambda x: pa.array([x])
                yield pa.RecordBatch.from_arrays([
                    pa.array([first + held // (2 * SHARD)]), pa.array([lengths[a]], pa.int32()), pa.array([first + made]), one(d.min(axis=0)), one(d.max(axis=0)),
                    one(part.column("label").to_numpy(zero_copy_only=False)), one(part.column("n").to_numpy(zero_copy_only=False)), one(part.column("v").flatten().to_numpy(zero_copy_only=False)),
                ], names=["shard", "length", "block", "low", "high", "labels", "weights", "v"])
                made, held = made + 1, held + (b - a) * int(lengths[a])

    measured = rows.select("label", "n", "v").mapInArrow(measure, schema).withColumn("length", F.size("v"))
    keys = ["length", "band", *(F.floor(F.get("d", F.lit(k)) / reach * BANDS) for k in range(1, PIVOTS))]
    dealt = measured.repartitionByRange(shards, *keys, F.xxhash64("label", "v")).sortWithinPartitions(*keys)
    return written(dealt.select("label", "n", "v", "d", "band").mapInArrow(pack, BLOCK), "pair-blocks")


def _tiles(blocks: DataFrame, reach: float) -> DataFrame:
    """shard, with: the shards that may hold something in reach of it by every pivot, and itself; one row for each shard."""
    least, most = (F.array(*(f(F.get(c, F.lit(k))) for k in range(PIVOTS))) for f, c in ((F.min, "low"), (F.max, "high")))
    facts = written(blocks.groupBy("shard").agg(F.min("length").alias("short"), F.max("length").alias("long"), least.alias("low"), most.alias("high")), "pair-shards")
    other = facts.select(F.col("shard").alias("with"), F.col("short").alias("s"), F.col("long").alias("l"), F.col("low").alias("lo"), F.col("high").alias("hi"))
    near = F.forall(F.arrays_zip("low", "high", "lo", "hi"), lambda x: (x["low"] - x["hi"] <= reach + 1e-9) & (x["lo"] - x["high"] <= reach + 1e-9))
    met = facts.crossJoin(F.broadcast(other)).where((F.col("short") <= F.col("l")) & (F.col("s") <= F.col("long")) & near)
    return met.groupBy("shard").agg(F.collect_list("with").alias("with"))


def _met(table: pa.Table, low: int, high: int, reach: float) -> Iterator[tuple[int, int]]:
    """Rows of two blocks, one of each of the two shards, in reach of each other by every pivot; each pair once, a block with itself too."""
    shard, block, length = (table.column(c).to_numpy() for c in ("shard", "block", "length"))
    least, most = (np.array(table.column(c).to_pylist()) for c in ("low", "high"))
    right = np.flatnonzero(shard == high)
    for i in np.flatnonzero(shard == low):
        others = right[block[right] >= block[i]] if low == high else right
        near = (least[i] - most[others] <= reach + 1e-9).all(axis=1) & (least[others] - most[i] <= reach + 1e-9).all(axis=1)
        for j in others[near & (length[others] == length[i])]:
            yield int(i), int(j)


def _counts(levels: tuple[float, ...], reach: float):
    def pair(first: tuple, second: tuple, same: bool) -> pa.Table:
        (la, wa, a), (lb, wb, b) = first, second
        kinds, at = np.unique(np.concatenate([la, lb]), return_inverse=True)
        ia, ib = at[: len(la)], at[len(la) :]
        found = np.zeros((len(levels), len(kinds) ** 2), np.int64)
        step = max(1, CELLS // len(lb))
        for start in range(0, len(la), step):
            part = slice(start, start + step)
            scores = a[part] @ b.T
            row, col = np.nonzero(scores >= min(levels) - SLACK)
            weight = wa[part][row] * wb[col]
            if same:  # each pair once; of a row's copies all pairs
                weight = np.where(col == row + start, weight - wb[col], np.where(col > row + start, 2 * weight, 0)) // 2
            score, one, two = np.round(scores[row, col], 12), ia[part][row], ib[col]
            cell = np.minimum(one, two) * len(kinds) + np.maximum(one, two)
            for n, t in enumerate(levels):
                found[n] += np.bincount(cell[score >= t], weight[score >= t], len(kinds) ** 2).astype(np.int64)
        held = np.flatnonzero(np.sum(found, axis=0))
        return pa.table([pa.array(kinds[held // len(kinds)]), pa.array(kinds[held % len(kinds)]), *(pa.array(f[held]) for f in found)], names=names)

    names = ["label", "other_label", *(f"n{k}" for k in range(len(levels)))]
    kinds_of = pa.schema([(n, pa.int64()) for n in names])

    def each(key: tuple, table: pa.Table) -> pa.Table:
        low, high = (x.as_py() for x in key)
        lists = {c: table.column(c).combine_chunks() for c in ("labels", "weights", "v")}
        take = lambda c, n: lists[c][n].values.to_numpy(zero_copy_only=False)
        part = lambda n: (take("labels", n), take("weights", n), take("v", n).reshape(-1, table.column("length")[n].as_py()))
        total, held = kinds_of.empty_table(), []
        for i, j in _met(table, low, high, reach):
            held.append(pair(part(i), part(j), i == j))
            if sum(map(len, held)) >= CELLS:
                total, held = _summed([total, *held]), []
        return _summed([total, *held])

    def _summed(tables: list[pa.Table]) -> pa.Table:
        grouped = pa.concat_tables(tables).group_by(names[:2]).aggregate([(n, "sum") for n in names[2:]])
        return grouped.rename_columns({f"{n}_sum": n for n in names[2:]}).select(names)

    return each


def count_pairs(vectors: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """label, other_label (not less), pairs, and ``n0``, ``n1``, ... : pairs whose cosine, to 12 digits, reaches each level.

    ``vectors``: label, embedding. Every pair of two rows counts once.
    """
    reach = float(np.sqrt(max(2 - 2 * min(levels), 0)) + 1e-6)
    size = F.size("embedding")
    sound = vectors.select(F.col("label").cast("bigint"), "embedding").where(F.col("label").isNotNull() & is_valid_vector(F.col("embedding"), size) & (size > 0))
    rows = written(sound.select("label", l2_normalize(F.col("embedding")).alias("v")).groupBy("label", "v").agg(F.count("*").alias("n")), "pair-rows")
    head = rows.orderBy(F.xxhash64("v")).limit(PIVOTS).select("v").toArrow()
    sizes = rows.groupBy(F.size("v").alias("length"), "label").agg(F.sum("n").alias("n"))
    a, b = sizes.select("length", "label", F.col("n").alias("a")), sizes.select("length", F.col("label").alias("other_label"), F.col("n").alias("b"))
    # labels x labels, as many as the result has rows
    product = F.when(F.col("label") == F.col("other_label"), F.floor(F.col("a") * (F.col("a") - 1) / 2)).otherwise(F.col("a") * F.col("b"))
    pairs = a.join(b, "length").where("label <= other_label").groupBy("label", "other_label").agg(F.sum(product).cast("bigint").alias("pairs"))
    names = [f"n{k}" for k in range(len(levels))]
    if not head.num_rows:
        return pairs.withColumns({n: F.lit(0).cast("bigint") for n in names})
    vectors_ = head.column("v").to_pylist()
    pivots = np.zeros((PIVOTS, max(map(len, vectors_))))
    for k in range(PIVOTS):
        v = vectors_[k % len(vectors_)]
        pivots[k, : len(v)] = v
    blocks = _packed(rows, pivots, reach)
    schema = "label bigint, other_label bigint, " + ", ".join(f"{n} bigint" for n in names)
    # one row for each shard
    held = blocks.join(F.broadcast(_tiles(blocks, reach)), "shard").withColumn("with", F.explode("with"))
    tiles = held.select(F.least("shard", "with").alias("low_shard"), F.greatest("shard", "with").alias("high_shard"), *blocks.columns)
    counts = tiles.groupBy("low_shard", "high_shard").applyInArrow(_counts(levels, reach), schema)
    counts = counts.groupBy("label", "other_label").agg(*(F.sum(n).alias(n) for n in names))
    return pairs.join(counts, ["label", "other_label"], "left").select("label", "other_label", "pairs", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def similarity_report(vectors: DataFrame, similar: float = 0.7, different: float = 0.5) -> DataFrame:
    """expected, warning, pairs over all pairs: alike by label but below ``similar``, or of two labels but above ``different``."""
    above = float(np.nextafter(round(different + 1e-12, 12), 1))  # scores have 12 digits: above means the next one on
    found = count_pairs(vectors, (similar, above)).withColumn("expected", F.col("label") == F.col("other_label"))
    low, high = F.struct(F.lit("similar pair scores low").alias("warning"), (F.col("pairs") - F.col("n0")).alias("n")), F.struct(F.lit("different pair scores high").alias("warning"), F.col("n1").alias("n"))
    fine = lambda n: F.struct(F.lit(None).cast("string").alias("warning"), n.alias("n"))
    kinds = F.when(F.col("expected"), F.array(low, fine(F.col("n0")))).otherwise(F.array(high, fine(F.col("pairs") - F.col("n1"))))
    return found.select("expected", F.inline(kinds)).groupBy("expected", "warning").agg(F.sum("n").alias("pairs")).where("pairs > 0")
