"""The vector table: id, embedding and free metadata columns, kept as parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.functions.vectors import is_valid_vector, l2_normalize
from passagework.session import written

_ROW_IN_PARTITION = (1 << 33) - 1  # low bits of monotonically_increasing_id


def assign_ids(df: DataFrame, order_by: list[str | Column], first_id: int = 0) -> DataFrame:
    """Adds dense ids from ``first_id`` in the order of ``order_by``.

    Range partitions are numbered on their own and shifted by the sizes of the
    partitions before them, so no task sees more than its partition. The sorted
    rows are written once: a lost executor must not draw other range borders.
    """
    sorted_rows = written(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_IN_PARTITION))),
        "ordered",
    )
    sizes = sorted_rows.groupBy("_part").agg(F.count("*").alias("n"))
    # One row per partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    return (
        sorted_rows.join(F.broadcast(offsets), "_part")
        .withColumn("id", F.col("_offset") + F.col("_row") + F.lit(first_id))
        .drop("_part", "_row", "_offset")
    )


def split_valid(df: DataFrame, dimension: int, embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows)."""
    ok = is_valid_vector(F.col(embedding), dimension)
    return df.filter(ok), df.filter(~ok)


def prepare_vectors(df: DataFrame, dimension: int, order_by: list[str], existing: DataFrame | None = None) -> DataFrame:
    """New rows ready to append: all vectors valid, unit length, ids after the existing ones.

    One invalid vector rejects the whole batch.
    """
    _, rejected = split_valid(df, dimension)
    if not rejected.isEmpty():
        raise ValueError("the batch holds vectors of a wrong dimension or with values that are not finite")
    last = existing.agg(F.max("id")).first()[0] if existing is not None else None
    unit = df.withColumn("embedding", l2_normalize(F.col("embedding")))
    return assign_ids(unit, order_by, 0 if last is None else last + 1)


def write_vectors(df: DataFrame, path: str, mode: str = "append", by_cell: bool = False) -> None:
    """Append or overwrite; with ``by_cell`` the cell becomes a folder that searches can skip."""
    writer = df.write.mode(mode)
    (writer.partitionBy("cell") if by_cell else writer).parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def vector_by_id(vectors: DataFrame, vector_id: int | Column) -> DataFrame:
    """The row with that id, with its unit vector; no row when missing."""
    return vectors.filter(F.col("id") == vector_id).withColumn("embedding", l2_normalize(F.col("embedding")))


def page_vectors(patches: DataFrame, doc_id: int | Column, page: int | Column) -> DataFrame:
    """The patch vectors of one page."""
    return patches.filter((F.col("doc_id") == doc_id) & (F.col("page") == page))


def store_stats(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    return vectors.agg(
        F.count("*").alias("total_vectors"),
        F.max(F.size(embedding)).alias("dimension"),
        F.count("*").alias("metadata_entries"),
    )


def multimodal_stats(text_vectors: DataFrame, patches: DataFrame) -> DataFrame:
    """One row with the sizes of both parts; each part is reduced to one row before they meet."""
    t = text_vectors.agg(F.count("*").alias("text_vectors"), F.max(F.size("embedding")).alias("text_dimension"))
    p = patches.agg(
        F.countDistinct("doc_id").alias("visual_documents"),
        F.count("*").alias("visual_patches"),
        F.max(F.size("embedding")).alias("visual_dimension"),
    )
    both = t.unionByName(p, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).withColumn(
        "metadata_entries", F.col("text_vectors") + F.col("visual_patches")
    )


def patch_explode(df: DataFrame, pages: str = "pages") -> DataFrame:
    """[pages, patches, dim] to a row per patch: doc_id, page (from 1), patch_index (running), embedding."""
    flat = F.flatten(
        F.transform(pages, lambda p, i: F.transform(p, lambda v: F.struct((i + 1).alias("page"), v.alias("v"))))
    )
    rows = df.select("doc_id", F.posexplode(flat).alias("patch_index", "p"))
    return rows.select("doc_id", F.col("p.page").alias("page"), "patch_index", F.col("p.v").alias("embedding"))
