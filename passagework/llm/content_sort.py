"""Exact duplicates by sorting contents.

Texts are equal when they are identical after lower-casing A-Z only. Rows are range-partitioned between sampled
splitters and sorted inside their partition, so equal texts lie side by side, the largest doc_id first. One pass
over each partition compares every text in full with the text before it. The sort keys are the first
``KEY_CHARS`` characters, the SHA-256 of the text, the text itself and doc_id; the splitters leave out the whole
text, so what the driver samples is bounded however long texts are.

Splitters also hold doc_id and a row number, so a hot group is cut at row level and spreads over many
partitions. A group can then touch the next partition: the first and the last group of a partition are *edges*.
Edges of equal texts (compared in full) are one group; there are at most two for each partition, and only their
numbers are broadcast to finish the rows that lie in them.

Defined cases: null is the empty text; of equal texts the row with the largest doc_id stays, null doc_ids come
last; of rows that repeat doc_id and text one stays; a group without any doc_id has a null keep_id; an empty
table gives no rows; other columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from passagework.session import written

KEY_CHARS = 64
EDGE = "edge long, edge_text binary"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def arranged(documents: DataFrame, text: str, doc_id: str, carry: bool) -> DataFrame:
    """Rows in content order: ``t`` (bytes of the text), ``sha``, ``id``, and ``row`` with all columns if ``carry``."""
    rows = documents.select(
        normalised(documents[text]).alias("t"),
        documents[doc_id].alias("id"),
        *([F.struct("*").alias("row")] if carry else []),
        F.monotonically_increasing_id().alias("n"),
    )
    rows = rows.withColumns({"sha": F.unhex(F.sha2(F.col("t").cast("binary"), 256)), "key": F.substring("t", 1, KEY_CHARS)})
    dealt = rows.repartitionByRange("key", "sha", F.desc_nulls_last("id"), "n")
    ordered = dealt.sortWithinPartitions("key", "sha", "t", F.desc_nulls_last("id"), "n")
    return ordered.select(F.col("t").cast("binary").alias("t"), "sha", "id", *(["row"] if carry else []))


def starts_of(texts: pa.Array, before: bytes | None) -> np.ndarray:
    """Which rows differ from the text just before them."""
    out = np.ones(len(texts), dtype=bool)
    if before is not None:
        out[0] = texts[0].as_py() != before
    if len(texts) > 1:
        out[1:] = pc.not_equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
    return out


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches, and which of their rows begin a new text."""
    before = None
    for batch in batches:
        if batch.num_rows:
            yield batch, starts_of(batch.column(0), before)
            before = batch.column(0)[batch.num_rows - 1].as_py()


def groups(kind: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each document: id, keep, size, head, sha, edge, edge_text; numbers are final except on edges."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple[pa.Array, pa.Array, np.ndarray]] = []  # ids, digests and starts of the group at hand
        first, text, last_text = True, None, None

        def numbered(ids: pa.Array, shas: pa.Array, begins: np.ndarray, last: bool) -> pa.RecordBatch:
            at = np.flatnonzero(begins)
            group = np.cumsum(begins) - 1
            edge, edge_text = [None] * len(ids), [None] * len(ids)
            if first or last:
                n = len(ids) if len(at) == 1 else int(at[1])
                edge[:n] = [2 * part + (0 if first else 1)] * n
                edge_text[0] = text if first else last_text
            columns = [
                ids, ids.take(pa.array(at[group])), pa.array(np.diff(np.append(at, len(ids)))[group]), pa.array(begins), shas,
                pa.array(edge, pa.int64()), pa.array(edge_text, pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, schema=kind)

        def joined(pieces: list) -> tuple[pa.Array, pa.Array, np.ndarray]:
            ids, shas, begins = zip(*pieces, strict=True)
            return pa.concat_arrays(ids), pa.concat_arrays(shas), np.concatenate(begins)

        for batch, begins in compared(batches):
            starts = np.flatnonzero(begins)
            if text is None:
                text = batch.column(0)[0].as_py()
            if not len(starts) or (not held and starts[-1] == 0):
                held.append((batch.column(2), batch.column(1), begins))
                continue
            cut = int(starts[-1])
            yield numbered(*joined([*held, (batch.column(2).slice(0, cut), batch.column(1).slice(0, cut), begins[:cut])]), last=False)
            first = False
            held = [(batch.column(2).slice(cut), batch.column(1).slice(cut), begins[cut:])]
            last_text = batch.column(0)[cut].as_py()
        if held:
            yield numbered(*joined(held), last=True)

    return each


def chained(edges: DataFrame) -> DataFrame:
    """Edges joined into groups by their whole texts: edge, its group's size, its keep_id and its first edge."""
    whole = edges.groupBy("edge_text").agg(F.sum("size").alias("all"), F.min("edge").alias("start"), F.max("keep").alias("kept"))
    return edges.select("edge", "edge_text").join(whole, "edge_text").select("edge", "all", "start", "kept")


def classes(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row."""
    id_type = documents.schema[doc_id].dataType
    schema = T.StructType(
        [T.StructField("id", id_type), T.StructField("keep", id_type), T.StructField("size", T.LongType()), T.StructField("head", T.BooleanType()), T.StructField("sha", T.BinaryType())]
        + list(T.StructType.fromDDL(EDGE))
    )
    rows = arranged(documents, text, doc_id, carry=False)
    found = written(rows.mapInArrow(groups(to_arrow_schema(schema)), schema), "content-groups")
    edges = chained(found.where("edge_text is not null"))
    done = found.drop("edge_text").join(F.broadcast(edges), "edge", "left")  # at most two small rows for each partition
    return done.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("all").isNull(), F.col("keep")).otherwise(F.col("kept")).alias("keep_id"),
        F.coalesce("all", "size").alias("group_size"),
        (F.col("head") & F.coalesce(F.col("edge") == F.col("start"), F.lit(True))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``documents`` that stay, with all their columns."""
    rows = arranged(documents, text, doc_id, carry=True)
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(EDGE)])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, first = None, True  # the latest head: it may turn out to be the last

        def edged(rows: pa.RecordBatch, last: bool) -> pa.RecordBatch:
            edge, edge_text = [None] * rows.num_rows, [None] * rows.num_rows
            if first or last:
                edge[0], edge_text[0] = 2 * part + (0 if first else 1), rows.column(0)[0].as_py()
            return pa.RecordBatch.from_arrays([rows.column(3), pa.array(edge, pa.int64()), pa.array(edge_text, pa.binary())], names=schema.names)

        for batch, begins in compared(batches):
            found = batch.filter(pa.array(begins))
            if not found.num_rows:
                continue
            if held is not None:
                yield edged(held, last=False)
                first = False
            if found.num_rows > 1:
                yield edged(found.slice(0, found.num_rows - 1), last=False)
                first = False
            held = found.slice(found.num_rows - 1)
        if held is not None:
            yield edged(held, last=True)

    found = written(rows.mapInArrow(heads, schema), "content-heads")
    edges = found.where("edge_text is not null").select("edge", "edge_text")
    start = edges.groupBy("edge_text").agg(F.min("edge").alias("start"))
    later = edges.join(start, "edge_text").where("edge > start").select("edge")
    return found.join(F.broadcast(later), "edge", "left_anti").select("row.*")
