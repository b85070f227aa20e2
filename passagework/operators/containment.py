"""Which chunks hold which passages, by winnowed fingerprints.

Every run of ``gram`` characters is hashed and the least hash of each ``window`` of neighbouring runs is a
fingerprint. A passage of at least ``gram + window - 1`` characters has a window of its own, so all its
fingerprints are among those of any text that holds it. Only the rarest fingerprint of each passage is joined, and
what meets is compared character by character; fingerprints never decide alone, and no pair of all rows is made.

Shorter passages take a finer grid, and those below that are looked up as runs of their own length.

Defined cases: null and empty passages are held by nothing; null texts hold nothing; repeated rows count as often
as they occur; upper and lower case differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.session import written

#: (gram, window) by falling least length of a passage; the window is a power of two.
GRIDS = ((16, 16), (4, 4))
GRID = 1000  # a grid is named gram * GRID + window
PRINT = "grid int, print bigint"
BITS = 24  # of the table that the chunks' prints have to be in: 2 MB
PIECE = 1 << 18  # characters that are hashed at a time


def grid_of(length: int) -> tuple[int, int]:
    return next(((g, w) for g, w in GRIDS if length >= g + w - 1), (length, 1))


def _hashes(codes: np.ndarray, grams: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(gram, hash of the run of ``gram`` characters from each place on) by rising gram; one pass over the characters of a run."""
    h, done = np.zeros(len(codes), np.uint64), 0
    for gram in sorted(set(grams)):
        for at in range(done, min(gram, len(codes))):
            h = h[: len(codes) - at] * np.uint64(0x9E3779B97F4A7C15) + codes[at:] + np.uint64(1)
        if len(codes) < gram:
            return
        done = gram
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        yield gram, mixed ^ (mixed >> np.uint64(32))


def _least(h: np.ndarray, window: int) -> np.ndarray:
    """The least of each ``window`` neighbours."""
    width = 1
    while width < window:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def fingerprints(text: str, gram: int, window: int) -> np.ndarray:
    """Distinct least hashes over all windows; none if the text is shorter than a window."""
    codes = _codes(text)
    if len(codes) - gram + 1 < window:
        return np.zeros(0, np.int64)
    return np.unique(_least(next(h for _, h in _hashes(codes, [gram])), window)).view(np.int64)


def _pieces(texts: list) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of up to ``PIECE`` characters together, or one longer text."""
    start = held = 0
    for at, text in enumerate(texts):
        if held and held + len(text or "") > PIECE:
            yield start, at
            start, held = at, 0
        held += len(text or "")
    yield start, len(texts)


def _printed(df: DataFrame, key: str) -> DataFrame:
    """key, grid, print of each text on the grid of its own length."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    gram, window = grid_of(len(text))
                    found = fingerprints(text, gram, window)
                    rows, grid = pa.array(np.full(len(found), at)), pa.array(np.full(len(found), gram * GRID + window, np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), grid, pa.array(found)], names=[key, "grid", "print"])

    return df.select(key, "text").mapInArrow(each, f"{key} {df.schema[key].dataType.simpleString()}, {PRINT}")


def _held(chunks: DataFrame, grids: list[tuple[int, int]], bits: np.ndarray) -> DataFrame:
    """id, grid, print of the chunks' texts on all ``grids``, as far as a table of bits knows the print.

    A piece of neighbouring texts is hashed at a time; what goes over a border between texts is left out.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(bits)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, windows = shared.value, {}
        for gram, window in grids:
            windows.setdefault(gram, []).append(window)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _pieces(texts):
                part = [t or "" for t in texts[a:b]]
                lengths = np.array([len(t) for t in part])
                row, ends = np.repeat(np.arange(a, b), lengths), np.repeat(np.cumsum(lengths), lengths)
                for gram, h in _hashes(_codes("".join(part)), list(windows)):
                    for window in windows[gram]:
                        if len(h) < window:
                            continue
                        least = _least(h, window)
                        low = (least & np.uint64((1 << BITS) - 1)).astype(np.int64)
                        at = np.flatnonzero((known[low >> 3] >> (low & 7).astype(np.uint8)) & 1)
                        at = at[at + gram + window - 1 <= ends[at]]
                        if not len(at):
                            continue
                        found = np.unique(np.stack([row[at], least[at].view(np.int64)]), axis=1)
                        grid = pa.array(np.full(found.shape[1], gram * GRID + window, np.int32))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found[0])), grid, pa.array(found[1])], names=["id", "grid", "print"])

    return chunks.select("id", "text").mapInArrow(each, f"id {chunks.schema['id'].dataType.simpleString()}, {PRINT}")


def _bit_table(prints: DataFrame) -> np.ndarray:
    """One bit for each value of the prints' low bits; 2 ** BITS / 8 bytes come to the driver, however many passages there are."""
    low = (F.col("print").bitwiseAND(F.lit((1 << BITS) - 1)) + 1).alias("b")
    rows = prints.select(low).groupBy(F.bitmap_bucket_number("b").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    out = np.zeros(1 << BITS >> 3, np.uint8)
    for r in rows:
        out[(r["n"] - 1) * 4096 : r["n"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def contained(passages: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, id of every passage (query_id, text) and chunk (id, text) that holds it."""
    asked = passages.select("query_id", F.col("text").alias("passage"), F.md5(F.col("text").cast("binary")).alias("digest")).where(F.length("passage") > 0)
    wanted = written(_printed(asked.select("digest", F.col("passage").alias("text")).dropDuplicates(["digest"]), "digest"), "passage-prints")
    # at most one value for each grid and short length
    grids = [divmod(r["grid"], GRID) for r in wanted.select("grid").distinct().orderBy("grid").collect()]
    held = _held(chunks, grids, _bit_table(wanted)).join(wanted.select("grid", "print").distinct(), ["grid", "print"], "left_semi")
    held = written(held, "chunk-prints")
    seen = held.groupBy("grid", "print").agg(F.count("*").alias("n"))
    rarest = (
        wanted.join(seen, ["grid", "print"], "left").groupBy("digest", "grid")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "print")).alias("r"))
        .where("r.n > 0").select("digest", "grid", F.col("r.print").alias("print"))
    )
    pairs = rarest.join(held, ["grid", "print"]).select("digest", "id").distinct()
    texts = pairs.join(asked, "digest").join(chunks.select("id", "text"), "id")
    return texts.where(F.contains("text", "passage")).select("query_id", "id")
