"""Helpers that several operators of this package share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"\w+")
#: Entries, and characters of their keys, that a worker's memo may hold between two texts; beyond that it is emptied.
MEMO, MEMO_CHARS = 400_000, 32_000_000


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores; null has none."""
    return WORD.findall(text.lower()) if text else []


class Memo(dict):
    """``memo[key]`` computes a value once; ``trim()`` between texts keeps the size bounded."""

    def __init__(self, compute: Callable, limit: int = MEMO):
        super().__init__()
        self.compute, self.limit, self.chars = compute, limit, 0

    def __missing__(self, key):
        value = self[key] = self.compute(key)
        self.chars += len(key)
        return value

    def trim(self) -> None:
        if len(self) > self.limit or self.chars > MEMO_CHARS:
            self.clear()
            self.chars = 0


def hash_word(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def word_hashes(text: str | None, memo: Memo) -> np.ndarray:
    """One unsigned 64-bit number for each word of a text."""
    found = words(text)
    return np.fromiter(map(memo.__getitem__, found), dtype=np.uint64, count=len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` with one call for each batch; Spark bounds a batch by rows and bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(each, schema)


def fields(df: DataFrame, *names: str) -> list[T.StructField]:
    """The named columns as they may leave Python, where any may be null."""
    return [T.StructField(n, df.schema[n].dataType, True) for n in names]


def text_digest(col: Column | str) -> Column:
    """Sixteen bytes that stand for a text; null has its own."""
    col = F.col(col) if isinstance(col, str) else col
    return F.unhex(F.coalesce(F.md5(col.cast("binary")), F.lit("00" * 16)))
