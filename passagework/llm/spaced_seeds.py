"""Benchmark decontamination with spaced seeds.

A seed is the hash of five words chosen by a fixed mask, which ignores the word positions between them. Seeds
of the benchmark are looked up at every word position of every document; around a hit the whole item is laid
over the document at the hit's offset and words are compared one by one, so substituted words are tolerated.

A document holds an item if, at one offset, at least 0.8 of the item's words agree, or at least 0.8 of some
``WINDOW`` consecutive words of it do. The three masks meet every such overlap of items of ten words or more:
any pattern of at most a fifth of substituted words in 10 to 19 words leaves one mask untouched, and longer
overlaps hold such a stretch (a test tries all patterns). Items of five to nine words have masks of their own,
which leave out each word in turn; shorter items cannot be told from chance and take no part.

Seeds of both sides are joined by Spark. A bit table of fixed size, built from the benchmark's seeds, goes to all
tasks and keeps seeds that no item has from leaving the pass over the documents. A seed of very many items is dealt
into parts, and copies of a text are one text (known by its digest), so neither makes a hot key. What meets gives
(text, item, offset); texts and items are joined to that once more, in groups of bounded size, and compared.

Defined cases: null and empty texts hold nothing and are held by nothing; repeated items count once, repeated
documents each; of several offsets the one with most agreeing words counts, then the first; empty tables hold nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm.common import Memo, hash_word, map_batches, mix, text_digest, word_hashes
from passagework.session import written

MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 4, 6, 7))
LEAST_WORDS, FULL_WORDS, WINDOW = 5, 10, 13
BITS = 26  # of the table that filters seeds: 8 MB, however large the benchmark is
HOT = 1000  # items that a seed may have before it is dealt into parts
GROUP = 4_000  # (text, item, offset) that one group compares
CELLS = 1_000_000
SEED = "mask int, seed long, item long, at int"
PLACE = "digest binary, mask int, seed long, pos int"


def enough(matches: np.ndarray, words: int) -> np.ndarray:
    return matches * 5 >= words * 4


def seeds_at(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The seed at each position where the mask fits."""
    n = max(len(words) - mask[-1], 0)
    h = np.zeros(n, dtype=np.uint64)
    for offset in mask:
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[offset : offset + n]
    return mix(h)


def joined(parts: list[np.ndarray], kind: type = np.uint64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def plans_of(lengths: Iterable[int]) -> list[tuple[tuple[int, ...], int | None]]:
    """(mask, length of the items that it is for; None: all long ones), with the masks that leave out each word of a short item."""
    short = sorted({n for n in lengths if LEAST_WORDS <= n < FULL_WORDS})
    return [(m, None) for m in MASKS] + [(tuple(o for o in range(n) if o != out), n) for n in short for out in range(n)]


def item_seeds(words: np.ndarray, plans: list[tuple[tuple[int, ...], int | None]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(mask number, seeds, their first word in the item) of one item."""
    for k, (mask, length) in enumerate(plans):
        if (len(words) >= FULL_WORDS) if length is None else (len(words) == length):
            first = mask[0]
            found = seeds_at(words[first:], tuple(o - first for o in mask))
            found = found if length is None else found[:1]
            yield k, found, np.arange(len(found)) + first


def agreeing(words: np.ndarray, item: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """(agreeing words, first word) of the offsets at which a text holds an item."""
    step = max(1, CELLS // len(item))
    for start in (starts[i : i + step] for i in range(0, len(starts), step)):
        at = start[:, None] + np.arange(len(item))
        inside = (at >= 0) & (at < len(words))
        agree = (words[np.clip(at, 0, len(words) - 1)] == item) & inside
        matches = agree.sum(axis=1)
        keep = enough(matches, len(item))
        if len(item) >= WINDOW:
            c = np.cumsum(np.pad(agree, ((0, 0), (1, 0))), axis=1)
            keep |= enough((c[:, WINDOW:] - c[:, :-WINDOW]).max(axis=1), WINDOW)
        for j in np.flatnonzero(keep):
            yield int(matches[j]), int(max(start[j], 0))


def items_of(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """item (a number of its own), item_id, words (hashes) of the distinct items of five words or more; written."""
    asked = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("t")).where(F.col("t").isNotNull()).distinct()
    schema = T.StructType([asked.schema["item_id"], T.StructField("words", T.ArrayType(T.LongType()))])

    def hashed(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        memo = Memo(hash_word)
        words = [word_hashes(t, memo).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64()))], names=["item_id", "words"])

    found = map_batches(asked, hashed, schema).where(F.size("words") >= LEAST_WORDS).distinct()
    return written(found.withColumn("item", F.monotonically_increasing_id()), "seed-items")


def seeds_of(items: DataFrame, plans: list) -> DataFrame:
    def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        out: list[tuple] = [(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))]
        for item, words in zip(batch.column(0).to_pylist(), batch.column(1)):
            for k, seeds, at in item_seeds(words.values.to_numpy(zero_copy_only=False).view(np.uint64), plans):
                out.append((np.full(len(seeds), k, np.int32), seeds.view(np.int64), np.full(len(seeds), item), at.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["mask", "seed", "item", "at"])

    return map_batches(items.select("item", "words"), each, T.StructType.fromDDL(SEED))


def bit_table(seeds: DataFrame) -> np.ndarray:
    """One bit for each value of the seeds' low bits; at most 2 ** BITS / 8 bytes come to the driver."""
    low = (F.col("seed").bitwiseAND(F.lit((1 << BITS) - 1)) + 1).alias("b")
    rows = seeds.select(low).groupBy(F.bitmap_bucket_number("b").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    out = np.zeros(1 << BITS >> 3, np.uint8)
    for r in rows:
        at = (r["n"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def places_of(documents: DataFrame, text: str, plans: list, bits: np.ndarray) -> DataFrame:
    """Seeds of the documents that some item may have; one pass, no text leaves it."""
    shared = documents.sparkSession.sparkContext.broadcast(bits)
    memo = Memo(hash_word)

    def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        table = shared.value
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            texts = [word_hashes(t, memo) for t in part.column(1).to_pylist()]
            memo.trim()
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            words, doc, first = joined(texts), np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
            out = [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int32))]
            for k, (mask, _) in enumerate(plans):
                offsets = tuple(o - mask[0] for o in mask)
                h = seeds_at(words, offsets)
                low = (h & np.uint64((1 << BITS) - 1)).astype(np.int64)
                p = np.flatnonzero((table[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool) & (doc[: len(h)] == doc[offsets[-1] :]))
                out.append((doc[p], np.full(len(p), k, np.int32), h[p].view(np.int64), (p - first[p]).astype(np.int32)))
            who, *rest = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who)), *map(pa.array, rest)], names=["digest", "mask", "seed", "pos"])

    rows = documents.select(text_digest(documents[text]).alias("digest"), documents[text].alias("text")).where("text is not null")
    return map_batches(rows, each, T.StructType.fromDDL(PLACE)).distinct()


def _compared(texts: pa.Table, found: pa.Table) -> pa.Table:
    """The best overlap of each text and item in one group."""
    memo = Memo(hash_word)
    place = {d: n for n, d in enumerate(texts.column("digest").to_pylist())}
    starts, asked, items = found.column("start").to_numpy(), found.column("words"), found.column("item").to_numpy().tolist()
    rows: dict[bytes, dict[int, list[int]]] = {}
    for n, digest in enumerate(found.column("digest").to_pylist()):
        rows.setdefault(digest, {}).setdefault(items[n], []).append(n)
    out: list[tuple] = []
    for digest, by_item in rows.items():  # the words of one text at a time
        words = word_hashes(texts.column("text")[place[digest]].as_py(), memo)
        memo.trim()
        for item, at in by_item.items():
            held = agreeing(words, asked[at[0]].values.to_numpy(zero_copy_only=False).view(np.uint64), starts[at])
            if best := min(((-m, s) for m, s in held), default=None):
                out.append((digest, item, -best[0], best[1]))
    columns = list(zip(*out)) if out else [[]] * 4
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["digest", "item", "matched", "first"])


def held_items(documents: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """digest, item, matched, first of every distinct text and item that it holds; written."""
    short = [r["n"] for r in items.select(F.size("words").alias("n")).where(F.col("n") < FULL_WORDS).distinct().collect()]  # at most five
    plans = plans_of(short)
    seeds = written(seeds_of(items, plans), "seeds")
    hot = seeds.groupBy("mask", "seed").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("mask", "seed", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = seeds.join(hot, ["mask", "seed"], "left").withColumn("part", F.pmod(F.xxhash64("item", "at"), parts)).drop("parts")
    places = places_of(documents, text, plans, bit_table(seeds)).join(hot, ["mask", "seed"], "left")
    places = places.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), (parts - 1).cast("bigint")))).drop("parts")
    met = places.join(dealt, ["mask", "seed", "part"]).select("digest", "item", (F.col("pos") - F.col("at")).cast("long").alias("start"))
    met = written(met.distinct(), "seed-hits")

    total = met.count()
    sizes = met.groupBy("digest").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    group = F.pmod(F.xxhash64("digest", "part"), F.lit(max(1, -(-total // GROUP)))).alias("group")
    asked = met.join(sizes, "digest").withColumn("part", F.pmod(F.xxhash64("item", "start"), "parts").cast("int")).join(items.select("item", "words"), "item")
    whole = documents.select(text_digest(documents[text]).alias("digest"), documents[text].alias("text")).join(sizes, "digest").groupBy("digest", "parts").agg(F.first("text").alias("text"))
    whole = whole.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = whole.select(group, "digest", "text").groupBy("group")
    right = asked.select(group, "digest", "item", "start", "words").groupBy("group")
    found = left.cogroup(right).applyInArrow(_compared, "digest binary, item long, matched long, first long")
    best = F.min(F.struct((-F.col("matched")).alias("m"), "first")).alias("b")
    return written(found.groupBy("digest", "item").agg(best).select("digest", "item", (-F.col("b.m")).alias("matched"), F.col("b.first").alias("first")), "seed-held")


def overlaps(documents: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """``doc_id, item_id, matched_words, item_words, first_word`` of every document and item that it holds."""
    items = items_of(benchmark, item_id, text)
    held = held_items(documents, items, text).join(items.select("item", "item_id", F.size("words").cast("long").alias("item_words")), "item")
    rows = documents.select(documents[doc_id].alias("doc_id"), text_digest(documents[text]).alias("digest"))
    return rows.join(held, "digest").select("doc_id", "item_id", F.col("matched").alias("matched_words"), "item_words", F.col("first").alias("first_word"))


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """``documents`` without those that hold a benchmark item."""
    items = items_of(benchmark.withColumn("__none", F.lit(0)), "__none", item_text)
    bad = held_items(documents, items, text).select(F.col("digest").alias("__digest")).distinct()
    return documents.withColumn("__digest", text_digest(documents[text])).join(bad, "__digest", "left_anti").select(*(documents[c] for c in documents.columns))
