"""Keyword search on postings: which articles hold a word is a list of places in ``SPAN`` articles, or a bit string of them.

A task numbers the articles where they lie, the newest first within a span of at most ``SPAN``, and writes for each token
of the span the places that have it; texts are neither sorted nor shuffled. A question's word meets the distinct tokens of
all titles and bodies once; what holds it is then looked up span by span: a group has the postings of the words that
are asked for, of one span, and up to ``ASKED`` questions as lists of words, and adds up the places of each question's words.
What the whole phrase may add is known only from the text, so every candidate has a lower and an upper score; candidates
whose upper score stays below the ``limit`` best lower scores are dropped, and only of those that are left, and hold every
word of the phrase, the title and body are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from passagework.functions.text import words
from passagework.session import written

SPAN_BITS = 13
SPAN = 1 << SPAN_BITS  # articles of one span
POSTED = 1 << 22  # postings of one span, beyond which it gets no further batch of articles
OFTEN = SPAN // 16  # from so many places on, a bit string of 1 KB is no longer than the list
ASKED = 1 << 14  # questions of one group, about
JOINED = 1 << 22  # places that a task joins into one row for each word
READ = 1000  # rows that are taken at a time
ROW = "query_id bigint, method int, n bigint, tm int, cm int, in_title boolean, in_body boolean, low double, high double"
TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.float64(), pa.float64())
NAMES = [c.split()[0] for c in ROW.split(", ")]
TITLE, CONTENT = 0, 1
HEAD = "head"


def numbered(articles: DataFrame, title: Column, body: Column, sides: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(heads, postings), written. ``sides`` are of raw (lower title as it is), t (stripped) and b (lower body).

    Heads: n, article_id, modified, title. Postings: side, span, token, bits. ``n`` is the span and the place in it.
    """
    text = {"raw": F.lower("title"), "t": title, "b": body}
    own = ["article_id", "modified", "title"]
    rows = articles.select(*own, *[F.array_distinct(words(F.coalesce(text[s], F.lit("")))).alias(s) for s in sides])
    schema = StructType([
        StructField("side", StringType()), StructField("span", LongType()), StructField("token", StringType()), StructField("bits", BinaryType()),
        StructField("n", LongType()), *[StructField(c, articles.schema[c].dataType) for c in own],
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = TaskContext.get().partitionId() << 24
        parts: list[pa.RecordBatch] = []

        def closed() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            table = table.take(pc.sort_indices(table, sort_keys=[("modified", "descending"), ("article_id", "ascending")])).combine_chunks()
            count = table.num_rows
            given = {"side": pa.array([HEAD] * count), "span": pa.array(np.full(count, span)), "n": pa.array((span << SPAN_BITS) + np.arange(count)), **{c: table.column(c) for c in own}}
            yield from _batches(given, count)
            for side in sides:
                lists = table.column(side)
                lists = pa.concat_arrays(lists.chunks) if lists.num_chunks != 1 else lists.chunk(0)
                coded = lists.flatten().dictionary_encode()
                if not len(coded):
                    continue
                place = np.repeat(np.arange(count, dtype=np.uint16), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                token = coded.indices.to_numpy()
                order = np.argsort(token, kind="stable")
                token, place = token[order], place[order]
                ends = np.r_[np.flatnonzero(np.diff(token)) + 1, len(token)]
                bits = [_coded(p) for p in np.split(place, ends[:-1])]
                yield from _batches({"side": pa.array([side] * len(ends)), "span": pa.array(np.full(len(ends), span)), "token": coded.dictionary.take(pa.array(token[ends - 1])), "bits": pa.array(bits, pa.binary())}, len(ends))

        def _batches(given: dict, count: int) -> Iterator[pa.RecordBatch]:
            yield from pa.table({c: given[c] if c in given else pa.nulls(count, kinds[c]) for c in schema.names}).to_batches(1 << 16)

        kinds = {"token": pa.string(), "bits": pa.binary(), "n": pa.int64()}
        held = posted = 0
        for batch in batches:
            kinds |= {c: batch.schema.field(c).type for c in own}
            for at in range(0, batch.num_rows, READ):
                at_end = min(batch.num_rows, at + READ)
                while at < at_end:
                    part = batch.slice(at, min(at_end - at, SPAN - held))
                    parts, held, at = [*parts, part], held + part.num_rows, at + part.num_rows
                    posted += sum(len(part.column(s).flatten()) for s in sides)
                    if held == SPAN or posted >= POSTED:
                        yield from closed()
                        parts, held, posted, span = [], 0, 0, span + 1
        if parts:
            yield from closed()

    stored = written(rows.mapInArrow(pack, schema), "postings")
    return stored.where(F.col("side") == HEAD).select("n", *own), stored.where(F.col("side") != HEAD).select("side", "span", "token", "bits")


def _coded(places: np.ndarray) -> bytes:
    """Places as two bytes each, or all of them as a bit string."""
    if len(places) < OFTEN:
        return places.astype("<u2").tobytes()
    row = np.zeros(SPAN, np.uint8)
    row[places] = 1
    return np.packbits(row).tobytes()


def _places(bits: bytes) -> np.ndarray:
    if len(bits) < SPAN // 8:
        return np.frombuffer(bits, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each span, side and part of up to ``JOINED`` places, with those of all tokens that hold the part."""

    def joined() -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        spans, span = np.unique(rows.column("span").to_numpy(), return_inverse=True)
        sides, part = (pa.concat_arrays(rows.column(c).chunks).dictionary_encode() for c in ("side", "part"))
        code = (span.astype(np.int64) * len(sides.dictionary) + sides.indices.to_numpy()) * len(part.dictionary) + part.indices.to_numpy()
        length = pc.binary_length(rows.column("bits")).to_numpy()
        short = length < SPAN // 8
        bits = rows.column("bits").filter(pa.array(short))
        places = np.frombuffer(b"".join(bits.to_pylist()), "<u2").astype(np.int64)
        found = [np.repeat(code[short], length[short] // 2) << SPAN_BITS | places]
        found += [(code[i] << SPAN_BITS) | _places(rows.column("bits")[i].as_py()) for i in np.flatnonzero(~short)]
        pairs = np.unique(np.concatenate(found))
        code, places = pairs >> SPAN_BITS, (pairs & (SPAN - 1)).astype(np.uint16)
        ends = np.r_[np.flatnonzero(np.diff(code)) + 1, len(code)]
        code, held = code[ends - 1], pa.array([_coded(x) for x in np.split(places, ends[:-1])], pa.binary())
        rest, which = np.divmod(code, len(part.dictionary))
        span, side = np.divmod(rest, len(sides.dictionary))
        columns = [pa.array(spans[span]), sides.dictionary.take(pa.array(side)), part.dictionary.take(pa.array(which)), held]
        return pa.RecordBatch.from_arrays(columns, names=["span", "side", "part", "bits"])

    parts, count = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, READ):
            part = batch.slice(at, READ)
            length = pc.binary_length(part.column("bits")).to_numpy()
            parts, count = [*parts, part], count + int(np.where(length < SPAN // 8, length // 2, SPAN).sum())
            if count >= JOINED:
                yield joined()
                parts, count = [], 0
    if parts:
        yield joined()


class _Held:
    """How many of some words each article of a span holds, side by side."""

    def __init__(self, table: pa.Table):
        found = defaultdict(list)
        for side, part, bits in zip(*(table.column(c).to_pylist() for c in ("side", "part", "bits"))):
            found[side, part].append(bits)
        self.few: dict = {}
        self.often: dict = {}
        rows = []
        for key, some in found.items():
            places = _places(some[0]) if len(some) == 1 else np.unique(np.concatenate([_places(x) for x in some]))
            if len(places) < OFTEN:
                self.few[key] = places
            else:
                self.often[key] = len(rows)
                row = np.zeros(SPAN, np.uint8)
                row[places] = 1
                rows.append(row)
        self.rows = np.stack(rows) if rows else np.zeros((0, SPAN), np.uint8)

    def count(self, side: str, parts: list[str]) -> np.ndarray:
        keys = [(side, x) for x in parts]
        often = [self.often[k] for k in keys if k in self.often]
        few = [self.few[k] for k in keys if k in self.few]
        out = np.zeros(SPAN, np.int32)
        if often:
            out += np.add.reduce(self.rows[often], axis=0, dtype=np.uint8 if len(often) < 256 else np.int32)
        if few:
            out += np.bincount(np.concatenate(few), minlength=SPAN).astype(np.int32)
        return out


def _scores(tm: np.ndarray, cm: np.ndarray, m: int, method: int) -> np.ndarray:
    n = max(m, 1)
    if method == TITLE:
        return np.maximum(0.3, np.minimum(1.0, (tm * 0.6 + cm * 0.4) / n))
    return np.minimum(1.0, cm * 0.4 / n)


_PLAIN = str.maketrans("", "", "?!")


def _plain(w: list[str]) -> list[str]:
    return [x for x in dict.fromkeys(x.translate(_PLAIN) for x in w) if x]


def _found(held: _Held, span: int, query: int, w: list[str], phrase: list[str], whole: list[str], titled: bool | None, limit: int | None) -> Iterator[list]:
    m = len(w)
    for method in (TITLE, CONTENT):
        if (method == CONTENT and (titled or limit is None)) or (method == TITLE and titled is False):
            continue
        if method == TITLE:
            hit = held.count("raw", _plain(w)) > 0 if m else (held.count("raw", phrase) == len(phrase)) & (len(phrase) > 0)
            if not hit.any():
                continue
        scored = m and limit is not None
        cm = held.count("b", w) if scored else np.zeros(SPAN, np.int32)
        whole_body = cm == m if scored else (held.count("b", whole) == len(whole)) & (len(whole) > 0)
        if method == CONTENT:
            hit = cm > 0 if m else whole_body
        at = np.flatnonzero(hit)
        if not len(at):
            continue
        tm = held.count("t", w)[at] if scored and method == TITLE else np.zeros(len(at), np.int32)
        cm = cm[at]
        in_title, in_body = ((tm == m) | (m == 0)) & (method == TITLE), whole_body[at]
        low = _scores(tm, cm, m, method) if m else np.zeros(len(at))  # without long words nothing is sure yet
        high = _scores(tm + 2 * in_title, cm + (1 + method) * in_body, m, method)
        if scored and len(at) > limit:
            floor = np.partition(low, len(low) - limit)[len(low) - limit]
            last = at[low == floor][limit - 1 - np.count_nonzero(low > floor)]
            keep = (high > floor) | ((high == floor) & (at <= last))
            at, tm, cm, in_title, in_body, low, high = at[keep], tm[keep], cm[keep], in_title[keep], in_body[keep], low[keep], high[keep]
        yield [np.full(len(at), query), np.full(len(at), method), at + (span << SPAN_BITS), tm, cm, in_title, in_body, low, high]


def _group(limit: int | None):
    def each(key: tuple, asks: pa.Table, postings: pa.Table) -> pa.Table:
        span = key[0].as_py()
        held = _Held(postings)
        tables, out, rows = [pa.table([pa.array([], k) for k in TYPES], names=NAMES)], [], 0

        def made() -> pa.Table:
            return pa.table([pa.array(np.concatenate(c)).cast(k) for c, k in zip(zip(*out), TYPES)], names=NAMES)

        for ask in zip(*(asks.column(c).to_pylist() for c in ("query_id", "w", "phrase_words", "whole_words", "titled"))):
            for found in _found(held, span, *ask, limit):
                out.append(found)
                rows += len(found[0])
            if rows >= 1 << 18:
                tables.append(made())
                out, rows = [], 0
        return pa.concat_tables([*tables, made()] if out else tables)

    return each


def _candidates(asked: DataFrame, heads: DataFrame, postings: DataFrame, meet, limit: int | None) -> DataFrame:
    """Rows of ``ROW``: what each span holds of the questions, the ``limit`` best by what is sure, and all that may be as good."""
    none = F.array().cast("array<string>")
    short = lambda c: F.when(F.size("w") == 0, F.array_distinct(words(F.col(c)))).otherwise(none)
    asks = asked.select("query_id", "w", short("phrase").alias("phrase_words"), short("q").alias("whole_words"))
    plain = F.filter(F.array_distinct(F.transform("w", lambda x: F.regexp_replace(x, "[?!]", ""))), lambda x: x != "")
    parts = written(asks.select(F.explode(F.array_distinct(F.concat("w", plain, "phrase_words", "whole_words"))).alias("part")).distinct(), "parts")
    pairs = written(meet(parts, postings.select("token").distinct()), "part-tokens")
    # a question of long words has a hit in some title as soon as some title has one of them
    in_titles = postings.where(F.col("side") == "raw").select("token").distinct().join(pairs, "token").select("part").distinct()
    titled = asks.select("query_id", F.explode(plain).alias("part")).join(in_titles, "part").select("query_id").distinct().withColumn("has", F.lit(True))
    asks = asks.join(titled, "query_id", "left").withColumn("titled", F.when(F.size("w") > 0, F.coalesce("has", F.lit(False)))).drop("has")
    asks = written(asks, "asks")
    blocks = max(1, -(-asks.count() // ASKED))
    # one row for each span
    spans = F.broadcast(heads.select(F.shiftright("n", SPAN_BITS).alias("span")).distinct())
    left = asks.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).crossJoin(spans)
    held = postings.join(pairs, "token").select("span", "side", "part", "bits").mapInArrow(_joined, "span bigint, side string, part string, bits binary")
    held = held.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("span", "qb").cogroup(held.groupBy("span", "qb")).applyInArrow(_group(limit), ROW)
    return written(found, "span-hits")


def title_hits(asked: DataFrame, articles: DataFrame, meet) -> DataFrame:
    """query_id, article_id, modified of every title with a word of the question, or with its phrase if it has no long word."""
    heads, postings = numbered(articles, F.lower("title"), F.lit(""), ("raw",))
    found = _candidates(asked, heads, postings, meet, None).select("query_id", "n").join(heads, "n")
    found = found.join(asked.select("query_id", F.size("w").alias("m"), "phrase"), "query_id")
    return found.where((F.col("m") > 0) | F.contains(F.lower("title"), F.col("phrase"))).select("query_id", "article_id", "modified")


def search(asked: DataFrame, articles: DataFrame, title: Column, body: Column, meet, limit: int) -> DataFrame:
    """query_id, article_id, modified, title, title_matches, content_matches, relevance_score, method: at least the ``limit`` best.

    ``asked``: query_id, q (lower question), w (its long words), phrase (q without question and exclamation marks).
    Questions with a title hit have only title hits, all others the bodies' hits. An article_id names one article.
    """
    heads, postings = numbered(articles, title, body, ("raw", "t", "b"))
    rows = _candidates(asked, heads, postings, meet, limit)
    best = Window.partitionBy("query_id", "method").orderBy(F.desc("low"))
    floors = rows.where("low > 0").withColumn("r", F.row_number().over(best)).where(F.col("r") <= limit).groupBy("query_id", "method").agg(F.when(F.count("*") == limit, F.min("low")).otherwise(-1.0).alias("floor"))
    left = rows.join(floors, ["query_id", "method"], "left").where(F.col("high") >= F.coalesce("floor", F.lit(-1.0)))
    left = written(left.drop("floor").join(heads, "n"), "left").join(asked.select("query_id", "q", "phrase", F.size("w").alias("m")), "query_id")
    unsure = F.col("in_title") | F.col("in_body") | (F.col("m") == 0)
    wanted = written(left.where(unsure).select("article_id").distinct(), "unsure")
    texts = articles.join(wanted, "article_id", "left_semi").select("article_id", F.lower("title").alias("raw"), title.alias("t"), body.alias("b"))
    read = left.where(unsure).join(texts, "article_id").where((F.col("m") > 0) | (F.col("method") == CONTENT) | F.contains("raw", "phrase"))
    own = ("query_id", "method", "article_id", "modified", "title", "m")
    sure = left.where(~unsure).select(*own, F.col("tm").alias("title_matches"), F.col("cm").alias("content_matches"))
    by_title = F.col("tm") + F.when(F.col("in_title") & F.contains("t", "q"), 2).otherwise(0)
    by_body = F.col("cm") + F.when(F.col("in_body") & F.contains("b", "q"), F.col("method") + 1).otherwise(0)
    told = read.select(*own, by_title.alias("title_matches"), by_body.alias("content_matches"))
    found = written(sure.unionByName(told).where((F.col("method") == TITLE) | (F.col("content_matches") > 0)), "scored")
    titled = found.where(F.col("method") == TITLE).select("query_id").distinct().withColumn("titled", F.lit(True))
    found = found.join(titled, "query_id", "left").where((F.col("method") == TITLE) | F.col("titled").isNull())
    n = F.greatest(F.lit(1), F.col("m"))
    title_score = F.greatest(F.lit(0.3), F.least(F.lit(1.0), (F.col("title_matches") * 0.6 + F.col("content_matches") * 0.4) / n))
    score = F.when(F.col("method") == TITLE, title_score).otherwise(F.least(F.lit(1.0), F.col("content_matches") * 0.4 / n))
    return found.select("query_id", "article_id", "modified", "title", "title_matches", "content_matches", score.alias("relevance_score"), "method")
