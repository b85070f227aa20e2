"""Chunking: one row per document in, one row per chunk out, without a shuffle.

Each strategy is an expression that returns ``array<struct<content, start_index,
end_index, method>>`` for the text of its own row; :func:`chunk` explodes it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions import constants as K
from passagework.functions.text import empty_strings, let, lines, strip, word_count, words

CHUNKS = "array<struct<content:string,start_index:int,end_index:int,method:string>>"


def _piece(content: Column, start: Column, end: Column, method: str | Column) -> Column:
    label = F.lit(method) if isinstance(method, str) else method
    return F.struct(
        content.alias("content"),
        start.cast("int").alias("start_index"),
        end.cast("int").alias("end_index"),
        label.alias("method"),
    )


#: Numbers that one inner fold of a running sum takes; a fold copies its state at every step.
SUM_BLOCK = 256


def sums_before(lengths: Column) -> Column:
    """At each place the sum of all numbers before it: sums inside blocks, shifted by the sums of whole blocks."""

    def running(xs):
        return F.aggregate(xs, F.array(F.lit(0)), lambda sums, n: F.array_append(sums, F.element_at(sums, -1) + n))

    def blocks(xs):
        last = F.greatest(F.lit(0), F.ceil(F.size(xs) / SUM_BLOCK).cast("int") - 1)
        return F.transform(F.sequence(F.lit(0), last), lambda b: running(F.slice(xs, b * SUM_BLOCK + 1, SUM_BLOCK)))

    def shifted(bs):
        totals = running(F.transform(bs, lambda x: F.element_at(x, -1)))
        return let(
            totals,
            lambda before: F.flatten(
                F.transform(bs, lambda x, b: F.transform(F.slice(x, 1, F.size(x) - 1), lambda v: v + F.get(before, b)))
            ),
        )

    return let(let(lengths, blocks), shifted)


def fixed(text: Column, size: int, overlap: int) -> Column:
    """Word windows of ``size`` that advance by ``size - overlap``."""
    step = size - overlap

    def windows(w):
        last = F.greatest(F.lit(0), F.ceil((F.size(w) - size) / F.lit(step)).cast("int"))
        starts = F.sequence(F.lit(0), last)
        # Length of each step of words and the space before the next; the running sum gives the character offsets.
        widths = F.transform(starts, lambda k: F.length(F.array_join(F.slice(w, k * step + 1, step), " ")) + 1)

        def window(k, offsets):
            start = F.greatest(F.get(offsets, k) - 1, F.lit(0))
            body = F.array_join(F.slice(w, k * step + 1, size), " ")
            return _piece(body, start, start + F.length(body), "fixed_tokens")

        return let(sums_before(widths), lambda o: F.transform(starts, lambda k: window(k, o)))

    return let(words(text), lambda w: F.when(F.size(w) == 0, F.array().cast(CHUNKS)).otherwise(windows(w)))


def fixed_texts(text: Column, size: int, overlap: int) -> Column:
    """The texts of :func:`fixed`'s windows alone, without places; none for a null text."""
    step = size - overlap

    def windows(w):
        last = F.greatest(F.lit(0), F.ceil((F.size(w) - size) / F.lit(step)).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(w, k * step + 1, size), " "))

    return let(words(F.coalesce(text, F.lit(""))), lambda w: F.when(F.size(w) == 0, empty_strings()).otherwise(windows(w)))


def split_sentences(text: Column) -> Column:
    """Sentences end with . ! or ? before whitespace and an ASCII capital."""
    parts = F.split(text, r"(?<=[.!?])(?U:\s+)(?=[A-Z])")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def _places(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _closing_pieces(counts: Column, limit: int) -> Column:
    """How many of the last pieces have at most ``limit`` words in all."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("kept"), F.lit(False).alias("full"))

    def take(state, count):
        n = state["n"] + count
        stop = state["full"] | (n > limit)
        return F.struct(
            F.when(stop, state["n"]).otherwise(n).alias("n"),
            F.when(stop, state["kept"]).otherwise(state["kept"] + 1).alias("kept"),
            stop.alias("full"),
        )

    return F.aggregate(F.reverse(counts), zero, take, lambda s: F.struct(s["n"].alias("n"), s["kept"].alias("kept")))


def _sentence_marks(x: Column, size: int, overlap: int) -> Column:
    """For each chunk its first sentence, the first piece of that sentence, and the first piece of the overlap before it.

    A fold copies its state at each step, so the state has numbers only: places, never texts.
    """
    ints = F.array().cast("array<int>")
    zero = F.struct(
        F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit(0).alias("tail"), ints.alias("starts"), ints.alias("pieces"), ints.alias("tails")
    )

    def step(state, i):
        count = F.get(x["counts"], i)
        flush = (i > 0) & (state["n"] + count > size)
        begins = flush | (i == 0)
        last = _closing_pieces(F.slice(x["lengths"], state["tail"] + 1, state["at"] - state["tail"]), overlap)
        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("kept"))
        return let(
            F.when(flush, last).otherwise(none),
            lambda kept: let(
                F.when(begins, state["at"] - kept["kept"]).otherwise(state["tail"]),
                lambda tail: F.struct(
                    (F.when(flush, kept["n"]).otherwise(state["n"]) + count).alias("n"),
                    (state["at"] + F.get(x["widths"], i)).alias("at"),
                    tail.alias("tail"),
                    F.when(begins, F.array_append(state["starts"], i)).otherwise(state["starts"]).alias("starts"),
                    F.when(begins, F.array_append(state["pieces"], state["at"])).otherwise(state["pieces"]).alias("pieces"),
                    F.when(begins, F.array_append(state["tails"], tail)).otherwise(state["tails"]).alias("tails"),
                ),
            ),
        )

    return F.aggregate(_places(F.size(x["counts"])), zero, step)


def _packed_sentences(text: Column, size: int, overlap: int) -> Column:
    """Greedy packing of whole sentences; contents only. A chunk opens with the closing pieces of the one before it."""

    def measured(s):
        pieces = F.transform(s, lambda t: F.split(t, r"(?<=[.!?])(?U:\s+)"))
        return let(
            pieces,
            lambda ps: let(
                F.flatten(ps),
                lambda flat: F.struct(
                    s.alias("sentences"), flat.alias("pieces"), F.transform(s, word_count).alias("counts"),
                    F.transform(ps, F.size).alias("widths"), F.transform(flat, word_count).alias("lengths"),
                ),
            ),
        )

    def contents(x, m):
        def content(start, k):
            end = F.coalesce(F.get(m["starts"], k + 1), F.size(x["sentences"]))
            body = F.array_join(F.slice(x["sentences"], start + 1, end - start), " ")
            tail = F.slice(x["pieces"], F.get(m["tails"], k) + 1, F.get(m["pieces"], k) - F.get(m["tails"], k))
            return let(strip(F.array_join(tail, " ")), lambda t: F.when(t == "", body).otherwise(F.concat(t, F.lit(" "), body)))

        return F.transform(m["starts"], content)

    return let(
        split_sentences(text),
        lambda s: let(measured(s), lambda x: let(_sentence_marks(x, size, overlap), lambda m: contents(x, m))),
    )


def sentences(text: Column, size: int, overlap: int, method: str = "sentences") -> Column:
    return F.transform(
        _packed_sentences(text, size, overlap),
        lambda c, k: _piece(strip(c), k * size, (k + 1) * size, method),
    )


def paragraphs(text: Column, size: int, overlap: int) -> Column:
    """Packs paragraphs without overlap; an oversized one is split by sentences.

    The fold finds where chunks start; its state has numbers only. Texts are joined once, afterwards.
    """
    parts = F.filter(F.transform(F.split(text, r"\n(?U:\s*)\n"), strip), lambda p: p != "")
    zero = F.struct(F.lit(0).alias("n"), F.lit(True).alias("closed"), F.array().cast("array<int>").alias("starts"))

    def starts(counts):
        def step(state, i):
            count = F.get(counts, i)
            big = count > size
            begins = state["closed"] | big | (state["n"] + count > size)
            return F.struct(
                F.when(begins, count).otherwise(state["n"] + count).alias("n"),
                big.alias("closed"),
                F.when(begins, F.array_append(state["starts"], i)).otherwise(state["starts"]).alias("starts"),
            )

        return F.aggregate(_places(F.size(counts)), zero, step, lambda s: s["starts"])

    def pieces(p, counts, at):
        def piece(start, k):
            end = F.coalesce(F.get(at, k + 1), F.size(p))
            whole = F.array_join(F.slice(p, start + 1, end - start), "\n\n")
            return F.when(F.get(counts, start) > size, sentences(F.get(p, start), size, overlap, "paragraphs_split")).otherwise(
                let(whole, lambda w: F.array(_piece(w, F.lit(0), F.length(w), "paragraphs")))
            )

        return F.flatten(F.transform(at, piece))

    return let(
        parts,
        lambda p: let(F.transform(p, word_count), lambda counts: let(starts(counts), lambda at: pieces(p, counts, at))),
    )


def is_heading(line: Column) -> Column:
    """A stripped line that opens a section."""
    return reduce(or_, [F.rlike(line, F.lit(p)) for p in K.SECTION_PATTERNS])


def split_sections(text: Column) -> Column:
    """Stripped, non-empty line ranges between headings."""

    def cut(ls):
        heads = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: is_heading(strip(F.get(ls, i))))
        marks = F.concat(F.array(F.lit(0)), heads, F.array(F.size(ls)))
        return let(
            marks,
            lambda m: F.transform(
                F.slice(m, 1, F.size(m) - 1),
                lambda at, j: strip(F.array_join(F.slice(ls, at + 1, F.get(m, j + 1) - at), "\n")),
            ),
        )

    return F.filter(let(lines(text), cut), lambda s: s != "")


def semantic(text: Column, size: int, overlap: int) -> Column:
    """One chunk per section; a long section by sentences; no sections: by paragraphs."""

    def section(s):
        whole = F.array(_piece(s, F.lit(0), F.length(s), "semantic"))
        return F.when(word_count(s) <= size, whole).otherwise(sentences(s, size, overlap, "semantic_split"))

    return let(
        split_sections(text),
        lambda parts: F.when(F.size(parts) <= 1, paragraphs(text, size, overlap)).otherwise(
            F.flatten(F.transform(parts, section))
        ),
    )


def structured(text: Column, size: int, overlap: int) -> Column:
    """One chunk per sheet entry with running offsets; other texts by sections."""
    found = F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(K.SHEET_ENTRY), 0), strip), lambda e: e != ""
    )

    def entries(es):
        def placed(starts):
            return F.transform(es, lambda e, i: _piece(e, F.get(starts, i), F.get(starts, i) + F.length(e), "structured_data_entry"))

        return let(sums_before(F.transform(es, F.length)), placed)

    return let(
        found,
        lambda es: F.when(F.size(es) > 0, entries(es)).otherwise(semantic(text, size, overlap)),
    )


STRATEGIES = {
    "fixed": fixed,
    "sentences": sentences,
    "paragraphs": paragraphs,
    "semantic": semantic,
    "structured_data": structured,
}


def _name_prefix(method: Column) -> Column:
    """Chunk names follow the strategy that made the chunk, also after a fallback."""
    return (
        F.when(method == "fixed_tokens", "token_chunk_")
        .when(method == "sentences", "sentence_chunk_")
        .when(method.startswith("paragraphs"), "paragraph_chunk_")
        .when(method.startswith("semantic"), "semantic_chunk_")
        .otherwise("data_entry_")
    )


def chunk_expression(text: Column, strategy: str, size: int = 1000, overlap: int = 200) -> Column:
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    if overlap < 0:
        raise ValueError("overlap cannot be negative")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy: {strategy}")
    return let(
        text,
        lambda t: F.when(strip(t) == "", F.array().cast(CHUNKS)).otherwise(STRATEGIES[strategy](t, size, overlap)),
    )


def explode_chunks(df: DataFrame, chunks: Column, keep: list[str]) -> DataFrame:
    """One row per chunk with number, name, offsets, method and word count."""
    rows = df.select(*keep, F.posexplode(chunks).alias("chunk_number", "c"))
    number = F.when(F.col("c.method") == "structured_data_entry", F.col("chunk_number") + 1).otherwise(
        F.col("chunk_number")
    )
    return rows.select(
        *keep,
        "chunk_number",
        F.concat(_name_prefix(F.col("c.method")), F.format_string("%03d", number)).alias("chunk_id"),
        F.col("c.content").alias("content"),
        F.col("c.start_index").alias("start_index"),
        F.col("c.end_index").alias("end_index"),
        F.col("c.method").alias("chunk_method"),
        word_count(F.col("c.content")).alias("word_count"),
    )


def chunk(
    df: DataFrame,
    text: str = "text",
    strategy: str = "sentences",
    size: int = 1000,
    overlap: int = 200,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Chunk the ``text`` column; ``keep`` columns are repeated on every chunk."""
    return explode_chunks(df, chunk_expression(F.col(text), strategy, size, overlap), list(keep))


def chunk_by_file_type(
    df: DataFrame,
    text: str = "text",
    extension: str = "extension",
    size: int = 1000,
    overlap: int = 200,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Tables by entry, other files by section; both in one pass over the input."""
    t = F.col(text)
    both = F.when(
        F.col(extension).isin(K.TABULAR_EXTENSIONS), chunk_expression(t, "structured_data", size, overlap)
    ).otherwise(chunk_expression(t, "semantic", size, overlap))
    return explode_chunks(df, both, list(keep))


def with_global_ids(chunks: DataFrame, file: str = "file") -> DataFrame:
    """Adds '{file}_chunk_{i}'."""
    return chunks.withColumn(
        "global_id", F.concat(F.col(file), F.lit("_chunk_"), F.col("chunk_number").cast("string"))
    )


def content_profile(text: Column) -> Column:
    """Counts and averages that describe the shape of a text.

    Breaking at whitespace or punctuation does not change the number of words on
    either side, so the averages need one word count per text, not one per piece.
    """
    paras = F.split(text, r"\n(?U:\s*)\n")
    sents = F.split(text, r"[.!?]+")

    def filled(parts):
        return F.size(F.filter(parts, lambda p: strip(p) != ""))

    heads = F.filter(lines(text), lambda x: F.rlike(strip(x), F.lit(K.PROFILE_HEADING)))
    return F.struct(
        F.length(text).alias("total_length"),
        word_count(text).alias("word_count"),
        F.size(lines(text)).alias("line_count"),
        filled(paras).alias("paragraph_count"),
        filled(sents).alias("sentence_count"),
        F.size(heads).alias("heading_count"),
        (word_count(text) / F.greatest(F.size(paras), F.lit(1))).alias("avg_paragraph_length"),
        (word_count(F.regexp_replace(text, r"[.!?]+", " ")) / F.greatest(F.size(sents), F.lit(1))).alias(
            "avg_sentence_length"
        ),
    )


def recommend_strategy(profile: Column, target: int = 1000) -> Column:
    average = profile["avg_paragraph_length"]
    return (
        F.when(profile["heading_count"] > 3, "semantic")
        .when(average > target * 0.8, "sentences")
        .when((profile["paragraph_count"] > 5) & (average < target * 0.3), "paragraphs")
        .otherwise("sentences")
    )


def chunk_quality(chunks: DataFrame, target: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Size statistics of a chunk set, or of one set per ``by`` group."""
    measured = chunks.select(
        *by, word_count(F.col("content")).alias("w"), F.length("content").alias("chars"), strip(F.col("content")).alias("s")
    )
    optimal = F.count_if((F.col("w") >= target * 0.5) & (F.col("w") <= target * 1.5))
    return measured.groupBy(*by).agg(
        F.count("*").alias("total_chunks"),
        F.min("w").alias("min_words"),
        F.max("w").alias("max_words"),
        F.avg("w").alias("mean_words"),
        F.count_if(F.col("w") < target * 0.5).alias("under_half"),
        optimal.alias("optimal"),
        F.count_if(F.col("w") > target * 1.5).alias("over_half"),
        F.count_if(F.col("s") == "").alias("empty_chunks"),
        F.count_if(F.col("w") < 10).alias("very_short_chunks"),
        F.avg("chars").alias("mean_chars"),
        F.round(optimal / F.count("*") * 100, 1).alias("quality_score"),
    )
