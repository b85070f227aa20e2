"""Chunking against plain Python on small and on real texts."""

import re

import pytest
from pyspark.sql import functions as F

from passagework.operators import chunking as C


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id int, text string")


def contents(df):
    return [r.content for r in df.orderBy("doc_id", "chunk_number").collect()]


def expected_sentences(text, size, overlap):
    """Greedy packing written from the rule: pieces with word counts, then indexes."""
    sents = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text) if s.strip()]
    out, open_text = [], ""
    for s in sents:
        if open_text and len(open_text.split()) + len(s.split()) > size:
            out.append(open_text)
            tail, n = [], 0
            for p in re.split(r"(?<=[.!?])\s+", open_text)[::-1]:
                n += len(p.split())
                if n > overlap:
                    break
                tail.insert(0, p)
            open_text = " ".join(tail + [s])
        else:
            open_text = f"{open_text} {s}" if open_text else s
    return out + [open_text] if open_text else out


def test_fixed_windows_stop_at_the_last_word(spark):
    df = texts(spark, " ".join(f"w{i}" for i in range(10)))
    rows = C.chunk(df, strategy="fixed", size=4, overlap=1).orderBy("chunk_number").collect()
    assert [r.content for r in rows] == ["w0 w1 w2 w3", "w3 w4 w5 w6", "w6 w7 w8 w9"]
    assert [r.start_index for r in rows] == [0, 8, 17]
    assert [r.end_index for r in rows] == [11, 19, 28]
    assert [r.chunk_id for r in rows] == ["token_chunk_000", "token_chunk_001", "token_chunk_002"]


def test_blank_text_has_no_chunks(spark):
    for strategy in C.STRATEGIES:
        assert C.chunk(texts(spark, "", "  \n\t "), strategy=strategy).count() == 0


def test_sentence_overlap_small(spark):
    text = "One two three. Four five. Six seven eight nine. Ten."
    got = contents(C.chunk(texts(spark, text), strategy="sentences", size=6, overlap=2))
    assert got == ["One two three. Four five.", "Four five. Six seven eight nine.", "Ten."]


@pytest.mark.parametrize("size,overlap", [(200, 40), (30, 29), (12, 0), (50, 10)])
def test_sentence_overlap_on_documents(spark, folder, size, overlap):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {}
    for r in C.chunk(docs, strategy="sentences", size=size, overlap=overlap).orderBy("doc_id", "chunk_number").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    for d in docs.collect():
        assert got.get(d.doc_id, []) == expected_sentences(d.text, size, overlap)


def test_paragraphs_pack_and_split(spark):
    long = " ".join(["Alpha beta gamma."] * 4)
    text = f"one two\n\nthree four\n \nfive six seven\n\n{long}\n\nlast"
    rows = C.chunk(texts(spark, text), strategy="paragraphs", size=5, overlap=0).orderBy("chunk_number").collect()
    assert [r.content for r in rows] == [
        "one two\n\nthree four", "five six seven", *["Alpha beta gamma."] * 4, "last",
    ]
    assert [r.chunk_method for r in rows] == ["paragraphs"] * 2 + ["paragraphs_split"] * 4 + ["paragraphs"]
    assert [r.chunk_id for r in rows] == [f"paragraph_chunk_{i:03d}" for i in range(7)]
    assert [r.start_index for r in rows] == [0, 0, 0, 5, 10, 15, 0]


def test_semantic_sections(spark):
    text = "intro line\n# Title One\nbody a\n2. Second part\nbody b\nTHIRD PART:\nbody c\nNote:\nbody d"
    got = contents(C.chunk(texts(spark, text), strategy="semantic", size=50, overlap=5))
    assert got == [
        "intro line", "# Title One\nbody a", "2. Second part\nbody b", "THIRD PART:\nbody c", "Note:\nbody d",
    ]


def test_structured_entries_are_one_chunk_each(spark):
    text = "Head\n### Sheet: S - Entry 1\n\nfirst row\n\n### Sheet: S - Entry 2\n\nsecond row\n"
    rows = C.chunk(texts(spark, text), strategy="structured_data", size=50, overlap=5).orderBy("chunk_number").collect()
    assert [r.content for r in rows] == [
        "### Sheet: S - Entry 1\n\nfirst row", "### Sheet: S - Entry 2\n\nsecond row",
    ]
    assert [r.chunk_id for r in rows] == ["data_entry_001", "data_entry_002"]
    assert rows[1].start_index == rows[0].end_index == len(rows[0].content)


def test_csv_entries_fall_back_to_sections(spark):
    text = "### CSV: c - Entry 1\n\nfirst\n\n### CSV: c - Entry 2\n\nsecond"
    rows = C.chunk(texts(spark, text), strategy="structured_data", size=50, overlap=5).collect()
    assert {r.chunk_method for r in rows} == {"semantic"} and len(rows) == 2


def test_wrong_arguments():
    for kwargs in ({"size": 5, "overlap": 5}, {"size": 5, "overlap": -1}):
        with pytest.raises(ValueError):
            C.chunk_expression(F.lit("x"), "fixed", **kwargs)
    with pytest.raises(ValueError):
        C.chunk_expression(F.lit("x"), "other")


def test_texts_of_fixed_windows_alone(spark):
    texts = [None, "", " \n ", "one", " a  b\tc ", " ".join(f"w{i}" for i in range(23))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    alone = frame.select("doc_id", F.posexplode(C.fixed_texts(F.col("text"), 7, 2)))
    whole = C.chunk(frame.where("text is not null"), strategy="fixed", size=7, overlap=2).select("doc_id", "chunk_number", "content")
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, whole.collect()))
