"""Clashing columns, repeated rows, long texts and empty tables, for operators and for all stages of the pipeline."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from passagework.llm import balanced_shards, dart_minhash, topk_columnar, trie_counts
from tests.llm.test_text_operators import ODD, PIECES

TABLES = ("documents", "labels", "benchmark")


def test_topk_with_clashing_columns(spark):
    vectors = [(i, [i % 5, 3 - i % 7, i]) for i in range(30)]
    plain = spark.createDataFrame(vectors, "vec_id long, vector array<long>")
    names = ("query_id", "rank", "score", "block", "shard", "asks", "query_key", "width", "n")
    clashing = plain.withColumns({c: F.lit("x") for c in names})
    got = topk_columnar.top_k(clashing, clashing.where("vec_id % 10 = 0"), k=4).collect()
    assert sorted(got) == sorted(topk_columnar.top_k(plain, plain.where("vec_id % 10 = 0"), k=4).collect()) and len(got) == 12


def test_shard_values_are_those_of_the_texts(spark):
    rows = [(7, "the same row again")] * 300 + [(k, f"text {k} é 日") for k in range(100)] + [(None, None), (None, None), (500, "")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, h int")
    got = balanced_shards.assign(docs, shards=8).collect()
    plain = lambda i, t: (i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted(plain(*r) for r in rows)
    assert len({(r.shard, r.slot) for r in got}) == len(rows)


def test_a_long_text_that_repeats_its_shingles(spark):
    long = " ".join(f"w{k % 7}" for k in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, long.upper()), (4, "w0 w1 w2 w3 w4 w5 w6"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in dart_minhash.classes(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    counts = {r.doc_id: (r.n_words, r.n_tokens) for r in trie_counts.count_tokens(docs, PIECES).collect()}
    part = counts[4][1]
    assert counts[1][0] == 200_000 and counts[1][1] // part == 200_000 // 7 and counts[5] == (0, 0)


def stored(spark, folder, path, change):
    for name in TABLES:
        change(name, spark.read.parquet(f"{folder}/{name}.parquet")).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_pipeline_of_odd_rows(spark, folder, tmp_path):
    long = " ".join(f"plain{k}" for k in range(60_000))
    odd = [(100_000 + n, t, None, None, None) for n, (_, t) in enumerate(ODD)] + [(None, "no id at all", "en", "s", 5), (100_100, long, "en", "s", 1), (100_100, long, "en", "s", 1)]

    def change(name, df):
        if name == "documents":
            df = df.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))
            return df.withColumns({c: F.lit("x") for c in ("digest", "label", "ids", "score", "mask")})
        if name == "benchmark":
            return df.unionByName(spark.createDataFrame([(None, None), (9000, ""), (9000, None)], "item_id long, text string")).withColumn("doc_id", F.lit(1))
        return df.unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None), (123456789, 0, 1)], df.schema)).withColumn("text", F.lit("x"))

    path = stored(spark, folder, tmp_path, change)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        left = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(left) > 0.5 * docs.count() and set(left) <= {r.doc_id for r in docs.collect()}, name
    assert len(names) == 5
    result = corpus_pipeline.run(spark, path)
    assert {"doc_id", "ids_sha256", "decoded_sha256"} <= set(result.columns)
    kept = [r.doc_id for r in result.collect()]
    assert kept and kept.count(100_100) <= 1  # the repeated row is there once


@pytest.mark.parametrize("none", [("documents",), TABLES])
def test_pipeline_of_empty_tables(spark, folder, tmp_path, none):
    path = stored(spark, folder, tmp_path, lambda name, df: df.limit(0) if name in none else df)
    assert corpus_pipeline.run(spark, path).count() == 0
