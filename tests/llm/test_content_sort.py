"""Exact duplicates by content sort against a plain version."""

import collections
import hashlib
import string

import pytest

from passagework.llm import content_sort

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ODD = [(1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "a"), (8, "A"), (8, "A"), (None, "a"), (None, "only without id"), (None, "only without id")]
LONG = [(100 + k, "word " * 40_000 + tail) for k, tail in enumerate(["x", "y", "X", "x"])]
HOT = [(1000 + k, "hot") for k in range(400)] + [(2000 + k, f"lone {k}") for k in range(300)] + [(3000 + k, f"pair {k // 2}" * 30) for k in range(300)]


def plain(rows):
    found = collections.defaultdict(list)
    for i, t in rows:
        found[(t or "").translate(LOWER)].append(i)
    out = []
    for t, ids in found.items():
        order = sorted(ids, key=lambda i: (i is None, -(i or 0)))
        out += [(i, order[0], len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()) for n, i in enumerate(order)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_classes_equal_plain_groups(spark, parts):
    """With 60 partitions the hot text lies in dozens of them, and many partitions hold one group only."""
    rows = ODD + LONG + HOT
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, edge int, sha int, keep int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = content_sort.classes(docs).collect()
        kept = content_sort.deduplicate(docs)
        kept_rows = kept.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)
    assert kept.columns == docs.columns
    want = sorted((p[0], p[4]) for p in plain(rows) if p[3] and p[0] is not None)
    assert sorted((r.doc_id, hashlib.sha256((r.text or "").translate(LOWER).encode()).hexdigest()) for r in kept_rows if r.doc_id is not None) == want
    assert len(kept_rows) == len(want) + 1


def test_no_rows_and_text_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert content_sort.classes(none).count() == 0 and content_sort.deduplicate(none).count() == 0
    named = spark.createDataFrame([("a", "x"), ("b", "X")], "name string, body string")
    assert [r.name for r in content_sort.deduplicate(named, text="body", doc_id="name").collect()] == ["b"]


def test_one_batch_after_another(spark):
    """Groups that reach over many Arrow batches."""
    rows = [(k, "hot" if k % 3 else f"lone {k}") for k in range(1000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        got = content_sort.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        kept = content_sort.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)
    assert sorted(r.doc_id for r in kept) == sorted([998, *range(0, 1000, 3)])
