"""Page envelopes and pair counts against plain versions."""

import numpy as np
import pytest

from passagework.operators import blocks as B
from passagework.operators import envelopes as EN
from passagework.operators import similar_pairs as SP


def clustered(rng, rows, d, centres=8):
    middle = rng.normal(size=(centres, d)) * 3
    return middle[np.arange(rows) % centres] + rng.normal(size=(rows, d)) * 0.2


@pytest.mark.parametrize("parts", [1, 6])
def test_bounded_pages_equal_all_pages(spark, parts):
    """Patches of two lengths, queries of two lengths, ties, null and spoilt vectors, more partitions than one a page."""
    rng = np.random.default_rng(8)
    v = clustered(rng, 400, 6)
    v[17], v[33] = v[1], 0
    rows = [(i % 8 + 10 * (i // 200), i // 8 % 5, i, v[i].tolist() if i % 7 else v[i][:4].tolist()) for i in range(400)]
    rows += [(90, 1, 900, None), (91, 1, 901, [float("nan")] * 6), (None, 1, 902, [1.0] * 6)]
    patches = spark.createDataFrame(rows, "doc_id long, page int, patch_index long, embedding array<double>").repartition(parts)
    queries = spark.createDataFrame([(i, v[i].tolist() if i % 3 else v[i][:5].tolist()) for i in range(20)] + [(50, None)], "query_id long, embedding array<double>")
    get = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.page, round(r.score, 9)) for r in df.collect())
    assert get(EN.visual_topk(queries, patches, 3)) == get(B.visual_topk(queries, patches, 3))
    found = EN.bounds(queries, patches, 3).pages().collect()
    assert sum(r.queries for r in found) < 0.6 * sum(r.asked for r in found)
    assert EN.visual_topk(queries, patches.limit(0), 3).count() == 0 and EN.visual_topk(queries.limit(0), patches, 3).count() == 0
    assert get(EN.visual_topk(queries, patches, 3, broadcast_limit=0)) == get(B.visual_topk(queries, patches, 3))


@pytest.mark.parametrize("rows_of_a_block", [5, 2048])
def test_pair_counts_equal_all_pairs(spark, monkeypatch, rows_of_a_block):
    monkeypatch.setattr(SP, "ROWS", rows_of_a_block)
    rng = np.random.default_rng(9)
    v = clustered(rng, 90, 5)
    rows = [(i % 4, v[i].tolist()) for i in range(90)] + [(1, v[0].tolist())] * 30 + [(2, [0.0] * 5)] * 3 + [(3, [1.0, 2.0])] * 2
    spoilt = [(None, v[0].tolist()), (1, None), (1, []), (2, [float("nan")] * 5)]
    frame = spark.createDataFrame(rows + spoilt, "label long, embedding array<double>")
    want = {}
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if len(x) == len(y):
                n = np.linalg.norm(x) * np.linalg.norm(y)
                s = round(float(np.dot(x, y) / n), 12) if n else 0.0
                entry = want.setdefault((min(a, b), max(a, b)), [0, 0, 0])
                entry[0] += 1
                entry[1] += s >= 0.9
                entry[2] += s >= 0.5
    got = {(r.label, r.other_label): [r.pairs, r.n0, r.n1] for r in SP.count_pairs(frame, (0.9, 0.5)).collect() if r.pairs}
    assert got == want
    assert SP.count_pairs(frame.limit(0), (0.5,)).count() == 0
    report = {(r.expected, r.warning): r.pairs for r in SP.similarity_report(frame).collect()}
    assert sum(report.values()) == sum(w[0] for w in want.values())


def test_a_row_is_copied_once_for_each_shard(spark, monkeypatch):
    """the rows of two blocks were shuffled for each pair of blocks."""
    monkeypatch.setattr(SP, "ROWS", 4)
    copies = spark.sparkContext.accumulator(0)
    counts = SP._counts

    def counted(*args):
        each = counts(*args)

        def run(key, table):
            copies.add(sum(len(x) for x in table.column("labels").to_pylist()))
            return each(key, table)

        return run

    monkeypatch.setattr(SP, "_counts", counted)
    v = np.random.default_rng(4).normal(size=(600, 3))
    frame = spark.createDataFrame([(i % 3, x.tolist()) for i, x in enumerate(v)], "label long, embedding array<double>")
    scores = np.round((u := v / np.linalg.norm(v, axis=1, keepdims=True)) @ u.T, 12)
    got = SP.count_pairs(frame, (0.5,)).agg({"n0": "sum", "pairs": "sum"}).first()
    assert (got["sum(n0)"], got["sum(pairs)"]) == (int(np.triu(scores >= 0.5, 1).sum()), 600 * 599 // 2)
    assert 600 <= copies.value <= 600 * 12  # 150 blocks would have made about 150 copies
