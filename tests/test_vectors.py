import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagework.functions import vectors as V
from passagework.operators import blocks as B
from passagework.operators import cells as CE
from passagework.operators import embedding as E
from passagework.session import written
from passagework.sources import vector_store as ST


def frame(spark, matrix, name):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} bigint, embedding array<float>")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    base = np.round(rng.normal(size=(60, 8)), 2).astype(np.float32)
    base[7] = base[3]  # equal vectors tie, the smaller id goes first
    base[9] = 0
    return base


def brute(queries, vectors, k):
    def unit(m):
        n = np.linalg.norm(m.astype(float), axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros(m.shape), where=n > 0)

    scores = np.round(unit(queries) @ unit(vectors).T, 12)
    return {q: sorted(range(len(vectors)), key=lambda i: (-scores[q, i], i))[:k] for q in range(len(queries))}


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out.get(r.query_id, [])) + 1
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.parametrize("limit", [4096, 0])
def test_exact_topk(spark, data, limit, monkeypatch):
    monkeypatch.setattr(B, "SLICE_ROWS", 7)
    got = B.exact_topk(frame(spark, data[:12], "query_id"), frame(spark, data, "id"), 5, limit)
    assert collected(got) == brute(data[:12], data, 5)


def test_exact_topk_with_many_shards_and_blocks(spark, data, monkeypatch):
    monkeypatch.setattr(B, "SHARD_ROWS", 4)
    monkeypatch.setattr(B, "QUERY_BLOCK", 3)
    got = B.exact_topk(frame(spark, data[:12], "query_id"), frame(spark, data, "id"), 5, 0)
    assert collected(got) == brute(data[:12], data, 5)


def test_empty_tables(spark, data):
    none = spark.createDataFrame([], "query_id bigint, embedding array<float>")
    assert B.exact_topk(none, frame(spark, data, "id"), 3).count() == 0
    empty = spark.createDataFrame([], "id bigint, embedding array<float>")
    assert B.exact_topk(frame(spark, data[:3], "query_id"), empty, 3).count() == 0


def test_approximate_recall_and_hot_cell(spark, folder, monkeypatch):
    v = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = v.withColumnRenamed("id", "query_id")
    centroids = B.train_cells(v, cells=20, iterations=5)
    exact = {(r.query_id, r.id) for r in B.exact_topk(q, v, 5).collect()}
    celled = B.assign_cells(v, centroids)
    some = {(r.query_id, r.id) for r in B.approximate_topk(q, celled, centroids, 5, nprobe=6).collect()}
    assert len(exact & some) / len(exact) > 0.6
    # All cells probed is exact, also when every cell is split into shards.
    monkeypatch.setattr(B, "SHARD_ROWS", 10)
    full = {(r.query_id, r.id) for r in B.approximate_topk(q, celled, centroids, 5, nprobe=20).collect()}
    assert full == exact


@pytest.mark.parametrize("limit", [4096, 0])
def test_stored_cells_are_exact_when_unbounded(spark, tmp_path, limit, monkeypatch):
    """Clustered vectors in two batches, other lengths among them, with ties and zero vectors."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8)) * 4
    base = centres[np.arange(200) % 6] + rng.normal(size=(200, 8)) * 0.3
    base[50], base[60] = base[8], 0
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(300 + i, v[:3].tolist()) for i, v in enumerate(base[:9])] + [(400, None), (401, [float("nan")] * 8)]
    stored = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    path = str(tmp_path / "cells")
    CE.build(stored.where("id % 3 <> 0"), path, cells=6, iterations=5, dimension=8)
    CE.append(stored.where("id % 3 = 0"), path, 1)
    CE.append(stored.where("id % 3 = 0"), path, 1)  # put again
    queries = stored.where("id % 9 = 0 or id = 60 or id >= 305").withColumnRenamed("id", "query_id")
    monkeypatch.setattr(B, "SHARD_ROWS", 16)
    got = CE.search(queries, path, 4, nprobe=1, broadcast_limit=limit).collect()
    want = B.exact_topk(queries, stored, 4).collect()
    assert sorted((r.query_id, r.rank, r.id, r.score) for r in got) == sorted((r.query_id, r.rank, r.id, r.score) for r in want)
    assert all(r.proved for r in got)
    once = CE.search(queries, path, 4, nprobe=1, rounds=1, broadcast_limit=limit).collect()
    exact = {(r.query_id, r.id) for r in want}
    assert all((r.query_id, r.id) in exact for r in once if r.proved) and any(r.proved for r in once if r.query_id < 200)


def test_cells_not_asked_for_are_not_read(spark, folder, tmp_path):
    v = spark.read.parquet(f"{folder}/embeddings.parquet").selectExpr("vec_id as id", "embedding")
    path = str(tmp_path / "cells")
    CE.build(v, path, cells=5, iterations=2)
    stored = spark.read.parquet(f"{path}/vectors")
    probes = v.limit(2).selectExpr("id as query_id", "embedding", "1 as cell")
    left, right = CE.probe_plan(written(probes, "probes"), stored)
    plan = right._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and right.select("cell").distinct().count() == 1
    few = CE._probe_few(probes.toArrow(), stored, 2)._jdf.queryExecution().executedPlan().toString()
    assert "(cell" in few.split("PartitionFilters: [")[1].split("]")[0]


def test_normalize_cosine_validity(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    r = df.select(
        V.l2_normalize(F.col("a")).alias("u"), V.l2_normalize(F.col("z")).alias("zero"),
        V.cosine(F.col("a"), F.col("z")).alias("c0"), V.cosine(F.col("a"), F.col("a")).alias("c1"),
        V.is_valid_vector(F.col("a"), 2).alias("ok"), V.is_valid_vector(F.col("a"), 3).alias("short"),
        V.is_valid_vector(F.array(F.lit(float("inf")), F.lit(1.0)), 2).alias("inf"),
    ).first()
    assert r.u == pytest.approx([0.6, 0.8]) and r.zero == [0.0, 0.0]
    assert (r.c0, r.c1) == (0.0, pytest.approx(1.0))
    assert (r.ok, r.short, r.inf) == (True, False, False)


def test_ids_are_dense_and_ordered(spark, data):
    shuffled = frame(spark, data, "k").withColumn("order", -F.col("k")).repartition(7)
    got = ST.assign_ids(shuffled, ["order"], 100).orderBy("id").collect()
    assert [r.id for r in got] == list(range(100, 160))
    assert [r.k for r in got] == list(range(59, -1, -1))


def test_prepare_rejects_a_batch_with_a_bad_vector(spark):
    bad = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [1.0, 2.0])], "k int, embedding array<float>")
    with pytest.raises(ValueError):
        ST.prepare_vectors(bad, 2, ["k"])


@pytest.mark.parametrize("limit", [4096, 0])
def test_visual_topk_first_page_of_equals(spark, limit):
    rows = [(1, 2, 0, [1.0, 0.0]), (1, 1, 1, [1.0, 0.0]), (2, 1, 0, [0.0, 1.0]), (3, 4, 0, [1.0, 0.0]), (3, 3, 1, [0.5, 0.5])]
    patches = spark.createDataFrame(rows, "doc_id bigint, page int, patch_index bigint, embedding array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id bigint, embedding array<float>")
    got = [(r.doc_id, r.page, r.rank) for r in B.visual_topk(q, patches, 2, limit).orderBy("rank").collect()]
    assert got == [(1, 1, 1), (3, 4, 2)]
    asked = spark.createDataFrame([(1, 1), (1, 3)], "query_id bigint, doc_id bigint")
    pages = {(r.doc_id, r.page): round(r.score, 6) for r in B.maxsim_pages(asked, q, patches).collect()}
    assert pages == {(1, 1): 1.0, (1, 2): 1.0, (3, 3): 0.707107, (3, 4): 1.0}


def test_maxsim_splits_a_hot_document(spark, monkeypatch):
    monkeypatch.setattr(B, "SHARD_ROWS", 3)
    monkeypatch.setattr(B, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(40, 4))
    patches = spark.createDataFrame([(1, i % 4, i, [float(x) for x in v]) for i, v in enumerate(m)], "doc_id bigint, page int, patch_index bigint, embedding array<double>")
    q = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(5)], "query_id bigint, embedding array<double>")
    asked = q.selectExpr("query_id", "1L as doc_id")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {(r.query_id, r.page): r.score for r in B.maxsim_pages(asked, q, patches).collect()}
    want = {(i, p): (unit[i] @ unit[p::4].T).max() for i in range(5) for p in range(4)}
    assert got == pytest.approx(want)


def test_hybrid_weights_zero_and_one(spark):
    def hits(rows):
        return spark.createDataFrame(rows, "query_id bigint, id bigint, score double, rank int")

    text, visual = hits([(1, 10, 0.9, 1), (1, 11, 0.5, 2)]), hits([(1, 20, 0.8, 1), (1, 10, 0.5, 2)])

    def order(w):
        return [(r.source, r.id) for r in B.hybrid_fuse(text, visual, 2, w).orderBy("rank").collect()]

    assert order(1.0) == [("text", 10), ("text", 11)]
    assert order(0.0) == [("visual", 20), ("visual", 10)]
    # The same document may come from both sides.
    both = B.hybrid_fuse(text, visual, 4, 0.5).orderBy("rank").collect()
    assert [(r.source, r.id) for r in both] == [("text", 10), ("visual", 20), ("text", 11), ("visual", 10)]


def test_cache_meets_each_text_once(spark):
    texts = spark.createDataFrame([("a b",), ("a b",), ("c",), ("d e f",)], "text string")
    docs = spark.createDataFrame([("a b",), ("x",)], "text string")
    idf = E.fit_idf(E.count_terms(docs))
    cache = E.embed(E.count_terms(spark.createDataFrame([("c",)], "text string")), idf).withColumn("key", E.cache_key(F.col("text"), "m"))
    rows, fresh = E.cached_embed(texts, cache.select("key", "embedding"), lambda m: E.embed(E.count_terms(m), idf), "m")
    assert fresh.count() == 2 and rows.count() == 4
    s = E.cache_stats(rows).first()
    assert (s.created, s.hits, s.misses, s.tokens, s.hit_rate) == (2, 2, 2, 5, 0.5)


def test_cache_keeps_null_texts(spark):
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (4, None)], "id int, text string")
    none = spark.createDataFrame([], "key string, embedding array<double>")
    rows, fresh = E.cached_embed(texts, none, lambda m: m.withColumn("embedding", F.array(F.length("text").cast("double"))), "m")
    assert sorted((r.id, r.text, r.embedding[0]) for r in rows.collect() if r.text is not None) == [(2, "", 0.0), (3, "x", 1.0)]
    assert rows.count() == 4 and fresh.count() == 2


def test_cache_table_is_not_shuffled(spark, tmp_path):
    name = f"cache_{tmp_path.name}".replace("-", "_")
    E.open_cache(spark, name, str(tmp_path / "cache"))
    E.open_cache(spark, name, str(tmp_path / "cache"))
    seen = []
    embedder = lambda m: m.withColumn("embedding", F.array(F.length("text").cast("double")))
    for texts in (["a", "bb", "a", None], ["bb", "ccc", ""]):
        frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
        seen.append(sorted((r.i, r.embedding[0], r.was_cached) for r in E.cached_embed_table(frame, name, embedder, "m").collect()))
    assert seen == [[(0, 1.0, False), (1, 2.0, False), (2, 1.0, False), (3, 0.0, False)], [(0, 2.0, True), (1, 3.0, False), (2, 0.0, True)]]
    assert spark.table(name).count() == 4
    keyed = spark.range(10).select(F.col("id").cast("string").alias("key"))
    plan = E.known_keys(keyed, name)._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.split("\n") if "FileScan" in line][0]
    depth = len(scan) - len(scan.lstrip(" :+-"))
    above = plan.split("\n")[: plan.split("\n").index(scan)]
    path = []
    for line in reversed(above):  # the operators between the scan and the root
        d = len(line) - len(line.lstrip(" :+-"))
        if d < depth:
            path.append(line)
            depth = d
    assert not any("Exchange" in line for line in path[: next(i for i, line in enumerate(path) if "Join" in line) + 1])


def test_own_embedder_runs_in_batches(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", " ", "bad", "cc"])], "i int, text string").coalesce(1)

    def lengths(texts):
        if "bad" in texts:
            raise ValueError
        return [[len(t), len(texts)] for t in texts]

    rows = E.embed_with(df, lengths, 2, batch=2).orderBy("i").collect()
    assert [r.embedding for r in rows] == [[1, 2], [2, 2], [0, 0], [0, 0], [0, 0]]
    assert [r.embedding_error for r in rows] == [None, None, None, "ValueError: ", "ValueError: "]


def test_blank_text_is_the_zero_vector(spark):
    df = E.count_terms(spark.createDataFrame([("",), ("a b",)], "text string"))
    got = E.embed(df, E.fit_idf(df)).collect()
    assert set(got[0].embedding) == {0.0}
    assert np.linalg.norm(got[1].embedding) == pytest.approx(1.0)


@pytest.mark.parametrize("limit", [4096, 0])
def test_searches_leave_out_unusable_vectors(spark, limit):
    good = [(k, [float(k % 5), 1.0, float(k)]) for k in range(6)]
    bad = [(10, None), (11, [1.0, 2.0]), (12, [float("nan"), 0.0, 1.0]), (13, [1.0, None, 2.0]), (14, [float("inf"), 0.0, 0.0])]
    vectors = spark.createDataFrame(bad + good, "id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 1.0, 1.0]), (2, None), (3, [1.0]), (4, [2.0, 1.0])], "query_id long, embedding array<double>")
    got = B.exact_topk(queries, vectors, 6, limit).collect()
    assert sorted(r.id for r in got if r.query_id == 1) == list(range(6))
    assert [r.id for r in got if r.query_id == 4] == [11] and {r.query_id for r in got} == {1, 4}  # each query meets its own length
    report = {(r.verdict, r.length): r.vectors for r in B.vector_report(vectors).collect()}
    assert report == {("no vector", 0): 1, ("searched", 2): 1, ("searched", 3): 6, ("not finite", 3): 3}
    patches = vectors.selectExpr("id as doc_id", "0 as page", "0 as patch_index", "embedding")
    short = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, embedding array<double>")  # cut to the smaller dimension
    assert sorted(r.doc_id for r in B.visual_topk(short, patches, 9, limit).collect()) == [*range(6), 11]
    asked = spark.createDataFrame([(1, d) for d in (*range(6), 10, 12)], "query_id long, doc_id long")
    assert sorted(r.doc_id for r in B.maxsim_pages(asked, short, patches).collect()) == list(range(6))


def test_scores_are_held_a_slice_at_a_time():
    """5,000 queries and 4,000 equal vectors: all scores would be 160 MB, and all of them tie."""
    rng = np.random.default_rng(2)
    queries, vectors = B._unit(rng.normal(size=(5000, 8))), np.ones((4000, 8)) / np.sqrt(8)
    tracemalloc.start()
    running = B._Running(queries, 3)
    running.add(np.arange(4000)[::-1], vectors)
    table = pa.table({"doc_id": np.arange(4000) // 400, "page": np.arange(4000) % 5, "embedding": pa.FixedSizeListArray.from_arrays(vectors.ravel(), 8).cast(pa.list_(pa.float64()))})
    pages = sum(len(names) for names, docs, _, best in B._page_scores(np.arange(5000), queries, table) if best.shape == (len(names), 50) and len(docs) == 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert running.found[1].reshape(5000, 3).tolist() == [[0, 1, 2]] * 5000 and pages == 5000
    assert peak < 150 << 20


def test_embedding_cache_counts_each_text_once_and_null_as_empty(spark, tmp_path):
    """the texts were counted for the weights, for the cache and for what it misses; null texts in the cache had no vector."""
    from passagework.plans.vector_queries import embedding_cache

    rows = [(1, "de", None), (2, "de", "ab cd ab"), (3, "en", "ab cd ab"), (4, "en", "ef"), (5, "en", None)]
    spark.createDataFrame(rows, "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.was_cached, r.total) for r in embedding_cache(spark, str(tmp_path)).collect()}
    assert {i: c for i, (c, _) in got.items()} == {1: True, 2: True, 3: True, 4: False, 5: True}
    assert got[1] == got[5] == (True, 0.0) and got[2] == got[3] and got[2][1] > 0 and got[4][1] > 0


def test_copies_of_a_patch_make_no_large_group(spark):
    """Shards are dealt by content, so copies would all lie in one."""
    rows = [(1, 1, [1.0, 0.0])] * 500 + [(1, 2, [1.0, 0.0])] * 500 + [(2, 1, [0.6, 0.8])]
    patches = spark.createDataFrame(rows, "doc_id long, page int, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<double>")
    parts = B.visual_topk(asked, patches, 2, broadcast_limit=0)
    found = lambda df: sorted((r.query_id, r.doc_id, r.page, round(r.score, 9), r["rank"]) for r in df.collect())
    assert found(parts) == found(B.visual_topk(asked, patches, 2)) == [(7, 1, 1, 1.0, 1), (7, 2, 1, 0.6, 2)]
    assert "Aggregate [doc_id" in parts._jdf.queryExecution().optimizedPlan().toString()


class Caught:
    """Stands for a DataFrame and hands out the function that a task would run."""

    def __init__(self, spark):
        self.sparkSession = spark

    def __getattr__(self, name):  # where, select, groupBy, cogroup
        return lambda *_: self

    def mapInArrow(self, function, _):
        return function

    applyInArrow = mapInArrow


def large_group(n, name, seed, **more):
    m = np.random.default_rng(seed).normal(size=(n, 8))
    return m, pa.table({name: np.arange(n), **more, "embedding": pa.FixedSizeListArray.from_arrays(m.ravel(), 8).cast(pa.list_(pa.float64()))})


def check_task(search, queries, vectors):
    """A task over 4,096 queries and 9,000 vectors, all scores of which would be 295 MB: its result and its memory."""
    tracemalloc.start()
    out = search()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found = sorted(zip(*(out.column(c).to_pylist() for c in ("query_id", "id"))))
    assert found[:60] == sorted((q, i) for q, ids in brute(queries[:20], vectors, 3).items() for i in ids) and len(found) == 3 * 4096
    assert peak < 60 << 20


def test_a_large_group_of_the_grid_holds_few_scores(spark):
    """F13, exact_search_grid: 2,048 x 8,192 scores were held at a time."""
    (queries, left), (vectors, right) = large_group(4096, "query_id", 1), large_group(9000, "id", 2)
    search = B.keyed_topk(Caught(spark), Caught(spark), ["shard", "qb"], 3)
    check_task(lambda: search(left, right), queries, vectors)


def test_a_broadcast_query_set_holds_few_scores(spark):
    """F14, exact_search: a query set that is broadcast meets each batch in the same steps."""
    (queries, head), (vectors, rows) = large_group(4096, "query_id", 1), large_group(9000, "id", 2)
    search = B._broadcast_topk(head, Caught(spark), 3)
    check_task(lambda: pa.Table.from_batches(search(rows.to_batches())), queries, vectors)


def test_probes_of_one_cell_hold_few_scores(spark):
    """F15, approx_recall: probes that are broadcast meet the rows of their cell in the same steps."""
    cell = lambda n: pa.array(np.zeros(n, np.int32))
    (queries, head), (vectors, rows) = large_group(4096, "query_id", 1, cell=cell(4096)), large_group(9000, "id", 2, cell=cell(9000))
    search = CE._probe_few(head, Caught(spark), 3)
    check_task(lambda: pa.Table.from_batches(search(rows.to_batches())), queries, vectors)


def test_probes_of_a_hot_cell_make_bounded_groups(spark, monkeypatch):
    monkeypatch.setattr(B, "SHARD_ROWS", 50)
    monkeypatch.setattr(B, "QUERY_BLOCK", 20)
    rows = lambda n, name: spark.range(n).select(F.col("id").alias(name), F.array(F.lit(1.0)).alias("embedding"), F.lit(0).alias("cell"))
    asked, held = CE.probe_plan(rows(200, "query_id"), rows(1000, "id"))
    sizes = lambda df: [r["count"] for r in df.groupBy("cell", "shard", "qb").count().collect()]
    # dealt by hash, so some are larger than the mean; every query meets every vector
    assert max(sizes(held)) < 100 and sum(sizes(held)) == 10 * 1000 and max(sizes(asked)) < 40 and sum(sizes(asked)) == 20 * 200
