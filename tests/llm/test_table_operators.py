"""Archives, top-k, shards, near-duplicates, the classifier and the pipeline against plain versions."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from passagework.llm import balanced_shards, cotraining, dart_minhash, topk_columnar, warc_index
from passagework.llm.common import Memo, hash_word, word_hashes
from passagework.session import scratch_path, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_archives_of_odd_pages(spark):
    big = "x" * 1000
    pages = [(1, "http://a.b/c d\n", big), (2, None, big), (3, "http://a.b/", "é" * 499), (4, "http://a.b/", "é" * 499), (5, "not a url", None), (6, "http://a.b/", "")]
    pages += [(7, "http://a.b/", big + "y"), (7, "http://a.b/", big + "y"), (None, "http://n/", big)]
    got = warc_index.round_trip(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, sort int")).collect()
    assert all(r.intact for r in got)
    rows = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    want = []
    for i, _, html in pages:
        body = (html or "").encode()
        again = html == big and i != 2
        want.append((i or 0, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert rows == sorted(want, key=lambda w: w[:4])
    assert warc_index.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    frame = spark.createDataFrame(got)
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_index.resolved(frame).collect()) == rows
    for damage in (frame.withColumn("intact", F.lit(False)), frame.where("not (page_id = 2 and record_type = 'response')"), frame.withColumn("payload_bytes", F.col("payload_bytes") + F.when(F.col("record_type") == "revisit", 1).otherwise(0))):
        with pytest.raises(Exception, match="damaged payload|no response"):
            warc_index.resolved(damage).collect()


def test_payload_values_come_from_the_payload():
    good = warc_index.record(1, "http://a.b/", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert warc_index.unpack(good)["intact"]
    bad = warc_index.unpack(good.replace(b"abc", b"abd"))
    assert not bad["intact"] and bad["payload_digest"] == hashlib.sha1(b"abd").hexdigest()


def test_index_search_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc_index, "BLOCK_LINES", 3)
    pages = spark.range(200).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 7, F.lit(".org/p")).alias("url"), F.lit("t").alias("html"))
    archives, index = scratch_path(spark, "w"), scratch_path(spark, "i")
    files = warc_index.write_index(warc_index.write_archives(pages, archives), index)
    got = warc_index.lookup(pages.where("page_id % 3 = 0"), archives, index, files).collect()
    assert sorted(r.page_id for r in got) == list(range(0, 200, 3))
    assert warc_index.lookup(pages.selectExpr("page_id + 1000 as page_id", "url"), archives, index, files).count() == 0


@pytest.mark.parametrize("scale", [5, 10**4, 10**8])
def test_topk_equals_all_products(spark, scale):
    pick = np.random.default_rng(scale)
    vectors = [(i, v.tolist()) for i, v in enumerate(pick.integers(-scale, scale, (150, 40)))]
    vectors += [(150, vectors[0][1]), (150, vectors[0][1]), (151, [1, 2]), (152, [3, 4]), (None, vectors[1][1]), (153, None), (154, [None] * 40)]
    frame = spark.createDataFrame(vectors, "vec_id long, vector array<long>")
    got = topk_columnar.top_k(frame, frame.where("vec_id % 10 = 0 or vec_id = 151"), k=7, cell_rows=40).collect()
    want = []
    usable = [(i, v) for i, v in vectors if i is not None and v is not None and None not in v]
    for q, a in {(i, tuple(v)) for i, v in usable if i % 10 == 0 or i == 151}:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(b) == len(a))[:7]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk_columnar.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_shards_hold_their_law_and_keep_copies_together(spark):
    texts = [None] * 3 + [""] * 2 + ["hot"] * 200 + [f"pair {k // 2}" for k in range(100)] + [f"lone {k}" for k in range(298)]
    docs = spark.createDataFrame([(k if k else None, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, shard int")
    start, end = (balanced_shards.assign(docs, shards=10, rounds=r).collect() for r in (0, 6))
    for rows in (start, end):
        sizes = collections.Counter(r.shard for r in rows)
        assert len(rows) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1
        for s, n in sizes.items():
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    homes = collections.defaultdict(set)
    for r in end:
        homes[r.digest].add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 6  # the group larger than a shard, and a few where quotas hold rows back
    cut = [balanced_shards.cut_edges(spark.createDataFrame(rows, "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, digest binary")).first().cut for rows in (start, end)]
    assert cut[1] < cut[0]
    assert balanced_shards.assign(docs.limit(0)).count() == 0 and balanced_shards.assign(docs.limit(3)).count() == 3


def test_quotas_never_overfill():
    pick = random.Random(5)
    for _ in range(300):
        n = pick.randint(2, 8)
        wanted = {(i, j): pick.randint(1, 9) for i in range(n) for j in range(n) if i != j and pick.random() < 0.4}
        free = {j: pick.randint(0, 6) for j in range(n)}
        allowed, back = balanced_shards.quotas(wanted, free, n)
        net = [0] * n
        for (i, j), k in allowed.items():
            assert 0 <= k <= wanted[i, j]
            net[j] += k
            net[i] -= k
        for j, k, low, high in back:
            assert 0 <= low < high <= free[j]
            net[j] -= high - low
            net[k] += high - low
        assert net == [0] * n


def near_classes(rows):
    memo = Memo(hash_word)
    units = [set(dart_minhash.regions(word_hashes(t, memo)).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = rows[a][1] == rows[b][1] if not units[a] or not units[b] else len(units[a] & units[b]) >= 0.8 * len(units[a] | units[b])
            if same:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, least[root(k)]) for k, (i, _) in enumerate(rows))


def test_near_duplicates_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(dart_minhash, "BLOCK", 3000)  # the group is cut into several blocks
    pick = random.Random(6)
    base = [f"w{pick.randint(0, 500)}" for _ in range(120)]
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, "!!"), (6, "one two"), (7, "One, two"), (8, "a " * 5000), (9, "a " * 5000)]
    for k in range(10, 110):
        w = list(base)
        for _ in range(pick.randint(0, 4)):
            w[pick.randrange(len(w))] = f"z{pick.randint(0, 10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(k, " ".join(f"v{pick.randint(0, 10**5)}" for _ in range(60))) for k in range(110, 150)] + [(10, rows[9][1])]
    docs = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, digest binary")
    got = dart_minhash.classes(docs).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == near_classes(rows)
    kept = dart_minhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in near_classes(rows)})
    assert dart_minhash.classes(docs.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, "x y"), (None, "x y"), (3, "x y")], "doc_id long, text string")
    assert {r.class_id for r in dart_minhash.classes(alone).collect()} == {3} and dart_minhash.deduplicate(alone).count() == 1


def test_bands_are_not_broadcast(spark, monkeypatch):
    """32 bands a text were sized as one, and broadcast at any number of texts that is not very large."""
    plans = {}

    def kept(df, label):
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    monkeypatch.setattr(dart_minhash, "written", kept)
    docs = spark.createDataFrame([(i, f"some words of text {i // 2} and no more") for i in range(20)], "doc_id long, text string")
    assert dart_minhash.classes(docs).select("class_id").distinct().count() == 10
    assert "SortMergeJoin" in plans["dart-stars"] and "Broadcast" not in plans["dart-stars"]


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    known = labels.join(held.select("doc_id"), "doc_id", "left_anti")
    got = cotraining.classify(docs, known.union(known)).join(held, "doc_id").collect()
    good = [r.accepted == (r.quality == 1 and r.toxic == 0) for r in got]
    assert len(good) > 60 and sum(good) / len(good) >= 0.85
    clean = [r.accepted for r in got if r.quality == 1 and r.toxic == 0]
    assert sum(clean) / len(clean) >= 0.95


def test_classifier_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "text", "en", "s", 4)], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        rows = cotraining.classify(docs, known).collect()
        assert len(rows) == 4 and all(r.accepted for r in rows)
    assert cotraining.classify(docs.limit(0), labels).count() == 0


def some_texts(spark, n, marked):
    """``n`` documents of invented words; those in ``marked`` hold six words of their own."""
    pick, rows = random.Random(9), []
    for i in range(n):
        words = [f"w{pick.randint(0, 400)}" for _ in range(40)] + ["vile", "scum", "foul", "rot", "bile", "muck"] * 6 * (i in marked)
        pick.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", 200))
    return spark.createDataFrame(rows, DOCS)


def test_classifier_learns_a_rare_class(spark):
    toxic = set(range(0, 3000, 100))  # 1 %, of which a tenth of all labels would hold three
    docs = some_texts(spark, 3000, toxic)
    known = [(i, 1, int(i in toxic)) for i in range(3000) if i % 200]
    absent = [(i, 1, 0) for i in range(10_000, 40_000)]  # labels of documents that are not there
    labels = spark.createDataFrame(known + absent, "doc_id long, quality int, toxic int")
    got = cotraining.classify(docs, labels, labelled=300).collect()
    refused = {r.doc_id for r in got if not r.accepted}
    assert len(refused & toxic) >= 28 and len(refused - toxic) <= 3
    few = labels.where("toxic = 0 OR doc_id < 700")  # three toxic rows
    refused = {r.doc_id for r in cotraining.classify(docs, few, labelled=2000).collect() if not r.accepted}
    assert len(refused & toxic) >= 20 and len(refused - toxic) <= 30


def test_classifier_keeps_all_where_every_label_is_positive(spark):
    docs = some_texts(spark, 50, set())
    labels = spark.createDataFrame([(i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = cotraining.classify(docs, labels).collect()
    assert len(got) == 50 and all(r.accepted and r.low_score == 1 for r in got)


def test_classifier_views_teach_over_all_documents(spark, monkeypatch):
    toxic = set(range(0, 3000, 5))
    docs = some_texts(spark, 3000, toxic)
    docs = docs.union(docs.where("doc_id = 10"))  # equal rows are picked once
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(3000)], "doc_id long, quality int, toxic int")
    taught, plain = [], cotraining.Fitting.learn

    def learn(self, view, x, said, rows):
        taught.append((view, list(said), list(rows)))
        plain(self, view, x, said, rows)

    monkeypatch.setattr(cotraining.Fitting, "learn", learn)
    model = cotraining.train(docs, labels, labelled=600, per_round=40)  # labels of all documents, 600 of them in the sample
    by_words = [(said, rows) for view, said, rows in taught if view == 1]
    assert by_words[0][0].count(1.0) == 20 == by_words[0][0].count(0.0)  # the most certain of either class
    assert len(by_words) == 3 and all(len(set(rows)) == len(rows) for _, rows in by_words)
    assert sum(len(rows) for _, rows in by_words) == len({r for _, rows in by_words for r in rows})
    ids = {r.row: r.doc_id for r in docs.select(F.xxhash64("doc_id", *cotraining.NEEDED).alias("row"), "doc_id").collect()}
    assert all((ids[r] in toxic) == (c == 1) for said, rows in by_words for c, r in zip(said, rows))
    sizes = np.log1p([len(r.text) for r in docs.collect()])
    assert np.isclose(model.centre[1], sizes.mean()) and np.isclose(model.spread[1], sizes.std() + 1e-6)


def test_pipeline_stages_leave_out_what_they_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    words = " ".join(f"u{k}" for k in range(80))
    extra = [(9001, words, "en", "s", 1), (9002, words + " more", "en", "s", 1), (9003, f"intro {bench} end", "en", "s", 1), (9004, f"mail me: me@here.org {words[:100]}", "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, DOCS))
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    near = stages["MinHash near-dedup"](spark, docs, folder)
    assert 9001 in ids(near) and 9002 not in ids(near) and near.columns == docs.columns
    clean = stages["benchmark decontamination"](spark, docs, folder)
    assert 9003 not in ids(clean) and {9001, 9002, 9004} <= ids(clean) and clean.columns == docs.columns
    masked = stages["PII"](spark, docs, folder).where("doc_id = 9004").first()
    assert masked.text.startswith("mail me: [EMAIL] u0") and masked.n_chars == len(masked.text)
    assert corpus_pipeline.run(spark, folder).count() > 0
