"""Knowledge-base search against plain Python over every query and article pair."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagework.operators import knowledge as KB
from passagework.operators import word_bitmaps as WB
from passagework.plans import knowledge_queries as KQ
from passagework.session import shared_folder
from passagework.sources import knowledge as SRC

WORDS = "air hotel booking cancel the repair rebooking x's late policy carpet guide? it a of handling".split()


@pytest.fixture(scope="module")
def world():
    rng = random.Random(3)
    articles = [
        (i, " ".join(rng.choices(WORDS, k=rng.randint(1, 4))).title(), "<p>" + " ".join(rng.choices(WORDS, k=12)) + "</p>", rng.randint(0, 40))
        for i in range(80)
    ]
    queries = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 4)))) for i in range(60)]
    queries += [(100, "???"), (101, "it a"), (102, "zzzunknown"), (103, ""), (104, "guide? !!! x"), (105, "of"), (106, "A")]
    return queries, articles


def frames(spark, world):
    q = spark.createDataFrame(world[0], "query_id bigint, query string")
    a = spark.createDataFrame(world[1], "article_id bigint, title string, body string, modified bigint")
    return q, a


def newest(rows, n):
    return sorted(rows, key=lambda a: (-a[3], a[0]))[:n]


def candidates(query, articles, n):
    words = [w.lower() for w in query.split() if len(w) > 2]
    likes = [w.replace("?", "").replace("!", "") for w in words or [query.lower()]]
    return newest([a for a in articles if any(x in a[1].lower() for x in likes)], n)


@pytest.mark.parametrize("n", [1, 5, 200])
def test_title_candidates(spark, world, n):
    q, a = frames(spark, world)
    got = {}
    for r in KB.title_candidates(q, a, n).collect():
        got.setdefault(r.query_id, set()).add(r.article_id)
    for qid, text in world[0]:
        assert got.get(qid, set()) == {x[0] for x in candidates(text, world[1], n)}, text


def every_candidate(query, articles):
    words = [w.lower() for w in query.split() if len(w) > 2]
    likes = [w.replace("?", "").replace("!", "") for w in words or [query.lower()]]
    return [a for a in articles if any(x and x in a[1].lower() for x in likes)]


def keyword(query, articles, n, newest_only):
    low, words = query.lower(), [w.lower() for w in query.split() if len(w) > 2]
    size = max(1, len(words))

    def hits(text, bonus):
        return sum(w in text for w in words) + (bonus if low in text else 0)

    def plain(body):
        return " ".join(body.replace("<p>", " ").replace("</p>", " ").split()).lower()

    out = []
    for a in candidates(query, articles, n) if newest_only else every_candidate(query, articles):
        score = (hits(a[1].lower(), 2) * 0.6 + hits(plain(a[2]), 1) * 0.4) / size
        out.append((max(0.3, min(1.0, score)), a))
    looked_at = newest(articles, 3 * n) if newest_only else articles if query.split() else []
    if not out:
        out = [(min(1.0, hits(plain(a[2]), 2) * 0.4 / size), a) for a in looked_at if hits(plain(a[2]), 2)]
    if not out:
        out = [(0.2, a) for a in newest(articles, n)]
    ranked = sorted(out, key=lambda x: (-round(x[0], 9), -x[1][3], x[1][0]))[:n]
    return [(a[0], pytest.approx(s)) for s, a in ranked]


@pytest.mark.parametrize("newest_only", [True, False])
def test_keyword_search(spark, world, newest_only):
    q, a = frames(spark, world)
    got = {}
    for r in KB.keyword_search(q, a, 4, fallback_all=True, newest=4 if newest_only else None).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.article_id, r.relevance_score))
    for qid, text in world[0]:
        assert got.get(qid, []) == keyword(text, world[1], 4, newest_only), text


def test_intent_search_stages(spark):
    articles = spark.createDataFrame(
        [
            (1, "Hotel cancellation policy", "", 5),
            (2, "Cancel anything", "about a hotel", 9),
            (3, "Car guide", "cancel here", 7),
            (4, "Booking overview", "the flight desk", 3),
        ],
        "article_id bigint, title string, body string, modified bigint",
    )
    queries = spark.createDataFrame(
        [(1, "cancel my hotel"), (2, "book a flight"), (3, "nonsense"), (4, "cancel the car")], "query_id bigint, query string"
    )
    got = [(r.query_id, r.article_id, round(r.relevance_score, 3), r.search_method) for r in KB.intent_search(queries, articles).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1.0, "action_and_service"), (2, 4, 0.8, "action_then_service")]


def test_the_best_article_is_found_behind_newer_ones(spark):
    rows = [(0, "Cancel the hotel booking", "hotel cancel", 0)] + [(k, "Cancel desk of any hotel", "nothing", k) for k in range(1, 9)]
    articles = spark.createDataFrame(rows, "article_id bigint, title string, body string, modified bigint")
    queries = spark.createDataFrame([(1, "cancel hotel booking"), (2, "cancel hotel booking"), (3, None)], "query_id bigint, query string")
    best = {r.query_id: r.article_id for r in KB.keyword_search(queries, articles, 3).filter("rank = 1").collect()}
    assert best == {1: 0, 2: 0}
    assert KB.keyword_search(queries, articles, 3, newest=3).filter("article_id = 0").count() == 0
    assert KB.intent_search(queries, articles, 3).count() == 6
    assert KB.keyword_search(queries, articles.limit(0)).count() == KB.intent_search(queries.limit(0), articles).count() == 0


def test_article_scan_and_union(spark):
    base = {"created": 1, "status": "Online", "language": "en_US", "record_type": "Product Documentation"}
    rows = [
        {**base, "id": 1, "title": "A", "body": "x", "modified": 1},
        {**base, "id": 2, "title": "B", "body": None, "modified": 3},
        {**base, "id": 3, "title": "C", "body": "y", "modified": 2, "status": "Draft"},
    ]
    schema = "id bigint, title string, body string, created bigint, modified bigint, status string, language string, record_type string"
    articles = SRC.scan_articles(spark.createDataFrame(rows, schema), 5)
    assert [(r.id, r.content) for r in articles.collect()] == [(2, "No content available for B"), (1, "x")]
    cases = spark.createDataFrame(
        [(7, "C-7", "Broken", "It broke", "Closed", "High", 1, 2, "Pump"), (8, "C-8", "Open", "x", "Open", "Low", 1, 2, "")],
        "id bigint, case_number string, subject string, description string, status string, priority string, created bigint, closed bigint, product string",
    )
    docs = SRC.unify_sources(articles, SRC.scan_closed_cases(cases)).collect()
    assert docs[-1].content == "Broken\n\nProblem: It broke\n\nSolution: It broke\n\nProduct: Pump, Priority: High"
    assert [d.type for d in docs] == ["knowledge_article"] * 2 + ["case_solution"]


def test_top_lines(spark):
    text = "1. Open it. Check the lid! Then wait. contact us."
    got = spark.createDataFrame([(text,)], "t string").select(KB.top_article_lines(F.col("t")).alias("x")).first().x
    assert got.split("\n") == ["**1.**", "Open it.", "**Action:** Check the lid!", "Then wait.", "**Action:** contact us."]


def test_keyword_search_writes_postings_and_no_texts(spark):
    """bodies were sorted, and written twice, to number the articles."""
    rng = random.Random(8)
    known = [f"{rng.getrandbits(40):x}" for _ in range(300)]
    rows = [(i, f"t{i}", " ".join(rng.choices(known, k=600)), i) for i in range(150)]
    a = spark.createDataFrame(rows, "article_id bigint, title string, body string, modified bigint")
    q = spark.createDataFrame([(1, known[0]), (2, f"{known[1]} t7 {known[2]}")], "query_id bigint, query string")
    sizes = lambda: {p: p.stat().st_size for p in Path(shared_folder(spark)).rglob("*.parquet") if p.is_file()}
    before = sizes()
    assert {r.query_id for r in KB.keyword_search(q, a).collect()} == {1, 2}
    written = sum(n for p, n in sizes().items() if p not in before)
    assert 0 < written < sum(len(r[2]) for r in rows) / 4


def test_places_of_one_word_are_joined():
    """Two tokens of a word, one of them in so many places that it is a bit string, become one row a span."""
    many, few = np.arange(0, WB.SPAN, 3), np.array([1, 4, 9])
    rows = [(7, "b", "air", WB._coded(many)), (7, "b", "air", WB._coded(few)), (8, "b", "air", WB._coded(few)), (7, "t", "air", WB._coded(few))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["span", "side", "part", "bits"])
    got = {(r["span"], r["side"], r["part"]): WB._places(r["bits"]).tolist() for x in WB._joined(iter([batch])) for r in x.to_pylist()}
    assert got == {(7, "b", "air"): np.union1d(many, few).tolist(), (8, "b", "air"): few.tolist(), (7, "t", "air"): few.tolist()}


def test_terms_for_body_say_what_the_body_says(spark):
    """bodies were carried to the scores; their terms give the same relevance."""
    rng = random.Random(5)
    bodies = [" ".join(rng.choices([*WORDS, *KB._BODY_TERMS, "rebooked", "Cancelled"], k=rng.randint(0, 12))) for _ in range(60)] + [None, ""]
    queries = ["How to cancel a hotel booking?", "Handle no-show flight", "How to escalate angry car rental customer?", "Modify air reservation"]
    rows = [(i, queries[i % 4], "Hotel x" if i % 3 else "Cancel it", b, i) for i, b in enumerate(bodies)]
    a = spark.createDataFrame(rows, "article_id bigint, query string, title string, body string, modified bigint")
    both = a.join(KB.with_terms_for_body(a).select("article_id", F.col("body").alias("terms")), "article_id")
    said = lambda c: KB.intent_relevance(F.col("query"), KB.extract_intent(F.col("query")), F.lower("title"), F.lower(F.coalesce(c, F.lit(""))))
    assert not any("\n" in t for t in KB._BODY_TERMS)
    got = both.select(said("body").alias("x"), said("terms").alias("y")).collect()
    assert len(got) == len(rows) and all(r.x == r.y for r in got)


@pytest.mark.parametrize("name", ["answer_sentences", "answer_sentences_all"])
def test_an_old_article_answers(spark, monkeypatch, name):
    """only the five newest title hits were scored."""
    rows = [(0, "Cancel the hotel booking", f"<p>{'The manager may waive what it costs to cancel. ' * 9}</p>", 0)]
    rows += [(k, "Cancel the hotel booking", f"<p>{'Nothing of note is here at all. ' * 9}</p>", k) for k in range(1, 9)]
    articles = spark.createDataFrame(rows, "article_id bigint, title string, body string, modified bigint")
    asked = spark.createDataFrame([(1, "Cancel a hotel booking, fee waiver")], "query_id bigint, query string")
    monkeypatch.setattr(KQ, "articles", lambda *_: articles)
    monkeypatch.setattr(KQ, "user_queries", lambda *_: asked)
    assert [r.answer.count("The manager may waive what it costs to cancel") for r in getattr(KQ, name)(spark, "").collect()] == [4]
