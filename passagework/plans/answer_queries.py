"""Selection, answers and end-to-end questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.functions import constants as K
from passagework.functions.query import chart_flags, expand_query
from passagework.operators import answers as A
from passagework.operators import evaluation as EV
from passagework.operators import selection as R
from passagework.plans import pipeline as P
from passagework.plans import sql_parts as S
from passagework.plans.knowledge_queries import (
    SQL_BONUS,
    SQL_EXPANDED,
    _pick,
    articles,
    sql_article_answers,
    sql_intent_search,
    user_queries,
)
from passagework.plans.registry import query, spread, table
from passagework.plans.vector_queries import SQL_SEARCH, passages, text_chunks, text_search
from passagework.session import scratch_path

SOURCES = ["text", "colpali", "salesforce"]
QUESTIONS = [
    "What does the chart show?", "How to cancel a booking", "Response time of the search", "based on the chart, what is the total?",
    "Explain the policy", "Which rate is the highest?", "Summary please",
]


def candidates(spark, folder):
    """Three events in a row are the answers of three sources to one question."""
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    qid = F.floor(F.col("event_id") / 3).cast("bigint")
    return e.select(
        qid.alias("query_id"),
        (F.col("event_id") % 3).cast("int").alias("position"),
        _pick(SOURCES, F.col("event_id") % 3).alias("source_type"),
        (F.col("event_type") != "error").alias("success"),
        F.when(k == 7, "").otherwise(F.concat("event_type", F.lit(" of user "), "user_id")).alias("answer"),
        F.least(F.col("value") / 25, F.lit(1.0)).alias("score"),
        (k / 100).alias("rerank_score"),
        _pick(QUESTIONS, qid).alias("query"),
    )


SQL_CANDIDATES = f"""(SELECT event_id // 3 AS query_id, CAST(event_id % 3 AS INT) AS position, {S.str_list(SOURCES)}[1 + event_id % 3] AS source_type,
  event_type <> 'error' AS success, CASE WHEN k = 7 THEN '' ELSE event_type || ' of user ' || user_id END AS answer,
  least(value / 25, 1.0::DOUBLE) AS score, k / 100::DOUBLE AS rerank_score, {S.str_list(QUESTIONS)}[1 + (event_id // 3) % {len(QUESTIONS)}] AS query
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def sql_ranked(candidates: str) -> str:
    """CTEs f to r: the usable candidates, scored and ranked."""
    return f"""f AS (SELECT *, lower(query) AS low FROM {candidates} WHERE success AND answer <> '' AND score >= 0.05),
  g AS (SELECT *, {S.any_in('low', K.CHART_QUERY)} OR {S.any_in('low', K.PERFORMANCE_QUERY)} AS bias, {S.any_in('low', K.EXPLICIT_CHART_QUERY)} AS explicit FROM f),
  h AS (SELECT *, CASE WHEN score < CASE source_type WHEN 'text' THEN 0.15::DOUBLE ELSE 0.2::DOUBLE END THEN (score * 0.4::DOUBLE + rerank_score * 0.6::DOUBLE) * 0.3::DOUBLE
      WHEN source_type = 'colpali' THEN score * 0.6::DOUBLE + rerank_score * 0.4::DOUBLE ELSE score * 0.3::DOUBLE + rerank_score * 0.7::DOUBLE END
      * CASE WHEN source_type = 'colpali' AND bias THEN CASE WHEN explicit THEN 2.5::DOUBLE ELSE 2.0::DOUBLE END
        WHEN source_type = 'text' AND score > 0.4::DOUBLE AND NOT explicit THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END AS raw FROM g),
  c AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, raw)) AS combined_score FROM h),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, position) AS rank FROM c)"""


SQL_RANKED = sql_ranked(SQL_CANDIDATES)


@query("combined_score", f"WITH {SQL_RANKED} SELECT query_id, source_type, round(combined_score, 6) AS combined_score FROM c")
def combined_score(spark, folder):
    c = R.usable_candidates(candidates(spark, folder))
    score = R.combined_score(F.col("score"), F.col("rerank_score"), F.col("source_type"), chart_flags(F.col("query")))
    return c.select("query_id", "source_type", F.round(score, 6).alias("combined_score"))


@query(
    "candidate_filter",
    f"SELECT source_type, count(*) AS kept, round(min(score), 6) AS lowest FROM {SQL_CANDIDATES} WHERE success AND answer <> '' AND score >= 0.05 GROUP BY 1",
)
def candidate_filter(spark, folder):
    c = R.usable_candidates(candidates(spark, folder))
    return c.groupBy("source_type").agg(F.count("*").alias("kept"), F.round(F.min("score"), 6).alias("lowest"))


@query(
    "select_best",
    f"""WITH {SQL_RANKED} SELECT q.query_id, source_type, answer, round(combined_score, 6) AS combined_score, source_type IS NOT NULL AS success
    FROM (SELECT DISTINCT event_id // 3 AS query_id FROM events) q LEFT JOIN (SELECT * FROM r WHERE rank = 1) b ON q.query_id = b.query_id""",
)
def select_best(spark, folder):
    c = candidates(spark, folder)
    best = R.select_best(c, c.select("query_id").distinct())
    return best.select("query_id", "source_type", "answer", F.round("combined_score", 6).alias("combined_score"), "success")


@query(
    "rejected_sources",
    f"""WITH {SQL_RANKED} SELECT r.query_id, r.source_type, r.rank,
      'Lower combined score (N vs N)' AS reason, round(r.combined_score, 6) AS combined_score, round(b.combined_score, 6) AS best_score FROM r JOIN r b USING (query_id) WHERE r.rank > 1 AND b.rank = 1""",
)
def rejected_sources(spark, folder):
    ranked = R.rank_candidates(candidates(spark, folder)).filter(F.col("rank") > 1)
    scores = [F.round(c, 6).alias(c) for c in ("combined_score", "best_score")]
    # Java and C round ties of three digits differently, so the numbers are compared as numbers.
    return ranked.select("query_id", "source_type", "rank", F.regexp_replace("reason", r"\d\.\d{3}\b", "N").alias("reason"), *scores)


@query(
    "compare_pair",
    f"""WITH {SQL_RANKED}, p AS (SELECT *, lead(source_type) OVER w AS loser, lead(rerank_score) OVER w AS loser_score FROM r WINDOW w AS (PARTITION BY query_id ORDER BY rank))
    SELECT query_id, source_type AS winner, round(rerank_score, 6) AS winner_score, loser, round(loser_score, 6) AS loser_score,
      round(rerank_score - coalesce(loser_score, 0), 6) AS margin, CASE WHEN rerank_score > 0.7::DOUBLE THEN 'high' WHEN rerank_score > 0.5::DOUBLE THEN 'medium' ELSE 'low' END AS confidence
    FROM p WHERE rank = 1""",
)
def compare_pair(spark, folder):
    pairs = R.compare_pairs(candidates(spark, folder))
    return pairs.withColumns({c: F.round(c, 6) for c in ("winner_score", "loser_score", "margin")})


@query(
    "fallback_select",
    f"""SELECT query_id, source_type, answer, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS n FROM {SQL_CANDIDATES}) WHERE n = 1""",
)
def fallback_select(spark, folder):
    return R.fallback_select(candidates(spark, folder)).withColumn("score", F.round("score", 6))


@query(
    "rerank_score",
    f"""SELECT d.doc_id, round(len(list_intersect(q, a)) / len(list_distinct(list_concat(q, a)))::DOUBLE, 6) AS score FROM (
      SELECT doc_id, list_distinct({S.words("lower(q)")}) AS q, list_distinct({S.words("lower(text)")}) AS a
      FROM (SELECT doc_id, text, 'the of la de und ' || source AS q FROM documents)) d""",
)
def rerank_score(spark, folder):
    q = F.concat(F.lit("the of la de und "), "source")
    return spread(table(spark, folder, "documents")).select("doc_id", F.round(R.token_overlap(q, F.col("text")), 6).alias("score"))


@query(
    "token_breakdown",
    f"""SELECT doc_id, round(q * 1.3::DOUBLE, 4) AS query_tokens, round(r * 1.3::DOUBLE, 4) AS response_tokens, 10 AS reranker_tokens,
      round(q * 1.3::DOUBLE + n_chars + doc_id + 5 + 10 + r * 1.3::DOUBLE, 4) AS total_tokens
    FROM (SELECT doc_id, n_chars, len({S.words('source')}) AS q, len({S.words('text')}) AS r FROM documents)""",
)
def token_breakdown(spark, folder):
    t = R.token_breakdown(F.col("source"), F.col("text"), F.col("n_chars"), F.col("doc_id"), F.lit(5))
    rows = spread(table(spark, folder, "documents")).select("doc_id", t.alias("t"))
    return rows.select(
        "doc_id", F.round("t.query_tokens", 4).alias("query_tokens"), F.round("t.response_tokens", 4).alias("response_tokens"),
        "t.reranker_tokens", F.round("t.total_tokens", 4).alias("total_tokens"),
    )


@query(
    "confidence_band",
    f"""SELECT CASE WHEN score >= 0.8::DOUBLE THEN 'high' WHEN score >= 0.5::DOUBLE THEN 'medium' ELSE 'low' END AS display,
      CASE WHEN score > 0.7::DOUBLE THEN 'high' WHEN score > 0.5::DOUBLE THEN 'medium' ELSE 'low' END AS visual, count(*) AS n FROM {SQL_CANDIDATES} GROUP BY ALL""",
)
def confidence_band(spark, folder):
    s = F.col("score")
    return candidates(spark, folder).groupBy(
        R.confidence_band(s).alias("display"), R.confidence_band(s, 0.7, 0.5, strict=True).alias("visual")
    ).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- extraction over whole texts

ASKED = ["What is the of and?", "explain la de que", "und die der", "define xyzzy", "in th on"]


def asked_documents(spark, folder):
    return spread(table(spark, folder, "documents")).withColumn("question", _pick(ASKED, F.col("doc_id")))


SQL_ASKED = f"(SELECT *, {S.str_list(ASKED)}[1 + doc_id % {len(ASKED)}] AS question FROM documents)"
SQL_PIECES = f"list_filter(list_transform(string_split(text, '.'), lambda s: {S.strip('s')}), lambda s: s <> '')"
SQL_END = "CASE WHEN {0} LIKE '%.' THEN {0} ELSE {0} || '.' END"
SQL_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda s: {S.strip('s')}), lambda s: s <> '')"
SQL_GENERAL = f"""CASE WHEN len(g) > 0 THEN {SQL_END.format("array_to_string(list_transform(g[1:3], lambda s: " + S.strip('s') + "), '. ')")}
  ELSE left(text, 300) || CASE WHEN length(text) > 300 THEN '...' ELSE '' END END"""
SQL_G = f"list_filter(string_split(text, '.'), lambda s: length(s) > 20 AND {S.strip('s')} <> '') AS g"


@query(
    "answer_factual",
    f"""SELECT doc_id, {SQL_END.format("a")} AS answer FROM (SELECT doc_id, array_to_string(CASE WHEN len(h) > 0 THEN h[1:2] ELSE ss[1:2] END, '. ') AS a FROM (
      SELECT doc_id, ss, list_filter(ss, lambda s: len(list_intersect({S.words('lower(s)')}, kw)) > 0) AS h FROM (
        SELECT doc_id, {SQL_PIECES} AS ss, list_filter({S.words('lower(question)')}, lambda w: NOT list_contains({S.str_list(K.QUESTION_STOP_WORDS)}, w)) AS kw FROM {SQL_ASKED})))""",
)
def answer_factual(spark, folder):
    return asked_documents(spark, folder).select("doc_id", A.factual(F.col("text"), F.col("question")).alias("answer"))


@query("answer_general", f"SELECT doc_id, {SQL_GENERAL} AS answer FROM (SELECT doc_id, text, {SQL_G} FROM documents)")
def answer_general(spark, folder):
    return asked_documents(spark, folder).select("doc_id", A.general(F.col("text")).alias("answer"))


@query(
    "answer_data_lines",
    f"""SELECT doc_id, CASE WHEN len(h) > 0 THEN array_to_string(h[1:3], '. ') || '.' ELSE {SQL_GENERAL} END AS answer FROM (
      SELECT doc_id, text, {SQL_G}, list_filter({SQL_LINES}, lambda x: regexp_matches(x, '[0-9]') OR {S.any_in('lower(x)', K.DATA_LINE_WORDS)}) AS h FROM documents)""",
)
def answer_data_lines(spark, folder):
    return asked_documents(spark, folder).select("doc_id", A.data_lines(F.col("text")).alias("answer"))


@query(
    "answer_procedural",
    f"""SELECT doc_id, CASE WHEN len(h) > 0 THEN 'The process involves: ' || array_to_string(h[1:4], '. ') || '.' ELSE {SQL_GENERAL} END AS answer FROM (
      SELECT doc_id, text, {SQL_G}, list_filter({SQL_LINES}, lambda x: {S.any_in('lower(x)', K.STEP_WORDS)}) AS h FROM documents)""",
)
def answer_procedural(spark, folder):
    return asked_documents(spark, folder).select("doc_id", A.procedural(F.col("text")).alias("answer"))


ROUTED = ["explain la de que", "how to la", "most la", "hello la"]


@query(
    "answer_router",
    f"""SELECT doc_id, {SQL_END.format("a")} AS answer FROM (SELECT doc_id, array_to_string(CASE WHEN len(h) > 0 THEN h[1:2] ELSE ss[1:2] END, '. ') AS a FROM (
      SELECT doc_id, ss, list_filter(ss, lambda s: len(list_intersect({S.words('lower(s)')}, ['la', 'de', 'que'])) > 0) AS h FROM (
        SELECT doc_id, {SQL_PIECES} AS ss FROM documents))) WHERE doc_id % 4 = 0
    UNION ALL SELECT doc_id, CASE WHEN len(h) > 0 THEN 'The process involves: ' || array_to_string(h[1:4], '. ') || '.' ELSE {SQL_GENERAL} END FROM (
      SELECT doc_id, text, {SQL_G}, list_filter({SQL_LINES}, lambda x: {S.any_in('lower(x)', K.STEP_WORDS)}) AS h FROM documents) WHERE doc_id % 4 = 1
    UNION ALL SELECT doc_id, CASE WHEN contains(text, '|') OR contains(text, 'Row') THEN 'The data contains information about ' || len({SQL_LINES}) || ' entries with various details.'
      WHEN len(h) > 0 THEN array_to_string(h[1:3], '. ') || '.' ELSE {SQL_GENERAL} END FROM (
      SELECT doc_id, text, {SQL_G}, list_filter({SQL_LINES}, lambda x: regexp_matches(x, '[0-9]') OR {S.any_in('lower(x)', K.DATA_LINE_WORDS)}) AS h FROM documents) WHERE doc_id % 4 = 2
    UNION ALL SELECT doc_id, {SQL_GENERAL} FROM (SELECT doc_id, text, {SQL_G} FROM documents) WHERE doc_id % 4 = 3""",
)
def answer_router(spark, folder):
    asked = spread(table(spark, folder, "documents")).withColumn("question", _pick(ROUTED, F.col("doc_id")))
    return asked.select("doc_id", A.answer(F.col("text"), F.col("question")).alias("answer"))


def _bare(tokens: str) -> str:
    return f"list_distinct(list_transform({tokens}, lambda w: trim(lower(w), {S.lit(K.EXCERPT_PUNCTUATION)})))"


# A ranked sentence is three steps: itself (1), the one before it (2), the one after it (3). The state has the same
# fields: text, its length without the spaces between sentences, and whether neighbours of the sentence at hand may join.
SQL_STEP = """CASE WHEN y.step = 1 AND x.n < 400 THEN {'text': CASE WHEN x.text = '' THEN y.text ELSE x.text || ' ' || y.text END, 'n': x.n + y.n, 'step': 1, 'open': x.n + y.n < 300}
    WHEN y.step = 1 THEN {'text': x.text, 'n': x.n, 'step': 1, 'open': false}
    WHEN x.open AND y.text IS NOT NULL AND NOT contains(x.text, y.text) AND x.n + y.n < 400
      THEN {'text': CASE WHEN y.step = 2 THEN y.text || ' ' || x.text ELSE x.text || ' ' || y.text END, 'n': x.n + y.n, 'step': 1, 'open': x.open}
    ELSE x END"""
SQL_EXCERPT = f"""WITH s AS (SELECT doc_id, plain, {_bare("list_filter(" + S.words('question') + ", lambda w: length(w) > 2)")} AS wanted,
    list_transform(list_filter(list_transform(string_split(plain, '.'), lambda s: {S.strip('s')}), lambda s: length(s) > 10), lambda s: s || '.') AS ss
    FROM (SELECT doc_id, question, array_to_string({S.words('text')}, ' ') AS plain FROM {SQL_ASKED})),
  r AS (SELECT doc_id, plain, ss, list_sort(list_filter(list_transform(range(1, len(ss) + 1), lambda i: {{'cost': -len(list_intersect(wanted, {_bare(S.words('ss[i]'))})), 'i': i}}), lambda h: h.cost < 0)) AS ranked FROM s),
  steps AS (SELECT *, flatten(list_transform(ranked, lambda h: list_transform([1, 2, 3], lambda k: {{'text': ss[h.i + [0, -1, 1][k]], 'n': coalesce(length(ss[h.i + [0, -1, 1][k]]), 0), 'step': k, 'open': false}}))) AS steps FROM r),
  built AS (SELECT *, list_reduce(steps, lambda x, y: {SQL_STEP}, {{'text': '', 'n': 0::BIGINT, 'step': 1, 'open': false}}).text AS built FROM steps)
  SELECT doc_id, CASE WHEN built <> '' THEN built WHEN len(ss) = 0 THEN left(plain, 500) || CASE WHEN length(plain) > 500 THEN '...' ELSE '' END
    ELSE left(plain, 400) || CASE WHEN length(plain) > 400 THEN '...' ELSE '' END END AS excerpt FROM built"""


@query("relevant_excerpt", SQL_EXCERPT)
def relevant_excerpt(spark, folder):
    return asked_documents(spark, folder).select("doc_id", A.relevant_excerpt(F.col("text"), F.col("question")).alias("excerpt"))


# ---------------------------------------------------------------- end to end


def files_of_chunks(spark, folder, which="true", found=None):
    return text_chunks(spark, folder, which, found).withColumn("filename", F.concat(F.lit("doc"), "doc_id", F.lit(".txt")))


def found_chunks(spark, folder):
    """The chunks of the documents that some chunks lie in."""
    return lambda ids: files_of_chunks(spark, folder, found=ids)


def questions(spark, folder):
    return passages(spark, folder).withColumnRenamed("text", "query")


SQL_HITS = f"{SQL_SEARCH}, res AS (SELECT query_id, rank, score, text AS content, 'doc' || doc_id || '.txt' AS filename FROM hits JOIN chunks USING (id))"


SQL_STORED = "SELECT query_id, id, round(score, 6) AS score, rank, md5(content) AS content_md5, filename FROM (SELECT h.*, text AS content, 'doc' || doc_id || '.txt' AS filename FROM hits h JOIN chunks USING (id))"


def _stored_hits(spark, folder, path):
    hits = P.search_index(questions(spark, folder), path)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank", F.md5("content").alias("content_md5"), "filename")


@query("search_index", f"WITH {SQL_SEARCH} {SQL_STORED}")
def search_index(spark, folder):
    """The index is built once and searched where it is stored."""
    path = scratch_path(spark, "index")
    P.build_index(files_of_chunks(spark, folder), path)
    return _stored_hits(spark, folder, path)


@query("append_to_index", f"WITH {SQL_SEARCH} {SQL_STORED}")
def append_to_index(spark, folder):
    """English documents make the index, all others are appended: the same as an index of all of them."""
    path = scratch_path(spark, "index")
    P.build_index(files_of_chunks(spark, folder, "lang = 'en'"), path)
    P.append_to_index(files_of_chunks(spark, folder, "lang <> 'en'"), path, 1)
    P.append_to_index(files_of_chunks(spark, folder, "lang <> 'en'"), path, 1)  # the same batch again changes nothing
    return _stored_hits(spark, folder, path)


@query(
    "relevance_filter",
    f"""WITH {SQL_HITS} SELECT query_id, count(*) AS kept, round(max(score), 6) AS confidence FROM res WHERE rank <= 3 AND score > 0.2 AND content <> '' GROUP BY 1""",
)
def relevance_filter(spark, folder):
    hits = P.search_text(questions(spark, folder), files_of_chunks(spark, folder), lookup=found_chunks(spark, folder))
    kept = R.relevant_results(hits)
    return kept.groupBy("query_id").agg(F.count("*").alias("kept"), F.round(F.max("score"), 6).alias("confidence"))


@query(
    "retrieval_metrics",
    f"""WITH {SQL_SEARCH} SELECT a.id AS query_id, count(h.id) AS total_results, round(coalesce(avg(h.score), 0), 6) AS avg_score,
      round(coalesce(max(h.score), 0), 6) AS max_score, 2 * len({S.words('any_value(a.text)')}) AS tokens_used, 0.0::DOUBLE AS cost_estimate
    FROM asked a LEFT JOIN hits h ON h.query_id = a.id GROUP BY a.id""",
)
def retrieval_metrics(spark, folder):
    m = EV.query_metrics(questions(spark, folder), text_search(spark, folder))
    return m.withColumns({c: F.round(c, 6) for c in ("avg_score", "max_score")})


@query(
    "format_sources",
    f"""WITH {SQL_HITS} SELECT query_id, rank AS source_number, filename, 'Unknown' AS page, left(content, 200) || '...' AS chunk_text, round(score, 3) AS relevance_score FROM res""",
)
def format_sources(spark, folder):
    hits = P.search_text(questions(spark, folder), files_of_chunks(spark, folder), lookup=found_chunks(spark, folder))
    return A.format_sources(hits).select("query_id", F.explode("sources").alias("s")).select("query_id", "s.*")


@query(
    "assemble_context",
    f"""WITH {SQL_HITS} SELECT query_id, string_agg('Source ' || n || ' (from ' || filename || ', relevance: ' || printf('%.3f', score) || '):' || chr(10) || content,
      chr(10) || chr(10) ORDER BY rank) AS context FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM res WHERE rank <= 3 AND score > 0.2 AND content <> '') GROUP BY 1""",
)
def assemble_context(spark, folder):
    return A.assemble_context(P.search_text(questions(spark, folder), files_of_chunks(spark, folder), lookup=found_chunks(spark, folder)))


@query(
    "text_query",
    f"""WITH {SQL_HITS}, kept AS (SELECT query_id, max(score) AS confidence, arg_min(content, rank) AS text FROM res WHERE rank <= 3 AND score > 0.2 GROUP BY 1)
    SELECT a.id AS query_id, true AS success, 5 AS chunks_used, round(coalesce(confidence, 0), 6) AS confidence,
      CASE WHEN k.text IS NULL THEN {S.lit(K.NO_ANSWER)} ELSE {SQL_GENERAL.replace('text', 'k.text').replace('g[', 'k.g[').replace('len(g)', 'len(k.g)')} END AS answer
    FROM asked a LEFT JOIN (SELECT *, {SQL_G} FROM kept) k ON k.query_id = a.id""",
)
def text_query(spark, folder):
    answered = P.text_query(questions(spark, folder), files_of_chunks(spark, folder), lookup=found_chunks(spark, folder))
    return answered.select("query_id", "success", "chunks_used", F.round("confidence", 6).alias("confidence"), "answer")


def _sql_both_searches() -> str:
    """Both sources see the expanded query; the article is chosen by the original one."""
    text = SQL_SEARCH.replace(
        "asked AS (SELECT item_id AS id, text FROM benchmark)", "asked AS (SELECT query_id AS id, query AS text FROM expanded)"
    )
    intents = sql_intent_search(3).replace(S.SQL_QUERIES, "expanded")
    return f"""WITH expanded AS MATERIALIZED (SELECT query_id, expanded AS query FROM ({SQL_EXPANDED})), {text}, {intents},
    o AS (SELECT query_id, query, lower(query) AS low FROM {S.SQL_QUERIES}),
    best AS (SELECT * FROM (SELECT query_id, article_id, relevance_score, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score + {SQL_BONUS} DESC, rank) AS n
      FROM intent_hits JOIN o USING (query_id) JOIN a USING (article_id)) WHERE n = 1 AND relevance_score >= 0.15)"""


SQL_GATHERED = f"""{_sql_both_searches()}
    SELECT a.id AS query_id, 0 AS position, 'text' AS source_type, true AS success, round(coalesce(max(CASE WHEN h.rank <= 3 AND h.score > 0.2 THEN h.score END), 0), 6) AS score
    FROM asked a LEFT JOIN hits h ON h.query_id = a.id GROUP BY a.id
    UNION ALL SELECT query_id, 2, 'salesforce', true, round(CAST(relevance_score AS DOUBLE), 6) FROM best"""


@query("gather_candidates", SQL_GATHERED)
def gather_candidates(spark, folder):
    asked, kb = user_queries(spark, folder), articles(spark, folder)
    expanded = asked.select("query_id", expand_query(F.col("query")).alias("query"))
    text = P.text_query(expanded, files_of_chunks(spark, folder), lookup=found_chunks(spark, folder))
    found = P.gather_candidates(text, None, P.knowledge_answers(asked, kb, expanded))
    return found.select("query_id", "position", "source_type", "success", F.round("score", 6).alias("score"))


def _sql_tokens(x: str) -> str:
    return f"1.3::DOUBLE * len({S.words(f'coalesce({x}, chr(32))')})"


# The chunks of the test tables hold neither bars nor rows of sheets, so data questions are answered from lines.
SQL_TEXT_ANSWERS = f"""found AS (SELECT query_id, count(*) AS n, max(score) FILTER (kept) AS confidence, arg_min(text, rank) FILTER (kept) AS text
      FROM (SELECT *, rank <= 3 AND score > 0.2 AND text <> '' AS kept FROM hits JOIN chunks USING (id)) GROUP BY 1),
    parts AS (SELECT *, {SQL_PIECES} AS ss, {SQL_G}, {SQL_LINES} AS ls, coalesce({S.first_label('lower(question)', K.QUERY_TYPES)}, 'general') AS kind,
        list_filter({S.words('lower(question)')}, lambda w: NOT list_contains({S.str_list(K.QUESTION_STOP_WORDS)}, w)) AS kw
      FROM (SELECT q.id AS query_id, q.text AS question, n, k.text, coalesce(confidence, 0) AS score FROM asked q LEFT JOIN found k ON k.query_id = q.id)),
    picked AS (SELECT *, list_filter(ss, lambda s: len(list_intersect({S.words('lower(s)')}, kw)) > 0) AS h,
        list_filter(ls, lambda x: regexp_matches(x, '[0-9]') OR {S.any_in('lower(x)', K.DATA_LINE_WORDS)}) AS data, list_filter(ls, lambda x: {S.any_in('lower(x)', K.STEP_WORDS)}) AS steps FROM parts),
    text_answers AS (SELECT query_id, score, CASE WHEN n IS NULL THEN {S.lit(K.NO_INFORMATION)} WHEN text IS NULL THEN {S.lit(K.NO_ANSWER)}
      WHEN kind = 'factual' THEN {SQL_END.format("array_to_string(CASE WHEN len(h) > 0 THEN h[1:2] ELSE ss[1:2] END, '. ')")}
      WHEN kind = 'data_lookup' AND len(data) > 0 THEN array_to_string(data[1:3], '. ') || '.'
      WHEN kind = 'procedural' AND len(steps) > 0 THEN 'The process involves: ' || array_to_string(steps[1:4], '. ') || '.'
      ELSE {SQL_GENERAL} END AS answer FROM picked)"""
SQL_UNMARKED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(r.answer, '### (CSV|Sheet): [^-]+ - Entry \d+\n\n', '', 'g'),
      '\n\nKey fields: [^\n]+', '', 'g'), '--- Page \d+ ---\n?', '', 'g'), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g')"""
SQL_ALL_SOURCES = f"""{_sql_both_searches()}, {sql_article_answers('o')}, {SQL_TEXT_ANSWERS},
    gathered AS MATERIALIZED (SELECT *, true AS success, len(list_intersect(q, w)) / greatest(len(list_distinct(list_concat(q, w))), 1)::DOUBLE AS rerank_score
      FROM (SELECT *, list_distinct({S.words('lower(query)')}) AS q, list_distinct({S.words('lower(answer)')}) AS w FROM (
        SELECT query_id, 0 AS position, 'text' AS source_type, answer, score FROM text_answers
        UNION ALL SELECT query_id, 2, 'salesforce', answer, CAST(relevance_score AS DOUBLE) FROM article_answers JOIN best USING (query_id)) JOIN o USING (query_id))),
    spent AS (SELECT query_id, sum({_sql_tokens('answer')}) AS tokens FROM gathered GROUP BY 1), {sql_ranked('gathered')},
    cleaned AS (SELECT o.query_id, o.query, r.source_type, r.score, r.rerank_score, r.combined_score, CASE WHEN {S.strip('r.answer')} = '' THEN r.answer
      ELSE {S.strip(SQL_UNMARKED)} END AS answer
      FROM o LEFT JOIN r ON r.query_id = o.query_id AND r.rank = 1)
    SELECT query_id, source_type IS NOT NULL AS success, source_type, answer, round(score, 6) AS score, round(rerank_score, 6) AS rerank_score, round(combined_score, 6) AS combined_score,
      CASE WHEN combined_score >= 0.8::DOUBLE THEN 'high' WHEN combined_score >= 0.5::DOUBLE THEN 'medium' ELSE 'low' END AS confidence_band,
      round({_sql_tokens('query')} + {_sql_tokens('answer')} + tokens + 10, 4) AS total_tokens FROM cleaned JOIN spent USING (query_id)"""


@query("query_all_sources", SQL_ALL_SOURCES)
def query_all_sources(spark, folder):
    answered = P.answer_all_sources(user_queries(spark, folder), files_of_chunks(spark, folder), articles(spark, folder), lookup=found_chunks(spark, folder))
    digits = {"score": 6, "rerank_score": 6, "combined_score": 6, "total_tokens": 4}
    return answered.withColumns({c: F.round(c, n) for c, n in digits.items()})
