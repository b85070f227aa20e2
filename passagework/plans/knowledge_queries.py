"""Query understanding and knowledge-base search."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.functions import constants as K
from passagework.functions import query as Q
from passagework.functions.text import strip_html
from passagework.operators import knowledge as KB
from passagework.plans import sql_parts as S
from passagework.plans.registry import query, spread, table
from passagework.session import written
from passagework.sources import knowledge as SRC


def _pick(values: list[str], index):
    return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))


def articles(spark, folder):
    title = F.concat_ws(
        " ", _pick(S.TITLES, F.col("doc_id") * 7 + F.col("n_chars")), "source", F.substring_index("text", " ", 1)
    )
    body = F.concat(F.lit("<p>"), "text", F.lit("</p><b>See the "), "source", F.lit(" guide &amp; rules</b>"))
    modified = (F.col("n_chars") * 31) % 100000 * 1000000 + F.col("doc_id")
    return spread(table(spark, folder, "documents")).select(
        F.col("doc_id").alias("article_id"), title.alias("title"), body.alias("body"), modified.alias("modified")
    )


def user_queries(spark, folder):
    users = table(spark, folder, "conversations").filter(F.col("role") == "user")
    tail = F.when(F.col("conv_id") % 2 == 0, "").otherwise(F.concat(F.lit(" "), "text"))
    return spread(users).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.concat(_pick(S.PHRASES, F.col("conv_id") * 5 + F.col("turn")), tail).alias("query"),
    )


def _sql_expansion() -> str:
    parts = []
    for triggers, choices in K.EXPANSIONS:
        inner = " ".join(f"WHEN {S.any_in('low', w)} THEN {S.str_list(a)}" for w, a in choices)
        parts.append(f"CASE WHEN {S.any_in('low', triggers)} THEN CASE {inner} ELSE [] END ELSE [] END")
    return f"list_sort(list_distinct(list_concat({', '.join(parts)})))"


SQL_EXPANDED = f"""SELECT query_id, CASE WHEN len(terms) > 0 THEN query || ' ' || array_to_string(terms, ' ') ELSE query END AS expanded
  FROM (SELECT query_id, query, {_sql_expansion()} AS terms FROM (SELECT *, lower(query) AS low FROM {S.SQL_QUERIES}))"""


@query("expand_query", SQL_EXPANDED)
def expand_query(spark, folder):
    return user_queries(spark, folder).select("query_id", Q.expand_query(F.col("query")).alias("expanded"))


@query(
    "query_type",
    f"""SELECT query_id, coalesce({S.first_label('lower(query)', K.QUERY_TYPES)}, 'general') AS query_type FROM {S.SQL_QUERIES}""",
)
def query_type(spark, folder):
    return user_queries(spark, folder).select("query_id", Q.query_type(F.col("query")).alias("query_type"))


@query(
    "extract_intent",
    f"""SELECT query_id, action, service, array_to_string(context, ',') AS context, is_valid, round(CAST(confidence AS DOUBLE), 6) AS confidence,
      scenario AS scenario_detected FROM ({S.intent(S.SQL_QUERIES)})""",
)
def extract_intent(spark, folder):
    i = KB.with_intent(user_queries(spark, folder)).select("query_id", "intent.*")
    return i.withColumns({"context": F.array_join("context", ","), "confidence": F.round("confidence", 6)})


@query(
    "intent_summary",
    f"""SELECT action, service, count(*) AS queries, count_if(is_valid) AS successful, count_if(NOT is_valid) AS failed,
      round(CAST(avg(confidence) AS DOUBLE), 6) AS mean_confidence FROM ({S.intent(S.SQL_QUERIES)}) GROUP BY action, service""",
)
def intent_summary(spark, folder):
    i = KB.with_intent(user_queries(spark, folder)).select("intent.*")
    return i.groupBy("action", "service").agg(
        F.count("*").alias("queries"),
        F.count_if("is_valid").alias("successful"),
        F.count_if(~F.col("is_valid")).alias("failed"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
    )


@query(
    "chart_flags",
    f"""SELECT query_id, {S.any_in('low', K.CHART_QUERY)} AS chart, {S.any_in('low', K.PERFORMANCE_QUERY)} AS performance,
      {S.any_in('low', K.EXPLICIT_CHART_QUERY)} AS explicit_chart FROM (SELECT query_id, lower(query) AS low FROM {S.SQL_QUERIES})""",
)
def chart_flags(spark, folder):
    return user_queries(spark, folder).select("query_id", Q.chart_flags(F.col("query")).alias("f")).select("query_id", "f.*")


# ---------------------------------------------------------------- keyword search

NEWEST = 5


def sql_keyword(newest: int | None, limit: int = 5) -> str:
    """All title hits and bodies are scored, or the ``newest`` title hits and thrice as many newest bodies."""
    likes = "likes" if newest else "list_filter(likes, lambda x: x <> '')"
    recent = f"ORDER BY modified DESC, article_id LIMIT {3 * newest}" if newest else ""
    return f"""q AS (SELECT *, {S.long_words('query')} AS w, lower(query) AS low FROM {S.SQL_QUERIES}),
  l AS (SELECT *, CASE WHEN len(w) > 0 THEN list_transform(w, lambda x: regexp_replace(x, '[?!]', '', 'g'))
    ELSE [regexp_replace(low, '[?!]', '', 'g')] END AS likes FROM q),
  a AS (SELECT *, lower(title) AS t, lower({S.SQL_PLAIN_BODY}) AS b FROM {S.SQL_ARTICLES}),
  c AS (SELECT * FROM (SELECT query_id, article_id, row_number() OVER (PARTITION BY query_id ORDER BY modified DESC, article_id) AS n
    FROM l, a WHERE len(list_filter({likes}, lambda x: contains(t, x))) > 0) {f'WHERE n <= {newest}' if newest else ''}),
  k1 AS (SELECT query_id, article_id, modified, title,
      len(list_filter(w, lambda x: contains(t, x))) + CASE WHEN contains(t, low) THEN 2 ELSE 0 END AS title_matches,
      len(list_filter(w, lambda x: contains(b, x))) + CASE WHEN contains(b, low) THEN 1 ELSE 0 END AS content_matches,
      greatest(len(w), 1) AS n FROM c JOIN q USING (query_id) JOIN a USING (article_id)),
  recent AS (SELECT * FROM a {recent}),
  k2 AS (SELECT query_id, article_id, modified, title, 0 AS title_matches,
      len(list_filter(w, lambda x: contains(b, x))) + CASE WHEN contains(b, low) THEN 2 ELSE 0 END AS content_matches, greatest(len(w), 1) AS n
      FROM q, recent WHERE query_id NOT IN (SELECT query_id FROM k1)),
  scored AS (SELECT query_id, article_id, modified, greatest(0.3::DOUBLE, least(1.0::DOUBLE, (title_matches * 0.6::DOUBLE + content_matches * 0.4::DOUBLE) / n)) AS relevance_score,
      title_matches, content_matches, 'title_search' AS search_method FROM k1
    UNION ALL SELECT query_id, article_id, modified, least(1.0::DOUBLE, content_matches * 0.4::DOUBLE / n), 0, content_matches, 'content_search' FROM k2 WHERE content_matches > 0),
  k3 AS (SELECT query_id, article_id, modified, 0.2, 0, 0, 'fallback_all' FROM q, (SELECT * FROM a ORDER BY modified DESC, article_id LIMIT {limit})
    WHERE query_id NOT IN (SELECT query_id FROM scored)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, modified DESC, article_id) AS rank
    FROM (SELECT * FROM scored UNION ALL SELECT * FROM k3)),
  keyword AS (SELECT * FROM ranked WHERE rank <= {limit})"""


SQL_KEYWORD = sql_keyword(NEWEST)


@query("title_candidates", f"WITH {SQL_KEYWORD} SELECT query_id, article_id FROM c")
def title_candidates(spark, folder):
    found = KB.title_candidates(user_queries(spark, folder), articles(spark, folder), 5)
    return found.select("query_id", "article_id")


SQL_KEYWORD_COLUMNS = "query_id, article_id, round(CAST(relevance_score AS DOUBLE), 6) AS relevance_score, title_matches, content_matches, search_method, rank"


@query("keyword_search", f"WITH {SQL_KEYWORD} SELECT {SQL_KEYWORD_COLUMNS} FROM keyword WHERE search_method <> 'fallback_all'")
def keyword_search(spark, folder):
    r = KB.keyword_search(user_queries(spark, folder), articles(spark, folder), newest=NEWEST)
    return r.drop("modified", "title").withColumn("relevance_score", F.round("relevance_score", 6))


@query("keyword_search_all", f"WITH {sql_keyword(None)} SELECT {SQL_KEYWORD_COLUMNS} FROM keyword WHERE search_method <> 'fallback_all'")
def keyword_search_all(spark, folder):
    """Every title hit and every body is scored before the best are taken."""
    r = KB.keyword_search(user_queries(spark, folder), articles(spark, folder))
    return r.drop("modified", "title").withColumn("relevance_score", F.round("relevance_score", 6))


# Texts without title words: benchmark passages, for the content and the last stage.
SQL_PASSAGES = "(SELECT item_id AS query_id, string_split(text, ' ')[3] AS query FROM benchmark)"
SQL_PASSAGE_KEYWORD = SQL_KEYWORD.replace(S.SQL_QUERIES, SQL_PASSAGES)
SQL_WHOLE_PASSAGE_KEYWORD = sql_keyword(None).replace(S.SQL_QUERIES, "(SELECT item_id AS query_id, text AS query FROM benchmark)")


@query("content_fallback", f"WITH {SQL_PASSAGE_KEYWORD} SELECT {SQL_KEYWORD_COLUMNS} FROM keyword")
def content_fallback(spark, folder):
    asked = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.get(F.split("text", " "), F.lit(2)).alias("query")
    )
    r = KB.keyword_search(asked, articles(spark, folder), fallback_all=True, newest=NEWEST)
    return r.drop("modified", "title").withColumn("relevance_score", F.round("relevance_score", 6))


@query("passage_keywords", f"WITH {SQL_WHOLE_PASSAGE_KEYWORD} SELECT {SQL_KEYWORD_COLUMNS} FROM keyword")
def passage_keywords(spark, folder):
    """Whole benchmark passages as questions; all hits are scored."""
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    r = KB.keyword_search(asked, articles(spark, folder), fallback_all=True)
    return r.drop("modified", "title").withColumn("relevance_score", F.round("relevance_score", 6))


# ---------------------------------------------------------------- intent search


def _sql_terms(groups) -> str:
    return "CASE " + " ".join(f"WHEN action = {S.lit(n)} THEN {S.str_list(t)}" for n, t in groups.items()) + " END"


_SQL_SCENARIO_TERMS = ", ".join(
    f"CASE WHEN action = 'handle' AND {S.any_in('low', h)} THEN {S.str_list(t)} ELSE [] END" for h, t in K.SEARCH_SCENARIOS
)
_SQL_SERVICE_TERMS = "CASE " + " ".join(f"WHEN service = {S.lit(n)} THEN {S.str_list(t)}" for n, t in K.SEARCH_SERVICES.items()) + " END"


def _sql_acts(text: str) -> str:
    extra = "CASE " + " ".join(f"WHEN {S.any_in('low', h)} THEN {S.any_in(text, t)}" for h, t in K.RELEVANCE_SCENARIOS) + " ELSE false END"
    return f"({S.label_says('action', text, K.RELEVANCE_ACTIONS)} OR (action = 'handle' AND scenario AND {extra}))"


_SQL_CTX = " + ".join(
    f"CASE WHEN list_contains(context, {S.lit(n)}) AND ({S.any_in('t', t)} OR {S.any_in('b', t)}) THEN 1 ELSE 0 END"
    for n, t in K.RELEVANCE_CONTEXTS.items()
)


def _sql_scored(name: str, candidates: str) -> str:
    return f"""{name}_f AS (SELECT query_id, article_id, modified, action, context, scenario, {_sql_acts('t')} AS a_t, {_sql_acts('b')} AS a_b,
      {S.label_says('service', 't', K.RELEVANCE_SERVICES)} AS s_t, {S.label_says('service', 'b', K.RELEVANCE_SERVICES)} AS s_b, {_SQL_CTX} AS ctx
      FROM {candidates} JOIN i USING (query_id) JOIN a USING (article_id)),
    {name}_s AS (SELECT *, least(1.0, CASE WHEN a_t AND s_t THEN 1.0 WHEN a_t AND s_b THEN 0.8 WHEN a_b AND s_t THEN 0.7 WHEN a_b AND s_b THEN 0.5
      WHEN a_t THEN 0.4 WHEN s_t THEN 0.3 ELSE 0.1 END + 0.1 * ctx) AS base FROM {name}_f),
    {name}_r AS (SELECT *, CASE WHEN scenario AND base > 0.3 THEN least(1.0, base + 0.1) ELSE base END AS score FROM {name}_s),
    {name} AS (SELECT query_id, article_id, modified, score AS relevance_score, ctx AS context_matches, scenario AS scenario_detected, '{name}' AS search_method
      FROM {name}_r WHERE score >= CASE WHEN scenario THEN 0.4 ELSE 0.3 END AND (((a_t OR a_b) AND (s_t OR s_b)) OR score >= 0.5)
      AND NOT (action = 'handle' AND len(context) > 0 AND ctx = 0 AND score < 0.6))"""


_SQL_ANY_OF = "len(list_filter({0}, lambda x: contains({1}, x))) > 0"


def sql_intent_search(limit: int, newest: int | None = None) -> str:
    """All title hits are scored and the ``limit`` best kept, or only the ``newest`` hits are scored."""
    at_most = lambda n: f"WHERE n <= {n}" if newest else ""
    return f"""i AS (SELECT *, list_concat({_sql_terms(K.SEARCH_ACTIONS)}, {_SQL_SCENARIO_TERMS}) AS terms, {_SQL_SERVICE_TERMS} AS sterms
      FROM ({S.intent(S.SQL_QUERIES)}) WHERE is_valid),
    a AS (SELECT *, lower(title) AS t, lower(body) AS b FROM {S.SQL_ARTICLES}),
    c1 AS (SELECT * FROM (SELECT query_id, article_id, row_number() OVER (PARTITION BY query_id ORDER BY modified DESC, article_id) AS n
      FROM i, a WHERE {_SQL_ANY_OF.format('terms', 't')} AND {_SQL_ANY_OF.format('sterms', 't')}) {at_most(newest)}),
    {_sql_scored('action_and_service', 'c1')},
    c2 AS (SELECT * FROM (SELECT query_id, article_id, modified, (({_SQL_ANY_OF.format('sterms', 't')}) OR ({_SQL_ANY_OF.format('sterms', 'b')})) AS serves,
      row_number() OVER (PARTITION BY query_id ORDER BY modified DESC, article_id) AS n
      FROM i, a WHERE query_id NOT IN (SELECT query_id FROM action_and_service) AND {_SQL_ANY_OF.format('terms', 't')}) {at_most(2 * (newest or 0))}),
    c3 AS (SELECT * FROM (SELECT query_id, article_id, row_number() OVER (PARTITION BY query_id ORDER BY modified DESC, article_id) AS n
      FROM c2 WHERE serves) {at_most(newest)}),
    {_sql_scored('action_then_service', 'c3')},
    intent_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, context_matches DESC, scenario_detected DESC, modified DESC, article_id) AS rank
      FROM (SELECT * FROM action_and_service UNION ALL SELECT * FROM action_then_service)) WHERE rank <= {limit})"""


SQL_INTENT = sql_intent_search(5, NEWEST)


@query("intent_candidates", f"WITH {SQL_INTENT} SELECT query_id, article_id FROM c1")
def intent_candidates(spark, folder):
    asked = KB.with_intent(user_queries(spark, folder)).filter("intent.is_valid")
    asked = asked.withColumn("terms", KB.search_terms(F.col("query"), F.col("intent.action")))
    return KB.intent_candidates(asked, articles(spark, folder), 5, True).select("query_id", "article_id")


@query(
    "intent_search",
    f"""WITH {SQL_INTENT} SELECT query_id, article_id, round(CAST(relevance_score AS DOUBLE), 6) AS relevance_score, context_matches, scenario_detected,
      search_method, rank FROM intent_hits""",
)
def intent_search(spark, folder):
    r = KB.intent_search(user_queries(spark, folder), articles(spark, folder), newest=NEWEST)
    return r.drop("modified", "title").withColumn("relevance_score", F.round("relevance_score", 6))


@query(
    "intent_search_all",
    f"""WITH {sql_intent_search(5)} SELECT query_id, article_id, round(CAST(relevance_score AS DOUBLE), 6) AS relevance_score, context_matches, scenario_detected,
      search_method, rank FROM intent_hits""",
)
def intent_search_all(spark, folder):
    """Every title hit is scored before the best are taken."""
    r = KB.intent_search(user_queries(spark, folder), articles(spark, folder))
    return r.drop("modified", "title").withColumn("relevance_score", F.round("relevance_score", 6))


@query(
    "intent_relevance",
    f"""WITH i AS ({S.intent("(SELECT doc_id AS query_id, " + S.str_list(S.PHRASES) + f"[1 + doc_id % {len(S.PHRASES)}] AS query FROM documents)")}),
    a AS (SELECT *, lower(title) AS t, lower(body) AS b FROM {S.SQL_ARTICLES}), c AS (SELECT doc_id AS query_id, doc_id AS article_id FROM documents),
    {_sql_scored('pair', 'c')}
    SELECT r.article_id, round(CAST(r.score AS DOUBLE), 6) AS score, r.ctx AS context_matches, p.article_id IS NOT NULL AS relevant,
      {S.label_says('r.action', 'a.t', K.CONFLICTING_ACTIONS)} AS conflict
    FROM pair_r r JOIN a USING (article_id) LEFT JOIN pair p ON r.article_id = p.article_id""",
)
def intent_relevance(spark, folder):
    pairs = articles(spark, folder).withColumn("query", _pick(S.PHRASES, F.col("article_id")))
    scored = pairs.withColumn("intent", Q.extract_intent(F.col("query"))).withColumn(
        "m", KB.intent_relevance(F.col("query"), F.col("intent"), F.lower("title"), F.lower("body"))
    )
    return scored.select(
        "article_id", F.round("m.score", 6).alias("score"), F.size("m.context_matches").alias("context_matches"),
        KB.is_relevant(F.col("intent"), F.col("m")).alias("relevant"),
        KB.conflicts_with_action(F.col("intent.action"), F.col("title")).alias("conflict"),
    )


def _sql_compare(keyword: str, intent: str) -> str:
    return f"""WITH {keyword}, {intent.replace('a AS (SELECT *, lower(title) AS t, lower(body) AS b', 'a2 AS (SELECT *, lower(title) AS t, lower(body) AS b').replace(' JOIN a USING', ' JOIN a2 USING').replace('FROM i, a WHERE', 'FROM i, a2 WHERE')},
    m AS (SELECT q.query_id, (SELECT count(*) FROM intent_hits h WHERE h.query_id = q.query_id) AS a_results,
        (SELECT count(*) FROM keyword h WHERE h.query_id = q.query_id AND search_method <> 'fallback_all') AS b_results,
        coalesce((SELECT avg(relevance_score) FROM intent_hits h WHERE h.query_id = q.query_id), 0) AS a_avg,
        coalesce((SELECT avg(relevance_score) FROM keyword h WHERE h.query_id = q.query_id AND search_method <> 'fallback_all'), 0) AS b_avg,
        (SELECT count(*) FROM intent_hits h WHERE h.query_id = q.query_id AND relevance_score > 0.7) AS a_high,
        (SELECT count(*) FROM keyword h WHERE h.query_id = q.query_id AND relevance_score > 0.7) AS b_high,
        (SELECT count(*) FROM intent_hits h WHERE h.query_id = q.query_id AND relevance_score < 0.3) AS a_low,
        (SELECT count(*) FROM keyword h WHERE h.query_id = q.query_id AND relevance_score < 0.3 AND search_method <> 'fallback_all') AS b_low FROM q)
    SELECT query_id, a_results, b_results, round(CAST(a_avg AS DOUBLE), 6) AS a_avg, round(CAST(b_avg AS DOUBLE), 6) AS b_avg, a_high, b_high, a_low, b_low,
      round(CAST(a_avg - b_avg AS DOUBLE), 6) AS improvement,
      CASE WHEN round(a_avg, 9) > round(b_avg, 9) OR a_high > b_high THEN 'Use intent-driven search' ELSE 'Old method performed better' END AS recommendation FROM m"""


def _compared(spark, folder, newest):
    asked, kb = user_queries(spark, folder), articles(spark, folder)
    r = KB.compare_searches(asked, KB.intent_search(asked, kb, newest=newest), KB.keyword_search(asked, kb, newest=newest))
    return r.drop("a_better").withColumns({c: F.round(c, 6) for c in ("a_avg", "b_avg", "improvement")})


@query("search_ab_compare", _sql_compare(SQL_KEYWORD, SQL_INTENT))
def search_ab_compare(spark, folder):
    return _compared(spark, folder, NEWEST)


@query("search_ab_compare_all", _sql_compare(sql_keyword(None), sql_intent_search(5)))
def search_ab_compare_all(spark, folder):
    """Every hit of both searches is scored."""
    return _compared(spark, folder, None)


SQL_BONUS = f"""CASE WHEN coalesce(contains(lower(title), {S.first_label('low', K.ANSWER_SERVICES)}), false) THEN 0.3 ELSE 0 END
  + CASE WHEN {S.label_says(f"({S.first_label('low', K.ANSWER_TITLE_ACTIONS)})", 'lower(title)', K.ANSWER_TITLE_ACTIONS)} THEN 0.4 ELSE 0 END"""
SQL_BEST, SQL_BEST_ALL = (f"""{intent}, best AS (SELECT * FROM (SELECT h.query_id, h.article_id, h.relevance_score, h.relevance_score + {SQL_BONUS} AS context_score,
    row_number() OVER (PARTITION BY h.query_id ORDER BY h.relevance_score + {SQL_BONUS} DESC, rank) AS n
    FROM intent_hits h JOIN i USING (query_id) JOIN a USING (article_id)) WHERE n = 1 AND relevance_score >= 0.15)""" for intent in (SQL_INTENT, sql_intent_search(5)))


_SQL_RESCORED = "SELECT query_id, article_id, round(CAST(relevance_score AS DOUBLE), 6) AS relevance_score, round(CAST(context_score AS DOUBLE), 6) AS context_score FROM best"


def _rescored(spark, folder, newest):
    asked, kb = user_queries(spark, folder), articles(spark, folder)
    return KB.rescore_articles(KB.intent_search(asked, kb, newest=newest), asked)


@query("article_rescore", f"WITH {SQL_BEST} {_SQL_RESCORED}")
def article_rescore(spark, folder, newest=NEWEST):
    best = _rescored(spark, folder, newest)
    return best.select(
        "query_id", "article_id", F.round("relevance_score", 6).alias("relevance_score"), F.round("context_score", 6).alias("context_score")
    )


@query("article_rescore_all", f"WITH {SQL_BEST_ALL} {_SQL_RESCORED}")
def article_rescore_all(spark, folder):
    return article_rescore(spark, folder, None)


_SQL_OTHER = " + ".join(
    f"CASE WHEN action <> {S.lit(n)} AND {S.any_in('x', t)} THEN 1 ELSE 0 END" for n, t in K.ANSWER_ACTIONS.items()
)


def sql_article_answers(asked: str) -> str:
    """CTEs up to article_answers (query_id, answer): what the ``best`` articles say to the questions ``asked``."""
    return f"""ans_c AS (SELECT query_id, {asked}.query, {S.first_label(asked + '.low', K.ANSWER_ACTIONS)} AS action, title, relevance_score, {S.SQL_CLEAN_BODY} AS content
      FROM best JOIN {asked} USING (query_id) JOIN a USING (article_id)),
    ans_s0 AS (SELECT *, list_filter(list_transform(string_split(content, '.'), lambda y: {S.strip('y')}), lambda y: length(y) > 15) AS ss FROM ans_c),
    ans_s AS (SELECT query_id, action, {S.long_words('query')} AS w, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM ans_s0),
    ans_p AS (SELECT query_id, s, pos, len(list_filter(w, lambda y: contains(x, y))) + CASE WHEN {S.label_says('action', 'x', K.ANSWER_ACTIONS)} THEN 3 ELSE 0 END
      + CASE WHEN {S.any_in('x', K.PROCEDURE_WORDS)} THEN 1 ELSE 0 END - CASE WHEN {S.any_in('x', K.FLUFF_WORDS)} THEN 2 ELSE 0 END
      - coalesce({_SQL_OTHER}, 0) AS score FROM (SELECT *, lower(s) AS x FROM ans_s)),
    ans_t AS (SELECT query_id, s, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS n FROM ans_p WHERE score > 0),
    ans_u AS (SELECT query_id, s, n FROM ans_t WHERE n <= 4 UNION ALL SELECT query_id, s, pos FROM ans_s WHERE pos <= 3 AND query_id NOT IN (SELECT query_id FROM ans_t)),
    ans_v AS (SELECT query_id, string_agg(n || '. ' || s || CASE WHEN s LIKE '%.' THEN '' ELSE '.' END || chr(10), '' ORDER BY n) AS body FROM ans_u GROUP BY 1),
    article_answers AS (SELECT query_id, CASE WHEN length(content) < 200 THEN 'Based on ''' || title || ''': ' || content
      ELSE 'Based on ''' || title || ''' (relevance: ' || printf('%.2f', relevance_score) || '):' || chr(10) || chr(10) || coalesce(body, '') END AS answer
    FROM ans_c LEFT JOIN ans_v USING (query_id))"""


def _sql_sentences(best: str) -> str:
    return f"WITH {best}, {sql_article_answers('i')} SELECT query_id, answer FROM article_answers"


@query("answer_sentences", _sql_sentences(SQL_BEST_ALL))
def answer_sentences(spark, folder):
    """Every title hit is scored before an article answers."""
    best = written(_rescored(spark, folder, None), "best")
    # each article that answers is cleaned once, however many questions it answers
    told = articles(spark, folder).join(best.select("article_id").distinct(), "article_id", "left_semi")
    full = best.join(written(told.select("article_id", strip_html(F.col("body")).alias("content")), "best-articles"), "article_id")
    return full.select(
        "query_id",
        KB.article_answer(F.col("query"), F.col("title"), F.col("content"), F.col("relevance_score")).alias("answer"),
    )


@query("answer_sentences_all", _sql_sentences(SQL_BEST_ALL))
def answer_sentences_all(spark, folder):
    return answer_sentences(spark, folder)


@query(
    "top_article_lines",
    f"""WITH a AS (SELECT article_id, {S.SQL_CLEAN_BODY} AS c FROM {S.SQL_ARTICLES}),
    l AS (SELECT article_id, list_filter(list_transform(string_split(regexp_replace(c, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:10],
      lambda s: {S.strip('s')}), lambda s: s <> '') AS ls FROM a)
    SELECT article_id, array_to_string(list_transform(ls, lambda s: CASE WHEN regexp_matches(s, '^\\d+\\.') THEN '**' || s || '**'
      WHEN regexp_matches(s, '^(?i)(Contact|Call|Email|Visit|Check|Verify|Confirm|Review|Submit|Complete)') THEN '**Action:** ' || s ELSE s END), chr(10)) AS lines FROM l""",
)
def top_article_lines(spark, folder):
    return articles(spark, folder).select(
        "article_id", KB.top_article_lines(strip_html(F.col("body"))).alias("lines")
    )


# ---------------------------------------------------------------- scans


def raw_articles(spark, folder):
    a = articles(spark, folder).withColumnRenamed("article_id", "id")
    d = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("lang") == "en", "en_US").otherwise(F.col("lang")).alias("language"),
        F.when(F.col("source") == "src3", "Draft").otherwise("Online").alias("status"),
        F.when(F.col("n_chars") % 5 == 0, "FAQ").otherwise("Product Documentation").alias("record_type"),
        F.when(F.col("n_chars") % 7 == 0, "").otherwise("x").alias("keep"),
    )
    return a.join(d, "id").select(
        "id", "title", F.when(F.col("keep") == "", "").otherwise(F.col("body")).alias("body"),
        F.col("modified").alias("created"), "modified", "status", "language", "record_type",
    )


SQL_RAW_ARTICLES = f"""(SELECT article_id AS id, title, CASE WHEN n_chars % 7 = 0 THEN '' ELSE body END AS body, modified AS created, modified,
  CASE WHEN source = 'src3' THEN 'Draft' ELSE 'Online' END AS status, CASE WHEN lang = 'en' THEN 'en_US' ELSE lang END AS language,
  CASE WHEN n_chars % 5 = 0 THEN 'FAQ' ELSE 'Product Documentation' END AS record_type
  FROM {S.SQL_ARTICLES} a JOIN documents d ON a.article_id = d.doc_id)"""


def raw_cases(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("C-"), "o_orderkey").alias("case_number"),
        F.concat(F.lit("Order of customer "), "o_custkey").alias("subject"),
        F.when(F.col("o_custkey") % 10 == 0, None).otherwise(F.concat(F.lit("Total "), F.col("o_totalprice").cast("bigint"))).alias("description"),
        F.when(F.col("o_orderstatus") == "F", "Closed").otherwise("Open").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").alias("created"),
        F.col("o_orderdate").alias("closed"),
    )


SQL_RAW_CASES = """(SELECT o_orderkey AS id, 'C-' || o_orderkey AS case_number, 'Order of customer ' || o_custkey AS subject,
  CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE 'Total ' || CAST(trunc(o_totalprice) AS BIGINT) END AS description,
  CASE WHEN o_orderstatus = 'F' THEN 'Closed' ELSE 'Open' END AS status, o_orderpriority AS priority, o_orderdate AS created, o_orderdate AS closed FROM orders)"""
_SQL_PUBLISHED = "status = 'Online' AND language = 'en_US' AND record_type = 'Product Documentation'"
SQL_SCAN_ARTICLES = f"""SELECT id, title, CASE WHEN body = '' THEN 'No content available for ' || title ELSE body END AS content, created, modified
  FROM {SQL_RAW_ARTICLES} WHERE {_SQL_PUBLISHED}"""
SQL_SCAN_CASES = f"""SELECT id, case_number, subject AS title, description AS problem, description AS solution, priority, created, closed
  FROM {SQL_RAW_CASES} WHERE status = 'Closed' AND description <> ''"""


@query("scan_articles", SQL_SCAN_ARTICLES)
def scan_articles(spark, folder):
    return SRC.scan_articles(raw_articles(spark, folder)).select("id", "title", "content", "created", "modified")


@query("scan_articles_newest", f"{SQL_SCAN_ARTICLES} ORDER BY modified DESC, id LIMIT {K.DEFAULT_ARTICLES}")
def scan_articles_newest(spark, folder):
    newest = SRC.scan_articles(raw_articles(spark, folder), K.DEFAULT_ARTICLES)
    return newest.select("id", "title", "content", "created", "modified")


@query("scan_closed_cases", SQL_SCAN_CASES)
def scan_closed_cases(spark, folder):
    return SRC.scan_closed_cases(raw_cases(spark, folder)).select(
        "id", "case_number", "title", "problem", "solution", "priority", "created", "closed"
    )


@query("scan_closed_cases_newest", f"{SQL_SCAN_CASES} ORDER BY closed DESC, id LIMIT {K.DEFAULT_CASES}")
def scan_closed_cases_newest(spark, folder):
    return SRC.scan_closed_cases(raw_cases(spark, folder), K.DEFAULT_CASES).select(
        "id", "case_number", "title", "problem", "solution", "priority", "created", "closed"
    )


@query(
    "incremental_scan",
    f"""SELECT 'article' AS kind, id, title, body AS content FROM {SQL_RAW_ARTICLES} WHERE status = 'Online' AND modified > 50000000000
    UNION ALL SELECT 'case', id, subject, description FROM {SQL_RAW_CASES} WHERE status = 'Closed' AND description <> ''
      AND closed > TIMESTAMP '1998-06-01 00:00:00'""",
)
def incremental_scan(spark, folder):
    a = SRC.changed_articles(raw_articles(spark, folder), F.lit(50000000000))
    c = SRC.changed_cases(raw_cases(spark, folder), F.expr("TIMESTAMP_NTZ'1998-06-01 00:00:00'"))
    return a.select(F.lit("article").alias("kind"), "id", "title", F.col("body").alias("content")).unionByName(
        c.select(F.lit("case").alias("kind"), "id", F.col("subject").alias("title"), F.col("description").alias("content"))
    )


@query(
    "unify_sources",
    rf"""SELECT {S.strip("title || chr(10) || chr(10) || content")} AS content, id AS source_id, title, 'knowledge_article' AS type, NULL AS priority
      FROM ({SQL_SCAN_ARTICLES})
    UNION ALL SELECT title || chr(10) || chr(10) || 'Problem: ' || problem || chr(10) || chr(10) || 'Solution: ' || solution
      || chr(10) || chr(10) || 'Priority: ' || priority, id, title, 'case_solution', priority FROM ({SQL_SCAN_CASES})""",
)
def unify_sources(spark, folder):
    a = SRC.scan_articles(raw_articles(spark, folder)).withColumn("created", F.lit(None).cast("timestamp_ntz"))
    both = SRC.unify_sources(a, SRC.scan_closed_cases(raw_cases(spark, folder)))
    return both.select("content", "source_id", "title", "type", "priority")
