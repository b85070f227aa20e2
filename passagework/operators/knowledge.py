"""Search in a knowledge base for many queries at once.

Queries: query_id, query. Articles: article_id, title, body, modified (published only).

Titles are matched by substring, as LIKE does. No query meets every article:
words meet distinct title tokens in blocks of both. With
``newest`` set, each token or term keeps only so many articles, which is enough
because the newest n of a union lie in the union of the newest n of its parts;
without it every match is scored. Equal questions are searched once.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import constants as K
from passagework.functions.query import extract_intent
from passagework.functions.text import (
    computed_once, contains_any, count_contained, empty_strings, first_label, let, long_words, strip, strip_html, words,
)
from passagework.operators import word_bitmaps as WB
from passagework.session import written

QUERY = "query_id"
PARTS = 1 << 19  # words of a group that tokens are looked through for, about
TOKENS = 1 << 18  # tokens of a block, about
HEAD = 24


def newest_per(df: DataFrame, keys: list[str], n: int | None) -> DataFrame:
    """The n newest articles per key, all without n; partitions drop the rest before the exchange."""
    if n is None:
        return df
    w = Window.partitionBy(*keys).orderBy(F.desc("modified"), "article_id")
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def once_each(asked: DataFrame, what: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row for each distinct ``what``, (query_id, ask) telling which row stands for which query).

    The least query id of equal questions stands for them. Partial minima, so a very frequent question is no hot group.
    """
    asks = written(asked.groupBy(*what).agg(F.min(QUERY).alias("ask")), "asks")
    same = reduce(lambda a, b: a & b, (asked[c].eqNullSafe(asks[c]) for c in what))
    return asks.withColumnRenamed("ask", QUERY), written(asked.join(asks, same).select(QUERY, "ask"), "asked")


def for_all(found: DataFrame, stands: DataFrame) -> DataFrame:
    """Results of the questions, repeated for every query that asks them."""
    return stands.join(found.withColumnRenamed(QUERY, "ask"), "ask").drop("ask")


def _containing(parts: pa.Table, tokens: pa.Table) -> pa.Table:
    """(part, token) pairs: every substring of a token that has the length of a part is looked up; longer parts by their first ``HEAD`` characters."""
    known = defaultdict(list)
    for part in parts.column("part").to_pylist():
        known[part[:HEAD]].append(part)
    lengths = sorted({len(x) for x in known})
    found, held = [], []
    for token in tokens.column("token").to_pylist():
        size, here = len(token), set()
        for n in lengths:
            if n > size:
                break
            for i in range(size - n + 1):
                if parts_here := known.get(token[i : i + n]):
                    here.update(parts_here if n < HEAD else (x for x in parts_here if token.startswith(x, i)))
        found += here
        held += [token] * len(here)
    return pa.table({"part": pa.array(found, pa.string()), "token": pa.array(held, pa.string())})


def contained_in_tokens(parts: DataFrame, tokens: DataFrame) -> DataFrame:
    """(part, token) pairs where the part is a substring of the token.

    Both sides hold distinct strings without whitespace. Blocks of tokens meet groups of parts, both of bounded size.
    """
    parts, tokens = written(parts.where("part <> ''"), "parts"), written(tokens, "tokens")
    groups = max(1, -(-parts.count() // PARTS))
    blocks = max(parts.sparkSession.sparkContext.defaultParallelism, -(-tokens.count() // TOKENS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = parts.select("part", F.pmod(F.xxhash64("part"), F.lit(groups)).cast("int").alias("pg"), every(blocks).alias("tb"))
    right = tokens.select("token", every(groups).alias("pg"), F.pmod(F.xxhash64("token"), F.lit(blocks)).cast("int").alias("tb"))
    return left.groupBy("pg", "tb").cogroup(right.groupBy("pg", "tb")).applyInArrow(_containing, "part string, token string")


def _title_tokens(articles: DataFrame) -> DataFrame:
    return articles.select(
        "article_id", "modified", F.explode(F.array_distinct(words(F.lower("title")))).alias("token")
    )


def _spoken(queries: DataFrame) -> DataFrame:
    """query_id, q, w, phrase of the questions that are not null."""
    low = F.lower("query")
    asked = queries.where(F.col("query").isNotNull())
    return asked.select(F.col(QUERY).cast("bigint").alias(QUERY), low.alias("q"), long_words(F.col("query")).alias("w"), F.regexp_replace(low, "[?!]", "").alias("phrase"))


def title_candidates(queries: DataFrame, articles: DataFrame, limit: int | None) -> DataFrame:
    """Per query the ``limit`` newest articles whose title contains one of its long words; all without a limit.

    A query without long words is looked up as a whole phrase. A word or phrase of question marks only matches
    every title, so it needs a limit; without one it matches none.
    """
    def plain(c):
        return F.regexp_replace(c, "[?!]", "")

    if limit is None:
        return WB.title_hits(_spoken(queries), articles, contained_in_tokens)
    phrase = plain(F.lower("query"))
    asked = queries.select(QUERY, long_words(F.col("query")).alias("w"), phrase.alias("phrase"))
    by_word = asked.filter(F.size("w") > 0).select(
        QUERY, F.explode(F.array_distinct(F.transform("w", plain))).alias("part")
    )
    by_phrase = asked.filter(F.size("w") == 0).select(QUERY, "phrase")
    postings = _title_tokens(articles)

    longest = F.array_max(F.transform(words(F.col("phrase")), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    phrases = by_phrase.withColumn("part", longest)
    spoken = phrases.filter(F.col("part").isNotNull())
    parts = by_word.filter(F.col("part") != "").select("part").union(spoken.select("part")).distinct()
    # As large as the vocabularies, not as the tables; used by words and phrases.
    pairs = written(contained_in_tokens(parts, postings.select("token").distinct()), "word-tokens")

    # Words: newest articles per word, then per query.
    per_word = newest_per(
        pairs.join(newest_per(postings, ["token"], limit), "token").select("part", "article_id", "modified").distinct(),
        ["part"], limit,
    )
    word_hits = by_word.join(per_word, "part").select(QUERY, "article_id", "modified")

    # Phrases of short words: found over their longest word, then checked in the title.
    titles = articles.select("article_id", F.lower("title").alias("title"))
    per_phrase = newest_per(
        spoken.select("phrase", "part").distinct()
        .join(pairs, "part")
        .join(postings, "token")
        .join(titles, "article_id")
        .filter(F.contains(F.col("title"), F.col("phrase")))
        .select("phrase", "article_id", "modified")
        .distinct(),
        ["phrase"], limit,
    )
    phrase_hits = spoken.join(per_phrase, "phrase").select(QUERY, "article_id", "modified")

    everything = by_word.filter(F.col("part") == "").select(QUERY).union(
        phrases.filter(F.col("part").isNull()).select(QUERY)
    )
    newest = with_each_of_newest(everything, articles.select("article_id", "modified"), limit)
    hits = word_hits.unionByName(phrase_hits).unionByName(newest.select(QUERY, "article_id", "modified")).distinct()
    return newest_per(hits, [QUERY], limit)


def with_each_of_newest(queries: DataFrame, articles: DataFrame, n: int, **added: Column) -> DataFrame:
    """Every query with the n newest articles; the article side has n rows, so it is broadcast.

    ``added`` columns are computed on those n rows only.
    """
    recent = articles.orderBy(F.desc("modified"), "article_id").limit(n)
    numbered = recent.withColumn(
        "position", F.row_number().over(Window.orderBy(F.desc("modified"), "article_id"))
    ).withColumns(added)
    asked = queries.withColumn("position", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return asked.join(F.broadcast(numbered), "position").drop("position")


def _ranked(df: DataFrame, *order: Column) -> DataFrame:
    w = Window.partitionBy(QUERY).orderBy(*order, F.desc("modified"), "article_id")
    return df.withColumn("rank", F.row_number().over(w))


def keyword_search(
    queries: DataFrame, articles: DataFrame, limit: int = 5, fallback_all: bool = False, newest: int | None = None
) -> DataFrame:
    """Title search, then content search for queries without a hit; the ``limit`` most relevant are returned.

    Every title hit, or every body for the content search, is scored. With ``newest`` only so many of the newest
    title hits are, and thrice as many of the newest articles in the content search. With ``fallback_all`` queries
    without any hit get the newest articles at 0.2. Null and blank queries get no results but those.
    """
    asks, stands = once_each(queries, ["query"])
    return for_all(_keyword_search(asks, articles, limit, fallback_all, newest), stands)


def _keyword_search(queries: DataFrame, articles: DataFrame, limit: int, fallback_all: bool, newest: int | None) -> DataFrame:
    if newest is None:
        results = _keyword_scores(queries, articles, limit)
    else:
        results = _newest_keyword_scores(queries, articles, newest)
    if fallback_all:
        results = written(results, "keyword-hits")
        left = queries.select(QUERY).join(results.select(QUERY).distinct(), QUERY, "left_anti")
        last = with_each_of_newest(left, articles.select("article_id", "modified", "title"), limit)
        results = results.unionByName(
            last.select(
                QUERY, "article_id", "modified", "title", F.lit(0.2).alias("relevance_score"),
                F.lit(0).alias("title_matches"), F.lit(0).alias("content_matches"),
                F.lit("fallback_all").alias("search_method"),
            )
        )
    return _ranked(results, F.desc("relevance_score")).filter(F.col("rank") <= limit)


def _title_and_body() -> tuple[Column, Column]:
    return F.lower(F.regexp_replace("title", "<[^>]+>", "")), F.lower(strip_html(F.col("body"), unescape=False))


def _keyword_scores(queries: DataFrame, articles: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best of all hits, from postings of words; equal ones by the newest."""
    found = WB.search(_spoken(queries), articles, *_title_and_body(), contained_in_tokens, limit)
    w = Window.partitionBy(QUERY).orderBy(F.desc("relevance_score"), F.desc("modified"), "article_id")
    best = found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit)
    return best.select(
        QUERY, "article_id", "modified", "title", "relevance_score", "title_matches", "content_matches",
        F.when(F.col("method") == WB.TITLE, "title_search").otherwise("content_search").alias("search_method"),
    )


def _newest_keyword_scores(queries: DataFrame, articles: DataFrame, newest: int) -> DataFrame:
    """The newest title hits, else the newest articles' bodies."""
    low = F.lower("query")
    asked = queries.select(QUERY, "query", low.alias("q"), long_words(F.col("query")).alias("w"))
    words_n = F.greatest(F.lit(1), F.size("w"))
    title, body = _title_and_body()

    # Used twice below: ids only.
    found = written(title_candidates(queries, articles, newest), "title-hits")
    known = articles.select("article_id", "modified", "title", title.alias("t"), body.alias("b"))
    scored = (
        found.select(QUERY, "article_id")
        .join(known, "article_id")
        .join(asked, QUERY)
        .select(
            QUERY, "article_id", "modified", "title", words_n.alias("n"),
            (count_contained(F.col("t"), F.col("w")) + F.when(F.contains("t", "q"), 2).otherwise(0)).alias("title_matches"),
            (count_contained(F.col("b"), F.col("w")) + F.when(F.contains("b", "q"), 1).otherwise(0)).alias("content_matches"),
        )
    )
    relevance = (F.col("title_matches") * 0.6 + F.col("content_matches") * 0.4) / F.col("n")
    by_title = scored.select(
        QUERY, "article_id", "modified", "title",
        F.greatest(F.lit(0.3), F.least(F.lit(1.0), relevance)).alias("relevance_score"),
        "title_matches", "content_matches", F.lit("title_search").alias("search_method"),
    )

    missed = asked.join(found.select(QUERY).distinct(), QUERY, "left_anti")
    recent = with_each_of_newest(missed, articles, 3 * newest, b=body)
    matches = count_contained(F.col("b"), F.col("w")) + F.when(F.contains("b", "q"), 2).otherwise(0)
    matched = computed_once(recent, "content_matches", matches).withColumn("n", words_n)
    by_content = matched.filter(F.col("content_matches") > 0).select(
        QUERY, "article_id", "modified", "title",
        F.least(F.lit(1.0), F.col("content_matches") * 0.4 / F.col("n")).alias("relevance_score"),
        F.lit(0).alias("title_matches"), "content_matches", F.lit("content_search").alias("search_method"),
    )
    return by_title.unionByName(by_content)


# ---------------------------------------------------------------- intent search


def _label_terms(label: Column, groups: dict[str, list[str]]) -> Column:
    out = empty_strings()
    for name, terms in groups.items():
        out = F.when(label == name, F.array(*[F.lit(t) for t in terms])).otherwise(out)
    return out


def _label_says(label: Column, low: Column, groups: dict[str, list[str]]) -> Column:
    out = F.lit(False)
    for name, terms in groups.items():
        out = F.when(label == name, contains_any(low, terms)).otherwise(out)
    return out


def search_terms(query: Column, action: Column) -> Column:
    """Title terms for the action; 'handle' adds terms of the scenario in the query."""

    def terms_of(x):
        extra = [
            F.when(
                (x["action"] == "handle") & contains_any(x["low"], hints), F.array(*[F.lit(t) for t in terms])
            ).otherwise(empty_strings())
            for hints, terms in K.SEARCH_SCENARIOS
        ]
        return F.array_distinct(F.concat(_label_terms(x["action"], K.SEARCH_ACTIONS), *extra))

    return let(F.struct(F.lower(query).alias("low"), action.alias("action")), terms_of)


def _all_search_terms() -> list[str]:
    groups = list(K.SEARCH_ACTIONS.values()) + [terms for _, terms in K.SEARCH_SCENARIOS]
    return sorted({t for g in groups for t in g})


def with_intent(queries: DataFrame) -> DataFrame:
    return queries.select(QUERY, "query", extract_intent(F.col("query")).alias("intent"))


def _matched(low: Column, terms: list[str]) -> Column:
    return F.filter(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms]), lambda t: t.isNotNull())


def intent_candidates(asked: DataFrame, articles: DataFrame, limit: int | None, with_service: bool) -> DataFrame:
    """Articles with an action term (and a service term) of the query in the title, the newest ``limit`` if set.

    The terms are a fixed list, so with a limit the scan keeps at most terms x services x limit rows.
    """
    hits = articles.select("article_id", "modified", F.lower("title").alias("t")).select(
        "article_id", "modified", "t", F.explode(_matched(F.col("t"), _all_search_terms())).alias("term")
    )
    keys = ["term"]
    asked_terms = asked.select(QUERY, F.col("intent.service").alias("service"), F.explode("terms").alias("term"))
    if with_service:
        keys = ["term", "service"]
        services = [F.when(contains_any(F.col("t"), terms), F.lit(s)) for s, terms in K.SEARCH_SERVICES.items()]
        hits = hits.withColumn("service", F.explode(F.filter(F.array(*services), lambda s: s.isNotNull())))
    postings = newest_per(hits.select("article_id", "modified", *keys), keys, limit)
    pairs = asked_terms.join(postings, keys).select(QUERY, "article_id", "modified").distinct()
    return newest_per(pairs, [QUERY], limit)


def intent_relevance(query: Column, intent: Column, title: Column, body: Column) -> Column:
    """Struct score, has_both, context_matches for one article and one intent; lower-case title and body."""

    def acts(x, text):
        extra = F.lit(False)
        for hints, terms in reversed(K.RELEVANCE_SCENARIOS):
            extra = F.when(contains_any(x["low"], hints), contains_any(text, terms)).otherwise(extra)
        scenario = (x["intent"]["action"] == "handle") & x["intent"]["scenario_detected"]
        return _label_says(x["intent"]["action"], text, K.RELEVANCE_ACTIONS) | (scenario & extra)

    def context(x):
        found = [
            F.when(
                F.array_contains(x["intent"]["context"], F.lit(label))
                & (contains_any(x["title"], terms) | contains_any(x["body"], terms)),
                F.lit(label),
            )
            for label, terms in K.RELEVANCE_CONTEXTS.items()
        ]
        return F.filter(F.array(*found), lambda c: c.isNotNull())

    def flags(x):
        service = x["intent"]["service"]
        return F.struct(
            acts(x, x["title"]).alias("at"),
            acts(x, x["body"]).alias("ab"),
            _label_says(service, x["title"], K.RELEVANCE_SERVICES).alias("st"),
            _label_says(service, x["body"], K.RELEVANCE_SERVICES).alias("sb"),
            context(x).alias("ctx"),
        )

    def score(x, f):
        base = (
            F.when(f["at"] & f["st"], 1.0)
            .when(f["at"] & f["sb"], 0.8)
            .when(f["ab"] & f["st"], 0.7)
            .when(f["ab"] & f["sb"], 0.5)
            .when(f["at"], 0.4)
            .when(f["st"], 0.3)
            .otherwise(0.1)
        )
        return let(
            F.least(F.lit(1.0), base + F.size(f["ctx"]) * 0.1),
            lambda raised: F.struct(
                F.when(
                    x["intent"]["scenario_detected"] & (raised > 0.3), F.least(F.lit(1.0), raised + 0.1)
                ).otherwise(raised).alias("score"),
                ((f["at"] | f["ab"]) & (f["st"] | f["sb"])).alias("has_both"),
                f["ctx"].alias("context_matches"),
            ),
        )

    known = F.struct(
        F.lower(query).alias("low"), intent.alias("intent"), title.alias("title"), body.alias("body")
    )
    return let(known, lambda x: let(flags(x), lambda f: score(x, f)))


def is_relevant(intent: Column, relevance: Column) -> Column:
    """Whether an article may be shown for the intent."""
    floor = F.when(intent["scenario_detected"], 0.4).otherwise(0.3)
    off_topic = (
        (intent["action"] == "handle")
        & (F.size(intent["context"]) > 0)
        & (F.size(relevance["context_matches"]) == 0)
        & (relevance["score"] < 0.6)
    )
    return (relevance["score"] >= floor) & (relevance["has_both"] | (relevance["score"] >= 0.5)) & ~off_topic


def conflicts_with_action(action: Column, title: Column) -> Column:
    """The title speaks for another action (an optional, stricter check)."""
    return _label_says(action, F.lower(title), K.CONFLICTING_ACTIONS)


_BODY_TERMS = sorted({
    t for lists in (K.RELEVANCE_ACTIONS.values(), K.RELEVANCE_SERVICES.values(), K.RELEVANCE_CONTEXTS.values(), K.SEARCH_SERVICES.values(), [x for _, x in K.RELEVANCE_SCENARIOS])
    for terms in lists for t in terms
})


def with_terms_for_body(articles: DataFrame) -> DataFrame:
    """article_id, modified, title and, as ``body``, the terms that a relevance looks for and the body holds, a line each.

    No term has a line feed, so a term is in these lines exactly if it is in the body.
    """
    low = computed_once(articles, "low", F.lower(F.coalesce("body", F.lit(""))))
    return low.select("article_id", "modified", "title", F.array_join(_matched(F.col("low"), _BODY_TERMS), "\n").alias("body"))


def _scored(candidates: DataFrame, asked: DataFrame, articles: DataFrame) -> DataFrame:
    joined = (
        candidates.select(QUERY, "article_id")
        .join(articles, "article_id")
        .join(asked.select(QUERY, "query", "intent"), QUERY)
        .withColumns({"t": F.lower("title"), "b": F.lower(F.coalesce("body", F.lit("")))})
    )
    return computed_once(
        joined, "match", intent_relevance(F.col("query"), F.col("intent"), F.col("t"), F.col("b"))
    )


def _shown(scored: DataFrame, method: str) -> DataFrame:
    return scored.filter(is_relevant(F.col("intent"), F.col("match"))).select(
        QUERY, "article_id", "modified", "title", F.col("match.score").alias("relevance_score"),
        F.size("match.context_matches").alias("context_matches"),
        F.col("intent.scenario_detected").alias("scenario_detected"), F.lit(method).alias("search_method"),
    )


def _scenario_hint(query: Column) -> Column:
    """Which scenario words the query has, as far as the relevance looks at them."""
    low = F.lower(query)
    return F.coalesce(*[F.when(contains_any(low, hints), i) for i, (hints, _) in enumerate(K.RELEVANCE_SCENARIOS)], F.lit(-1))


def intent_search(queries: DataFrame, articles: DataFrame, limit: int = 5, newest: int | None = None) -> DataFrame:
    """Staged search for queries with a valid intent; later stages see only unmatched queries.

    The relevance depends on the query's intent, terms and scenario only, so the search runs once for each
    distinct set of them: a number bounded by the fixed word lists, whatever the number of queries. Every title
    hit is scored and the ``limit`` best are returned; with ``newest`` only so many of the newest hits are scored.
    Bodies are not shuffled: of all of them the terms are taken where they lie, and a few are looked up.
    """
    asked = with_intent(queries).filter(F.col("intent.is_valid")).withColumns(
        {"terms": search_terms(F.col("query"), F.col("intent.action")), "hint": _scenario_hint(F.col("query"))}
    )
    asked = written(asked, "intents")
    asks, stands = once_each(asked, ["intent", "terms", "hint"])
    asks = asks.join(asked.select(QUERY, "query"), QUERY)
    return for_all(_intent_search(asks, articles, limit, newest), stands)


def _intent_search(asked: DataFrame, articles: DataFrame, limit: int, newest: int | None) -> DataFrame:
    best = (F.desc("relevance_score"), F.desc("context_matches"), F.desc("scenario_detected"))
    if newest is None:
        articles = written(with_terms_for_body(articles), "article-terms")
    # written, so that Spark knows how few they are
    looked = (lambda c: c) if newest is None else (lambda c: written(c, "candidates"))
    first = written(
        _ranked(_shown(_scored(looked(intent_candidates(asked, articles, newest, True)), asked, articles), "action_and_service"), *best)
        .filter(F.col("rank") <= limit).drop("rank"),
        "stage-one",
    )
    open_queries = asked.join(first.select(QUERY).distinct(), QUERY, "left_anti")
    wide = intent_candidates(open_queries, articles, 2 * newest if newest else None, False)
    looked_up = _scored(looked(wide), open_queries, articles)
    serving = looked_up.filter(
        _label_says(F.col("intent.service"), F.col("t"), K.SEARCH_SERVICES)
        | _label_says(F.col("intent.service"), F.col("b"), K.SEARCH_SERVICES)
    )
    second = _shown(newest_per(serving, [QUERY], newest), "action_then_service")
    return _ranked(first.unionByName(second), *best).filter(F.col("rank") <= limit)


def compare_searches(queries: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Per query: counts and average relevance of two methods and which one to use."""
    def measured(df, p):
        return df.groupBy(QUERY).agg(
            F.count("*").alias(f"{p}_results"),
            F.avg("relevance_score").alias(f"{p}_avg"),
            F.count_if(F.col("relevance_score") > 0.7).alias(f"{p}_high"),
            F.count_if(F.col("relevance_score") < 0.3).alias(f"{p}_low"),
        )

    both = measured(a, "a").join(measured(b, "b"), QUERY, "full_outer")
    full = queries.select(QUERY).join(both, QUERY, "left").na.fill(0)
    better = (F.col("a_avg") > F.col("b_avg")) | (F.col("a_high") > F.col("b_high"))
    return full.withColumns(
        {
            "improvement": F.col("a_avg") - F.col("b_avg"),
            "a_better": F.col("a_avg") > F.col("b_avg"),
            "recommendation": F.when(better, "Use intent-driven search").otherwise("Old method performed better"),
        }
    )


# ---------------------------------------------------------------- answers from articles


def rescore_articles(results: DataFrame, queries: DataFrame) -> DataFrame:
    """The best article per query after bonuses for service and action in the title."""
    asked = let(
        F.lower("query"),
        lambda low: F.struct(
            first_label(low, K.ANSWER_SERVICES).alias("service"),
            first_label(low, K.ANSWER_TITLE_ACTIONS).alias("action"),
        ),
    )

    def added(x):
        service, title = x["asked"]["service"], x["title"]
        return F.when(service.isNotNull() & F.contains(title, service), 0.3).otherwise(0.0) + F.when(
            _label_says(x["asked"]["action"], title, K.ANSWER_TITLE_ACTIONS), 0.4
        ).otherwise(0.0)

    bonus = let(F.struct(asked.alias("asked"), F.lower("title").alias("title")), added)
    joined = results.join(queries.select(QUERY, "query"), QUERY)
    scored = joined.withColumn("context_score", F.col("relevance_score") + bonus)
    order = Window.partitionBy(QUERY).orderBy(F.desc("context_score"), "rank")
    best = scored.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == 1).drop("_n")
    return best.filter(F.col("relevance_score") >= 0.15)


def answer_sentences(query: Column, content: Column, top: int = 4) -> Column:
    """The sentences of a cleaned article that answer the query best, else its first three."""
    sentences = F.filter(F.transform(F.split(content, r"\."), strip), lambda s: F.length(s) > 15)
    asked = let(
        F.lower(query),
        lambda low: F.struct(long_words(low).alias("words"), first_label(low, K.ANSWER_ACTIONS).alias("action")),
    )

    def score(text, a):
        other = reduce(
            lambda x, y: x + y,
            [
                F.when((a["action"] != name) & contains_any(text, terms), 1).otherwise(0)
                for name, terms in K.ANSWER_ACTIONS.items()
            ],
        )
        return (
            count_contained(text, a["words"])
            + F.when(_label_says(a["action"], text, K.ANSWER_ACTIONS), 3).otherwise(0)
            + F.when(contains_any(text, K.PROCEDURE_WORDS), 1).otherwise(0)
            - F.when(contains_any(text, K.FLUFF_WORDS), 2).otherwise(0)
            - other
        )

    def scored(ss, a):
        return F.transform(
            ss,
            lambda s, i: F.struct(
                (-let(F.lower(s), lambda text: score(text, a))).alias("cost"), i.alias("i"), s.alias("s")
            ),
        )

    def pick(ss):
        best = let(asked, lambda a: F.slice(F.sort_array(F.filter(scored(ss, a), lambda x: x["cost"] < 0)), 1, top))
        return let(
            best,
            lambda b: F.when(F.size(b) > 0, F.transform(b, lambda x: x["s"])).otherwise(F.slice(ss, 1, 3)),
        )

    return let(sentences, pick)


def article_answer(query: Column, title: Column, content: Column, relevance: Column) -> Column:
    """Answer text from one cleaned article; a short article is returned whole."""
    numbered = F.array_join(
        F.transform(
            answer_sentences(query, content),
            lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s, F.when(F.endswith(s, F.lit(".")), "").otherwise("."), F.lit("\n")),
        ),
        "",
    )
    head = F.concat(F.lit("Based on '"), title, F.lit("' (relevance: "), F.format_string("%.2f", relevance), F.lit("):\n\n"))
    return F.when(
        F.length(content) < 200, F.concat(F.lit("Based on '"), title, F.lit("': "), content)
    ).otherwise(F.concat(head, numbered))


def top_article_lines(content: Column) -> Column:
    """First ten sentences of a cleaned article; numbered ones bold, actions marked."""
    sentences = F.transform(F.slice(F.split(content, r"(?<=[.!?])(?U:\s+)"), 1, 10), strip)
    marked = F.transform(
        F.filter(sentences, lambda s: s != ""),
        lambda s: F.when(F.rlike(s, F.lit(r"^\d+\.")), F.concat(F.lit("**"), s, F.lit("**")))
        .when(F.rlike(s, F.lit(K.ACTION_LINE)), F.concat(F.lit("**Action:** "), s))
        .otherwise(s),
    )
    return F.array_join(marked, "\n")
