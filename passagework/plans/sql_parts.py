"""SQL text shared by the oracles; the word lists come from the fixed values."""

from __future__ import annotations

from passagework.functions import constants as K


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(values: list[str]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def any_in(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(t)})" for t in terms) + ")" if terms else "false"


def first_label(column: str, groups: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {any_in(column, t)} THEN {lit(n)}" for n, t in groups.items()) + " END"


def label_says(label: str, column: str, groups: dict[str, list[str]]) -> str:
    return "coalesce(" + " OR ".join(f"({label} = {lit(n)} AND {any_in(column, t)})" for n, t in groups.items()) + ", false)"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def long_words(x: str) -> str:
    return rf"list_filter(string_split_regex(lower({x}), '\s+'), lambda w: length(w) > 2)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def intent(source: str) -> str:
    """CTE body: query_id, query, low, action, service, context, is_valid, confidence, scenario."""
    scenario = any_in("low", K.SCENARIO_PHRASES)
    contexts = ", ".join(f"CASE WHEN {any_in('low', t)} THEN {lit(n)} END" for n, t in K.CONTEXT_KEYWORDS.items())
    return f"""SELECT *, action IS NOT NULL AND service IS NOT NULL AS is_valid,
      CASE WHEN action IS NULL OR service IS NULL THEN 0.0 ELSE 0.5
        + CASE WHEN {label_says('action', 'low', K.CONFIDENT_ACTIONS)} THEN 0.3 ELSE 0 END
        + CASE WHEN {label_says('service', 'low', K.CONFIDENT_SERVICES)} THEN 0.2 ELSE 0 END END AS confidence
      FROM (SELECT query_id, query, low, CASE WHEN {scenario} THEN 'handle' ELSE {first_label('low', K.ACTION_KEYWORDS)} END AS action,
        {first_label('low', K.SERVICE_KEYWORDS)} AS service,
        list_filter([{contexts}], lambda x: x IS NOT NULL) AS context, {scenario} AS scenario
        FROM (SELECT query_id, query, lower(query) AS low FROM {source}))"""


# Articles made from documents, and queries made from the user turns of conversations.
TITLES = [
    "Hotel cancellation policy", "Air booking guidelines", "Car rental modification", "Handling late hotel arrival",
    "Flight no-show process", "New car booking", "Guest complaint resolution", "Escalation procedures",
    "Modify flight reservation", "Payment overview", "Refund of air tickets",
]
def _phrases() -> list[str]:
    """Questions by rule: every action with every service, scenarios and contexts, and some that have no intent."""
    frames = ("We need to {} our {}", "{} one {} by Friday", "The {} of this {} is unclear")
    verbs = [words[-1] for words in K.ACTION_KEYWORDS.values()]
    things = [words[-1] for words in K.SERVICE_KEYWORDS.values()]
    out = [frames[(n + k) % len(frames)].format(v, t) for n, v in enumerate(verbs) for k, t in enumerate(things)]
    out += [f"{p}: {things[n % len(things)]}" for n, p in enumerate(K.SCENARIO_PHRASES) if n % 3 == 0]
    out += [f"{words[0]} for the {things[n % len(things)]}, please" for n, words in enumerate(K.CONTEXT_KEYWORDS.values())]
    return [*out, "Blue or green?", "to be", "?!", f"{K.EXPLICIT_CHART_QUERY[0]} per week"]


PHRASES = _phrases()
SQL_ARTICLES = f"""(SELECT doc_id AS article_id, {str_list(TITLES)}[1 + (doc_id * 7 + n_chars) % {len(TITLES)}] || ' ' || source
    || ' ' || string_split(text, ' ')[1] AS title,
  '<p>' || text || '</p><b>See the ' || source || ' guide &amp; rules</b>' AS body,
  (n_chars * 31) % 100000 * 1000000 + doc_id AS modified FROM documents)"""
SQL_QUERIES = f"""(SELECT conv_id * 1000 + turn AS query_id, {str_list(PHRASES)}[1 + (conv_id * 5 + turn) % {len(PHRASES)}]
    || CASE WHEN conv_id % 2 = 0 THEN '' ELSE ' ' || text END AS query FROM conversations WHERE role = 'user')"""
SQL_PLAIN_BODY = strip(r"regexp_replace(regexp_replace(body, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')")
SQL_CLEAN_BODY = strip(r"regexp_replace(replace(regexp_replace(body, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '\s+', ' ', 'g')")
