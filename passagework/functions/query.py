"""Query understanding: expansion, type, intent, flags; all plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.functions import constants as K
from passagework.functions.text import contains_any, empty_strings, first_label, let


def _string_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else empty_strings()


def expand_query(text: Column) -> Column:
    """Appends related terms, distinct and in alphabetical order."""
    both = F.struct(text.alias("text"), F.lower(text).alias("low"))
    return let(both, lambda x: _expanded(x["text"], x["low"]))


def _expanded(text: Column, low: Column) -> Column:
    found = []
    for triggers, choices in K.EXPANSIONS:
        terms = empty_strings()
        for words, added in reversed(choices):
            terms = F.when(contains_any(low, words), _string_array(added)).otherwise(terms)
        found.append(F.when(contains_any(low, triggers), terms).otherwise(empty_strings()))
    return let(
        F.array_sort(F.array_distinct(F.concat(*found))),
        lambda t: F.when(F.size(t) > 0, F.concat(text, F.lit(" "), F.array_join(t, " "))).otherwise(text),
    )


def query_type(text: Column) -> Column:
    return let(F.lower(text), lambda low: F.coalesce(first_label(low, K.QUERY_TYPES), F.lit("general")))


def intent_action(low: Column) -> Column:
    return F.when(contains_any(low, K.SCENARIO_PHRASES), "handle").otherwise(first_label(low, K.ACTION_KEYWORDS))


def intent_service(low: Column) -> Column:
    return first_label(low, K.SERVICE_KEYWORDS)


def intent_context(low: Column) -> Column:
    labels = [F.when(contains_any(low, words), F.lit(label)) for label, words in K.CONTEXT_KEYWORDS.items()]
    return F.filter(F.array(*labels), lambda x: x.isNotNull())


def _says(low: Column, label: Column, groups: dict[str, list[str]]) -> Column:
    """Whether the text has one of the words of its own label."""
    out = F.lit(False)
    for name, terms in groups.items():
        out = F.when(label == name, contains_any(low, terms)).otherwise(out)
    return out


def intent_confidence(low: Column, action: Column, service: Column) -> Column:
    score = (
        F.lit(0.5)
        + F.when(_says(low, action, K.CONFIDENT_ACTIONS), 0.3).otherwise(0.0)
        + F.when(_says(low, service, K.CONFIDENT_SERVICES), 0.2).otherwise(0.0)
    )
    return F.when(action.isNull() | service.isNull(), 0.0).otherwise(F.least(F.lit(1.0), score))


def extract_intent(text: Column) -> Column:
    """Struct action, service, context, is_valid, confidence, scenario_detected.

    The lower-case text and the labels are bound once; repeating their
    expressions per use would outgrow the generated code.
    """

    def labelled(low, found):
        action, service = found["action"], found["service"]
        return F.struct(
            action.alias("action"),
            service.alias("service"),
            intent_context(low).alias("context"),
            (action.isNotNull() & service.isNotNull()).alias("is_valid"),
            intent_confidence(low, action, service).alias("confidence"),
            contains_any(low, K.SCENARIO_PHRASES).alias("scenario_detected"),
        )

    return let(
        F.lower(text),
        lambda low: let(
            F.struct(intent_action(low).alias("action"), intent_service(low).alias("service")),
            lambda found: labelled(low, found),
        ),
    )


def chart_flags(text: Column) -> Column:
    """Struct chart, performance, explicit_chart."""
    return let(
        F.lower(text),
        lambda low: F.struct(
            contains_any(low, K.CHART_QUERY).alias("chart"),
            contains_any(low, K.PERFORMANCE_QUERY).alias("performance"),
            contains_any(low, K.EXPLICIT_CHART_QUERY).alias("explicit_chart"),
        ),
    )
