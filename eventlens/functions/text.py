"""Text expressions and the default offline scorers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens import reference as ref
from eventlens.functions import expressions as X

# Default lexicon of the offline scorer; a model is plugged in through ``scorer``.
POSITIVE_WORDS = [
    "agree", "agreement", "aid", "boost", "calm", "ceasefire", "cooperation", "deal", "gain",
    "gains", "growth", "improve", "peace", "progress", "rally", "recovery", "rise", "stable",
    "success", "support", "surge", "truce",
]
NEGATIVE_WORDS = [
    "attack", "attacks", "bomb", "clash", "conflict", "crash", "crisis", "decline", "fall",
    "fear", "fight", "invasion", "kill", "killed", "loss", "protest", "recession", "sanctions",
    "slump", "strike", "threat", "violence", "war",
]


def _named(*columns: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit("Unknown"))


def event_text(
    geo_name: str = "action_geo_name", geo_code: str = "action_geo_country_code"
) -> Column:
    """Sentence that stands for an event: actors, place, tone bucket, large coverage."""
    g, n = F.col("goldstein_scale"), F.col("num_mentions")
    tone = F.when(g > 2, "cooperative").when(g < -2, "conflictual").otherwise("neutral")
    place = F.coalesce(F.nullif(F.col(geo_name), F.lit("")), F.nullif(F.col(geo_code), F.lit("")))
    return F.concat_ws(
        ". ",
        F.concat(
            _named("actor1_name", "actor1_code"),
            F.lit(" action against "),
            _named("actor2_name", "actor2_code"),
        ),
        F.concat(F.lit("in "), place),
        F.when(g.isNotNull(), F.format_string("(%s, Goldstein: %.1f)", tone, g)),
        F.when(n > 10, F.concat(F.lit("Mentions: "), n.cast("string"))),
    )


def doc_event_summary() -> Column:
    """'actor1 → actor2 in place'."""
    return F.concat(
        _named("actor1_name", "actor1_code"),
        F.lit(" → "),
        _named("actor2_name", "actor2_code"),
        F.lit(" in "),
        _named("action_geo_name", "action_geo_country_code"),
    )


def query_countries(text: str | Column) -> Column:
    """Sorted distinct countries whose keyword occurs in the text, which is put into lower case once."""

    def named(low: Column) -> Column:
        hits = F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(c)) for w, c in ref.COUNTRY_WORDS.items()])
        return F.array_sort(F.array_distinct(F.array_compact(hits)))

    # Evaluated without generated code, equal expressions are computed again for each keyword; a lambda's argument is not.
    return F.transform(F.array(F.lower(X.col(text))), named)[0]


def query_symbols(countries: str | Column) -> Column:
    """Sorted assets of the countries plus the four default symbols."""
    from eventlens.operators.market import symbols_of_countries

    linked = symbols_of_countries(X.col(countries), ref.COUNTRY_ASSETS)
    return F.array_sort(
        F.array_union(linked, F.array(*[F.lit(s) for s in ref.DEFAULT_SYMBOLS]))
    )


def words(text: str | Column) -> Column:
    return F.filter(F.split(F.lower(X.col(text)), "[^a-z]+"), lambda w: w != "")


def lexicon_sentiment(text: str | Column) -> tuple[Column, Column]:
    """(label, confidence) from counts of positive and negative words."""
    w = words(text)

    def count(names: list[str]) -> Column:
        return F.size(F.filter(w, lambda x: x.isin(names)))

    good, bad = count(POSITIVE_WORDS), count(NEGATIVE_WORDS)
    label = F.when(good > bad, "positive").when(good < bad, "negative").otherwise("neutral")
    confidence = F.coalesce(
        X.safe_ratio(F.abs(good - bad).cast("double"), (good + bad).cast("double")), F.lit(0.0)
    )
    return label, confidence
