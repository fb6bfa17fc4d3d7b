"""Everything a free-text question needs, for a batch of questions at once."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens import reference as ref
from eventlens.functions import expressions as X
from eventlens.functions import text as txt
from eventlens.operators import anomalies, correlation, dedup, events, news, patterns, retrieval


def questions_scope(questions: DataFrame, symbols: int | None = None) -> DataFrame:
    """(query_id, query) -> countries named and symbols to look at.

    Without a named country the global symbols apply. ``symbols`` bounds a question's
    symbols, in their order; all of them by default. The texts are dealt over all tasks before they are
    searched, however few files they come from.
    """
    tasks = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    world = F.array(*[F.lit(s) for s in ref.GLOBAL_SYMBOLS])
    named = questions.repartition(tasks, "query_id").withColumn("countries", txt.query_countries("query"))
    listed = F.when(F.size("countries") > 0, txt.query_symbols("countries")).otherwise(world)
    return named.withColumn("symbols", listed if symbols is None else F.slice(listed, 1, symbols))


def _first(rows: DataFrame, group: str, order: list, n: int | None) -> DataFrame:
    """The first ``n`` rows of each group, or all; ranked before any question is joined."""
    if n is None:
        return rows
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def _in_scope(scope: DataFrame, column: str, name: str) -> DataFrame:
    """The countries or symbols of all questions, each once: a part of two short fixed lists."""
    # A plain ``explode`` would search all texts once more, to leave out empty lists first.
    return scope.select(F.explode_outer(column).alias(name)).filter(F.col(name).isNotNull()).distinct()


def for_questions(section: DataFrame, scope: DataFrame) -> DataFrame:
    """A section's rows beside each question that they are about, for a reader of single questions."""
    key = "country" if "country" in section.columns else "symbol"
    column = "countries" if key == "country" else "symbols"
    return scope.select("query_id", F.explode(column).alias(key)).join(section, key)


def question_context(
    questions: DataFrame, headlines: DataFrame, bronze_events: DataFrame, as_of, days_back: int = 30, limit: int = 10,
    load: Callable | None = None,
) -> DataFrame:
    """``query_id, context``: the documents nearest to each question among the last ``days_back`` days.

    A question's vector is a row like any other and comes from the encoder of the documents
    (``load``, see ``embed_text``), which also embeds documents without a stored vector; so do all questions
    and days together. A question that nothing is near to has an empty context.
    """
    since = days_before(as_of, days_back)

    def vectors(rows: DataFrame, text) -> DataFrame:
        return retrieval.embed_text(rows.withColumn("_text", text), "_text", load).drop("_text")

    def documents(rows: DataFrame, text) -> DataFrame:
        if "embedding" not in rows.columns:
            return vectors(rows, text)
        known = F.col("embedding").isNotNull()
        return rows.filter(known).unionByName(vectors(rows.filter(~known).drop("embedding"), text))

    tasks = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = questions.select("query_id", "query").repartition(tasks, "query_id")
    heads = headlines.filter(X.timestamp_in_days("published_at", since, as_of))
    happened = dedup.dedup_events(bronze_events.filter(X.between_dates("event_date", since, as_of)))
    found = retrieval.search_all(
        documents(heads, F.col("headline")), documents(happened, txt.event_text()),
        vectors(asked, F.col("query")).select("query_id", F.col("embedding").alias("vector")), limit, since, as_of,
    )
    context = retrieval.format_context(found, asked.select("query_id", F.col("query").alias("title")))
    return asked.select("query_id").join(context, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))


def query_dossier(
    questions: DataFrame,
    market: DataFrame,
    bronze_events: DataFrame,
    headlines: DataFrame,
    as_of,
    start="2016-01-01",
    symbols: int | None = None,
    analysed_symbols: int | None = None,
    events_per_country: int | None = None,
    prices_per_symbol: int | None = None,
    countries: int | None = None,
    headline_count: int | None = None,
    load: Callable | None = None,
) -> dict[str, DataFrame]:
    """Sections for a batch of questions.

    ``scope`` has each question's countries and symbols, ``context`` the documents nearest to it as a
    text (``question_context``). The other sections are kept once, however many questions
    are about them: ``events`` by country, ``market``, ``correlations``, ``patterns`` and ``anomalies`` by
    symbol, for the countries and symbols in scope; ``event_summary``, ``headlines`` and ``sentiment`` for
    all. ``for_questions`` joins a section to the questions. So the output grows with the questions and
    the data, not with their product. Sections are cut if a bound is given; none is by default.
    """
    scope = questions_scope(questions, symbols)
    end = F.lit(as_of).cast("date")
    month, week, quarter = (F.date_sub(end, n) for n in (30, 7, 90))
    recent = bronze_events.filter(
        F.col("event_date").between(month, end) & (F.col("num_mentions") >= 200)
    )
    by_country = recent.withColumn("country", F.explode(patterns.event_countries())).join(
        _in_scope(scope, "countries", "country"), "country", "left_semi"
    )
    top_events = _first(by_country, "country", events.newest_first(recent), events_per_country).select(
        "country", *events.BRIEF
    )
    summary = events.events_by_country(
        bronze_events.filter(F.col("event_date").between(month, end)), limit=countries
    ).select("country_code", "count")

    wanted = _in_scope(scope, "symbols", "symbol")
    analysed = _in_scope(
        scope if analysed_symbols is None else scope.withColumn("symbols", F.slice("symbols", 1, analysed_symbols)),
        "symbols", "symbol",
    )
    prices = _first(
        market.filter(F.col("date").between(week, end)).join(wanted, "symbol", "left_semi"),
        "symbol", [F.col("date").desc()], prices_per_symbol,
    ).select("symbol", "date", "open", "high", "low", "close", "volume", "daily_return")
    merged = correlation.merged_daily(market, bronze_events, start, as_of)
    flagged = anomalies.detect_anomalies(
        market, bronze_events, days_before(as_of, 90), as_of
    ).filter(F.col("date").between(quarter, end))

    def significant(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("p_value") < 0.05).join(analysed, "symbol", "left_semi")

    return {
        "scope": scope,
        "context": question_context(questions, headlines, bronze_events, as_of, load=load),
        "events": top_events,
        "event_summary": summary,
        "market": prices,
        "headlines": news.headline_sentiment(
            headlines.filter(F.to_date("published_at").between(week, end)), limit=headline_count
        ),
        "sentiment": news.sentiment_summary(
            headlines.filter(F.to_date("published_at").between(week, end))
        ),
        "correlations": significant(correlation.correlations(merged)),
        "patterns": significant(patterns.all_patterns(market, bronze_events, start=start, end=as_of)),
        "anomalies": flagged.join(analysed, "symbol", "left_semi"),
    }


def days_before(as_of, days_back: int):
    """Plain date ``days_back`` days before ``as_of``."""
    day = dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    return day - dt.timedelta(days=days_back)
