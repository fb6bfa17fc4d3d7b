"""Data-quality checks. Each returns (check, table, column, failures); none blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens import reference as ref
from eventlens.functions import expressions as X

GROUPS = [*ref.EVENT_GROUPS, "other"]
SOURCES = ["reuters", "ap", "bbc", "aljazeera", "all"]
LEVELS = ["low", "elevated", "high"]


def _unfold(counts: DataFrame, check: str, table: str, columns: list[str]) -> DataFrame:
    """One aggregated row of counts -> one row per column."""
    return counts.unpivot([], columns, "column", "failures").select(
        F.lit(check).alias("check"), F.lit(table).alias("table"), "column", "failures"
    )


def dq_not_null(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Null rows of every listed column in one scan."""
    return _unfold(
        df.agg(*[X.count_if(F.col(c).isNull()).alias(c) for c in columns]), "not_null", table, columns
    )


def dq_unique(df: DataFrame, table: str, column: str) -> DataFrame:
    """Values that occur more than once."""
    twice = df.filter(F.col(column).isNotNull()).groupBy(column).count().filter("count > 1")
    return _unfold(twice.agg(F.count(F.lit(1)).alias(column)), "unique", table, [column])


def dq_accepted_values(df: DataFrame, table: str, column: str, values: list[str]) -> DataFrame:
    """Distinct values outside the list."""
    other = df.filter(F.col(column).isNotNull() & ~F.col(column).isin(values))
    return _unfold(
        other.agg(F.countDistinct(column).alias(column)), "accepted_values", table, [column]
    )


def dq_condition(df: DataFrame, check: str, table: str, column: str, failing) -> DataFrame:
    return _unfold(df.agg(X.count_if(failing).alias(column)), check, table, [column])


def dq_no_null_dates(summary: DataFrame) -> DataFrame:
    c = F.col("summary_date")
    return dq_condition(summary, "no_null_dates", "gold_daily_summary", "summary_date", c.isNull())


def dq_non_negative_mentions(geo: DataFrame) -> DataFrame:
    c = F.col("total_mentions")
    return dq_condition(
        geo, "non_negative_mentions", "gold_geopolitical_daily", "total_mentions", c < 0
    )


def dq_valid_risk(summary: DataFrame) -> DataFrame:
    c = F.col("risk_level")
    return dq_condition(
        summary, "valid_risk", "gold_daily_summary", "risk_level", ~c.isin(LEVELS)
    )


NOT_NULL = {
    "silver_events": ["event_id", "event_date", "event_group", "event_root_code"],
    "silver_market": ["symbol", "date", "close"],
    "silver_headlines": ["headline_id", "published_date", "sentiment_score"],
    "silver_event_market": ["event_date", "symbol"],
    "gold_geopolitical_daily": ["event_date", "country_code", "total_events"],
    "gold_market_daily": ["date", "symbol", "close"],
    "gold_sentiment_daily": ["published_date", "source", "headline_count"],
    "gold_economic_snapshot": ["date", "series_id", "value"],
    "gold_daily_summary": ["summary_date", "risk_level"],
}
UNIQUE = {
    "silver_events": "event_id",
    "silver_headlines": "headline_id",
    "gold_daily_summary": "summary_date",
}
ACCEPTED = [
    ("silver_events", "event_group", GROUPS),
    ("silver_event_market", "dominant_event_group", GROUPS),
    ("gold_sentiment_daily", "source", SOURCES),
    ("gold_economic_snapshot", "series_id", list(ref.SERIES_NAMES)),
    ("gold_daily_summary", "risk_level", LEVELS),
]


#: Single conditions: (check, table, column, what fails).
CONDITIONS = [
    ("no_null_dates", "gold_daily_summary", "summary_date", lambda c: c.isNull()),
    ("valid_risk", "gold_daily_summary", "risk_level", lambda c: ~c.isin(LEVELS)),
    ("non_negative_mentions", "gold_geopolitical_daily", "total_mentions", lambda c: c < 0),
]


def _in_one_pass(df: DataFrame, table: str) -> DataFrame:
    """All checks of a table that need no grouping, as one aggregation."""
    failing = [("not_null", c, X.count_if(F.col(c).isNull())) for c in NOT_NULL.get(table, [])]
    failing += [
        ("accepted_values", c, F.countDistinct(F.when(~F.col(c).isin(values), F.col(c))))
        for t, c, values in ACCEPTED if t == table
    ]
    failing += [
        (check, c, X.count_if(fails(F.col(c)))) for check, t, c, fails in CONDITIONS if t == table
    ]
    names = [f"{check} {c}" for check, c, _ in failing]
    counts = df.agg(*[n.alias(name) for name, (_, _, n) in zip(names, failing, strict=True)])
    name = F.split("name", " ")
    return counts.unpivot([], names, "name", "failures").select(
        name[0].alias("check"), F.lit(table).alias("table"), name[1].alias("column"), "failures"
    )


def dq_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Every check whose table is given, with ``passed``.

    Each table is read once, and once more where a column has to be unique.
    """
    checked = {*NOT_NULL, *(t for t, _, _ in ACCEPTED), *(t for _, t, _, _ in CONDITIONS)}
    parts = [_in_one_pass(tables[t], t) for t in sorted(checked) if t in tables]
    parts += [dq_unique(tables[t], t, c) for t, c in UNIQUE.items() if t in tables]
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("failures") == 0)
