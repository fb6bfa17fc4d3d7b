"""Headline queries and sentiment summaries (Bronze shape)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions import expressions as X


def _newest(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("published_at").desc_nulls_first(), "id")


def headlines_by_date_range(
    headlines: DataFrame, start=None, end=None, source: str | None = None
) -> DataFrame:
    """Days are compared as a timestamp range, which reaches the scan."""
    h = headlines.filter(X.timestamp_in_days("published_at", start, end))
    return _newest(h if source is None else h.filter(F.col("source") == source))


def headline_sentiment(
    headlines: DataFrame,
    start=None,
    end=None,
    source: str | None = None,
    sentiment: str | None = None,
    limit: int | None = 20,
) -> DataFrame:
    h = headlines_by_date_range(headlines, start, end, source)
    if sentiment is not None:
        h = h.filter(F.col("sentiment_label") == sentiment)
    return (h if limit is None else h.limit(limit)).select(
        "headline", "source", "published_at", "sentiment_score", "sentiment_label"
    )


def _scored(headlines: DataFrame, start, end, source: str | None) -> DataFrame:
    h = headlines.filter(
        X.timestamp_in_days("published_at", start, end) & F.col("sentiment_score").isNotNull()
    )
    return h if source is None else h.filter(F.col("source") == source)


def sentiment_trend(headlines: DataFrame, start=None, end=None, source: str | None = None) -> DataFrame:
    """Mean score and count per day."""
    return (
        _scored(headlines, start, end, source)
        .groupBy(F.to_date("published_at").alias("date"))
        .agg(
            X.to_decimals(F.avg("sentiment_score"), 4).alias("avg_sentiment"),
            F.count(F.lit(1)).alias("headline_count"),
        )
        .orderBy("date")
    )


def sentiment_summary(
    headlines: DataFrame, start=None, end=None, source: str | None = None
) -> DataFrame:
    """One row: totals, spread, label counts and the overall mood."""
    label, score = F.col("sentiment_label"), F.col("sentiment_score")
    return (
        _scored(headlines, start, end, source)
        .agg(
            F.count(F.lit(1)).alias("total_headlines"),
            F.avg(score).alias("_avg"),
            X.to_decimals(F.min(score), 4).alias("min_score"),
            X.to_decimals(F.max(score), 4).alias("max_score"),
            *[
                X.count_if(label == name).alias(name)
                for name in ("positive", "negative", "neutral")
            ],
        )
        .withColumns(
            {
                "overall_mood": X.mood(F.coalesce("_avg", F.lit(0.0))),
                "avg_sentiment_score": X.to_decimals("_avg", 4),
            }
        )
        .drop("_avg")
    )


def headline_mood(headlines: DataFrame) -> DataFrame:
    """Mean of the scored rows and its label."""
    return headlines.agg(F.avg("sentiment_score").alias("mean_score")).withColumn(
        "mood", X.mood(F.coalesce("mean_score", F.lit(0.0)))
    )
