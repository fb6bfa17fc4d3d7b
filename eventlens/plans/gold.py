"""Silver -> Gold marts. Each function recomputes every date of its input; the caller
decides which dates to feed (see ``plans.refresh``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions import expressions as X
from eventlens.operators import dedup
from eventlens.plans import silver


def gold_geopolitical_daily(events: DataFrame) -> DataFrame:
    """One row per (date, country); modal root code, smallest code on ties."""
    counts = silver.country_day_counts(events)
    rolled = silver.country_day_rollup(
        counts,
        top_event_code=F.min_by(
            "event_root_code", F.struct((-F.col("n")).alias("n"), "event_root_code")
        ),
    )
    return rolled.select(
        "event_date",
        "country_code",
        F.col("event_count").alias("total_events"),
        F.col("conflict_count").alias("conflict_events"),
        F.col("cooperation_count").alias("cooperation_events"),
        F.col("violent_count").alias("violent_events"),
        "avg_goldstein",
        "min_goldstein",
        "max_goldstein",
        "total_mentions",
        "avg_tone",
        "top_event_code",
    )


def flag_market_anomalies(market: DataFrame, results: DataFrame) -> DataFrame:
    """Left join of the anomaly flag; false where none."""
    return market.join(dedup.anomaly_flags(results), ["symbol", "date"], "left").withColumn(
        "is_anomaly", F.coalesce("is_anomaly", F.lit(False))
    )


def gold_market_daily(market: DataFrame, results: DataFrame) -> DataFrame:
    return flag_market_anomalies(market, results).select(
        "date",
        "symbol",
        "close",
        "daily_return",
        "log_return",
        "return_5d",
        "return_20d",
        "volatility_20d",
        "volume_zscore",
        "is_anomaly",
        "anomaly_score",
    )


def gold_sentiment_daily(headlines: DataFrame) -> DataFrame:
    """Per (date, source) plus the source 'all', from one pass over the headlines."""
    score, hid, label = F.col("sentiment_score"), F.col("headline_id"), F.col("sentiment_label")
    return (
        headlines.groupingSets(
            [["published_date", "source"], ["published_date"]], "published_date", "source"
        )
        .agg(
            F.grouping("source").alias("_total"),
            F.count(F.lit(1)).alias("headline_count"),
            F.avg(score).alias("avg_sentiment"),
            X.count_if(label == "positive").alias("positive_count"),
            X.count_if(label == "negative").alias("negative_count"),
            X.count_if(label == "neutral").alias("neutral_count"),
            F.min_by("headline", F.struct(score, hid)).alias("most_negative_headline"),
            F.max_by("headline", F.struct(score, -hid)).alias("most_positive_headline"),
        )
        .withColumn("source", F.when(F.col("_total") == 1, "all").otherwise(F.col("source")))
        .drop("_total")
    )


def gold_economic_snapshot(indicators: DataFrame) -> DataFrame:
    """Value, previous value and change; percent change of the absolute previous."""
    w = Window.partitionBy("series_id").orderBy("date")
    value, prev = F.col("value"), F.col("previous_value")
    return (
        indicators.select("date", "series_id", "series_name", "value")
        .withColumn("previous_value", F.lag("value").over(w))
        .withColumn("change", value - prev)
        .withColumn("change_pct", X.pct_of_abs(value, prev))
    )


def gold_daily_summary(geo: DataFrame, market: DataFrame, sentiment: DataFrame) -> DataFrame:
    """One row per date over the three daily marts, with the composite risk level."""
    g = geo.groupBy(F.col("event_date").alias("summary_date")).agg(
        F.sum("total_events").alias("total_global_events"),
        F.sum("conflict_events").alias("total_conflict_events"),
        F.sum("violent_events").alias("total_violent_events"),
        F.min_by("country_code", F.struct(-F.col("conflict_events"), "country_code")).alias(
            "top_conflict_country"
        ),
    )
    m = market.groupBy(F.col("date").alias("summary_date")).agg(
        F.avg("daily_return").alias("avg_market_return"),
        F.max(F.when(F.col("symbol") == "^VIX", F.col("close"))).alias("vix_close"),
        X.count_if(F.col("is_anomaly")).alias("market_anomaly_count"),
    )
    s = sentiment.filter(F.col("source") == "all").select(
        F.col("published_date").alias("summary_date"),
        F.col("avg_sentiment").alias("avg_news_sentiment"),
        "headline_count",
    )
    joined = g.join(m, "summary_date", "full_outer").join(s, "summary_date", "full_outer")

    def zero(c: str):
        return F.coalesce(c, F.lit(0)).alias(c)

    return joined.select(
        "summary_date",
        zero("total_global_events"),
        zero("total_conflict_events"),
        zero("total_violent_events"),
        "top_conflict_country",
        "avg_market_return",
        "vix_close",
        zero("market_anomaly_count"),
        "avg_news_sentiment",
        zero("headline_count"),
        X.risk_level(
            F.col("total_conflict_events"), F.col("avg_news_sentiment"), F.col("vix_close")
        ).alias("risk_level"),
    )


def stamped(df: DataFrame) -> DataFrame:
    """Add the build time that every stored mart carries."""
    return df.withColumn("computed_at", F.current_timestamp())
