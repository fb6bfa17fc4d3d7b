"""Silver tables, Gold marts and their building blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.functions import expressions as X
from eventlens.operators import dedup
from eventlens.plans import gold, silver
from registry import query
from registry import results as _results  # noqa: F401  (adds the result CTEs)
from registry.sql import big, query as q, r

EVENT_KEY = "event_id, event_date, country_code, event_group, event_root_code, cameo_label"
EVENT_REST = (
    "actor1_name, actor1_country, actor2_name, actor2_country, geo_name, "
    "is_significant"
)
SILVER_EVENTS = (
    f"{EVENT_KEY}, {EVENT_REST}, {big('num_mentions', 'num_sources')}, "
    f"{r('goldstein_scale', 'avg_tone', 'geo_lat', 'geo_long')}"
)
SILVER_MARKET = "symbol, date, is_trading_day, " + big("volume") + ", " + r(
    "open", "high", "low", "close", "daily_return", "log_return", "return_5d", "return_20d",
    "volatility_20d", "volume_zscore",
)
EVENT_MARKET = "event_date, country_code, symbol, dominant_event_group, " + big(
    "event_count", "total_mentions", "violent_count", "conflict_count", "cooperation_count"
) + ", " + r(
    "avg_goldstein", "min_goldstein", "max_goldstein", "avg_tone", "close", "daily_return",
    "log_return", "return_5d", "volatility_20d",
)
GEO = "event_date, country_code, top_event_code, " + big(
    "total_events", "conflict_events", "cooperation_events", "violent_events", "total_mentions"
) + ", " + r("avg_goldstein", "min_goldstein", "max_goldstein", "avg_tone")
MARKET_DAILY = "date, symbol, is_anomaly, " + r(
    "close", "daily_return", "log_return", "return_5d", "return_20d", "volatility_20d",
    "volume_zscore", "anomaly_score",
)
SENTIMENT = "published_date, source, most_negative_headline, most_positive_headline, " + big(
    "headline_count", "positive_count", "negative_count", "neutral_count"
) + ", " + r("avg_sentiment")
SUMMARY = "summary_date, top_conflict_country, risk_level, " + big(
    "total_global_events", "total_conflict_events", "total_violent_events",
    "market_anomaly_count", "headline_count",
) + ", " + r("avg_market_return", "vix_close", "avg_news_sentiment")


# ---- deduplication ----------------------------------------------------------------
@query(
    "dedup_events",
    q("SELECT event_id AS global_event_id, " + big("num_mentions", "num_sources")
      + ", event_date FROM silver_events", "silver_events"),
)
def _(f):
    return dedup.dedup_events(f.bronze_events).select(
        "global_event_id", "num_mentions", "num_sources", "event_date"
    )


@query("dedup_market", q(f"SELECT symbol, date, id, {big('volume')}, {r('close')} FROM dedup_market", "dedup_market"))
def _(f):
    return dedup.dedup_market(f.bronze_market).select("symbol", "date", "id", "volume", "close")


@query(
    "dedup_headlines",
    q("SELECT headline_id AS id, url, published_date FROM silver_headlines", "silver_headlines"),
)
def _(f):
    return dedup.dedup_headlines(f.bronze_headlines).select(
        "id", "url", F.to_date("published_at").alias("published_date")
    )


@query(
    "distinct_anomalies",
    q(
        f"SELECT DISTINCT symbol, event_window_start AS anomaly_date, {r('anomaly_score')} "
        "FROM analysis_results WHERE is_anomaly",
        "analysis_results",
    ),
)
def _(f):
    return dedup.distinct_anomalies(f.results)


# ---- Silver -----------------------------------------------------------------------
@query(
    "classify_events",
    q("SELECT event_group, cameo_label, event_root_code, count(*) AS n FROM be GROUP BY ALL", "be"),
)
def _(f):
    return (
        silver.classify_events(f.bronze_events)
        .groupBy("event_group", "cameo_label", "event_root_code")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "fips_to_iso",
    q("SELECT action_geo_country_code, country_code, count(*) AS n FROM be GROUP BY ALL", "be"),
)
def _(f):
    return f.events.groupBy("action_geo_country_code", "country_code").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "normalize_source",
    q(
        "SELECT h.id, coalesce(s.canonical, lower(h.source)) AS source FROM b_news_headlines h "
        "LEFT JOIN source_map s ON lower(h.source) = s.raw",
        "b_news_headlines source_map",
    ),
)
def _(f):
    return silver.normalize_source(f.bronze_headlines).select("id", "source")


@query("silver_events", q(f"SELECT {SILVER_EVENTS} FROM silver_events", "silver_events"))
def _(f):
    return f.silver_events


@query(
    "silver_market_returns",
    q(f"SELECT symbol, date, {r('close', 'daily_return', 'log_return')} FROM silver_returns", "silver_returns"),
)
def _(f):
    return silver.silver_market_returns(dedup.dedup_market(f.bronze_market)).select(
        "symbol", "date", "close", "daily_return", "log_return"
    )


@query(
    "silver_market_windows",
    q(
        "SELECT symbol, date, "
        + r("return_5d", "return_20d", "volatility_20d", "volume_zscore")
        + " FROM silver_market",
        "silver_market",
    ),
)
def _(f):
    returns = silver.silver_market_returns(dedup.dedup_market(f.bronze_market))
    return silver.silver_market_windows(returns).select(
        "symbol", "date", "return_5d", "return_20d", "volatility_20d", "volume_zscore"
    )


@query("silver_market", q(f"SELECT {SILVER_MARKET} FROM silver_market", "silver_market"))
def _(f):
    return f.silver_market


@query(
    "silver_headlines",
    q("SELECT headline_id, source, headline, url, published_date, sentiment_label, "
      + r("sentiment_score") + " FROM silver_headlines", "silver_headlines"),
)
def _(f):
    return f.silver_headlines


@query(
    "event_country_day_agg",
    q(
        "SELECT event_date, country_code, "
        + big("event_count", "total_mentions", "violent_count", "conflict_count", "cooperation_count")
        + ", " + r("avg_goldstein", "min_goldstein", "max_goldstein", "avg_tone")
        + " FROM events_agg",
        "events_agg",
    ),
)
def _(f):
    return silver.event_country_day_agg(f.silver_events)


@query("dominant_event_group", q("SELECT event_date, country_code, dominant_event_group FROM dominant", "dominant"))
def _(f):
    return silver.dominant_event_group(f.silver_events)


@query("silver_event_market", q(f"SELECT {EVENT_MARKET} FROM silver_event_market", "silver_event_market"))
def _(f):
    return f.silver_event_market


@query(
    "link_event_market",
    q(
        "SELECT symbol, dominant_event_group, count(*) AS n_links, "
        + big("sum(event_count) AS events") + ", " + r("avg(log_return) AS mean_log_return")
        + " FROM silver_event_market GROUP BY symbol, dominant_event_group",
        "silver_event_market",
    ),
)
def _(f):
    links = silver.link_event_market(
        silver.event_market_features(f.silver_events), f.silver_market
    )
    return links.groupBy("symbol", "dominant_event_group").agg(
        F.count(F.lit(1)).alias("n_links"),
        F.sum("event_count").alias("events"),
        F.avg("log_return").alias("mean_log_return"),
    )


@query(
    "staging_views",
    q(
        "SELECT 'stg_events' AS view_name, count(*) AS n, max(event_date) AS last_date FROM silver_events "
        "UNION ALL SELECT 'stg_market', count(*), max(date) FROM silver_market "
        "UNION ALL SELECT 'stg_headlines', count(*), max(published_date) FROM silver_headlines "
        "UNION ALL SELECT 'stg_event_market', count(*), max(event_date) FROM silver_event_market",
        "silver_events silver_market silver_headlines silver_event_market",
    ),
)
def _(f):
    views = silver.staging_views(
        {
            "silver_events": f.silver_events,
            "silver_market": f.silver_market,
            "silver_headlines": f.silver_headlines,
            "silver_event_market": f.silver_event_market,
        }
    )
    day = {"stg_market": "date", "stg_headlines": "published_date"}
    parts = [
        df.agg(F.count(F.lit(1)).alias("n"), F.max(day.get(v, "event_date")).alias("last_date"))
        .withColumn("view_name", F.lit(v))
        for v, df in views.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- Gold -------------------------------------------------------------------------
@query("gold_geopolitical_daily", q(f"SELECT {GEO} FROM gold_geo", "gold_geo"))
def _(f):
    return f.gold_geo


@query("flag_market_anomalies", q(
    f"SELECT symbol, date, is_anomaly, {r('anomaly_score')} FROM gold_market", "gold_market"))
def _(f):
    return gold.flag_market_anomalies(f.silver_market, f.results).select(
        "symbol", "date", "is_anomaly", "anomaly_score"
    )


@query("gold_market_daily", q(f"SELECT {MARKET_DAILY} FROM gold_market", "gold_market"))
def _(f):
    return f.gold_market


@query("gold_sentiment_daily", q(f"SELECT {SENTIMENT} FROM gold_sentiment", "gold_sentiment"))
def _(f):
    return f.gold_sentiment


@query(
    "union_all_sources",
    q("SELECT source, " + big("sum(headline_count) AS headlines", "count(*) AS days")
      + " FROM gold_sentiment GROUP BY source", "gold_sentiment"),
)
def _(f):
    return f.gold_sentiment.groupBy("source").agg(
        F.sum("headline_count").alias("headlines"), F.count(F.lit(1)).alias("days")
    )


@query(
    "gold_economic_snapshot",
    q("SELECT date, series_id, series_name, "
      + r("value", "previous_value", "change", "change_pct") + " FROM gold_econ", "gold_econ"),
)
def _(f):
    return gold.gold_economic_snapshot(f.indicators)


@query("gold_daily_summary", q(f"SELECT {SUMMARY} FROM gold_summary", "gold_summary"))
def _(f):
    return f.gold_summary


@query(
    "summary_full_outer",
    q(
        "SELECT summary_date, (avg_market_return IS NULL AND vix_close IS NULL) AS no_market, "
        "avg_news_sentiment IS NULL AS no_sentiment, "
        + big("total_global_events", "headline_count") + " FROM gold_summary",
        "gold_summary",
    ),
)
def _(f):
    return f.gold_summary.select(
        "summary_date",
        (F.col("avg_market_return").isNull() & F.col("vix_close").isNull()).alias("no_market"),
        F.col("avg_news_sentiment").isNull().alias("no_sentiment"),
        "total_global_events",
        "headline_count",
    )


@query(
    "risk_level",
    q("SELECT risk_level, count(*) AS days, " + big("sum(total_conflict_events) AS conflict_events")
      + " FROM gold_summary GROUP BY risk_level", "gold_summary"),
)
def _(f):
    level = X.risk_level(
        F.col("total_conflict_events"), F.col("avg_news_sentiment"), F.col("vix_close")
    )
    return f.gold_summary.groupBy(level.alias("risk_level")).agg(
        F.count(F.lit(1)).alias("days"), F.sum("total_conflict_events").alias("conflict_events")
    )


# ---- scalar expressions over the event table ----------------------------------------
@query(
    "cameo_code_norm",
    q(
        "SELECT event_root_code, substr(lpad(CAST(CAST(event_root_code AS INT) AS VARCHAR), 2, '0'), 1, 2) "
        "AS code, count(*) AS n FROM b_events GROUP BY ALL",
        "b_events",
    ),
)
def _(f):
    short = F.col("event_root_code").cast("int").cast("string")
    return f.bronze_events.groupBy(
        "event_root_code", X.cameo_code_norm(short).alias("code")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "event_category",
    q("SELECT cameo_label AS category, event_group, count(*) AS n FROM be GROUP BY ALL", "be"),
)
def _(f):
    code = "event_root_code"
    return f.bronze_events.groupBy(
        X.event_category(code).alias("category"), X.event_group(code).alias("event_group")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "is_significant",
    q("SELECT is_significant, count(*) AS n FROM silver_events GROUP BY ALL", "silver_events"),
)
def _(f):
    return f.silver_events.groupBy("is_significant").agg(F.count(F.lit(1)).alias("n"))


