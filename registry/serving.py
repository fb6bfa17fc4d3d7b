"""Row-returning and summary queries over events, prices, news, series and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens import reference as ref
from eventlens.functions import expressions as X
from eventlens.operators import events, market, news, results, series
from registry import query
from registry.sql import big, codes, cte, query as q, r

ALL = ("1995-01-01", "2001-12-31")
IN_SPAN = "BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'"
EVENT = (
    "id, event_date, event_root_code, source_url, country_code, actor1_country_code, "
    "actor2_country_code, " + big("num_mentions") + ", " + r("goldstein_scale", "avg_tone")
)
_EVENT_COLS = [
    "id", "event_date", "event_root_code", "source_url", "country_code", "actor1_country_code",
    "actor2_country_code", "num_mentions", "goldstein_scale", "avg_tone",
]
NEWEST = "ORDER BY event_date DESC, num_mentions DESC, id, source_url"


def _any_country(code: str) -> str:
    return f"(actor1_country_code = '{code}' OR actor2_country_code = '{code}' OR country_code = '{code}')"


# ---- events ------------------------------------------------------------------------------
@query(
    "events_by_date_range",
    q(f"SELECT {EVENT} FROM be WHERE event_date {IN_SPAN} AND {_any_country('RUS')} "
      "AND abs(goldstein_scale) >= 4 AND num_mentions >= 500", "be"),
)
def _(f):
    return events.events_by_date_range(
        f.events, *ALL, country="RUS", min_goldstein=4, min_mentions=500
    ).select(*_EVENT_COLS)


@query(
    "significant_events",
    q(f"SELECT {EVENT} FROM be WHERE event_date {IN_SPAN} AND abs(goldstein_scale) >= 3 AND num_mentions >= 10", "be"),
)
def _(f):
    return events.significant_events(f.events, *ALL).select(*_EVENT_COLS)


@query(
    "conflict_events",
    q(f"SELECT {EVENT} FROM be WHERE event_date {IN_SPAN} AND event_root_code IN ('18', '19', '20')", "be"),
)
def _(f):
    return events.conflict_events(f.events, *ALL).select(*_EVENT_COLS)


@query(
    "events_for_country",
    q(f"SELECT {EVENT} FROM be WHERE event_date BETWEEN DATE '2001-06-01' AND DATE '2001-07-01' "
      f"AND {_any_country('CHN')}", "be"),
)
def _(f):
    return events.events_for_country(f.events, "CHN", as_of="2001-07-01").select(*_EVENT_COLS)


@query(
    "list_events",
    q(f"SELECT {EVENT} FROM be WHERE event_date {IN_SPAN} AND event_root_code IN {codes(ref.VIOLENT_ROOTS)} "
      f"AND num_mentions >= 10 {NEWEST} LIMIT 100 OFFSET 50", "be"),
)
def _(f):
    return events.list_events(
        f.events, *ALL, event_group="violent_conflict", min_mentions=10, limit=100, offset=50
    ).select(*_EVENT_COLS)


@query("event_by_id", q(f"SELECT {EVENT} FROM be WHERE id = 801", "be"))
def _(f):
    return events.event_by_id(f.events, 801).select(*_EVENT_COLS)


@query(
    "recent_events_brief",
    q("SELECT event_date, actor1_name, actor1_country_code, actor2_name, actor2_country_code, event_root_code, "
      + big("num_mentions") + ", " + r("goldstein_scale", "avg_tone")
      + f", action_geo_name, action_geo_country_code FROM be WHERE event_date {IN_SPAN} AND {_any_country('IRN')} "
      f"AND num_mentions >= 200 {NEWEST} LIMIT 20", "be"),
)
def _(f):
    return events.recent_events_brief(f.events, *ALL, country="IRN")


@query(
    "ml_significant_events",
    q("SELECT id, source_url, event_date, event_root_code, " + big("num_mentions", "num_sources") + ", "
      + r("goldstein_scale", "avg_tone") + f" FROM be WHERE event_date {IN_SPAN} "
      "AND abs(goldstein_scale) >= 5 AND num_mentions >= 1000 AND event_root_code IS NOT NULL", "be"),
)
def _(f):
    from eventlens.operators import datasets

    return datasets.ml_significant_events(f.events, *ALL).select(
        "id", "source_url", "event_date", "event_root_code", "num_mentions", "num_sources",
        "goldstein_scale", "avg_tone",
    )


@query("event_count", q(f"SELECT count(*) AS count FROM be WHERE event_date {IN_SPAN}", "be"))
def _(f):
    return events.event_count(f.events, *ALL)


@query(
    "events_by_country",
    q("SELECT action_geo_country_code AS country_code, count(*) AS count, "
      + r("avg(goldstein_scale) AS avg_goldstein", d=2)
      + " FROM be WHERE action_geo_country_code <> '' GROUP BY 1 ORDER BY count DESC, country_code LIMIT 20", "be"),
)
def _(f):
    return events.events_by_country(f.events, *ALL)


@query(
    "events_by_type",
    q("SELECT event_root_code AS code, cameo_label AS name, event_group AS \"group\", count(*) AS count "
      "FROM be GROUP BY ALL", "be"),
)
def _(f):
    return events.events_by_type(f.events, *ALL)


cte(
    "event_map",
    f"""SELECT country_code, count(*) AS event_count, round(avg(goldstein_scale), 2) AS avg_goldstein,
               coalesce(sum(num_mentions), 0) AS total_mentions,
               count(*) FILTER (event_root_code IN {codes(ref.CONFLICT_ROOTS)}) AS conflict_count,
               count(*) FILTER (event_root_code IN {codes(ref.COOPERATION_ROOTS)}) AS cooperation_count
        FROM be WHERE action_geo_country_code <> '' GROUP BY country_code""",
    "be",
)
_MAP = "country_code, " + big("event_count", "total_mentions", "conflict_count", "cooperation_count") + ", " + r("avg_goldstein")


@query("event_map", q(f"SELECT {_MAP} FROM event_map", "event_map"))
def _(f):
    return events.event_map(f.bronze_events, *ALL)


@query("risk_radar", q(f"SELECT {_MAP} FROM event_map ORDER BY event_count DESC, country_code LIMIT 8", "event_map"))
def _(f):
    return events.risk_radar(f.bronze_events, *ALL)


@query(
    "null_audit",
    q("SELECT count(*) FILTER (goldstein_scale IS NULL) AS null_goldstein_scale, "
      "count(*) FILTER (action_geo_country_code IS NULL) AS null_action_geo_country_code, "
      "count(*) FILTER (event_date IS NULL) AS null_event_date, "
      "count(*) FILTER (avg_tone IS NULL) AS null_avg_tone FROM b_events", "b_events"),
)
def _(f):
    return events.null_audit(
        f.bronze_events, ["goldstein_scale", "action_geo_country_code", "event_date", "avg_tone"]
    )


@query(
    "value_distribution",
    q("SELECT event_root_code, count(*) AS n FROM b_events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10", "b_events"),
)
def _(f):
    return events.value_distribution(f.bronze_events, "event_root_code")


@query(
    "top_activity_links",
    q("SELECT event_date, country_code, symbol, dominant_event_group, event_count, "
      + r("avg_goldstein", d=2) + ", " + r("daily_return", d=4)
      + " FROM silver_event_market s ORDER BY event_count DESC, event_date, country_code, symbol LIMIT 15",
      "silver_event_market"),
)
def _(f):
    return events.top_activity_links(f.silver_event_market)


@query(
    "table_counts",
    q(" UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM b_{n}"
        for n in ("events", "market_data", "news_headlines", "economic_indicators")
    ), "b_events b_market_data b_news_headlines b_economic_indicators"),
)
def _(f):
    return events.table_counts(
        {
            "events": f.bronze_events,
            "market_data": f.bronze_market,
            "news_headlines": f.bronze_headlines,
            "economic_indicators": f.indicators,
        }
    )


# ---- prices ------------------------------------------------------------------------------
PRICE = "symbol, date, " + r("open", "high", "low", "close") + ", " + big("volume") + ", " + r("daily_return")
_PRICE = ["symbol", "date", "open", "high", "low", "close", "volume", "daily_return"]


@query("market_slice", q(f"SELECT {PRICE} FROM silver_market WHERE symbol = 'CL=F' AND date {IN_SPAN}", "silver_market"))
def _(f):
    return market.market_slice(f.silver_market, "CL=F", *ALL).select(*_PRICE)


@query("market_slice_multi", q(f"SELECT {PRICE} FROM silver_market WHERE symbol IN ('CL=F', 'QQQ')", "silver_market"))
def _(f):
    return market.market_slice_multi(f.silver_market, ["CL=F", "QQQ"], *ALL).select(*_PRICE)


@query(
    "silver_market_slice",
    q("SELECT date, " + r("close", "daily_return", "log_return") + ", volume FROM silver_market WHERE symbol = 'GC=F'",
      "silver_market"),
)
def _(f):
    return market.silver_market_slice(f.silver_market, "GC=F", *ALL)


@query("list_market", q(f"SELECT {PRICE} FROM silver_market s ORDER BY symbol, date DESC LIMIT 100 OFFSET 20", "silver_market"))
def _(f):
    return market.list_market(f.silver_market, None, *ALL, limit=100, offset=20).select(*_PRICE)


@query("symbol_history", q(f"SELECT {PRICE} FROM silver_market s WHERE symbol = 'NG=F' ORDER BY date DESC LIMIT 365", "silver_market"))
def _(f):
    return market.symbol_history(f.silver_market, "NG=F", *ALL).select(*_PRICE)


cte(
    "tail30",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM silver_market)
       WHERE rn <= 30""",
    "silver_market",
)


@query("market_tail", q(f"SELECT {PRICE} FROM tail30", "tail30"))
def _(f):
    return market.market_tail(f.silver_market)


@query("latest_price", q(f"SELECT {PRICE} FROM tail30 WHERE rn = 1", "tail30"))
def _(f):
    return market.latest_price(f.silver_market.select(*_PRICE))


@query(
    "symbol_returns_pct",
    q("SELECT symbol, date, " + r("daily_return * 100 AS return_pct") + " FROM silver_market WHERE daily_return IS NOT NULL",
      "silver_market"),
)
def _(f):
    return market.symbol_returns_pct(f.silver_market)


@query(
    "symbol_stats",
    q("SELECT m.symbol, coalesce(any_value(c.name), m.symbol) AS name, coalesce(any_value(c.category), 'unknown') AS category, "
      "count(*) AS data_points, "
      + r("avg(daily_return) * 100 AS mean_daily_return_pct", "min(daily_return) * 100 AS min_return_pct",
          "max(daily_return) * 100 AS max_return_pct", "min(close) AS min_price", "max(close) AS max_price")
      + " FROM silver_market m LEFT JOIN catalog c ON m.symbol = c.symbol GROUP BY m.symbol", "silver_market catalog"),
)
def _(f):
    return market.symbol_stats(f.silver_market)


@query(
    "symbol_catalog",
    q("SELECT c.symbol, name, category, coalesce(n, 0) AS n_rows, first_date, last_date FROM catalog c LEFT JOIN "
      "(SELECT symbol, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM b_market_data GROUP BY symbol) m "
      "ON c.symbol = m.symbol", "catalog b_market_data"),
)
def _(f):
    return ref.symbol_availability(ref.symbol_catalog(f.spark), f.bronze_market)


@query(
    "symbol_country_map",
    q("SELECT m.symbol, coalesce(string_agg(s.country_code, ',' ORDER BY s.country_code), '') AS sensitive_to_countries "
      "FROM (SELECT DISTINCT symbol FROM b_market_data) m LEFT JOIN symbol_countries s ON m.symbol = s.symbol GROUP BY m.symbol",
      "b_market_data symbol_countries"),
)
def _(f):
    out = ref.countries_of_symbols(f.bronze_market.select("symbol").distinct())
    return out.withColumn("sensitive_to_countries", F.array_join("sensitive_to_countries", ","))


@query(
    "country_asset_map",
    q("SELECT e.country_code, coalesce(string_agg(a.symbol, ',' ORDER BY a.symbol), '') AS assets FROM "
      "(SELECT DISTINCT country_code FROM be WHERE country_code IS NOT NULL) e LEFT JOIN asset_map a "
      "ON e.country_code = a.country_code GROUP BY e.country_code", "be asset_map"),
)
def _(f):
    seen = f.events.select("country_code").dropna().distinct()
    return ref.assets_of_countries(seen).withColumn("assets", F.array_join("assets", ","))


@query(
    "latest_dates",
    q("SELECT symbol AS key, max(date) AS latest_date FROM b_market_data GROUP BY 1 UNION ALL "
      "SELECT source, max(CAST(published_at AS DATE)) FROM b_news_headlines GROUP BY 1 UNION ALL "
      "SELECT series_id, max(date) FROM b_economic_indicators GROUP BY 1",
      "b_market_data b_news_headlines b_economic_indicators"),
)
def _(f):
    parts = [
        market.latest_dates(f.bronze_market, "symbol", "date"),
        market.latest_dates(f.bronze_headlines, "source", F.to_date("published_at")),
        market.latest_dates(f.indicators, "series_id", "date"),
    ]
    named = [p.toDF("key", "latest_date") for p in parts]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query(
    "highwater_start",
    q("SELECT symbol, CASE WHEN last >= DATE '2001-07-28' THEN last + 1 ELSE DATE '2001-07-28' END AS start, "
      "DATE '2001-08-05' AS \"end\" FROM (SELECT symbol, max(date) AS last FROM b_market_data GROUP BY symbol) "
      "WHERE CASE WHEN last >= DATE '2001-07-28' THEN last + 1 ELSE DATE '2001-07-28' END <= DATE '2001-08-05'",
      "b_market_data"),
)
def _(f):
    requests = f.bronze_market.select("symbol").distinct().withColumns(
        {"start": F.lit("2001-07-28").cast("date"), "end": F.lit("2001-08-05").cast("date")}
    )
    return market.highwater_start(requests, f.bronze_market)


# ---- overlay -----------------------------------------------------------------------------
cte(
    "event_symbols",
    """SELECT DISTINCT e.*, s.symbol FROM be e JOIN symbol_countries s
         ON s.country_code IN (e.actor1_country_code, e.actor2_country_code, e.country_code)""",
    "be symbol_countries",
)


def _overlay_sql(source: str, keys: str, least: int) -> str:
    counted = f"num_mentions >= {least}"
    return f"""SELECT *, CASE WHEN event_count > 0 THEN 1 END AS has FROM (
        SELECT {keys}, event_date AS date, count(*) FILTER ({counted}) AS event_count,
               round(avg(goldstein_scale) FILTER ({counted}), 2) AS avg_goldstein,
               coalesce(sum(num_mentions) FILTER ({counted}), 0) AS total_mentions,
               count(*) FILTER ({counted} AND event_root_code IN {codes(ref.CONFLICT_ROOTS)}) AS conflict_count,
               count(*) FILTER ({counted} AND event_root_code IN {codes(ref.COOPERATION_ROOTS)}) AS cooperation_count,
               (array_agg(id ORDER BY num_mentions DESC NULLS LAST, id DESC, source_url DESC))[1] AS top_event_id,
               coalesce((array_agg(action_geo_name ORDER BY num_mentions DESC NULLS LAST, id DESC, source_url DESC))[1], '')
                 AS top_event_place,
               (array_agg(goldstein_scale ORDER BY num_mentions DESC NULLS LAST, id DESC, source_url DESC))[1]
                 AS top_event_goldstein,
               (array_agg(num_mentions ORDER BY num_mentions DESC NULLS LAST, id DESC, source_url DESC))[1]
                 AS top_event_mentions,
               (array_agg(event_group ORDER BY num_mentions DESC NULLS LAST, id DESC, source_url DESC))[1]
                 AS top_event_group
        FROM {source} GROUP BY {keys}, event_date) WHERE event_count > 0"""


cte("overlay_own", _overlay_sql("event_symbols", "symbol", 60), "event_symbols")
cte("overlay_world", _overlay_sql("(SELECT *, '^VIX' AS symbol FROM be)", "symbol", 60), "be")
cte("overlay_all", _overlay_sql("(SELECT *, 'w' AS k FROM be)", "k", 0), "be")
_OVER = (
    big("total_mentions", "conflict_count", "cooperation_count", "top_event_id", "top_event_mentions")
    + ", top_event_place, top_event_group, " + r("avg_goldstein", "top_event_goldstein")
)


@query(
    "overlay_day_agg",
    q(f"SELECT symbol, date, event_count, {_OVER} FROM overlay_own", "overlay_own"),
)
def _(f):
    return market.overlay_day_agg(f.events, min_mentions=60)


@query(
    "top_event_per_day",
    q("SELECT date, " + big("top_event_id", "top_event_mentions")
      + ", top_event_place, top_event_group, " + r("top_event_goldstein") + " FROM overlay_all", "overlay_all"),
)
def _(f):
    return market.top_event_per_day(f.events)


@query(
    "semi_join_event_dates",
    q("SELECT event_date, count(*) AS n FROM be WHERE event_date IN "
      "(SELECT date FROM silver_market WHERE symbol = '^VIX') GROUP BY event_date", "be silver_market"),
)
def _(f):
    vix = f.silver_market.filter(F.col("symbol") == "^VIX")
    return market.semi_join_event_dates(f.events, vix).groupBy("event_date").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "price_event_overlay",
    q("SELECT m.symbol, m.date, " + r("m.close", "m.open", "m.high", "m.low", "m.daily_return") + ", m.volume, "
      "coalesce(o.event_count, 0) AS event_count, " + _OVER
      + " FROM silver_market m LEFT JOIN (SELECT * FROM overlay_own UNION ALL SELECT * FROM overlay_world) o "
      "ON m.symbol = o.symbol AND m.date = o.date", "silver_market overlay_own overlay_world"),
)
def _(f):
    return market.price_event_overlay(f.silver_market, f.events, min_mentions=60)


# ---- headlines ----------------------------------------------------------------------------
HEADLINE = "id, source, headline, published_at, sentiment_label, " + r("sentiment_score")
_HEADLINE = ["id", "source", "headline", "published_at", "sentiment_label", "sentiment_score"]


@query(
    "headlines_by_date_range",
    q(f"SELECT {HEADLINE} FROM b_news_headlines WHERE CAST(published_at AS DATE) {IN_SPAN} AND source = 'BBC'",
      "b_news_headlines"),
)
def _(f):
    return news.headlines_by_date_range(f.bronze_headlines, *ALL, source="BBC").select(*_HEADLINE)


@query(
    "headline_sentiment",
    q("SELECT headline, source, published_at, sentiment_label, " + r("sentiment_score")
      + " FROM b_news_headlines WHERE sentiment_label = 'negative' ORDER BY published_at DESC, id LIMIT 20",
      "b_news_headlines"),
)
def _(f):
    return news.headline_sentiment(f.bronze_headlines, *ALL, sentiment="negative")


@query(
    "sentiment_summary",
    q("SELECT count(*) AS total_headlines, "
      + r("avg(sentiment_score) AS avg_sentiment_score", "min(sentiment_score) AS min_score",
          "max(sentiment_score) AS max_score", d=4)
      + ", count(*) FILTER (sentiment_label = 'positive') AS positive, count(*) FILTER (sentiment_label = 'negative') AS negative, "
      "count(*) FILTER (sentiment_label = 'neutral') AS neutral, CASE WHEN avg(sentiment_score) > 0.1 THEN 'positive' "
      "WHEN avg(sentiment_score) < -0.1 THEN 'negative' ELSE 'neutral' END AS overall_mood "
      "FROM b_news_headlines WHERE sentiment_score IS NOT NULL", "b_news_headlines"),
)
def _(f):
    return news.sentiment_summary(f.bronze_headlines)


@query(
    "sentiment_trend",
    q("SELECT CAST(published_at AS DATE) AS date, count(*) AS headline_count, "
      + r("avg(sentiment_score) AS avg_sentiment", d=4)
      + " FROM b_news_headlines WHERE sentiment_score IS NOT NULL GROUP BY 1", "b_news_headlines"),
)
def _(f):
    return news.sentiment_trend(f.bronze_headlines)


@query(
    "headline_mood",
    q("SELECT " + r("avg(sentiment_score) AS mean_score") + ", CASE WHEN avg(sentiment_score) > 0.1 THEN 'positive' "
      "WHEN avg(sentiment_score) < -0.1 THEN 'negative' ELSE 'neutral' END AS mood FROM b_news_headlines",
      "b_news_headlines"),
)
def _(f):
    return news.headline_mood(f.bronze_headlines)


# ---- series --------------------------------------------------------------------------------
@query(
    "indicator_series",
    q("SELECT series_id, series_name, date, " + r("value") + " FROM b_economic_indicators WHERE series_id = 'GDP'",
      "b_economic_indicators"),
)
def _(f):
    return series.indicator_series(f.indicators, "GDP")


cte(
    "deltas",
    """SELECT *, value - previous_value AS change,
              CASE WHEN previous_value <> 0 THEN (value - previous_value) / previous_value * 100 END AS change_pct
       FROM (SELECT *, lag(value) OVER w AS previous_value, lag(date) OVER w AS previous_date,
                    row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS rn
             FROM b_economic_indicators WINDOW w AS (PARTITION BY series_id ORDER BY date)) WHERE rn = 1""",
    "b_economic_indicators",
)


@query(
    "indicator_deltas",
    q("SELECT series_id, series_name, date, previous_date, "
      + r("value", "previous_value", "change", "change_pct") + " FROM deltas", "deltas"),
)
def _(f):
    return series.indicator_deltas(f.indicators)


@query(
    "latest_per_key",
    q("SELECT series_id, series_name, date, " + r("value") + " FROM deltas", "deltas"),
)
def _(f):
    return series.latest_indicators(f.indicators)


cte(
    "predictions",
    """SELECT * FROM (SELECT *, CAST(snapshot_at AS DATE) AS snapshot_date, row_number() OVER
         (PARTITION BY market_id, CAST(snapshot_at AS DATE) ORDER BY snapshot_at, id) AS rn FROM b_prediction_snapshots)
       WHERE rn = 1""",
    "b_prediction_snapshots",
)
PRED = "market_id, question, event_title, snapshot_date, " + r("yes_price", "volume_24h", "total_volume", "liquidity")
_PRED = ["market_id", "question", "event_title", "snapshot_date", "yes_price", "volume_24h", "total_volume", "liquidity"]


@query("daily_snapshots", q(f"SELECT {PRED} FROM predictions", "predictions"))
def _(f):
    return f.predictions.select(*_PRED)


@query("market_snapshots", q(f"SELECT {PRED} FROM predictions WHERE market_id = '7'", "predictions"))
def _(f):
    return series.market_snapshots(f.predictions, "7").select(*_PRED)


@query(
    "latest_predictions",
    q(f"SELECT {PRED} FROM (SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY market_id "
      "ORDER BY snapshot_date DESC) = 1) p ORDER BY p.volume_24h DESC, market_id LIMIT 50", "predictions"),
)
def _(f):
    return series.latest_predictions(f.predictions).select(*_PRED)


cte(
    "movers",
    """SELECT n.market_id, n.question, n.event_title, n.yes_price AS current_price, t.yes_price AS previous_price,
              n.yes_price - t.yes_price AS price_change, abs(n.yes_price - t.yes_price) AS abs_change,
              n.snapshot_date, t.snapshot_date AS previous_date
       FROM (SELECT * FROM predictions WHERE snapshot_date = (SELECT max(snapshot_date) FROM predictions)) n
       JOIN (SELECT * FROM predictions WHERE snapshot_date <= (SELECT max(snapshot_date) FROM predictions) - 7
             QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY snapshot_date DESC) = 1) t
         ON n.market_id = t.market_id""",
    "predictions",
)
_MOVE = "market_id, question, event_title, snapshot_date, previous_date, " + r(
    "current_price", "previous_price", "price_change", "abs_change"
)


@query("asof_snapshot_compare", q(f"SELECT {_MOVE} FROM movers", "movers"))
def _(f):
    return series.asof_snapshot_compare(f.predictions)


@query("prediction_movers", q(f"SELECT {_MOVE} FROM movers m ORDER BY m.abs_change DESC, market_id LIMIT 10", "movers"))
def _(f):
    return series.prediction_movers(f.predictions)


# ---- stored results ---------------------------------------------------------------------------
RESULT = (
    "event_id, symbol, analysis_type, event_window_start, is_anomaly, anomaly_type, is_significant, "
    + r("car", "car_t_stat", "car_p_value", "expected_return", "actual_return", "anomaly_score")
)
_RESULT = [
    "event_id", "symbol", "analysis_type", "event_window_start", "is_anomaly", "anomaly_type",
    "is_significant", "car", "car_t_stat", "car_p_value", "expected_return", "actual_return",
    "anomaly_score",
]
TIES = "event_id, symbol, analysis_type, event_window_start"


@query(
    "results_for_event",
    q(f"SELECT {RESULT} FROM analysis_results WHERE event_id = (SELECT max(event_id) FROM study_pairs WHERE symbol = 'CL=F')",
      "analysis_results study_pairs"),
)
def _(f):
    from registry.results import study_pairs

    wanted = study_pairs(f).filter("symbol = 'CL=F'").agg(F.max("event_id")).scalar()
    return results.results_for_event(f.results, wanted).select(*_RESULT)


@query(
    "list_results",
    q(f"SELECT {RESULT} FROM analysis_results a WHERE analysis_type = 'event_study' AND is_significant AND abs(a.car) >= 0.01 "
      f"ORDER BY abs(a.car) DESC NULLS FIRST, {TIES} LIMIT 100 OFFSET 10", "analysis_results"),
)
def _(f):
    return results.list_results(
        f.results, analysis_type="event_study", significant=True, min_car=0.01, offset=10
    ).select(*_RESULT)


@query(
    "anomaly_results",
    q(f"SELECT {RESULT} FROM analysis_results a WHERE is_anomaly ORDER BY a.anomaly_score DESC NULLS FIRST, {TIES} LIMIT 100",
      "analysis_results"),
)
def _(f):
    return results.anomaly_results(f.results).select(*_RESULT)


@query(
    "significant_results",
    q("SELECT a.event_id, e.event_date, e.cameo_label AS event_type, a.symbol, "
      + r("a.car * 100 AS car_pct", "a.car_t_stat AS t_stat", "a.car_p_value AS p_value", "e.goldstein_scale") + ", "
      + big("e.num_mentions")
      + " FROM analysis_results a JOIN silver_events e ON a.event_id = e.event_id WHERE a.is_significant AND "
      "analysis_type = 'event_study' AND abs(a.car) >= 0.01 ORDER BY abs(a.car) DESC, a.event_id, a.symbol LIMIT 50",
      "analysis_results silver_events"),
)
def _(f):
    return results.significant_results(f.results, f.silver_events)


@query(
    "anomalies_with_events",
    q("SELECT a.event_id, e.event_date, e.cameo_label AS event_type, e.event_group, a.symbol, a.anomaly_type, "
      "coalesce(nullif(actor1_name, ''), actor1_country) AS actor1, coalesce(nullif(actor2_name, ''), actor2_country) AS actor2, "
      + r("a.anomaly_score", "a.expected_return", "a.actual_return", "e.goldstein_scale")
      + " FROM analysis_results a JOIN silver_events e ON a.event_id = e.event_id WHERE is_anomaly "
      "ORDER BY a.anomaly_score DESC, a.event_id, a.symbol LIMIT 100", "analysis_results silver_events"),
)
def _(f):
    return results.anomalies_with_events(f.results, f.silver_events)


@query(
    "avg_market_reaction",
    q("SELECT event_root_code, symbol, count(*) AS n_results, "
      + r("avg(car) AS avg_car", "avg(CAST(a.is_significant AS INT)) AS significance_rate")
      + " FROM analysis_results a JOIN silver_events e ON a.event_id = e.event_id WHERE analysis_type = 'event_study' "
      "GROUP BY ALL", "analysis_results silver_events"),
)
def _(f):
    return results.avg_market_reaction(f.results, f.silver_events)


@query(
    "analysis_summary",
    q("SELECT count(*) AS total_results, count(*) FILTER (is_significant) AS significant_results, "
      "count(*) FILTER (is_anomaly) AS total_anomalies, "
      "(SELECT string_agg(anomaly_type || ':' || n, ',' ORDER BY anomaly_type) FROM (SELECT anomaly_type, count(*) AS n "
      "FROM analysis_results WHERE is_anomaly AND anomaly_type IS NOT NULL GROUP BY 1)) AS anomaly_breakdown, "
      + r("count(*) FILTER (is_significant) / count(*) AS significance_rate") + " FROM analysis_results",
      "analysis_results"),
)
def _(f):
    out = results.analysis_summary(f.results)
    pairs = F.transform(
        F.array_sort(F.map_entries("anomaly_breakdown")),
        lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")),
    )
    return out.withColumn("anomaly_breakdown", F.array_join(pairs, ","))


# ---- expressions --------------------------------------------------------------------------------
@query(
    "temporal_features",
    q("SELECT date, CAST((isodow(date) - 1) AS BIGINT) AS day_of_week, CAST(month(date) AS BIGINT) AS month, "
      "CAST(isodow(date) = 1 AS BIGINT) AS is_monday, CAST(isodow(date) = 5 AS BIGINT) AS is_friday, count(*) AS n "
      "FROM silver_market GROUP BY ALL", "silver_market"),
)
def _(f):
    t = X.temporal_features("date")
    return f.silver_market.groupBy("date", *[c.alias(n) for n, c in t.items()]).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "event_category_flags",
    q("SELECT event_root_code, goldstein_scale < -5 AS conflict, count(*) AS n, "
      + ", ".join(f"CAST(event_group = '{g}' AS BIGINT) AS is_{g}" for g in ref.EVENT_GROUPS)
      + ", CAST(goldstein_scale < -5 AS BIGINT) AS is_conflict_signal, CAST(goldstein_scale > 5 AS BIGINT) AS is_cooperation_signal "
      "FROM be GROUP BY ALL", "be").replace("goldstein_scale < -5 AS conflict, ", ""),
)
def _(f):
    flags = X.event_category_flags("event_root_code") | X.signal_flags("goldstein_scale")
    return f.events.groupBy("event_root_code", *[c.alias(n) for n, c in flags.items()]).agg(
        F.count(F.lit(1)).alias("n")
    )


