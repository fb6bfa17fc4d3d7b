"""Stored analysis results over the sample tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens import reference as ref
from eventlens.functions.forest import DECIMALS, SAMPLE, TREES
from eventlens.operators import anomalies, event_study, results
from registry.sql import cte, t_two_sided

SPAN = ("1995-01-01", "2001-08-01")


def study_pairs(f) -> DataFrame:
    """Significant Silver events x assets of their country."""
    return (
        f.silver_events.filter("is_significant")
        .join(F.broadcast(ref.country_asset_map(f.spark)), "country_code")
        .select("event_id", "symbol", "event_date")
    )


def rule_anomalies(f) -> DataFrame:
    return anomalies.detect_anomalies(f.silver_market, f.events, *SPAN, forest=False)


def day_events(f) -> DataFrame:
    """Best-covered event of each date."""
    return f.silver_events.groupBy(F.col("event_date").alias("date")).agg(
        F.max_by("event_id", F.struct("num_mentions", "event_id")).alias("event_id")
    )


def analysis_results(f) -> DataFrame:
    studied = event_study.event_study_batch(f.silver_market, study_pairs(f))
    return results.from_event_study(studied).unionByName(
        results.from_anomalies(rule_anomalies(f), day_events(f))
    )


# ---- SQL ---------------------------------------------------------------------------
cte(
    "study_pairs",
    """SELECT event_id, symbol, event_date FROM silver_events JOIN asset_map USING (country_code)
       WHERE is_significant""",
    "silver_events asset_map",
)
cte("study_returns", "SELECT symbol, date, log_return AS ret FROM silver_market WHERE log_return IS NOT NULL", "silver_market")
cte(
    "study_windows",
    """SELECT p.symbol, p.event_date,
              avg(ret) FILTER (date BETWEEN event_date - 42 AND event_date - 2) AS expected_return,
              stddev_samp(ret) FILTER (date BETWEEN event_date - 42 AND event_date - 2) AS std_dev,
              count(ret) FILTER (date BETWEEN event_date - 42 AND event_date - 2) AS estimation_days,
              sum(ret) FILTER (date BETWEEN event_date - 1 AND event_date + 5) AS actual_return,
              count(ret) FILTER (date BETWEEN event_date - 1 AND event_date + 5) AS event_days,
              stddev_samp(ret) FILTER (date BETWEEN event_date - 1 AND event_date + 5) AS event_sd
       FROM (SELECT DISTINCT symbol, event_date FROM study_pairs) p
       JOIN study_returns m ON m.symbol = p.symbol
        AND m.date BETWEEN p.event_date - 42 AND p.event_date + 5
       GROUP BY ALL""",
    "study_pairs study_returns",
)
cte(
    "event_study",
    f"""SELECT *, {t_two_sided('t_statistic', 'dof')} AS p_value
        FROM (SELECT *, actual_return - event_days * expected_return AS car,
                     CASE WHEN event_days > 1
                          THEN (actual_return - event_days * expected_return) / event_days
                               * sqrt(event_days) / nullif(event_sd, 0)
                          ELSE coalesce((actual_return - event_days * expected_return)
                                        / nullif(std_dev, 0), 0) END AS t_statistic,
                     CASE WHEN event_days > 1 THEN event_days - 1
                          ELSE estimation_days - 1 END AS dof
              FROM study_windows WHERE estimation_days >= 10 AND event_days >= 1)""",
    "study_windows",
)
cte(
    "anomaly_stats",
    """SELECT *, (log_return - rolling_mean) / nullif(rolling_std, 0) AS z_score
       FROM (SELECT symbol, date, close, log_return, daily_return, volume,
                    abs(log_return) AS abs_return,
                    CASE WHEN count(log_return) OVER w >= 10 THEN avg(log_return) OVER w END
                      AS rolling_mean,
                    CASE WHEN count(log_return) OVER w >= 10 THEN stddev_samp(log_return) OVER w END
                      AS rolling_std,
                    (volume - lag(volume) OVER s) / nullif(lag(volume) OVER s, 0) AS volume_change,
                    CASE WHEN count(volume) OVER w >= 30
                         THEN (volume - avg(volume) OVER w)
                              / nullif(stddev_samp(volume) OVER w, 0) END AS volume_zscore
             FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM silver_market
                   WHERE date BETWEEN DATE '1994-11-22' AND DATE '2001-08-01')
             WHERE n >= 30
             WINDOW s AS (PARTITION BY symbol ORDER BY date),
                    w AS (PARTITION BY symbol ORDER BY date
                          ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))""",
    "silver_market",
)
cte(
    "anomaly_events",
    """SELECT event_date AS date, avg(coalesce(goldstein_scale, 0)) AS goldstein_mean,
              min(coalesce(goldstein_scale, 0)) AS goldstein_min, count(*) AS event_count,
              coalesce(sum(num_mentions), 0) AS mentions_total
       FROM b_events WHERE event_date BETWEEN DATE '1994-11-22' AND DATE '2001-08-01'
       GROUP BY event_date""",
    "b_events",
)
cte(
    "anomaly_features",
    """SELECT s.*, coalesce(goldstein_mean, 0) AS goldstein_mean,
              coalesce(goldstein_min, 0) AS goldstein_min, coalesce(event_count, 0) AS event_count,
              coalesce(mentions_total, 0) AS mentions_total
       FROM anomaly_stats s LEFT JOIN anomaly_events e ON s.date = e.date
       WHERE s.date BETWEEN DATE '1995-01-01' AND DATE '2001-08-01'
         AND log_return IS NOT NULL AND z_score IS NOT NULL""",
    "anomaly_stats anomaly_events",
)
cte(
    "anomaly_flags",
    """SELECT *, abs(z_score) > 2 AS zscore_anomaly,
              abs(z_score) > 1.5 AND event_count = 0 AS unexplained_move,
              abs(goldstein_min) > 5 AND abs_return < 0.005 AS muted_response
       FROM anomaly_features""",
    "anomaly_features",
)
cte(
    "rule_anomalies",
    """SELECT symbol, date,
              CASE WHEN unexplained_move THEN 'unexplained_move'
                   WHEN muted_response THEN 'muted_response'
                   ELSE 'statistical_outlier' END AS anomaly_type,
              log_return AS actual_return, coalesce(rolling_mean, 0) AS expected_return, z_score,
              event_count, goldstein_mean AS avg_goldstein,
              concat_ws(',', CASE WHEN zscore_anomaly THEN 'zscore' END,
                        CASE WHEN unexplained_move THEN 'unexplained_move' END,
                        CASE WHEN muted_response THEN 'muted_response' END) AS detected_by
       FROM anomaly_flags WHERE zscore_anomaly OR unexplained_move OR muted_response""",
    "anomaly_flags",
)
# ---- the isolation forest, grown again level by level --------------------------------------
_X = ["log_return", "abs_return", "z_score", "goldstein_mean", "event_count"]


def _share(node: str, purpose: str) -> str:
    return f"(CAST('0x' || substr(md5(tree || ':' || {node} || ':{purpose}'), 1, 8) AS BIGINT) / 4294967296.0)"


def _mean_path(n: str) -> str:
    return (f"CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE "
            f"2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1) / {n} END")


cte(
    "forest_days",
    "SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, "
    f"least({SAMPLE}, count(*) OVER (PARTITION BY symbol)) AS size, "
    "[" + ", ".join(f"round(CAST({c} AS DOUBLE), {DECIMALS})" for c in _X) + "] AS x FROM anomaly_features",
    "anomaly_features",
)
cte("forest_shares", f"SELECT tree, i, {_share('i', 'row')} AS u FROM range({TREES}) t(tree), "
    "(SELECT DISTINCT i FROM forest_days)", "forest_days")
cte(
    "forest_0",
    """SELECT symbol, tree, i, x, size, 1 AS node,
              row_number() OVER (PARTITION BY symbol, tree ORDER BY u, i) <= size AS sampled
       FROM forest_days JOIN forest_shares USING (i)""",
    "forest_days forest_shares",
)
LEVELS = (SAMPLE - 1).bit_length()
for _d in range(LEVELS + 1):
    _low, _high = ("[" + ", ".join(f"{f}(x[{j}]) FILTER (sampled)" for j in range(1, len(_X) + 1)) + "]" for f in ("min", "max"))
    cte(
        f"forest_nodes_{_d}",
        f"""SELECT *, size > 1 AND {_d} < ceil(log2(greatest(whole, 2))) AND len(open) > 0 AS splits,
                   open[1 + CAST(floor({_share('node', 'feature')} * len(open)) AS BIGINT)] AS j, {_share('node', 'cut')} AS u
            FROM (SELECT *, list_filter(range(1, {len(_X) + 1}), lambda k: high[k] > low[k]) AS open
                  FROM (SELECT symbol, tree, node, any_value(size) AS whole, count(*) FILTER (sampled) AS size,
                               {_low} AS low, {_high} AS high FROM forest_{_d} GROUP BY symbol, tree, node))""",
        f"forest_{_d}",
    )
    cte(
        f"forest_done_{_d}",
        f"""SELECT r.symbol, r.i, {_d} + {_mean_path('n.size')} AS path FROM forest_{_d} r
            JOIN forest_nodes_{_d} n USING (symbol, tree, node) WHERE NOT splits""",
        f"forest_{_d} forest_nodes_{_d}",
    )
    if _d < LEVELS:
        cte(
            f"forest_{_d + 1}",
            f"""SELECT r.symbol, r.tree, r.i, r.x, r.size, sampled,
                       2 * node + CAST(x[j] > low[j] + (high[j] - low[j]) * u AS INT) AS node
                FROM forest_{_d} r JOIN forest_nodes_{_d} n USING (symbol, tree, node) WHERE splits""",
            f"forest_{_d} forest_nodes_{_d}",
        )
cte(
    "forest_scores",
    f"""SELECT symbol, date, round(decision, 12) < 0 AS isolation_flag, decision AS isolation_score,
               1 - (decision - min(decision) OVER s) / (max(decision) OVER s - min(decision) OVER s + 1e-10) AS anomaly_probability
        FROM (SELECT symbol, date, raw - quantile_cont(raw, 0.05) OVER (PARTITION BY symbol) AS decision
              FROM (SELECT symbol, date, -pow(2, -total / {TREES} / greatest({_mean_path('size')}, 1e-12)) AS raw
                    FROM forest_days JOIN (SELECT symbol, i, sum(path) AS total FROM ("""
    + " UNION ALL ".join(f"SELECT * FROM forest_done_{d}" for d in range(LEVELS + 1))
    + """) GROUP BY symbol, i) USING (symbol, i)))
        WINDOW s AS (PARTITION BY symbol)""",
    "forest_days " + " ".join(f"forest_done_{d}" for d in range(LEVELS + 1)),
)
cte(
    "all_anomalies",
    """SELECT symbol, date,
              CASE WHEN unexplained_move THEN 'unexplained_move'
                   WHEN muted_response THEN 'muted_response'
                   ELSE 'statistical_outlier' END AS anomaly_type,
              log_return AS actual_return, coalesce(rolling_mean, 0) AS expected_return, z_score,
              isolation_score, anomaly_probability, event_count, goldstein_mean AS avg_goldstein,
              concat_ws(',', CASE WHEN isolation_flag THEN 'isolation_forest' END,
                        CASE WHEN zscore_anomaly THEN 'zscore' END,
                        CASE WHEN unexplained_move THEN 'unexplained_move' END,
                        CASE WHEN muted_response THEN 'muted_response' END) AS detected_by
       FROM anomaly_flags JOIN forest_scores USING (symbol, date)
       WHERE isolation_flag OR zscore_anomaly OR unexplained_move OR muted_response""",
    "anomaly_flags forest_scores",
)
cte(
    "day_events",
    """SELECT event_date AS date, event_id
       FROM (SELECT event_date, event_id, row_number() OVER (PARTITION BY event_date
                 ORDER BY num_mentions DESC, event_id DESC) AS rn FROM silver_events)
       WHERE rn = 1""",
    "silver_events",
)
cte(
    "analysis_results",
    """SELECT p.event_id, p.symbol, 'event_study' AS analysis_type, car,
              t_statistic AS car_t_stat, p_value AS car_p_value,
              p.event_date - 42 AS estimation_window_start,
              p.event_date - 2 AS estimation_window_end,
              p.event_date - 1 AS event_window_start, p.event_date + 5 AS event_window_end,
              expected_return, actual_return, car AS abnormal_return, false AS is_anomaly,
              NULL AS anomaly_type, NULL AS anomaly_score,
              coalesce(p_value < 0.05, false) AS is_significant
       FROM study_pairs p JOIN event_study s ON p.symbol = s.symbol AND p.event_date = s.event_date
       UNION ALL
       SELECT d.event_id, a.symbol, 'anomaly_detection', NULL, NULL, NULL, NULL, NULL,
              a.date, a.date, expected_return, actual_return, actual_return - expected_return,
              true, anomaly_type, abs(z_score), false
       FROM rule_anomalies a LEFT JOIN day_events d ON a.date = d.date""",
    "study_pairs event_study rule_anomalies day_events",
)
cte(
    "gold_market",
    """SELECT m.date, m.symbol, close, daily_return, log_return, return_5d, return_20d,
              volatility_20d, volume_zscore, a.anomaly_score IS NOT NULL AS is_anomaly,
              a.anomaly_score
       FROM silver_market m
       LEFT JOIN (SELECT symbol, event_window_start AS date, max(anomaly_score) AS anomaly_score
                  FROM analysis_results WHERE is_anomaly GROUP BY ALL) a
         ON m.symbol = a.symbol AND m.date = a.date""",
    "silver_market analysis_results",
)
cte(
    "gold_summary",
    """SELECT *, CASE WHEN total_conflict_events >= 50 AND round(coalesce(avg_news_sentiment, 0), 12) < -0.2
                        THEN 'high'
                      WHEN total_conflict_events >= 50 OR round(coalesce(avg_news_sentiment, 0), 12) < -0.2
                        THEN 'elevated'
                      WHEN coalesce(vix_close, 0) > 30 THEN 'elevated'
                      WHEN total_conflict_events >= 20 AND coalesce(vix_close, 0) > 25
                        THEN 'elevated'
                      ELSE 'low' END AS risk_level
       FROM (SELECT coalesce(g.event_date, m.date, s.published_date) AS summary_date,
                    coalesce(g.total_events, 0) AS total_global_events,
                    coalesce(g.conflict_events, 0) AS total_conflict_events,
                    coalesce(g.violent_events, 0) AS total_violent_events,
                    g.top_conflict_country, m.avg_market_return, m.vix_close,
                    coalesce(m.anomaly_count, 0) AS market_anomaly_count,
                    s.avg_sentiment AS avg_news_sentiment,
                    coalesce(s.headline_count, 0) AS headline_count
             FROM (SELECT event_date, sum(total_events) AS total_events,
                          sum(conflict_events) AS conflict_events,
                          sum(violent_events) AS violent_events,
                          (array_agg(country_code ORDER BY conflict_events DESC, country_code))[1]
                            AS top_conflict_country
                   FROM gold_geo GROUP BY event_date) g
             FULL OUTER JOIN
                  (SELECT date, avg(daily_return) AS avg_market_return,
                          max(CASE WHEN symbol = '^VIX' THEN close END) AS vix_close,
                          sum(CASE WHEN is_anomaly THEN 1 ELSE 0 END) AS anomaly_count
                   FROM gold_market GROUP BY date) m ON g.event_date = m.date
             FULL OUTER JOIN (SELECT * FROM gold_sentiment WHERE source = 'all') s
               ON coalesce(g.event_date, m.date) = s.published_date)""",
    "gold_geo gold_market gold_sentiment",
)
