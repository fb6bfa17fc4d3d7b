"""Daily features, correlations, patterns, event studies, regression and anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens import reference as ref
from eventlens.functions import expressions as X
from eventlens.functions.distributions import t_sf
from eventlens.operators import (
    anomalies, correlation, event_study, features, patterns, regression,
)
from registry import query
from registry.results import SPAN, rule_anomalies, study_pairs
from registry.sql import big, codes, cte, query as q, r, t_two_sided

# ---- SQL: daily features ------------------------------------------------------------
cte(
    "daily",
    """SELECT event_date AS date, coalesce(avg(goldstein_scale), 0) AS goldstein_mean,
              coalesce(min(goldstein_scale), 0) AS goldstein_min,
              coalesce(max(goldstein_scale), 0) AS goldstein_max,
              coalesce(stddev_samp(goldstein_scale), 0) AS goldstein_std,
              coalesce(sum(num_mentions), 0) AS mentions_total,
              coalesce(max(num_mentions), 0) AS mentions_max,
              coalesce(avg(avg_tone), 0) AS avg_tone,
              count(*) FILTER (event_root_code IN ('18', '19', '20')) AS conflict_count,
              count(*) FILTER (event_root_code IN ('03', '04', '05', '06')) AS cooperation_count
       FROM b_events GROUP BY event_date""",
    "b_events",
)
cte(
    "merged",
    """SELECT m.symbol, m.date, m.close, coalesce(m.log_return, 0) AS log_return,
              coalesce(m.daily_return, 0) AS daily_return, coalesce(m.volume, 0) AS volume,
              """
    + ", ".join(
        f"coalesce(d.{c}, 0) AS {c}"
        for c in (
            "goldstein_mean", "goldstein_min", "goldstein_max", "goldstein_std",
            "mentions_total", "mentions_max", "avg_tone", "conflict_count", "cooperation_count",
        )
    )
    + " FROM silver_market m LEFT JOIN daily d ON m.date = d.date",
    "silver_market daily",
)
METRICS = correlation.EVENT_METRICS
cte(
    "long_metrics",
    " UNION ALL ".join(
        f"SELECT symbol, date, log_return AS y, '{m}' AS event_metric, CAST({m} AS DOUBLE) AS x FROM merged"
        for m in METRICS
    ),
    "merged",
)
cte(
    "long_ranks",
    """SELECT symbol, event_metric,
              rank() OVER (PARTITION BY symbol, event_metric ORDER BY x)
                + (count(*) OVER (PARTITION BY symbol, event_metric, x) - 1) / 2 AS x,
              rank() OVER (PARTITION BY symbol, event_metric ORDER BY y)
                + (count(*) OVER (PARTITION BY symbol, event_metric, y) - 1) / 2 AS y
       FROM long_metrics""",
    "long_metrics",
)
for _name, _source in (("corr_pearson", "long_metrics"), ("corr_spearman", "long_ranks")):
    _t = "(c * sqrt(n - 2) / sqrt(1 - c * c))"
    cte(
        _name,
        f"""SELECT symbol, event_metric, c AS correlation, n AS n_observations,
                   {t_two_sided(_t, 'n - 2')} AS p_value
            FROM (SELECT symbol, event_metric, count(*) AS n,
                         covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)) AS c
                  FROM {_source} GROUP BY symbol, event_metric
                  HAVING count(*) >= 10 AND stddev_samp(x) > 0 AND stddev_samp(y) > 0)""",
        _source,
    )

DAILY = ("goldstein_mean", "goldstein_min", "goldstein_max", "goldstein_std", "avg_tone")
COUNTS = ("mentions_total", "conflict_count", "cooperation_count")


@query(
    "daily_event_features",
    q("SELECT date, " + r(*DAILY) + ", " + big(*COUNTS) + " FROM daily", "daily"),
)
def _(f):
    return features.daily_event_features(
        f.bronze_events, goldstein_metrics=("mean", "min", "max", "std")
    )


@query(
    "flag_event_rows",
    q(
        "SELECT event_date AS date, CAST(event_root_code IN ('18', '19', '20') AS BIGINT) AS is_conflict, "
        "CAST(event_root_code IN ('03', '04', '05', '06') AS BIGINT) AS is_cooperation, count(*) AS n, "
        + r("sum(coalesce(goldstein_scale, 0)) AS goldstein") + ", "
        + big("sum(coalesce(num_mentions, 0)) AS mentions") + " FROM b_events GROUP BY ALL",
        "b_events",
    ),
)
def _(f):
    return features.flag_event_rows(f.bronze_events).groupBy(
        "date", "is_conflict", "is_cooperation"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("goldstein_scale").alias("goldstein"),
        F.sum("num_mentions").alias("mentions"),
    )


@query(
    "aggregate_events",
    q("SELECT date, " + r("goldstein_mean", "goldstein_std", "avg_tone") + ", "
      + big("mentions_total", "mentions_max", "conflict_count", "cooperation_count") + " FROM daily", "daily"),
)
def _(f):
    return features.aggregate_events(
        features.flag_event_rows(f.bronze_events),
        goldstein_metrics=("mean", "std"),
        mention_metrics=("sum", "max"),
    )


@query(
    "merge_market_events",
    q("SELECT symbol, date, " + r("close", "log_return", "daily_return", "goldstein_mean",
      "goldstein_min", "goldstein_max", "avg_tone") + ", " + big(*COUNTS) + " FROM merged", "merged"),
)
def _(f):
    return features.merge_market_events(
        features.market_columns(f.silver_market), features.daily_event_features(f.bronze_events)
    )


@query(
    "rolling_stats",
    q("SELECT symbol, date, " + r("abs_return", "rolling_mean", "rolling_std", "z_score",
      "volume_change", "volume_zscore") + " FROM anomaly_stats", "anomaly_stats"),
)
def _(f):
    return features.rolling_stats(features.market_columns(f.silver_market, volume=True)).select(
        "symbol", "date", "abs_return", "rolling_mean", "rolling_std", "z_score",
        "volume_change", "volume_zscore",
    )


@query(
    "anomaly_event_agg",
    q("SELECT date, " + r("goldstein_mean", "goldstein_min") + ", "
      + big("event_count", "mentions_total") + " FROM anomaly_events", "anomaly_events"),
)
def _(f):
    return features.anomaly_event_agg(f.bronze_events, "1994-11-22", SPAN[1])


@query(
    "anomaly_features",
    q("SELECT symbol, date, " + r("close", "log_return", "daily_return", "abs_return",
      "rolling_mean", "rolling_std", "z_score", "volume_change", "volume_zscore",
      "goldstein_mean", "goldstein_min") + ", " + big("volume", "event_count", "mentions_total")
      + " FROM anomaly_features", "anomaly_features"),
)
def _(f):
    return features.anomaly_features(f.silver_market, f.bronze_events, *SPAN)


def _feature_sql(names, rows):
    return q(
        "SELECT symbol, date, " + r(*names, "log_return")
        + ", CAST(log_return > 0 AS BIGINT) AS target FROM "
        f"(SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM merged) WHERE n >= {rows}",
        "merged",
    )


@query("classification_features", _feature_sql(features.CLASSIFICATION_FEATURES, 20))
def _(f):
    return features.classification_features(f.silver_market, f.bronze_events)


@query("regression_features", _feature_sql(features.REGRESSION_FEATURES, 10))
def _(f):
    return features.regression_features(f.silver_market, f.bronze_events)


@query("extended_features", _feature_sql(features.EXTENDED_FEATURES, 30))
def _(f):
    return features.extended_features(f.silver_market, f.bronze_events)


@query(
    "up_target",
    q("SELECT symbol, CAST(log_return > 0 AS BIGINT) AS up, "
      "CAST(abs(log_return) >= 0.015 AS BIGINT) AS moved, count(*) AS n FROM merged GROUP BY ALL", "merged"),
)
def _(f):
    merged = correlation.merged_daily(f.silver_market, f.bronze_events)
    return merged.groupBy(
        "symbol", X.up_target("log_return").alias("up"), X.move_target("log_return").alias("moved")
    ).agg(F.count(F.lit(1)).alias("n"))


# ---- correlations --------------------------------------------------------------------
CORR = "symbol, event_metric, n_observations, " + r("correlation", "p_value")
RANKED = (
    "symbol, event_metric, n_observations, CASE WHEN correlation > 0 THEN 'positive' ELSE "
    "'negative' END AS direction, " + r("correlation", "p_value", "abs(correlation) AS abs_correlation")
)


@query("correlations", q(f"SELECT {CORR}, 'pearson' AS method FROM corr_pearson", "corr_pearson"))
def _(f):
    return correlation.correlations(correlation.merged_daily(f.silver_market, f.bronze_events))


@query(
    "correlations_spearman",
    q(f"SELECT {CORR}, 'spearman' AS method FROM corr_spearman", "corr_spearman"),
)
def _(f):
    return correlation.correlations(
        correlation.merged_daily(f.silver_market, f.bronze_events), "spearman"
    )


@query(
    "top_correlated_pairs",
    q(f"SELECT {RANKED}, 'pearson' AS method FROM corr_pearson "
      "ORDER BY abs(corr_pearson.correlation) DESC, symbol, event_metric LIMIT 20", "corr_pearson"),
)
def _(f):
    return correlation.top_correlated_pairs(
        correlation.merged_daily(f.silver_market, f.bronze_events)
    )


@query(
    "corr_direction",
    q("SELECT event_metric, CASE WHEN correlation > 0 THEN 'positive' ELSE 'negative' END AS direction, "
      "count(*) AS n FROM corr_pearson GROUP BY ALL", "corr_pearson"),
)
def _(f):
    c = correlation.correlations(correlation.merged_daily(f.silver_market, f.bronze_events))
    return c.groupBy("event_metric", X.corr_direction("correlation").alias("direction")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "correlation_heatmap",
    q(
        "SELECT s.symbol, "
        + r(*[f"coalesce(max(correlation) FILTER (event_metric = '{m}'), 0) AS {m}" for m in METRICS])
        + " FROM (SELECT DISTINCT symbol FROM merged) s LEFT JOIN corr_pearson c ON s.symbol = c.symbol "
        "GROUP BY s.symbol",
        "merged corr_pearson",
    ),
)
def _(f):
    return correlation.correlation_heatmap(
        correlation.merged_daily(f.silver_market, f.bronze_events)
    )


@query(
    "rolling_correlation",
    q(
        "SELECT symbol, date, 'conflict_count' AS event_metric, CAST(30 AS BIGINT) AS window_days, "
        + r("c AS correlation",
            "tanh(atanh(least(greatest(c, -0.999), 0.999)) + 1.96 / sqrt(27)) AS upper_ci",
            "tanh(atanh(least(greatest(c, -0.999), 0.999)) - 1.96 / sqrt(27)) AS lower_ci")
        + """ FROM (SELECT symbol, date, count(*) OVER w AS n, total,
                    CASE WHEN stddev_samp(conflict_count) OVER w > 0 AND stddev_samp(log_return) OVER w > 0
                         THEN covar_samp(conflict_count, log_return) OVER w
                              / (stddev_samp(conflict_count) OVER w * stddev_samp(log_return) OVER w) END AS c
              FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS total FROM merged)
              WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
              WHERE n >= 15 AND total >= 40 AND c IS NOT NULL""",
        "merged",
    ),
)
def _(f):
    return correlation.rolling_correlation(
        correlation.merged_daily(f.silver_market, f.bronze_events)
    )


# ---- patterns --------------------------------------------------------------------------
cte(
    "tagged",
    f"""SELECT DISTINCT date, g AS event_group, c AS country FROM (
          SELECT event_date AS date, event_group AS g, NULL AS c FROM be WHERE event_group <> 'other'
          UNION ALL
          SELECT event_date, NULL, unnest([actor1_country_code, actor2_country_code, country_code]) FROM be
          UNION ALL
          SELECT event_date, event_group, unnest([actor1_country_code, actor2_country_code, country_code])
          FROM be WHERE event_group IN {codes(patterns.COMBINED_GROUPS)})
        WHERE g IS NOT NULL OR c IS NOT NULL""",
    "be",
)
_LABEL = (
    "CASE WHEN event_group IS NULL AND country IS NULL THEN 'all events' ELSE "
    "concat_ws(' ', replace(event_group, '_', ' '), 'in ' || country) END"
)


def _pattern_sql(source: str, keys: str) -> str:
    t = "(mean * sqrt(n) / sd)"
    return f"""SELECT {keys}, n AS total_occurrences, up_count, down_count,
                      up_count / n * 100 AS up_percentage, coalesce(up * 100, 0) AS avg_return_up,
                      coalesce(down * 100, 0) AS avg_return_down, mean * 100 AS avg_return_all,
                      med * 100 AS median_return, {t} AS t_statistic,
                      {t_two_sided(t, 'n - 1')} AS p_value
               FROM (SELECT {keys}, count(*) AS n, count(*) FILTER (log_return > 0) AS up_count,
                            count(*) FILTER (log_return <= 0) AS down_count,
                            avg(log_return) FILTER (log_return > 0) AS up,
                            avg(log_return) FILTER (log_return <= 0) AS down,
                            avg(log_return) AS mean, median(log_return) AS med,
                            nullif(stddev_samp(log_return), 0) AS sd
                     FROM {source} GROUP BY {keys}) WHERE n >= 5"""


cte(
    "pattern_days",
    """SELECT m.symbol, t.event_group, t.country, m.date, m.log_return
       FROM silver_market m JOIN tagged t ON m.date = t.date
       LEFT JOIN symbol_countries s ON s.symbol = m.symbol AND s.country_code = t.country
       WHERE m.log_return IS NOT NULL AND (t.country IS NULL OR s.symbol IS NOT NULL)""",
    "silver_market tagged symbol_countries",
)
cte("patterns", _pattern_sql("pattern_days", "symbol, event_group, country"), "pattern_days")
PATTERN = big("total_occurrences", "up_count", "down_count") + ", " + r(
    "up_percentage", "avg_return_up", "avg_return_down", "avg_return_all", "median_return",
    "t_statistic", "p_value",
)


@query(
    "all_patterns",
    q(f"SELECT symbol, {_LABEL} AS event_filter, {PATTERN} FROM patterns WHERE total_occurrences >= 10",
      "patterns"),
)
def _(f):
    return patterns.all_patterns(f.silver_market, f.events)


cte(
    "violent_rus",
    """SELECT event_date AS date, count(*) AS event_count,
              avg(coalesce(goldstein_scale, 0)) AS avg_goldstein, sum(num_mentions) AS total_mentions
       FROM be WHERE event_root_code IN ('18', '19', '20')
         AND (actor1_country_code = 'RUS' OR actor2_country_code = 'RUS' OR country_code = 'RUS')
       GROUP BY event_date""",
    "be",
)
cte(
    "violent_rus_returns",
    """SELECT symbol, log_return FROM silver_market m JOIN violent_rus v ON m.date = v.date
       WHERE log_return IS NOT NULL""",
    "silver_market violent_rus",
)
cte("one_pattern", _pattern_sql("violent_rus_returns", "symbol"), "violent_rus_returns")


@query(
    "historical_pattern",
    q(f"SELECT symbol, 'violent conflict in RUS' AS event_filter, {PATTERN} FROM one_pattern", "one_pattern"),
)
def _(f):
    return patterns.historical_pattern(f.silver_market, f.events, "violent_conflict", "RUS")


@query(
    "pattern_label",
    q(f"SELECT {_LABEL} AS event_filter, count(*) AS days FROM tagged "
      "WHERE country IS NULL OR country IN (SELECT country_code FROM symbol_countries) GROUP BY ALL",
      "tagged symbol_countries"),
)
def _(f):
    days = patterns.tagged_days(f.events)
    return days.groupBy(patterns.pattern_label("event_group", "country").alias("event_filter")).agg(
        F.count(F.lit(1)).alias("days")
    )


@query("event_date_counts", q("SELECT date, event_count FROM violent_rus", "violent_rus"))
def _(f):
    return patterns.event_date_counts(f.events, root_codes=ref.VIOLENT_ROOTS, country="RUS")


@query(
    "event_day_agg_having",
    q("SELECT date, " + big("event_count", "total_mentions") + ", " + r("avg_goldstein")
      + " FROM violent_rus WHERE event_count >= 2", "violent_rus"),
)
def _(f):
    return patterns.event_day_agg_having(f.events, "violent_conflict", "RUS", 2)


@query(
    "event_day_returns",
    q("SELECT m.symbol, m.date, v.event_count, " + r("m.log_return") + " FROM silver_market m "
      "JOIN violent_rus v ON m.date = v.date WHERE log_return IS NOT NULL", "silver_market violent_rus"),
)
def _(f):
    days = patterns.event_date_counts(f.events, root_codes=ref.VIOLENT_ROOTS, country="RUS")
    return patterns.event_day_returns(f.silver_market.select("symbol", "date", "log_return"), days)


@query(
    "t_test_1samp",
    q(
        "SELECT symbol, n, " + r("m * sqrt(n) / s AS t_statistic", t_two_sided("(m * sqrt(n) / s)", "n - 1") + " AS p_value")
        + " FROM (SELECT symbol, count(log_return) AS n, avg(log_return) AS m, stddev_samp(log_return) AS s "
        "FROM silver_market GROUP BY symbol)",
        "silver_market",
    ),
)
def _(f):
    ret = F.col("log_return")
    return (
        f.silver_market.groupBy("symbol")
        .agg(
            F.count(ret).alias("n"),
            X.safe_ratio(F.avg(ret) * F.sqrt(F.count(ret)), F.stddev_samp(ret)).alias("t_statistic"),
        )
        .withColumn("p_value", t_sf("t_statistic", (F.col("n") - 1).cast("double")))
    )


# ---- event study -----------------------------------------------------------------------
STUDY = r("car", "car * 100 AS car_percent", "t_statistic", "p_value", "expected_return",
          "actual_return", "std_dev") + ", " + big("estimation_days", "event_days")
_SHOWN = ["car", "car_percent", "t_statistic", "p_value", "expected_return", "actual_return",
          "std_dev", "estimation_days", "event_days"]


@query(
    "interval_join_event_study",
    q("SELECT symbol, event_date, " + r("expected_return", "std_dev", "actual_return") + ", "
      + big("estimation_days", "event_days") + " FROM study_windows", "study_windows"),
)
def _(f):
    return (
        event_study.interval_aggregates(f.silver_market, study_pairs(f))
        .filter((F.col("estimation_days") > 0) | (F.col("event_days") > 0))
        .select("symbol", "event_date", "expected_return", "std_dev", "actual_return",
                "estimation_days", "event_days")
    )


@query("event_study", q(f"SELECT symbol, event_date, {STUDY} FROM event_study", "event_study"))
def _(f):
    return event_study.event_study(f.silver_market, study_pairs(f)).select(
        "symbol", "event_date", *_SHOWN
    )


@query("event_study_inference")
def _(f):
    """Confidence bands and signed-rank p values (checked by unit tests)."""
    return event_study.event_study(f.silver_market, study_pairs(f)).select(
        "symbol", "event_date", "ci_lower", "ci_upper", "wilcoxon_p", "is_significant"
    )


@query(
    "event_study_batch",
    q(
        f"SELECT p.event_id, p.symbol, p.event_date, {STUDY} FROM study_pairs p "
        "JOIN event_study s ON p.symbol = s.symbol AND p.event_date = s.event_date",
        "study_pairs event_study",
    ),
)
def _(f):
    return event_study.event_study_batch(f.silver_market, study_pairs(f)).select(
        "event_id", "symbol", "event_date", *_SHOWN
    )


# ---- regression ------------------------------------------------------------------------
# Gram-Schmidt in SQL: each predictor is freed of the earlier ones, so R-squared is a sum of
# squared correlations and the last coefficients follow by back substitution.
cte("x0", "SELECT symbol, date, log_return AS y, goldstein_mean AS x1, mentions_total AS x2, "
    "avg_tone AS x3, conflict_count AS x4 FROM merged", "merged")
cte("x1", "SELECT *, x1 - avg(x1) OVER (PARTITION BY symbol) AS q1 FROM x0", "x0")
cte("x2", """SELECT *, x2 - avg(x2) OVER p - b12 * q1 AS q2
             FROM (SELECT *, regr_slope(x2, q1) OVER p AS b12 FROM x1 WINDOW p AS (PARTITION BY symbol))
             WINDOW p AS (PARTITION BY symbol)""", "x1")
cte("x3", """SELECT *, x3 - avg(x3) OVER p - b13 * q1 - b23 * q2 AS q3
             FROM (SELECT *, regr_slope(x3, q1) OVER p AS b13, regr_slope(x3, q2) OVER p AS b23
                   FROM x2 WINDOW p AS (PARTITION BY symbol))
             WINDOW p AS (PARTITION BY symbol)""", "x2")
cte("x4", """SELECT *, x4 - avg(x4) OVER p - b14 * q1 - b24 * q2 - b34 * q3 AS q4
             FROM (SELECT *, regr_slope(x4, q1) OVER p AS b14, regr_slope(x4, q2) OVER p AS b24,
                          regr_slope(x4, q3) OVER p AS b34
                   FROM x3 WINDOW p AS (PARTITION BY symbol))
             WINDOW p AS (PARTITION BY symbol)""", "x3")
cte(
    "ols_parts",
    """SELECT symbol, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3,
              avg(x4) AS m4, any_value(b12) AS b12, any_value(b13) AS b13, any_value(b23) AS b23,
              any_value(b14) AS b14, any_value(b24) AS b24, any_value(b34) AS b34,
              regr_slope(y, q1) AS c1, regr_slope(y, q2) AS c2, regr_slope(y, q3) AS c3,
              regr_slope(y, q4) AS c4, regr_sxx(y, q1) AS s1, regr_sxx(y, q2) AS s2,
              regr_sxx(y, q3) AS s3, regr_sxx(y, q4) AS s4, regr_syy(y, q1) AS tss
       FROM x4 GROUP BY symbol""",
    "x4",
)
cte(
    "ols_sql",
    """SELECT *, c4 AS k4, c3 - b34 * c4 AS k3, c2 - b23 * (c3 - b34 * c4) - b24 * c4 AS k2,
              (c1 * c1 * s1 + c2 * c2 * s2 + c3 * c3 * s3 + c4 * c4 * s4) / tss AS r2,
              -b34 AS i34, -b24 + b23 * b34 AS i24, -b23 AS i23
       FROM ols_parts""",
    "ols_parts",
)
cte(
    "ols_se",
    """SELECT *, c1 - b12 * k2 - b13 * k3 - b14 * k4 AS k1, (1 - r2) * tss / (n - 5) AS s2e,
              -b12 AS i12, -b13 + b12 * b23 AS i13,
              -b14 + b12 * b24 + b13 * b34 - b12 * b23 * b34 AS i14
       FROM ols_sql""",
    "ols_sql",
)
cte(
    "ols_terms",
    """SELECT symbol, n, r2, 'goldstein_mean' AS term, k1 AS coef,
              sqrt(s2e * (1 / s1 + i12 * i12 / s2 + i13 * i13 / s3 + i14 * i14 / s4)) AS se FROM ols_se
       UNION ALL SELECT symbol, n, r2, 'mentions_total', k2,
              sqrt(s2e * (1 / s2 + i23 * i23 / s3 + i24 * i24 / s4)) FROM ols_se
       UNION ALL SELECT symbol, n, r2, 'avg_tone', k3, sqrt(s2e * (1 / s3 + i34 * i34 / s4)) FROM ols_se
       UNION ALL SELECT symbol, n, r2, 'conflict_count', k4, sqrt(s2e / s4) FROM ols_se
       UNION ALL SELECT symbol, n, r2, 'const', my - k1 * m1 - k2 * m2 - k3 * m3 - k4 * m4,
              sqrt(s2e * (1 / n + m1 * m1 / s1 + pow(m2 + i12 * m1, 2) / s2
                          + pow(m3 + i23 * m2 + i13 * m1, 2) / s3
                          + pow(m4 + i34 * m3 + i24 * m2 + i14 * m1, 2) / s4)) FROM ols_se""",
    "ols_se",
)
# F(4, d) has a closed upper tail.
cte(
    "ols_full",
    f"""SELECT *, 1 - (1 - r2) * (n - 1) / (n - 5) AS adj, coef / se AS t_value,
               (r2 / 4) / ((1 - r2) / (n - 5)) AS f_statistic,
               {t_two_sided('(coef / se)', 'n - 5')} AS p_value,
               pow(1 - r2, (n - 5) / 2) * (1 + (n - 5) / 2 * r2) AS f_pvalue
        FROM ols_terms""",
    "ols_terms",
)


def _ols(f):
    return regression.ols_regression(
        features.regression_features(f.silver_market, f.bronze_events)
    )


@query(
    "ols_regression",
    q("SELECT symbol, term, n AS n_observations, "
      + r("r2 AS r_squared", "adj AS adj_r_squared", "f_statistic", "f_pvalue", "coef",
          "se AS std_error", "t_value", "p_value") + " FROM ols_full", "ols_full"),
)
def _(f):
    return _ols(f).drop("ci_lower", "ci_upper", "n_features")


@query("ols_confidence")
def _(f):
    """Confidence limits per coefficient (quantile checked by unit tests)."""
    return _ols(f).select("symbol", "term", "coef", "ci_lower", "ci_upper")


@query(
    "ols_compare",
    q("SELECT symbol, any_value(n) AS n_obs, "
      "coalesce(string_agg(term, ', ' ORDER BY term) FILTER (p_value < 0.05 AND term <> 'const'), 'None') "
      "AS significant_predictors, "
      + r("any_value(r2) AS r_squared", "any_value(adj) AS adj_r_squared", "any_value(f_pvalue) AS f_pvalue",
          "max(coef) FILTER (term = 'goldstein_mean') AS goldstein_coef",
          "max(p_value) FILTER (term = 'goldstein_mean') AS goldstein_pval")
      + " FROM ols_full GROUP BY symbol", "ols_full"),
)
def _(f):
    return regression.ols_compare(_ols(f))


# ---- anomalies -------------------------------------------------------------------------
@query(
    "zscore_anomaly",
    q("SELECT symbol, date, zscore_anomaly FROM anomaly_flags", "anomaly_flags"),
)
def _(f):
    days = features.anomaly_features(f.silver_market, f.bronze_events, *SPAN)
    return anomalies.zscore_anomaly(days).select("symbol", "date", "zscore_anomaly")


@query(
    "event_mismatch",
    q("SELECT symbol, date, unexplained_move, muted_response FROM anomaly_flags", "anomaly_flags"),
)
def _(f):
    days = features.anomaly_features(f.silver_market, f.bronze_events, *SPAN)
    return anomalies.event_mismatch(days).select(
        "symbol", "date", "unexplained_move", "muted_response"
    )


@query(
    "isolation_forest",
    q("SELECT symbol, date, isolation_flag, " + r("isolation_score", "anomaly_probability") + " FROM forest_scores", "forest_scores"),
)
def _(f):
    days = features.anomaly_features(f.silver_market, f.bronze_events, *SPAN)
    return anomalies.isolation_forest(days).select(
        "symbol", "date", "isolation_flag", "isolation_score", "anomaly_probability"
    )


@query(
    "detect_anomalies",
    q("SELECT symbol, date, anomaly_type, detected_by, event_count, "
      + r("actual_return", "expected_return", "z_score", "isolation_score", "anomaly_probability", "avg_goldstein")
      + " FROM all_anomalies", "all_anomalies"),
)
def _(f):
    found = anomalies.detect_anomalies(f.silver_market, f.bronze_events, *SPAN)
    return found.withColumn("detected_by", F.array_join("detected_by", ","))


@query(
    "rule_anomalies",
    q("SELECT symbol, date, anomaly_type, detected_by, event_count, "
      + r("actual_return", "expected_return", "z_score", "avg_goldstein") + " FROM rule_anomalies",
      "rule_anomalies"),
)
def _(f):
    return rule_anomalies(f).withColumn("detected_by", F.array_join("detected_by", ",")).drop(
        "isolation_score", "anomaly_probability"
    )


@query(
    "top_anomalies",
    q("SELECT symbol, date, anomaly_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol "
      "ORDER BY abs(z_score) DESC, date) AS rank FROM rule_anomalies) WHERE rank <= 10", "rule_anomalies"),
)
def _(f):
    return anomalies.top_anomalies(rule_anomalies(f)).select("symbol", "date", "anomaly_type", "rank")


cte(
    "report",
    """SELECT h.symbol, trading_days, count(a.date) AS anomaly_count,
              count(*) FILTER (anomaly_type = 'unexplained_move') AS unexplained_moves,
              count(*) FILTER (anomaly_type = 'muted_response') AS muted_responses,
              count(*) FILTER (anomaly_type = 'statistical_outlier') AS statistical_outliers,
              CAST(DATE '2001-08-01' - DATE '1995-01-01' AS BIGINT) AS total_days
       FROM (SELECT symbol, count(*) AS trading_days FROM silver_market
             WHERE date BETWEEN DATE '1995-01-01' AND DATE '2001-08-01' GROUP BY symbol) h
       LEFT JOIN rule_anomalies a ON a.symbol = h.symbol GROUP BY h.symbol, trading_days""",
    "silver_market rule_anomalies",
)
_REPORT = "symbol, anomaly_count, unexplained_moves, muted_responses, statistical_outliers, "


@query(
    "anomaly_report",
    q(f"SELECT {_REPORT} trading_days, total_days, "
      + r("anomaly_count / total_days AS anomaly_rate", "anomaly_count / trading_days AS trading_day_rate")
      + " FROM report", "report"),
)
def _(f):
    return anomalies.anomaly_report(rule_anomalies(f), f.silver_market, *SPAN)


@query(
    "anomaly_compare",
    q(f"SELECT {_REPORT}" + r("anomaly_count / total_days AS anomaly_rate") + " FROM report", "report"),
)
def _(f):
    return anomalies.anomaly_compare(
        anomalies.anomaly_report(rule_anomalies(f), f.silver_market, *SPAN)
    )
