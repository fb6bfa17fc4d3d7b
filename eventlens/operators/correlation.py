"""Correlation of daily event metrics with returns, for all symbols in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions import expressions as X
from eventlens.functions.distributions import t_sf
from eventlens.operators import features

EVENT_METRICS = [
    "goldstein_mean", "mentions_total", "avg_tone", "conflict_count", "cooperation_count",
]
MIN_ROWS = 10


def merged_daily(market: DataFrame, events: DataFrame, start=None, end=None) -> DataFrame:
    daily = features.daily_event_features(events, start, end, goldstein_metrics=("mean",))
    return features.merge_market_events(features.market_columns(market, start, end), daily)


def _average_rank(value: str) -> Column:
    """Mean rank over ties within (symbol, metric)."""
    by = Window.partitionBy("symbol", "event_metric")
    peers = F.count(F.lit(1)).over(Window.partitionBy("symbol", "event_metric", value))
    return F.rank().over(by.orderBy(value)) + (peers - 1) / 2


def correlations(merged: DataFrame, method: str = "pearson") -> DataFrame:
    """One row per (symbol, event_metric); metrics without variance are left out."""
    long = merged.select(
        "symbol", "date", "log_return", *[F.col(m).cast("double").alias(m) for m in EVENT_METRICS]
    ).unpivot(["symbol", "date", "log_return"], EVENT_METRICS, "event_metric", "x")
    y = "log_return"
    if method == "spearman":
        long = long.withColumns({"rx": _average_rank("x"), "ry": _average_rank("log_return")})
        long = long.select("symbol", "event_metric", F.col("rx").alias("x"), F.col("ry").alias(y))
    r, n = F.col("correlation"), F.col("n_observations")
    stats = (
        long.groupBy("symbol", "event_metric")
        .agg(
            X.safe_corr(F.col("x"), F.col(y)).alias("correlation"),
            F.count(F.lit(1)).alias("n_observations"),
        )
        .filter((n >= MIN_ROWS) & r.isNotNull())
    )
    t = r * F.sqrt(n - 2) / F.sqrt(F.greatest(1 - r * r, F.lit(1e-300)))
    return stats.withColumn("p_value", t_sf(t, (n - 2).cast("double"))).withColumn(
        "method", F.lit(method)
    )


def rolling_correlation(
    merged: DataFrame, event_metric: str = "conflict_count", window_days: int = 30
) -> DataFrame:
    """Trailing-row correlation with a 95 % Fisher band, per symbol and date."""
    frame = X.symbol_window().rowsBetween(-(window_days - 1), 0)
    x, y = F.col(event_metric).cast("double"), F.col("log_return")
    corr = X.safe_ratio(
        F.covar_samp(x, y).over(frame), F.stddev_samp(x).over(frame) * F.stddev_samp(y).over(frame)
    )
    z = F.atanh(F.least(F.greatest(F.col("correlation"), F.lit(-0.999)), F.lit(0.999)))
    half = 1.96 / max(window_days - 3, 1) ** 0.5
    return (
        merged.withColumns(
            {
                "correlation": X.guarded(
                    corr, F.count(F.lit(1)).over(frame), max(10, window_days // 2)
                ),
                "_n": F.count(F.lit(1)).over(Window.partitionBy("symbol")),
            }
        )
        .filter((F.col("_n") >= window_days + 10) & F.col("correlation").isNotNull())
        .select(
            "symbol",
            "date",
            "correlation",
            F.tanh(z + half).alias("upper_ci"),
            F.tanh(z - half).alias("lower_ci"),
            F.lit(event_metric).alias("event_metric"),
            F.lit(window_days).alias("window_days"),
        )
    )


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "abs_correlation": F.abs("correlation"),
            "direction": X.corr_direction("correlation"),
        }
    ).orderBy(F.col("abs_correlation").desc(), "symbol", "event_metric")


def top_correlated_pairs(merged: DataFrame, method: str = "pearson", limit: int = 20) -> DataFrame:
    return _ranked(correlations(merged, method)).limit(limit)


def cached_correlations(cache: DataFrame, method: str = "pearson", limit: int = 20) -> DataFrame:
    """Strongest stored pairs of a method."""
    return _ranked(cache.filter(F.col("method") == method)).limit(limit)


def correlation_heatmap(merged: DataFrame, method: str = "pearson") -> DataFrame:
    """Symbols x metrics; 0 where no correlation exists."""
    symbols = merged.select("symbol").distinct()
    grid = (
        correlations(merged, method)
        .groupBy("symbol")
        .pivot("event_metric", EVENT_METRICS)
        .agg(F.first("correlation"))
    )
    return symbols.join(grid, "symbol", "left").fillna(0.0)
