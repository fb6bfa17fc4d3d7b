"""Daily event features, rolling statistics and the feature sets built from them.

Every function handles all symbols in one job. Event aggregates are one row per date, so
whatever the size of the event table, everything after the first aggregation is bounded
by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens import reference as ref
from eventlens.functions import expressions as X

_AGG = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "sum": F.sum,
    "count": F.count,
}
CLASSIFICATION_FEATURES = [
    "goldstein_mean", "goldstein_min", "goldstein_max", "mentions_total", "avg_tone",
    "conflict_count", "cooperation_count",
]
REGRESSION_FEATURES = ["goldstein_mean", "mentions_total", "avg_tone", "conflict_count"]
EXTENDED_FEATURES = [
    "goldstein_mean", "goldstein_min", "goldstein_max", "goldstein_std", "mentions_total",
    "mentions_max", "avg_tone", "conflict_count", "cooperation_count",
]


def daily_event_features(
    events: DataFrame,
    start=None,
    end=None,
    goldstein_metrics: tuple[str, ...] = ("mean", "min", "max"),
    include_cooperation: bool = True,
    include_mentions_max: bool = False,
) -> DataFrame:
    """One row per event date; conflict = codes 18-20, cooperation = codes 03-06."""
    code = "event_root_code"
    aggs = [
        _AGG[m]("goldstein_scale").alias(f"goldstein_{m}") for m in goldstein_metrics
    ] + [
        F.sum("num_mentions").alias("mentions_total"),
        F.avg("avg_tone").alias("avg_tone"),
        X.count_if(X.in_codes(code, ref.VIOLENT_ROOTS)).alias("conflict_count"),
    ]
    if include_cooperation:
        aggs.append(
            X.count_if(X.in_codes(code, ref.FEATURE_COOPERATION_ROOTS)).alias(
                "cooperation_count"
            )
        )
    if include_mentions_max:
        aggs.append(F.max("num_mentions").alias("mentions_max"))
    return (
        events.filter(X.between_dates("event_date", start, end))
        .groupBy(F.col("event_date").alias("date"))
        .agg(*aggs)
        .fillna(0)
    )


def flag_event_rows(events: DataFrame, start=None, end=None) -> DataFrame:
    """Event rows with nulls as 0 and 0/1 conflict and cooperation columns."""
    code = "event_root_code"
    return (
        events.filter(X.between_dates("event_date", start, end))
        .select(
            F.col("event_date").alias("date"),
            "goldstein_scale",
            "num_mentions",
            "avg_tone",
            X.in_codes(code, ref.VIOLENT_ROOTS).cast("int").alias("is_conflict"),
            X.in_codes(code, ref.FEATURE_COOPERATION_ROOTS).cast("int").alias("is_cooperation"),
        )
        .fillna(0)
    )


def aggregate_events(
    flagged: DataFrame,
    goldstein_metrics: tuple[str, ...] = ("mean", "min", "max"),
    mention_metrics: tuple[str, ...] = ("sum",),
    include_cooperation: bool = True,
) -> DataFrame:
    """Aggregate flagged rows by date with the metrics asked for."""
    names = {"sum": "mentions_total", "max": "mentions_max"}
    aggs = [_AGG[m]("goldstein_scale").alias(f"goldstein_{m}") for m in goldstein_metrics]
    aggs += [
        _AGG[m]("num_mentions").alias(names.get(m, f"mentions_{m}")) for m in mention_metrics
    ]
    aggs += [F.avg("avg_tone").alias("avg_tone"), F.sum("is_conflict").alias("conflict_count")]
    if include_cooperation and "is_cooperation" in flagged.columns:
        aggs.append(F.sum("is_cooperation").alias("cooperation_count"))
    out = flagged.groupBy("date").agg(*aggs)
    return out.fillna(0, subset=["goldstein_std"]) if "goldstein_std" in out.columns else out


def market_columns(market: DataFrame, start=None, end=None, volume: bool = False) -> DataFrame:
    """The columns analytics read from Silver prices."""
    names = ["symbol", "date", "close", "log_return", "daily_return"]
    return market.filter(X.between_dates("date", start, end)).select(
        *names, *(["volume"] if volume else [])
    )


def merge_market_events(
    market: DataFrame, daily: DataFrame, drop_null_returns: bool = False
) -> DataFrame:
    """Left join on date; event-less days and missing returns become 0.

    The zero fill also covers a symbol's first return. ``drop_null_returns`` drops those
    rows instead.
    """
    m = market.dropna(subset=["log_return"]) if drop_null_returns else market
    return m.join(daily, "date", "left").fillna(0)


def _at_least(df: DataFrame, rows: int) -> DataFrame:
    """Keep symbols that have ``rows`` rows."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return df.withColumn("_n", n).filter(F.col("_n") >= rows).drop("_n")


def feature_set(
    market: DataFrame,
    events: DataFrame,
    features: list[str],
    min_samples: int,
    start=None,
    end=None,
) -> DataFrame:
    daily = daily_event_features(
        events,
        start,
        end,
        goldstein_metrics=("mean", "min", "max", "std"),
        include_mentions_max="mentions_max" in features,
    )
    merged = merge_market_events(market_columns(market, start, end), daily)
    return _at_least(merged, min_samples).select(
        "symbol",
        "date",
        *[F.col(c).cast("double").alias(c) for c in features],
        "log_return",
        X.up_target("log_return").alias("target"),
    )


def classification_features(market, events, start=None, end=None, min_samples: int = 20):
    return feature_set(market, events, CLASSIFICATION_FEATURES, min_samples, start, end)


def regression_features(market, events, start=None, end=None, min_samples: int = 10):
    return feature_set(market, events, REGRESSION_FEATURES, min_samples, start, end)


def extended_features(market, events, start=None, end=None, min_samples: int = 30):
    return feature_set(market, events, EXTENDED_FEATURES, min_samples, start, end)


def _frame(rows: int):
    return X.symbol_window().rowsBetween(-(rows - 1), 0)


def _rolling(fn, column: str | Column, rows: int, min_periods: int) -> Column:
    f = _frame(rows)
    return X.guarded(fn(column).over(f), F.count(column).over(f), min_periods)


def rolling_stats(df: DataFrame, lookback_days: int = 30, min_periods: int = 10) -> DataFrame:
    """Return z-score over a partial window, volume z-score over a full one.

    A symbol without any volume gets zeros for the two volume columns.
    """
    ret, vol = F.col("log_return"), F.col("volume")
    df = df.withColumns(
        {
            "abs_return": F.abs(ret),
            "rolling_mean": _rolling(F.avg, "log_return", lookback_days, min_periods),
            "rolling_std": _rolling(F.stddev_samp, "log_return", lookback_days, min_periods),
            "_has_volume": F.count("volume").over(Window.partitionBy("symbol")) > 0,
            "_prev_volume": F.lag("volume").over(X.symbol_window()),
            "_vol_mean": _rolling(F.avg, "volume", lookback_days, lookback_days),
            "_vol_std": _rolling(F.stddev_samp, "volume", lookback_days, lookback_days),
        }
    )

    def if_volume(c: Column) -> Column:
        return F.when(F.col("_has_volume"), c).otherwise(0.0)

    return df.withColumns(
        {
            "z_score": X.safe_ratio(ret - F.col("rolling_mean"), F.col("rolling_std")),
            "volume_change": if_volume(
                X.safe_ratio(vol - F.col("_prev_volume"), F.col("_prev_volume"))
            ),
            "volume_zscore": if_volume(
                X.safe_ratio(vol - F.col("_vol_mean"), F.col("_vol_std"))
            ),
        }
    ).drop("_has_volume", "_prev_volume", "_vol_mean", "_vol_std")


def anomaly_event_agg(events: DataFrame, start=None, end=None) -> DataFrame:
    zero = F.coalesce("goldstein_scale", F.lit(0.0))
    return (
        events.filter(X.between_dates("event_date", start, end))
        .groupBy(F.col("event_date").alias("date"))
        .agg(
            F.avg(zero).alias("goldstein_mean"),
            F.min(zero).alias("goldstein_min"),
            F.count(F.lit(1)).alias("event_count"),
            F.coalesce(F.sum("num_mentions"), F.lit(0)).alias("mentions_total"),
        )
    )


def anomaly_features(
    market: DataFrame, events: DataFrame, start=None, end=None, lookback_days: int = 30
) -> DataFrame:
    """Rolling stats warmed up on earlier days, plus the day's event figures."""
    warm = None if start is None else F.date_sub(F.lit(start).cast("date"), lookback_days + 10)
    prices = _at_least(market_columns(market, warm, end, volume=True), lookback_days)
    stats = rolling_stats(prices, lookback_days)
    daily = anomaly_event_agg(events, warm, end)
    return (
        stats.join(daily, "date", "left")
        .fillna(0, subset=["goldstein_mean", "goldstein_min", "event_count", "mentions_total"])
        .filter(X.between_dates("date", start, end))
        .dropna(subset=["log_return", "z_score"])
    )


# ---- daily training features ---------------------------------------------------------
def sentiment_daily_features(headlines: DataFrame, start=None, end=None) -> DataFrame:
    """Per date over scored headlines (Bronze shape)."""
    return (
        headlines.filter(
            X.timestamp_in_days("published_at", start, end)
            & F.col("sentiment_score").isNotNull()
        )
        .groupBy(F.to_date("published_at").alias("date"))
        .agg(
            F.avg("sentiment_score").alias("sentiment_mean"),
            F.min("sentiment_score").alias("sentiment_min"),
            F.max("sentiment_score").alias("sentiment_max"),
            F.count(F.lit(1)).alias("headline_count"),
        )
    )


def attach_daily_sentiment(df: DataFrame, daily: DataFrame) -> DataFrame:
    names = ["sentiment_mean", "sentiment_min", "sentiment_max", "headline_count"]
    return df.join(daily, "date", "left").fillna(0, subset=names)


def market_context(df: DataFrame) -> DataFrame:
    """Volatility, mean return, momentum and volume ratio over trailing rows."""
    w, close = X.symbol_window(), F.col("close")
    ago5, ago20 = F.lag("close", 5).over(w), F.lag("close", 20).over(w)
    return df.withColumns(
        {
            f"volatility_{n}d": _rolling(F.stddev_samp, "log_return", n, 3) for n in (5, 10, 20)
        }
        | {
            "return_5d_mean": _rolling(F.avg, "log_return", 5, 3),
            "return_20d_mean": _rolling(F.avg, "log_return", 20, 10),
            "momentum_5d": X.safe_ratio(close - ago5, ago5),
            "momentum_20d": X.safe_ratio(close - ago20, ago20),
            "volume_ratio": F.coalesce(
                X.safe_ratio(F.col("volume"), _rolling(F.avg, "volume", 20, 10)), F.lit(1.0)
            ),
        }
    )


def temporal_features(df: DataFrame) -> DataFrame:
    return df.withColumns(X.temporal_features("date"))


def event_velocity(df: DataFrame) -> DataFrame:
    """Value minus its trailing 5-row mean."""
    names = {
        "conflict_velocity": "conflict_count",
        "mentions_velocity": "mentions_total",
        "goldstein_trend": "goldstein_mean",
    }
    return df.withColumns(
        {out: F.col(c) - F.avg(c).over(_frame(5)) for out, c in names.items()}
    )
