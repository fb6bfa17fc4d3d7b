"""Abnormal returns around events, for every (symbol, date) probe in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions import expressions as X
from eventlens.functions.distributions import t_ppf_975, t_sf, wilcoxon_exact

ESTIMATION_DAYS = 30
BEFORE, AFTER = 1, 5
ALPHA = 0.05


def interval_aggregates(
    market: DataFrame,
    probes: DataFrame,
    estimation_days: int = ESTIMATION_DAYS,
    before: int = BEFORE,
    after: int = AFTER,
) -> DataFrame:
    """Return statistics in the calendar windows around each probe date.

    A range join would compare every probe with every price. Instead probe rows (null
    return) are unioned with the price rows and read RANGE frames over the day number;
    aggregates skip the nulls. Probes are distinct, so a symbol's partition stays within
    two rows per calendar day.
    """
    p = probes.select(
        "symbol", F.col("event_date").alias("date"), F.lit(None).cast("double").alias("ret"),
        F.lit(True).alias("_probe"),
    ).distinct()
    m = market.dropna(subset=["log_return"]).select(
        "symbol", "date", F.col("log_return").alias("ret"), F.lit(False).alias("_probe")
    )
    w = Window.partitionBy("symbol").orderBy("_day")
    gap = before + 1
    est = w.rangeBetween(-(gap + estimation_days + 10), -gap)
    evt = w.rangeBetween(-before, after)
    rows = m.unionByName(p).withColumn("_day", X.day_number("date"))
    return (
        rows.withColumns(
            {
                "expected_return": F.avg("ret").over(est),
                "std_dev": F.stddev_samp("ret").over(est),
                "estimation_days": F.count("ret").over(est),
                "actual_return": F.sum("ret").over(evt),
                "event_days": F.count("ret").over(evt),
                "_event_sd": F.stddev_samp("ret").over(evt),
                "_returns": F.collect_list("ret").over(evt),
            }
        )
        .filter("_probe")
        .drop("_probe", "ret", "_day")
        .withColumnRenamed("date", "event_date")
    )


def event_study(
    market: DataFrame,
    probes: DataFrame,
    estimation_days: int = ESTIMATION_DAYS,
    before: int = BEFORE,
    after: int = AFTER,
    alpha: float = ALPHA,
) -> DataFrame:
    """CAR, its t-test, confidence band and signed-rank p per (symbol, event_date)."""
    s = interval_aggregates(market, probes, estimation_days, before, after).filter(
        (F.col("estimation_days") >= 10) & (F.col("event_days") >= 1)
    )
    n, est_n = F.col("event_days"), F.col("estimation_days")
    car, sd, mean = F.col("car"), F.col("std_dev"), F.col("expected_return")
    many = n > 1
    s = s.withColumn("car", F.col("actual_return") - n * mean)
    s = s.withColumns(
        {
            "t_statistic": F.when(
                many, X.safe_ratio(car / n * F.sqrt(n), F.col("_event_sd"))
            ).otherwise(F.coalesce(X.safe_ratio(car, sd), F.lit(0.0))),
            "_df": F.when(many, n - 1).otherwise(est_n - 1).cast("double"),
            "_half": t_ppf_975((est_n - 1).cast("double")) * sd * F.sqrt(n),
            "wilcoxon_p": wilcoxon_exact(
                F.transform("_returns", lambda x: x - F.col("expected_return"))
            ),
        }
    ).withColumn("p_value", t_sf("t_statistic", "_df"))
    return s.select(
        "symbol",
        "event_date",
        "car",
        (car * 100).alias("car_percent"),
        "t_statistic",
        "p_value",
        F.coalesce(F.col("p_value") < alpha, F.lit(False)).alias("is_significant"),
        (car - F.col("_half")).alias("ci_lower"),
        (car + F.col("_half")).alias("ci_upper"),
        "expected_return",
        "actual_return",
        "std_dev",
        "wilcoxon_p",
        "estimation_days",
        "event_days",
    )


def event_study_batch(market: DataFrame, event_assets: DataFrame, **windows) -> DataFrame:
    """Study each distinct (symbol, date) once, then attach it to all its events.

    ``event_assets``: (event_id, symbol, event_date). Many events share a day; the joined
    side is one row per (symbol, day), which AQE splits around if a day is hot.
    """
    studied = event_study(market, event_assets, **windows)
    return event_assets.join(studied, ["symbol", "event_date"])
