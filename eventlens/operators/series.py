"""Economic indicator series and prediction-market snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions import expressions as X
from eventlens.operators.dedup import keep_best


def indicator_series(indicators: DataFrame, series_id: str, start=None, end=None) -> DataFrame:
    return indicators.filter(
        (F.col("series_id") == series_id) & X.between_dates("date", start, end)
    ).orderBy("date")


def indicator_deltas(indicators: DataFrame) -> DataFrame:
    """Latest value per series against the one before; percent of the previous value."""
    by = Window.partitionBy("series_id")
    value, prev = F.col("value"), F.col("previous_value")
    # Only the two newest rows of a series survive the first step.
    two = keep_best(indicators, ["series_id"], [F.col("date").desc()], n=2)
    return (
        two.withColumns(
            {
                "previous_value": F.lag("value").over(by.orderBy("date")),
                "previous_date": F.lag("date").over(by.orderBy("date")),
                "_rn": F.row_number().over(by.orderBy(F.col("date").desc())),
            }
        )
        .filter(F.col("_rn") == 1)
        .select(
            "series_id",
            "series_name",
            "date",
            "value",
            "previous_value",
            "previous_date",
            (value - prev).alias("change"),
            X.pct_of(value, prev).alias("change_pct"),
        )
    )


def latest_per_key(df: DataFrame, key: str, day: str) -> DataFrame:
    """Newest row per key in one pass (no self join on the maximum)."""
    ties = [F.col(c).desc() for c in ("snapshot_at", "id") if c in df.columns]
    return keep_best(df, [key], [F.col(day).desc(), *ties])


def latest_indicators(indicators: DataFrame) -> DataFrame:
    return latest_per_key(indicators, "series_id", "date")


def latest_predictions(snapshots: DataFrame, limit: int = 50) -> DataFrame:
    """Newest snapshot of each market, most traded first."""
    return (
        latest_per_key(snapshots, "market_id", "snapshot_date")
        .orderBy(F.col("volume_24h").desc_nulls_first(), "market_id")
        .limit(limit)
    )


def daily_snapshots(observed: DataFrame) -> DataFrame:
    """First snapshot of each market and UTC day."""
    s = observed.withColumn("snapshot_at", F.col("snapshot_at").cast("timestamp")).withColumn(
        "snapshot_date", F.to_date("snapshot_at")
    )
    ties = ["id"] if "id" in s.columns else []
    return keep_best(s, ["market_id", "snapshot_date"], [F.col("snapshot_at"), *map(F.col, ties)])


def market_snapshots(snapshots: DataFrame, market_id: str, start=None, end=None) -> DataFrame:
    return snapshots.filter(
        (F.col("market_id") == market_id) & X.between_dates("snapshot_date", start, end)
    ).orderBy("snapshot_date")


def asof_snapshot_compare(snapshots: DataFrame, days_back: int = 7) -> DataFrame:
    """Markets seen on the last day against their newest snapshot ``days_back`` earlier.

    Both sides are conditional ``max_by`` in one aggregation; the last day is a scalar
    subquery.
    """
    last = snapshots.agg(F.max("snapshot_date")).scalar()
    day = F.col("snapshot_date")
    earlier = day <= F.date_sub(last, days_back)
    now = F.struct("question", "event_title", "yes_price", "snapshot_date")
    then = F.struct("yes_price", "snapshot_date")
    both = (
        snapshots.filter((day == last) | earlier)
        .groupBy("market_id")
        .agg(
            F.max_by(F.when(day == last, now), F.when(day == last, day)).alias("_now"),
            F.max_by(F.when(earlier, then), F.when(earlier, day)).alias("_then"),
        )
        .filter(F.col("_now").isNotNull() & F.col("_then").isNotNull())
    )
    current, previous = F.col("_now.yes_price"), F.col("_then.yes_price")
    return both.select(
        "market_id",
        F.col("_now.question").alias("question"),
        F.col("_now.event_title").alias("event_title"),
        current.alias("current_price"),
        previous.alias("previous_price"),
        (current - previous).alias("price_change"),
        F.abs(current - previous).alias("abs_change"),
        F.col("_now.snapshot_date").alias("snapshot_date"),
        F.col("_then.snapshot_date").alias("previous_date"),
    )


def prediction_movers(snapshots: DataFrame, days_back: int = 7, limit: int = 10) -> DataFrame:
    return (
        asof_snapshot_compare(snapshots, days_back)
        .orderBy(F.col("abs_change").desc(), "market_id")
        .limit(limit)
    )
