"""Anomalous days: isolation forest, z-score and event/market mismatch rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions import expressions as X
from eventlens.functions.forest import isolation_scores
from eventlens.operators import features

Z_THRESHOLD = 2.0
CONTAMINATION = 0.05
FOREST_FEATURES = ["log_return", "abs_return", "z_score", "goldstein_mean", "event_count"]
METHODS = {
    "isolation_forest": "isolation_flag",
    "zscore": "zscore_anomaly",
    "unexplained_move": "unexplained_move",
    "muted_response": "muted_response",
}


def zscore_anomaly(df: DataFrame, threshold: float = Z_THRESHOLD) -> DataFrame:
    return df.withColumn("zscore_anomaly", F.abs("z_score") > threshold)


def event_mismatch(df: DataFrame) -> DataFrame:
    """Large move without events, or strong event without a move."""
    return df.withColumns(
        {
            "unexplained_move": (F.abs("z_score") > 1.5) & (F.col("event_count") == 0),
            "muted_response": (F.abs("goldstein_min") > 5) & (F.col("abs_return") < 0.005),
        }
    )


def isolation_forest(df: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """Add isolation_flag, isolation_score and anomaly_probability per symbol.

    A symbol has at most one row per calendar day, so its group is small by construction.
    """
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("isolation_flag", T.BooleanType()),
            T.StructField("isolation_score", T.DoubleType()),
            T.StructField("anomaly_probability", T.DoubleType()),
        ]
    )

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").reset_index(drop=True)
        x = np.nan_to_num(pdf[FOREST_FEATURES].to_numpy(float))
        raw = isolation_scores(x)
        decision = raw - np.percentile(raw, 100 * contamination)
        low, high = decision.min(), decision.max()
        return pdf.assign(
            isolation_flag=np.round(decision, 12) < 0,
            isolation_score=decision,
            anomaly_probability=1 - (decision - low) / (high - low + 1e-10),
        )

    return df.groupBy("symbol").applyInPandas(score, schema)


def _without_forest(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "isolation_flag": F.lit(False),
            "isolation_score": F.lit(0.0),
            "anomaly_probability": F.lit(0.0),
        }
    )


def flag_days(df: DataFrame, forest: bool = True, threshold: float = Z_THRESHOLD) -> DataFrame:
    scored = isolation_forest(df) if forest else _without_forest(df)
    return event_mismatch(zscore_anomaly(scored, threshold))


def detect_anomalies(
    market: DataFrame,
    events: DataFrame,
    start=None,
    end=None,
    lookback_days: int = 30,
    forest: bool = True,
) -> DataFrame:
    """Days that any method flags, with the methods and the primary type."""
    days = flag_days(
        features.anomaly_features(market, events, start, end, lookback_days), forest
    )
    found = F.array_compact(
        F.array(*[F.when(F.col(c), F.lit(name)) for name, c in METHODS.items()])
    )
    return (
        days.withColumn("detected_by", found)
        .filter(F.size("detected_by") > 0)
        .select(
            "symbol",
            "date",
            F.when(F.col("unexplained_move"), "unexplained_move")
            .when(F.col("muted_response"), "muted_response")
            .otherwise("statistical_outlier")
            .alias("anomaly_type"),
            F.col("log_return").alias("actual_return"),
            F.coalesce("rolling_mean", F.lit(0.0)).alias("expected_return"),
            F.coalesce("z_score", F.lit(0.0)).alias("z_score"),
            "isolation_score",
            "anomaly_probability",
            "event_count",
            F.col("goldstein_mean").alias("avg_goldstein"),
            "detected_by",
        )
    )


def top_anomalies(anomalies: DataFrame, n: int = 10) -> DataFrame:
    """The n likeliest anomalies of each symbol."""
    w = Window.partitionBy("symbol").orderBy(
        F.col("anomaly_probability").desc(), F.abs("z_score").desc(), "date"
    )
    return anomalies.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def anomaly_report(anomalies: DataFrame, market: DataFrame, start, end) -> DataFrame:
    """Counts by type and rates per symbol of ``market``, quiet symbols included.

    ``anomaly_rate`` divides by calendar days of the period; ``trading_day_rate`` by the
    price rows in it.
    """
    kind, n = F.col("anomaly_type"), F.col("anomaly_count")
    total = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date"))
    held = (
        market.filter(X.between_dates("date", start, end))
        .groupBy("symbol")
        .agg(F.count(F.lit(1)).alias("trading_days"))
    )
    counts = anomalies.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("anomaly_count"),
        X.count_if(kind == "unexplained_move").alias("unexplained_moves"),
        X.count_if(kind == "muted_response").alias("muted_responses"),
        X.count_if(kind == "statistical_outlier").alias("statistical_outliers"),
    )
    return (
        held.join(counts, "symbol", "left")
        .fillna(0)
        .withColumns(
            {
                "total_days": total,
                "anomaly_rate": n / F.greatest(total, F.lit(1)),
                "trading_day_rate": n / F.col("trading_days"),
            }
        )
    )


def anomaly_compare(report: DataFrame) -> DataFrame:
    return report.select(
        "symbol",
        "anomaly_count",
        "anomaly_rate",
        "unexplained_moves",
        "muted_responses",
        "statistical_outliers",
    ).orderBy(F.col("anomaly_rate").desc(), "symbol")
