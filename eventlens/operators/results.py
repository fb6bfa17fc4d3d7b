"""The stored table of analysis results: rows to write, and the queries over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions import expressions as X
from eventlens.operators.event_study import AFTER, BEFORE, ESTIMATION_DAYS

COLUMNS = {
    "event_id": "string",
    "symbol": "string",
    "analysis_type": "string",
    "car": "double",
    "car_t_stat": "double",
    "car_p_value": "double",
    "estimation_window_start": "date",
    "estimation_window_end": "date",
    "event_window_start": "date",
    "event_window_end": "date",
    "expected_return": "double",
    "actual_return": "double",
    "abnormal_return": "double",
    "is_anomaly": "boolean",
    "anomaly_type": "string",
    "anomaly_score": "double",
    "is_significant": "boolean",
}


def _shaped(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(
        *[
            (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
            for c, t in COLUMNS.items()
        ]
    )


def from_event_study(studied: DataFrame) -> DataFrame:
    """Rows of ``event_study_batch`` in the stored shape."""
    day, gap = F.col("event_date"), BEFORE + 1
    return _shaped(
        studied.withColumns(
            {
                "analysis_type": F.lit("event_study"),
                "car_t_stat": F.col("t_statistic"),
                "car_p_value": F.col("p_value"),
                "estimation_window_start": F.date_sub(day, gap + ESTIMATION_DAYS + 10),
                "estimation_window_end": F.date_sub(day, gap),
                "event_window_start": F.date_sub(day, BEFORE),
                "event_window_end": F.date_add(day, AFTER),
                "abnormal_return": F.col("car"),
                "is_anomaly": F.lit(False),
            }
        )
    )


def from_anomalies(anomalies: DataFrame, day_events: DataFrame | None = None) -> DataFrame:
    """Rows of ``detect_anomalies``; the score is the forest's, else the size of z.

    ``day_events`` (date, event_id) names the event an anomaly is attached to.
    """
    a = anomalies
    if day_events is not None:
        a = a.join(day_events, "date", "left")
    return _shaped(
        a.withColumns(
            {
                "analysis_type": F.lit("anomaly_detection"),
                "event_window_start": F.col("date"),
                "event_window_end": F.col("date"),
                "abnormal_return": F.col("actual_return") - F.col("expected_return"),
                "is_anomaly": F.lit(True),
                "anomaly_score": F.when(
                    F.col("anomaly_probability") > 0, F.col("anomaly_probability")
                ).otherwise(F.abs("z_score")),
                "is_significant": F.lit(False),
            }
        )
    )


def _keep(df: DataFrame, **equal) -> DataFrame:
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def _page(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


# Postgres puts nulls first in a descending order; so do the queries below.
def _size_of_car():
    return F.abs("car")


_TIES = ("event_id", "symbol", "analysis_type", "event_window_start")


def results_for_event(results: DataFrame, event_id) -> DataFrame:
    return results.filter(F.col("event_id") == event_id)


def list_results(
    results: DataFrame,
    event_id=None,
    symbol: str | None = None,
    analysis_type: str | None = None,
    significant: bool | None = None,
    min_car: float | None = None,
    limit: int | None = 100,
    offset: int = 0,
) -> DataFrame:
    r = _keep(
        results,
        event_id=event_id,
        symbol=symbol,
        analysis_type=analysis_type,
        is_significant=significant,
    )
    if min_car is not None:
        r = r.filter(_size_of_car() >= min_car)
    return _page(r.orderBy(_size_of_car().desc_nulls_first(), *_TIES), limit, offset)


def anomaly_results(
    results: DataFrame, anomaly_type: str | None = None, limit: int | None = 100
) -> DataFrame:
    r = _keep(results.filter("is_anomaly"), anomaly_type=anomaly_type)
    return _page(r.orderBy(F.col("anomaly_score").desc_nulls_first(), *_TIES), limit)


def significant_results(
    results: DataFrame,
    events: DataFrame,
    symbol: str | None = None,
    start=None,
    end=None,
    min_car: float | None = 0.01,
    limit: int | None = 50,
) -> DataFrame:
    """Significant event studies with their event (Silver events)."""
    r = _keep(results.filter("is_significant"), symbol=symbol, analysis_type="event_study")
    if min_car is not None:
        r = r.filter(_size_of_car() >= min_car)
    e = events.filter(X.between_dates("event_date", start, end)).select(
        "event_id", "event_date", "event_root_code", "goldstein_scale", "num_mentions"
    )
    out = r.join(e, "event_id").select(
        "event_id",
        "event_date",
        X.event_category("event_root_code", F.col("event_root_code")).alias("event_type"),
        "symbol",
        (F.col("car") * 100).alias("car_pct"),
        F.col("car_t_stat").alias("t_stat"),
        F.col("car_p_value").alias("p_value"),
        "goldstein_scale",
        "num_mentions",
    )
    return _page(out.orderBy(F.abs("car_pct").desc_nulls_first(), "event_id", "symbol"), limit)


def anomalies_with_events(
    results: DataFrame,
    events: DataFrame,
    anomaly_type: str | None = None,
    symbol: str | None = None,
    min_score: float | None = None,
    limit: int | None = 100,
) -> DataFrame:
    """Flagged results with labels and actors of their event."""
    r = _keep(results.filter("is_anomaly"), anomaly_type=anomaly_type, symbol=symbol)
    if min_score is not None:
        r = r.filter(F.col("anomaly_score") >= min_score)
    have = set(events.columns)

    def actor(n: int):
        names = [c for c in (f"actor{n}_name", f"actor{n}_code", f"actor{n}_country") if c in have]
        return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names]).alias(f"actor{n}")

    e = events.select(
        "event_id",
        "event_date",
        "event_root_code",
        "goldstein_scale",
        actor(1),
        actor(2),
    )
    out = r.join(e, "event_id").select(
        "event_id",
        "event_date",
        X.event_category("event_root_code", F.col("event_root_code")).alias("event_type"),
        X.event_group("event_root_code").alias("event_group"),
        "symbol",
        "anomaly_type",
        "anomaly_score",
        "expected_return",
        "actual_return",
        "goldstein_scale",
        "actor1",
        "actor2",
    )
    return _page(
        out.orderBy(F.col("anomaly_score").desc_nulls_first(), "event_id", "symbol"), limit
    )


def avg_market_reaction(
    results: DataFrame, events: DataFrame, root_code: str | None = None, symbol: str | None = None
) -> DataFrame:
    """Mean CAR, count and share significant per (root code, symbol)."""
    r = _keep(results, symbol=symbol, analysis_type="event_study")
    e = _keep(events.select("event_id", "event_root_code"), event_root_code=root_code)
    return (
        r.join(e, "event_id")
        .groupBy("event_root_code", "symbol")
        .agg(
            F.avg("car").alias("avg_car"),
            F.count(F.lit(1)).alias("n_results"),
            F.avg(F.col("is_significant").cast("double")).alias("significance_rate"),
        )
    )


def analysis_summary(results: DataFrame) -> DataFrame:
    """Totals and the anomaly breakdown as a map, from one aggregate by type.

    Counting by (type, flags) first keeps the final single-row aggregate tiny.
    """
    by_type = results.groupBy("anomaly_type").agg(
        F.count(F.lit(1)).alias("n"),
        X.count_if(F.col("is_significant")).alias("sig"),
        X.count_if(F.col("is_anomaly")).alias("anom"),
    )
    entry = F.when(
        F.col("anomaly_type").isNotNull() & (F.col("anom") > 0), F.struct("anomaly_type", "anom")
    )
    total, sig = F.col("total_results"), F.col("significant_results")
    return by_type.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_results"),
        F.coalesce(F.sum("sig"), F.lit(0)).alias("significant_results"),
        F.coalesce(F.sum("anom"), F.lit(0)).alias("total_anomalies"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("anomaly_breakdown"),
    ).withColumn("significance_rate", F.coalesce(X.safe_ratio(sig, total), F.lit(0.0)))
