"""Deduplication. One best row per key, chosen by a total order.

``row_number() == 1`` is written so that Spark limits each key on the map side before
the shuffle (WindowGroupLimit): a key holding a third of all rows sends one row per
task, and unused columns are still pruned at the scan. That sorts all rows of a task; where nearly
every key is unique, rows are dealt first and only those of frequent keys are limited before (``keep_best_of_many``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_best(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")
    )


#: Buckets of keys that are counted, and rows of a bucket from which its keys are limited first.
KEY_BUCKETS, FREQUENT = 1 << 16, 100_000


def keep_best_of_many(df: DataFrame, keys: list[str], order: list[Column], frequent: int = FREQUENT) -> DataFrame:
    """``keep_best`` for keys that are mostly unique.

    Rows are dealt by key before they are sorted, so no task sorts, and spills, all rows it has read. A key
    is frequent if its bucket holds more than ``frequent`` rows; these go through ``keep_best`` first and
    send a row per task. A wrong guess costs a sort and changes no row. Keys must not be null.
    """
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int"))
    full = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > frequent)
    # At most as many numbers as there are buckets.
    full = F.broadcast(full.select("_bucket"))
    first = keep_best(bucketed.join(full, "_bucket", "left_semi"), keys, order)
    rows = bucketed.join(full, "_bucket", "left_anti").unionByName(first).drop("_bucket")
    return keep_best(rows.repartition(*keys), keys, order)


def _desc(df: DataFrame, names: list[str]) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in names if c in df.columns]


def dedup_events(events: DataFrame, tiebreak: tuple[str, ...] = ("id", "source_url")) -> DataFrame:
    """Best-covered row per event id; rows without id, date or root code are dropped."""
    valid = events.dropna(subset=["global_event_id", "event_date", "event_root_code"])
    return keep_best_of_many(
        valid, ["global_event_id"], _desc(events, ["num_mentions", "num_sources", *tiebreak])
    )


def dedup_market(market: DataFrame, tiebreak: tuple[str, ...] = ("id",)) -> DataFrame:
    """Highest-volume row per (symbol, date)."""
    valid = market.dropna(subset=["symbol", "date", "close"])
    return keep_best(valid, ["symbol", "date"], _desc(market, ["volume", *tiebreak]))


def dedup_headlines(headlines: DataFrame) -> DataFrame:
    """Latest row per url, then required fields."""
    best = keep_best(headlines, ["url"], _desc(headlines, ["published_at", "id"]))
    return best.dropna(subset=["headline", "url", "published_at", "sentiment_score"])


def dedup_docs_across_topics(docs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First occurrence of each content by (topic, distance)."""
    return keep_best(docs, [*(keys or []), "content"], [F.col("topic_no"), F.col("distance"), F.col("doc_id")])


def distinct_anomalies(results: DataFrame) -> DataFrame:
    """(symbol, anomaly_date, anomaly_score) of flagged results, one row each."""
    return (
        results.filter("is_anomaly")
        .select("symbol", F.col("event_window_start").alias("anomaly_date"), "anomaly_score")
        .distinct()
    )


def anomaly_flags(results: DataFrame) -> DataFrame:
    """One flag row per (symbol, date): the highest score, so joins cannot fan out."""
    return (
        results.filter("is_anomaly")
        .groupBy("symbol", F.col("event_window_start").alias("date"))
        .agg(F.max("anomaly_score").alias("anomaly_score"))
        .withColumn("is_anomaly", F.lit(True))
    )
