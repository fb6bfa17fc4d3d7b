"""Streaming forms of the daily refresh: landing, daily counts, and mart upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from eventlens import reference as ref
from eventlens.functions import expressions as X
from eventlens.plans import gold, silver
from eventlens.sources import feeds, months, tables

LATE = "3 days"


def read_event_stream(
    spark: SparkSession, folder: str, schema: StructType | None = None, files_per_trigger: int = 1000
) -> DataFrame:
    """Event files as they arrive: raw exports, or Parquet when a schema is given."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    if schema is not None:
        return reader.schema(schema).parquet(folder)
    raw = reader.schema(feeds.EVENT_SCHEMA).options(**feeds.TSV_OPTIONS).csv(folder)
    return feeds.land_events(raw)


def stream_land_events(events: DataFrame, late: str = LATE) -> DataFrame:
    """First arrival of each event id; state is dropped once ``late`` has passed."""
    return (
        events.withColumn("event_ts", F.col("event_date").cast("timestamp"))
        .withWatermark("event_ts", late)
        .dropDuplicatesWithinWatermark(["global_event_id"])
    )


def land_batch(batch: DataFrame, batch_id: int, landed_path: str, late_path: str, late_days: int = 3) -> None:
    """Land the first arrival of each event id; rows that come too late go to a side table.

    Too late is what lies ``late_days`` or more before the newest day landed by earlier batches, as
    a watermark would have it. That day is noted for the batch, so that a replay parts the same rows:
    it finds its events landed and writes its part of the side table again.
    """
    spark = batch.sparkSession
    rows = batch.drop("event_ts").dropna(subset=["global_event_id", "event_date"])
    note = f"{late_path}/_newest/{batch_id}"
    if not months.exists(spark, note):
        days = [m for m in months.stored(spark, landed_path) if m != months.UNDATED]
        # Months are in order; the newest day is in the last.
        last = months.read(spark, landed_path, days[-1:]).agg(F.max("event_date")).first()[0] if days else ""
        months.note(spark, note, str(last))
    newest = months.noted(spark, note)
    in_time = F.lit(True) if not newest else F.col("event_date") > F.date_sub(F.lit(newest).cast("date"), late_days)
    keys = tables.KEYS["events"]
    first = [F.col(c).desc_nulls_last() for c in rows.columns if c not in keys]
    tables.insert_by_month(
        spark, landed_path, rows.filter(in_time), lambda old, new: tables.insert_absent(old, new, keys, first), keys, "event_date"
    )
    if newest:
        rows.filter(~in_time).write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")


def stream_land_with_late(
    events: DataFrame, landed_path: str, late_path: str, checkpoint: str, late_days: int = 3
) -> DataStreamWriter:
    """Writer that lands a stream and loses nothing: see ``land_batch`` and ``late_events``."""
    return (
        events.writeStream.foreachBatch(lambda batch, no: land_batch(batch, no, landed_path, late_path, late_days))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def late_events(spark: SparkSession, late_path: str) -> DataFrame | None:
    """The side table, to be landed by the next daily run; None while there is none."""
    if not any(n.startswith("batch=") for n in months.names(spark, late_path)):
        return None
    return spark.read.parquet(late_path).drop("batch")


def stream_daily_geo(landed: DataFrame) -> DataFrame:
    """Running figures per (day, country); run in update mode.

    Expects ``stream_land_events`` rows, whose watermark bounds the open days.
    """
    code = "event_root_code"
    e = silver.fips_to_iso(landed).filter(F.col("country_code").isNotNull())
    return (
        e.groupBy(F.window("event_ts", "1 day"), "country_code")
        .agg(
            F.count(F.lit(1)).alias("total_events"),
            X.count_if(X.in_codes(code, ref.CONFLICT_ROOTS)).alias("conflict_events"),
            X.count_if(X.in_codes(code, ref.COOPERATION_ROOTS)).alias("cooperation_events"),
            X.count_if(X.in_codes(code, ref.VIOLENT_ROOTS)).alias("violent_events"),
            F.avg("goldstein_scale").alias("avg_goldstein"),
            F.sum("num_mentions").alias("total_mentions"),
        )
        .withColumn("event_date", F.to_date("window.start"))
        .drop("window")
    )


def refresh_touched_months(batch: DataFrame, events_path: str, gold_path: str) -> None:
    """Merge a micro-batch into the event table and rebuild the mart of the months it touches.

    These are the months of new and changed rows and those that moved events leave; a month
    without events any more loses its mart. They are marked in the mart's folder before a
    file of the events moves, and stay marked until their mart is stored. A batch that is
    replayed finds its events stored; what its first run left undone is done then.
    """
    spark = batch.sparkSession
    rows = batch.drop("event_ts")
    tables.upsert_by_month(
        spark, events_path, rows, tables.KEYS["events"], "event_date",
        touched=lambda changed: months.mark(spark, gold_path, "events", changed),
    )
    marks = months.marked(spark, gold_path)
    wanted = sorted(marks.get("events", {}))
    if wanted:
        stored = months.read(spark, events_path, wanted).drop("month")
        mart = gold.stamped(gold.gold_geopolitical_daily(silver.silver_events(stored)))
        months.change(spark, gold_path, months.dated(mart, "event_date"), wanted)
        months.unmark(spark, marks)


def stream_incremental_gold(
    events: DataFrame, events_path: str, gold_path: str, checkpoint: str
) -> DataStreamWriter:
    """Writer that keeps the geopolitical mart current, late rows included."""
    return (
        events.writeStream.foreachBatch(
            lambda batch, _: refresh_touched_months(batch, events_path, gold_path)
        )
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
