"""Writers: merges by key, insert-if-absent, replacement of months, and their storage.

Large tables are partitioned by month (``months``) and changed a month at a time. Small ones
(reports, registries, stored results) are rewritten whole, as Parquet folders in numbered
versions; readers take the newest version that Spark closed with its _SUCCESS marker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.operators.dedup import keep_best
from eventlens.session import checkpoint
from eventlens.sources import months

KEYS = {
    "events": ["global_event_id"],
    "market_data": ["symbol", "date"],
    "news_headlines": ["url"],
    "economic_indicators": ["series_id", "date"],
    "prediction_markets": ["market_id", "snapshot_date"],
    "analysis_results": ["event_id", "symbol", "analysis_type"],
}


# ---- merge semantics (pure DataFrame -> DataFrame) --------------------------------------
def merge_by_key(
    old: DataFrame, new: DataFrame, keys: list[str], newest: list[Column] | None = None
) -> DataFrame:
    """Update-or-insert: a new row replaces the stored columns it brings.

    Columns the new rows lack keep their stored value, as an update by field would. The
    last of several new rows for a key is chosen by ``newest`` (default: every column
    descending, which is deterministic).
    """
    order = newest or [F.col(c).desc_nulls_last() for c in new.columns if c not in keys]
    incoming = keep_best(new.dropna(subset=keys), keys, order) if order else new.dropDuplicates(keys)
    brought = [c for c in new.columns if c not in keys]
    n = incoming.select(*keys, F.struct(*brought).alias("_new"))
    joined = old.join(n, keys, "full_outer")
    out = []
    for c in dict.fromkeys([*old.columns, *new.columns]):
        if c in keys:
            out.append(F.col(c))
        elif c in brought and c in old.columns:
            out.append(
                F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
            )
        elif c in brought:
            out.append(F.col("_new")[c].alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def merge_events(old: DataFrame, new: DataFrame) -> DataFrame:
    return merge_by_key(old, new, KEYS["events"])


def merge_market(old: DataFrame, new: DataFrame) -> DataFrame:
    return merge_by_key(old, new, KEYS["market_data"])


def merge_analysis_results(old: DataFrame, new: DataFrame) -> DataFrame:
    return merge_by_key(old, new, KEYS["analysis_results"])


def append_market(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bulk insert without looking for duplicates."""
    return old.unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], first: list[Column]) -> DataFrame:
    """Rows of ``new`` whose key is unseen; the first per key by ``first``."""
    fresh = keep_best(new.dropna(subset=keys), keys, first)
    return fresh.join(old.select(*keys), keys, "left_anti")


def insert_new_headlines(old: DataFrame, new: DataFrame) -> DataFrame:
    return insert_absent(
        old, new, KEYS["news_headlines"], [F.col("published_at"), F.col("headline")]
    )


def insert_new_indicators(old: DataFrame, new: DataFrame) -> DataFrame:
    return insert_absent(old, new, KEYS["economic_indicators"], [F.col("value")])


def with_snapshot_day(new: DataFrame) -> DataFrame:
    """Add the UTC day of a snapshot, a part of its key."""
    return new.withColumn("snapshot_at", F.col("snapshot_at").cast("timestamp")).withColumn(
        "snapshot_date", F.to_date("snapshot_at")
    )


def insert_new_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """First snapshot per market and UTC day; a day already stored is skipped."""
    dated = with_snapshot_day(new)
    ties = [F.col("id")] if "id" in new.columns else [F.col("yes_price")]
    return insert_absent(
        old, dated, KEYS["prediction_markets"], [F.col("snapshot_at"), *ties]
    )


# ---- storage ---------------------------------------------------------------------------
exists = months.exists


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions of a table: those Spark closed with a _SUCCESS marker."""
    found = []
    for name in months.names(spark, path):
        if name.startswith("v=") and exists(spark, f"{path}/{name}/_SUCCESS"):
            found.append(int(name[2:]))
    return sorted(found)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Newest finished version of a versioned table."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no finished version of a table under {path}")
    return spark.read.parquet(f"{path}/v={versions[-1]}")


def write_table(df: DataFrame, path: str, keep: int = 2) -> None:
    """Write the next version; drop versions older than the last ``keep``."""
    spark = df.sparkSession
    versions = _versions(spark, path)
    number = versions[-1] + 1 if versions else 1
    df.write.mode("overwrite").parquet(f"{path}/v={number}")
    for old in versions[: max(0, len(versions) + 1 - keep)]:
        months.remove(spark, f"{path}/v={old}")


def materialize_table(df: DataFrame, path: str) -> DataFrame:
    """Full rebuild of a table, read back from storage."""
    write_table(df, path)
    return read_table(df.sparkSession, path)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, merge) -> DataFrame:
    """Apply a merge function to the stored table (or start it) and store the result."""
    if not _versions(spark, path):
        empty = spark.createDataFrame([], new.schema)
        return materialize_table(merge(empty, new), path)
    return materialize_table(merge(read_table(spark, path), new), path)


def replace_correlation_cache(results: DataFrame, path: str) -> None:
    """Replace the stored rows of the methods in ``results``; other methods stay."""
    (
        results.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("method")
        .parquet(path)
    )


def materialize_incremental(
    df: DataFrame, path: str, date_column: str, since=None, touched: months.Touched | None = None
) -> list[str]:
    """Replace the months from ``since`` on, everything without it; returns the touched months.

    ``df`` must hold every row of these months, so the caller recomputes whole months
    (``month_start``). A stored month of the interval that has no rows any more is removed. The
    months change together once all rows are staged (``months.change``); a job that dies in
    between is finished by the next one.
    """
    spark = df.sparkSession
    rows = months.dated(df, date_column)
    if since is None:
        return months.change(spark, path, rows, None, touched=touched, small=True)
    months.finish(spark, path, touched)
    first = str(since)[:7]
    rows = rows.filter(F.col(date_column) >= month_start(since))
    new = [r["month"] for r in rows.select("month").distinct().collect()]
    wanted = sorted({m for m in months.stored(spark, path) if m != months.UNDATED and m >= first} | set(new))
    return months.change(spark, path, rows, wanted, touched=touched, small=True)


def _last_of_key(new: DataFrame, keys: list[str], date_column: str) -> DataFrame:
    order = [F.col(c).desc_nulls_last() for c in new.columns if c not in keys]
    rows = new.dropna(subset=[*keys, date_column])
    return keep_best(rows, keys, order) if order else rows.dropDuplicates(keys)


def upsert_by_month(
    spark: SparkSession, path: str, new: DataFrame, keys: list[str], date_column: str,
    touched: months.Touched | None = None, more: dict[str, str] | None = None,
) -> list[str]:
    """Update-or-insert that touches only months with a new or changed row; returns them.

    Rows that are stored already, as an overlapping window brings them again and again, are left out.
    New rows of months without a changed row are appended. A month with a changed row is
    rewritten, and so is the one that the row leaves if its date moves: stored months of the
    arriving keys are looked up in the key columns alone, and not at all where the date belongs to
    the key. ``more`` names columns, with their types, that are filled later on.
    """
    months.finish(spark, path, touched)
    incoming = months.dated(_last_of_key(new, keys, date_column), date_column)
    if not months.stored(spark, path):
        empty = {c: F.lit(None).cast(t) for c, t in (more or {}).items() if c not in incoming.columns}
        return months.change(spark, path, None, None, incoming.withColumns(empty), touched)
    table = months.read(spark, path)
    if date_column in keys:
        near = incoming.select("month").distinct()
    else:
        # The keys alone: which of several new rows for a key is the last makes no difference here.
        arriving = new.dropna(subset=[*keys, date_column]).select(*keys)
        near = table.select(*keys, "month").join(arriving, keys, "left_semi").select("month").distinct()
    old = months.read(spark, path, [r["month"] for r in near.collect()])
    brought = [c for c in incoming.columns if c not in keys and c in table.columns]
    unknown = any(c not in table.columns for c in incoming.columns)
    before = old.select(*keys, F.struct(*brought).alias("_old"), F.col("month").alias("_old_month"))
    same = F.lit(False) if unknown else F.struct(*brought).eqNullSafe(F.col("_old"))
    judged = incoming.join(before, keys, "left").withColumn("_new", F.col("_old_month").isNull())
    fresh = checkpoint(judged.filter(F.col("_new") | ~same).drop("_old"))
    left = fresh.filter("NOT _new").select(F.explode(F.array("month", "_old_month")).alias("month")).distinct()
    rewritten = sorted(r["month"] for r in left.collect())
    into, rows = F.col("month").isin(rewritten), fresh.drop("_new", "_old_month")
    added = _shaped(rows.filter(~into), table)
    if not rewritten:
        return months.change(spark, path, None, None, added, touched)
    merged = merge_by_key(months.read(spark, path, rewritten), rows.filter(into), keys)
    return months.change(spark, path, months.dated(merged, date_column), rewritten, added, touched)


def _shaped(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with all columns of the stored table, in its types; others follow."""
    known = [
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema
    ]
    return rows.select(*known, *(c for c in rows.columns if c not in table.columns))


def insert_by_month(
    spark: SparkSession, path: str, new: DataFrame, absent, keys: list[str], date_column: str,
    touched: months.Touched | None = None, more: dict[str, str] | None = None,
) -> list[str]:
    """Append the rows that an insert-if-absent function lets through; returns their months.

    Stored files stay as they are. Keys are looked up in the key columns alone, and only in
    the arriving months where the date belongs to the key.
    """
    months.finish(spark, path, touched)
    empty = {c: F.lit(None).cast(t) for c, t in (more or {}).items() if c not in new.columns}
    if not months.stored(spark, path):
        first = absent(spark.createDataFrame([], new.schema), new)
        return months.change(spark, path, None, None, months.dated(first, date_column).withColumns(empty), touched)
    table = months.read(spark, path)
    if date_column in keys:
        arriving = [r["month"] for r in months.dated(new, date_column).select("month").distinct().collect()]
        table = months.read(spark, path, arriving)
    fresh = months.dated(absent(table, new), date_column)
    return months.change(spark, path, None, None, _shaped(fresh, table), touched)


def month_start(day) -> Column:
    return F.trunc(F.lit(day).cast("date"), "month")
