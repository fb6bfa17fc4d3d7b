"""Tables partitioned by month: replaced, appended to and followed a month at a time.

A writer first stages its rows in a hidden folder of the table, then a list of what is to be
done, which is the commit; then staged files take the place of the months. A job that dies
before the list is there leaves the table as it was; one that dies after it is finished by
the next writer (``finish``), however far it came. A table has one writer at a
time.

Months that a writer touches are told to ``touched`` before any file moves. A table built
from others keeps such marks in a hidden folder of its own until it has rebuilt the months.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The month of rows without a date.
UNDATED = "undated"
Touched = Callable[[list[str]], None]


# ---- files ------------------------------------------------------------------------------
def _fs(spark: SparkSession, path: str):
    sc = spark.sparkContext
    if not hasattr(sc, "_eventlens_files"):
        sc._eventlens_files = (spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration())
    kind, conf = sc._eventlens_files
    p = kind(path)
    return p.getFileSystem(conf), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs(spark, source)
    if not fs.rename(p, _fs(spark, target)[1]):
        raise OSError(f"cannot move {source} to {target}")


def note(spark: SparkSession, path: str, text: str | bytes) -> None:
    """A small file, which is there in full or not at all."""
    fs, p = _fs(spark, f"{path}.tmp")
    out = fs.create(p, True)
    out.write(bytearray(text.encode() if isinstance(text, str) else text))
    out.close()
    move(spark, f"{path}.tmp", path)


def noted(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    file = fs.open(p)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    file.close()
    return text


# ---- reading ----------------------------------------------------------------------------
def stored(spark: SparkSession, path: str) -> list[str]:
    """Months that the table holds, from the names of its folders."""
    return [n.removeprefix("month=") for n in names(spark, path) if n.startswith("month=")]


def read(spark: SparkSession, path: str, only: Iterable[str] | None = None) -> DataFrame:
    """The table with its ``month`` (a string), or only some months: other files aren't read."""
    rows = spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))
    return rows if only is None else rows.filter(F.col("month").isin(sorted(only)))


def dated(rows: DataFrame, date_column: str) -> DataFrame:
    return rows.withColumn("month", F.coalesce(F.date_format(date_column, "yyyy-MM"), F.lit(UNDATED)))


# ---- writing ----------------------------------------------------------------------------
def _stage(rows: DataFrame, path: str, small: bool) -> None:
    """Write the months; one that is large is written by several tasks.

    Months known to be ``small`` (a row for each day and key of a bounded list) go to a task each,
    so that their files are written side by side and not one after another.
    """
    if small:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartition(tasks, "month")
    else:
        dealt = rows.hint("rebalance", F.col("month"))
    dealt.write.mode("overwrite").partitionBy("month").parquet(path)


def change(
    spark: SparkSession, path: str, replaced: DataFrame | None, months: list[str] | None,
    appended: DataFrame | None = None, touched: Touched | None = None, small: bool = False,
) -> list[str]:
    """Replace ``months`` by the rows ``replaced`` and append the rows ``appended``.

    Both carry ``month``. A month of ``months`` without rows is removed; None stands for every
    month that is stored or has rows. ``small``: see ``_stage``. Returns the touched months.
    """
    finish(spark, path, touched)
    staged = f"{path}/_staged"
    remove(spark, staged)
    kept, plan = stored(spark, path), []
    if replaced is not None:
        _stage(replaced, f"{staged}/replaced", small)
        full = stored(spark, f"{staged}/replaced")
        wanted = sorted(set(kept) | set(full)) if months is None else months
        if extra := sorted(set(full) - set(wanted)):
            raise ValueError(f"rows of months that aren't replaced: {extra}")
        plan += [("replace" if m in full else "remove", m, "") for m in wanted if m in full or m in kept]
    if appended is not None:
        _stage(appended, f"{staged}/appended", small)
        for m in stored(spark, f"{staged}/appended"):
            folder = f"{staged}/appended/month={m}"
            plan += [("append", m, n) for n in names(spark, folder) if not n.startswith(("_", "."))]
    if plan:
        # A line for each month and new file: what one refresh touches, not what the table holds.
        note(spark, f"{staged}/plan", json.dumps(plan))
    return finish(spark, path, touched)


def finish(spark: SparkSession, path: str, touched: Touched | None = None) -> list[str]:
    """Carry out what was staged to its end; drop what was never staged to its end.

    Every step may have been done before. Returns the touched months.
    """
    staged = f"{path}/_staged"
    if not exists(spark, f"{staged}/plan"):
        remove(spark, staged)
        return []
    plan = json.loads(noted(spark, f"{staged}/plan"))
    months = sorted({month for _, month, _ in plan})
    if touched is not None:
        touched(months)
    kept = set(stored(spark, path))
    replaced, appended = (set(stored(spark, f"{staged}/{kind}")) for kind in ("replaced", "appended"))
    for what, month, name in plan:
        target = f"{path}/month={month}"
        if what == "append":
            source = f"{staged}/appended/month={month}/{name}"
            if month in appended and exists(spark, source):
                fs, folder = _fs(spark, target)
                fs.mkdirs(folder)
                move(spark, source, f"{target}/{name}")
        elif what == "remove" or month in replaced:
            if month in kept:
                remove(spark, target)
            if what == "replace":
                move(spark, f"{staged}/replaced/month={month}", target)
    remove(spark, staged)
    # Sessions that have read the table hold lists of its files.
    spark.catalog.refreshByPath(path)
    return months


# ---- marks ------------------------------------------------------------------------------
def mark(spark: SparkSession, path: str, source: str, months: list[str]) -> None:
    """Note in the table at ``path`` that these months of ``source`` have changed."""
    for month in months:
        fs, p = _fs(spark, f"{path}/_changed/{source}/{month}={uuid.uuid4().hex}")
        fs.create(p).close()


def marked(spark: SparkSession, path: str) -> dict[str, dict[str, list[str]]]:
    """Changed months of each source, and the files of their marks."""
    out: dict[str, dict[str, list[str]]] = {}
    for source in names(spark, f"{path}/_changed"):
        for name in names(spark, f"{path}/_changed/{source}"):
            if "=" in name and not name.startswith("."):
                out.setdefault(source, {}).setdefault(name.partition("=")[0], []).append(f"{path}/_changed/{source}/{name}")
    return out


def unmark(spark: SparkSession, marks: dict[str, dict[str, list[str]]], only: set[str] | None = None) -> None:
    """Remove these marks (of some months); such as were set since they were read stay."""
    for months in marks.values():
        for month, files in months.items():
            if only is None or month in only:
                for file in files:
                    remove(spark, file)


# ---- which months depend on which ----------------------------------------------------------
def linked_months(counts: DataFrame, key: str, months: list[str], rows: int) -> tuple[list[str], list[str]]:
    """Months whose windows of ``rows`` earlier rows of a key reach into ``months``, those
    included, and the months that these windows need besides.

    ``counts``: ``key, month, n``, a row for each key and month that hold rows.
    """
    w = Window.partitionBy(key).orderBy("month")
    placed = counts.select(
        key, "month", F.row_number().over(w).alias("_no"), F.sum("n").over(w).alias("_until"), F.col("n").alias("_n")
    )
    earlier = placed.select(key, F.col("_no").alias("_back"), F.col("month").alias("_from"), F.col("_until").alias("_from_until"))
    # A month is within the reach of a later one if fewer than ``rows`` rows lie between; a
    # month holds a row at least, so ``rows`` months back are enough.
    later = placed.withColumn("_back", F.explode(F.sequence(F.col("_no") - rows, F.col("_no") - 1)))
    pairs = later.join(earlier, [key, "_back"]).filter(F.col("_until") - F.col("_n") - F.col("_from_until") < rows)

    def names_of(df: DataFrame, column: str) -> set[str]:
        return {r[0] for r in df.select(column).distinct().collect()}

    after = names_of(pairs.filter(F.col("_from").isin(months)), "month") | set(months)
    needed = names_of(pairs.filter(F.col("month").isin(sorted(after))), "_from") - after
    return sorted(after), sorted(needed)
