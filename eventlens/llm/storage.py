"""Input tables and intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from eventlens.session import ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables; also makes this package importable in the workers."""
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset (tests) a local one."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="eventlens-llm-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str, tasks: int | None = None) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, read back, and the table's path.

    Cuts the lineage: what is lost later is read again, not computed again. ``tasks`` bounds
    the files of a table whose number of rows is known to be small for them.
    """
    df = df.coalesce(tasks) if tasks else df
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/eventlens-llm/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove intermediate tables that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
