"""Session factory and the one durable way this package cuts lineage."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on; anything about cluster size stays with the cluster.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "eventlens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a folder of this machine is made if all of Spark runs here (tests), and
    a cluster is refused: its executors would each write to their own disk.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="eventlens-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; iterative fits read their input many times."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per context.

    Same effect as ``spark-submit --py-files``; needed where only the driver has the
    repository on its path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_eventlens_shipped", False):
        return
    package = Path(__file__).resolve().parent
    base = str(Path(tempfile.mkdtemp(prefix="eventlens-")) / "eventlens")
    sc.addPyFile(shutil.make_archive(base, "zip", package.parent, package.name))
    sc._eventlens_shipped = True


def run_together(spark: SparkSession, *jobs: Callable[[], None]) -> None:
    """Submit independent jobs at once, so that one job's tail does not idle the cluster."""
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]:
            done.result()
