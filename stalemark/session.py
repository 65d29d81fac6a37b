"""Session settings, and the shared folder a job may write intermediate tables to."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small shuffles keep several tasks; large ones are far above this size anyway.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    # Joins of many rows with at most one row per key (profiles, verdicts) rely on this for hot keys.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app: str, master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators expect; ``extra`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Give a session that the caller brings the settings the operators expect."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="stalemark-")


_written: list[str] = []


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the cluster's shared folder: ``spark.checkpoint.dir``, or the folder of ``setCheckpointDir``.

    Where neither is set, a local session (as in tests) gets a temporary folder. On a cluster that is an error, because
    every executor would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def write_through(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, read back from a table written to the shared folder; ``remove_written`` removes such tables."""
    path = shared_folder(df.sparkSession, purpose)
    register_written(path)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def register_written(path: str) -> None:
    """Have ``remove_written`` remove this path too."""
    _written.append(path)


def written_tables() -> list[str]:
    """The paths of the tables that this driver has written and not removed."""
    return list(_written)


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``write_through`` that nothing needs any more, not even the repeat of a lost task."""
    for table in tables:
        path = table.written_path
        if path in _written:
            _written.remove(path)
            _remove(table.sparkSession, path)


def remove_written(spark: SparkSession) -> None:
    """Remove those tables. Results that were read from them can't be computed again afterwards."""
    while _written:
        _remove(spark, _written.pop())


def _remove(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
