"""Reading operation logs: text files of comma-separated lines, one directory per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stalemark.functions.columns import key_type
from stalemark.schemas import LOG

# File name patterns per kind, fields of a read and of an update line, and the op of a line without one.
LOG_FILES = {"read": "read*", "update": "update*"}
READ_FIELDS = 9
UPDATE_FIELDS = 10
NO_OP = "N"


def scan_logs(spark: SparkSession, directory: str, kind: str) -> DataFrame:
    """Lines (``value``) of all logs of one kind, with the ``file`` they come from. Many files are one scan.

    A log is a file, or a folder of part files, whose name matches the kind's pattern.
    """
    lines = spark.read.text(f"{directory.rstrip('/')}/{LOG_FILES[kind]}")
    return lines.select("value", F.col("_metadata.file_name").alias("file"))


def union_logs(*logs: DataFrame) -> DataFrame:
    """Logs from several places as one."""
    together = logs[0]
    for more in logs[1:]:
        together = together.unionByName(more)
    return together


def parse_logs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines as typed log rows, and the lines that are none, with a ``reason``.

    Nine fields are a line without an op, ten have it before the last field. Numbers must be whole and in range, and an
    interval must not end before it starts.
    """
    field = F.split(F.trim("value", F.lit(" \t\r\n")), ",")
    has_op = F.size("f") == UPDATE_FIELDS

    def at(i: int):
        return F.try_element_at("f", F.lit(i + 1))

    last = F.when(has_op, at(9)).otherwise(at(8))
    columns = {
        "log_type": at(0),
        "attribute": at(1),
        "seq_id": at(2).try_cast("bigint"),
        "thread_id": at(3).try_cast("int"),
        "key": at(4).try_cast("bigint"),
        "start_ns": at(5).try_cast("bigint"),
        "end_ns": at(6).try_cast("bigint"),
        "value": at(7).try_cast("int"),
        "op": F.when(has_op, at(8)).otherwise(NO_OP),
        "action_type": last,
    }
    missing = F.lit(False)
    for name in ("seq_id", "thread_id", "key", "start_ns", "end_ns", "value"):
        missing = missing | columns[name].isNull()
    reason = (
        F.when(~F.size("f").isin(READ_FIELDS, UPDATE_FIELDS), "field_count")
        .when(missing, "bad_number")
        .when(columns["start_ns"] > columns["end_ns"], "start_after_end")
    )
    record = F.struct(*[c.alias(name) for name, c in columns.items()], reason.alias("reason"))
    # Exploding the one record keeps the filters below it from being pushed under the split and repeating it per field.
    parsed = lines.withColumn("f", field).select(*lines.columns, F.explode(F.array(record)).alias("log"))
    logs = parsed.where("log.reason is null").select(*[f"log.{name}" for name in LOG.names])
    rejects = parsed.where("log.reason is not null").select(*lines.columns, "log.reason")
    return logs, rejects


def classify_key(logs: DataFrame) -> DataFrame:
    """Logs with ``key_type``: what kind of key the attribute is counted under."""
    return logs.withColumn("key_type", key_type(F.col("attribute")))
