"""The driver's tables as inputs: logs from ``events``, the social graph from customers, orders and line items.

The mappings are part of the queries' definition (see FIXTURES.md); nothing is filtered beyond what they say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stalemark.functions.columns import floor_div

UNIT_US = 10_800_000_000  # three hours


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver. Its schema is looked up once per path; looking it up is a job of its own."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in the layout of a log, with ``event_type`` kept to tell reads from updates."""
    event_id = F.col("event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    start = floor_div(micros, F.lit(UNIT_US)) * F.lit(UNIT_US * 1000)
    length = (floor_div(event_id, F.lit(2).cast("bigint")) % 4 + 1) * F.lit(UNIT_US * 1000)
    even = event_id % 2 == 0
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"),
        F.when(even, F.lit("ACCEPTFRND")).otherwise(F.lit("PENDFRND")).alias("attribute"),
        start.alias("start_ns"),
        (start + length).alias("end_ns"),
        event_id.alias("seq_id"),
        "event_type",
        _k().alias("k"),
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    value = F.when(F.col("attribute") == "ACCEPTFRND", k % 7 + 7).otherwise(k % 4)
    logs = event_logs(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    return logs.select("key", "attribute", "start_ns", "end_ns", "seq_id", value.alias("value"))


def update_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth key is updated under the third attribute only, so its other two items have reads and no updates."""
    logs = event_logs(spark, sf_dir).where(F.col("event_type").isin("purchase", "signup", "error"))
    third = F.when(F.col("key") % 10 == 3, F.lit("POSTCOMMENT")).otherwise(F.col("attribute"))
    return logs.withColumn("attribute", third)


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = update_events(spark, sf_dir)
    op = F.when(F.col("k") % 2 == 0, F.lit("I")).otherwise(F.lit("D"))
    return logs.select("key", "attribute", "start_ns", "end_ns", "seq_id", op.alias("op"))


# -------------------------------------------------------------------- log lines


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads as lines of a log, some of them spoiled (see ``_lines``)."""
    logs = event_logs(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    value = F.when(F.col("attribute") == "ACCEPTFRND", F.col("k") % 7 + 7).otherwise(F.col("k") % 4)
    return _lines(logs, "READ", [value, F.lit("GetProfile")])


def update_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = update_events(spark, sf_dir)
    op = F.when(F.col("k") % 2 == 0, F.lit("I")).otherwise(F.lit("D"))
    return _lines(logs, "UPDATE", [F.lit(1), op, F.lit("AcceptFriend")])


def _lines(logs: DataFrame, log_type: str, tail: list[Column]) -> DataFrame:
    """k = 1: two fields too many; 2: a key that is no number; 3: interval the wrong way round; 4: blanks around."""
    k = F.col("k")
    key = F.when(k == 2, F.concat(F.lit("x"), F.col("key"))).otherwise(F.col("key").cast("string"))
    first, second = F.col("start_ns"), F.col("end_ns")
    fields = [
        F.lit(log_type), F.col("attribute"), F.col("seq_id"), F.col("seq_id") % 16, key,
        F.when(k == 3, second).otherwise(first), F.when(k == 3, first).otherwise(second), *tail,
    ]
    line = F.concat_ws(",", *[f.cast("string") for f in fields])
    spoiled = F.when(k == 1, F.concat(line, F.lit(",a,b"))).when(k == 4, F.concat(F.lit(" "), line, F.lit(" \t")))
    return logs.select(spoiled.otherwise(line).alias("value"))


# ----------------------------------------------------------------- social graph


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("userid"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("address")
    )


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("rid"),
        F.col("o_custkey").alias("creatorid"),
        (F.col("o_custkey") - F.col("o_custkey") % 3).alias("walluserid"),
        F.col("o_orderpriority").alias("type"),
        F.col("o_orderstatus").alias("body"),
    )


def manipulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    mid = F.concat_ws("-", *[F.col(f"l_{c}").cast("string") for c in ("orderkey", "linenumber", "partkey", "suppkey")], day.cast("string"))
    creators = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rid"), F.col("o_custkey").alias("creatorid"))
    comments = table(spark, sf_dir, "lineitem").select(
        mid.alias("mid"),
        F.col("l_orderkey").alias("rid"),
        F.col("l_suppkey").alias("modifierid"),
        day.alias("timestamp"),
        F.col("l_returnflag").alias("type"),
        F.col("l_linestatus").alias("content"),
    )
    return comments.join(creators, "rid").select(
        "mid", "creatorid", "rid", "modifierid", "timestamp", "type", "content"
    )


def friendship_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is an operation; views are of no known kind, and some pairs are one user twice, so both are refused."""
    kind = F.col("event_type")
    op = (
        F.when(kind == "signup", "invite")
        .when(kind == "purchase", "accept")
        .when(kind == "error", "reject")
        .when(kind == "click", "thaw")
        .otherwise(kind)
    )
    inviter = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("op_seq"),
        op.alias("op"),
        inviter.alias("inviter"),
        (inviter - inviter % 10 + _k() % 10).alias("invitee"),
    )


def no_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "owner bigint, other bigint, kind string")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        (owner - owner % 2).alias("requester"), owner.alias("owner"), (owner % 4).cast("int").alias("k")
    )
