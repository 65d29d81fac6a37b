"""Fixed column layouts of the inputs, and the constants of the benchmark."""

from __future__ import annotations

from pyspark.sql import types as T

# The two validated counters and the value each starts from.
INITIAL = {"ACCEPTFRND": 10, "PENDFRND": 0}

# A data item is one counter of one key.
ITEM = ("key", "attribute")

# Fields of a log line, as the typed row they become.
LOG = T.StructType(
    [
        T.StructField("log_type", T.StringType()),
        T.StructField("attribute", T.StringType()),
        T.StructField("seq_id", T.LongType()),
        T.StructField("thread_id", T.IntegerType()),
        T.StructField("key", T.LongType()),
        T.StructField("start_ns", T.LongType()),
        T.StructField("end_ns", T.LongType()),
        T.StructField("value", T.IntegerType()),
        T.StructField("op", T.StringType()),
        T.StructField("action_type", T.StringType()),
    ]
)

# Fields of the three kinds of entities.
USERS = T.StructType(
    [
        T.StructField("userid", T.IntegerType()),
        T.StructField("username", T.StringType()),
        T.StructField("pw", T.StringType()),
        T.StructField("fname", T.StringType()),
        T.StructField("lname", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("dob", T.DateType()),
        T.StructField("jdate", T.DateType()),
        T.StructField("ldate", T.DateType()),
        T.StructField("address", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("tel", T.StringType()),
        T.StructField("ConfFriends", T.ArrayType(T.IntegerType())),
        T.StructField("PendFriends", T.ArrayType(T.IntegerType())),
        T.StructField("pic", T.BinaryType()),
        T.StructField("tpic", T.BinaryType()),
    ]
)

RESOURCES = T.StructType(
    [
        T.StructField("rid", T.IntegerType()),
        T.StructField("creatorid", T.IntegerType()),
        T.StructField("walluserid", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("doc", T.StringType()),
    ]
)

MANIPULATIONS = T.StructType(
    [
        T.StructField("mid", T.IntegerType()),
        T.StructField("creatorid", T.IntegerType()),
        T.StructField("rid", T.IntegerType()),
        T.StructField("modifierid", T.IntegerType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("type", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

ENTITIES = {"users": ("userid", USERS), "resources": ("rid", RESOURCES), "manipulations": ("mid", MANIPULATIONS)}

# Text formats of dates and timestamps in entity files.
DATE_FORMAT = "yyyy/MM/dd"
TIMESTAMP_FORMAT = "yyyy/MM/dd HH:mm:ss"

# The profile fields a friend listing returns when the caller names none.
PROFILE_FIELDS = [
    "userid", "username", "pw", "fname", "lname", "gender", "dob", "jdate", "ldate", "address", "email", "tel",
    "PendFriends", "ConfFriends",
]
