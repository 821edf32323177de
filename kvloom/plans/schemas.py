"""Schemas of the relations and of the replica stream's messages."""

from __future__ import annotations

from pyspark.sql import types as T

SNAPSHOT = T.StructType([
    T.StructField("db", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()),
    T.StructField("raw_value", T.BinaryType()), T.StructField("expire", T.TimestampType()), T.StructField("rdb_type", T.IntegerType()),
])
COMMAND = T.StructType([T.StructField("cmd", T.StringType()), T.StructField("args", T.ArrayType(T.BinaryType()))])
SEGMENT = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("offset", T.LongType()),
    T.StructField("size", T.LongType()), T.StructField("created_at", T.TimestampType()), T.StructField("path", T.StringType()),
])
CHECKPOINT = T.StructType([
    T.StructField("replid", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("version", T.LongType()), T.StructField("mtime", T.LongType()),
])
SLOT_RANGE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

# Messages of the replica stream; they are described here and never served.
SYNC_REQUEST = T.StructType([
    T.StructField("node_id", T.StringType()), T.StructField("address", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("run_id", T.StringType()),
])
SYNC_META = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("msg", T.StringType()), T.StructField("aof", T.BooleanType())])
SYNC_RESPONSE = T.StructType([
    T.StructField("code", T.IntegerType()), T.StructField("meta", SYNC_META), T.StructField("offset", T.LongType()),
    T.StructField("size", T.LongType()), T.StructField("data", T.BinaryType()),
])
# Response codes, by number (fixed values).
RESPONSE_CODES = ("UNKNOWN", "META", "CONTINUE", "HANDOVER", "CLEAR", "FAULT", "ERROR", "FAILURE")
