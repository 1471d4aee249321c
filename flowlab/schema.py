"""Explicit schemas for flow records and the lookup tables."""

from __future__ import annotations

from pyspark.sql import types as T

FLOW_COLUMNS = [
    "flow_id", "period", "timestamp", "src_ip", "dst_ip",
    "proto", "port", "up_bytes", "down_bytes",
]

# Columns of a stored flow file (one period per file); ``period`` is added on read.
FLOW_FILE_SCHEMA = T.StructType([
    T.StructField("flow_id", T.LongType(), False),
    T.StructField("timestamp", T.LongType(), True),
    T.StructField("src_ip", T.StringType(), True),
    T.StructField("dst_ip", T.StringType(), True),
    T.StructField("proto", T.StringType(), True),
    T.StructField("port", T.IntegerType(), True),
    T.StructField("up_bytes", T.LongType(), True),
    T.StructField("down_bytes", T.LongType(), True),
])

# Integer forms of the addresses, parsed once when a flow table is stored.
NUM_COLUMNS = ["src_ip_num", "dst_ip_num"]

# A stored, period-partitioned flow dataset: file columns, the parsed
# addresses, and the partition column.
FLOW_SCHEMA = T.StructType(
    FLOW_FILE_SCHEMA.fields
    + [T.StructField(c, T.LongType(), True) for c in NUM_COLUMNS]
    + [T.StructField("period", T.StringType(), True)])

GEO_SCHEMA = T.StructType([
    T.StructField("lo", T.LongType(), False),
    T.StructField("hi", T.LongType(), False),
    T.StructField("cc", T.StringType(), True),
])

ASN_SCHEMA = T.StructType([
    T.StructField("lo", T.LongType(), False),
    T.StructField("hi", T.LongType(), False),
    T.StructField("org", T.StringType(), True),
])

DNS_CACHE_SCHEMA = T.StructType([
    T.StructField("ptr_name", T.StringType(), False),
    T.StructField("host", T.StringType(), True),
])

BLOCKLIST_SCHEMA = T.StructType([
    T.StructField("ip", T.StringType(), False),
    T.StructField("reasons", T.ArrayType(T.StringType(), False), False),
])

BASELINE = "baseline"
TEST = "test"
