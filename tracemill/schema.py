"""Declared schemas: spans as read from a source, and the canonical event log."""

from pyspark.sql import types as T

RAW_SPAN = T.StructType(
    [
        T.StructField("span_id", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("ts_start", T.DoubleType()),
        T.StructField("ts_end", T.DoubleType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("status", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("resource_attrs", T.MapType(T.StringType(), T.StringType())),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("activity_raw", T.StringType()),
        T.StructField("activity", T.StringType()),
        T.StructField("ts_start", T.DoubleType()),
        T.StructField("ts_end", T.DoubleType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("agent", T.StringType()),
        T.StructField("resource", T.StringType()),
        T.StructField("tokens_in", T.LongType()),
        T.StructField("tokens_cached", T.LongType()),
        T.StructField("tokens_cache_write", T.LongType()),
        T.StructField("tokens_out", T.LongType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("attrs", T.StringType()),
    ]
)
COLUMNS = EVENT.fieldNames()
