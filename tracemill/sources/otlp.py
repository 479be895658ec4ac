"""OTLP/JSON exports: resource spans, scope spans, spans; camel or snake case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import present
from ..schema import RAW_SPAN
from . import json_text

#: Lists and maps inside a value are read to this depth; what is deeper stays as it is written.
DEPTH = 1


def _value_type(depth: int) -> str:
    inner = _value_type(depth - 1) if depth else None
    items = f"struct<values:array<{inner}>>" if inner else "string"
    pairs = f"struct<values:array<struct<key:string,value:{inner}>>>" if inner else "string"
    return f"struct<stringValue:string,intValue:string,doubleValue:string,boolValue:string,arrayValue:{items},kvlistValue:{pairs},bytesValue:string>"


_VALUE = _value_type(DEPTH)
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_SPAN = (
    "struct<traceId:string,trace_id:string,spanId:string,span_id:string,parentSpanId:string,parent_span_id:string,name:string,startTimeUnixNano:string,start_time_unix_nano:string,"
    f"endTimeUnixNano:string,end_time_unix_nano:string,attributes:{_ATTRS},status:struct<code:string,message:string>>"
)
_RESOURCE = f"struct<resource:struct<attributes:{_ATTRS}>,scopeSpans:array<struct<spans:array<{_SPAN}>>>,scope_spans:array<struct<spans:array<{_SPAN}>>>>"
SCHEMA = f"struct<resourceSpans:array<{_RESOURCE}>,resource_spans:array<{_RESOURCE}>>"


def json_value(v: Column, depth: int = DEPTH) -> Column:
    """The value as JSON text that keeps its type; an integer that is none is a JSON null."""
    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    whole = F.when(F.trim(v["intValue"]).rlike(r"^[+-]?\d{1,38}$"), F.trim(v["intValue"]).try_cast("decimal(38,0)").cast("string"))
    real = F.when(v["doubleValue"].rlike(number), v["doubleValue"]).otherwise(json_text.encoded(v["doubleValue"]))
    if depth:
        items = F.transform(v["arrayValue"]["values"], lambda x: json_value(x, depth - 1))
        many = F.when(v["arrayValue"].isNotNull(), F.concat(F.lit("["), F.coalesce(F.array_join(items, ","), F.lit("")), F.lit("]")))
        pairs = F.when(v["kvlistValue"].isNotNull(), json_text.object_text(_entries(F.coalesce(v["kvlistValue"]["values"], F.array()), depth - 1)))
    else:
        many, pairs = v["arrayValue"], v["kvlistValue"]
    return F.coalesce(
        F.when(v["stringValue"].isNotNull(), json_text.encoded(v["stringValue"])), F.when(v["intValue"].isNotNull(), F.coalesce(whole, F.lit("null"))), F.when(v["doubleValue"].isNotNull(), real),
        v["boolValue"], many, pairs, F.when(v["bytesValue"].isNotNull(), json_text.encoded(v["bytesValue"])), F.lit("null"),
    )


def _entries(items: Column, depth: int = DEPTH) -> Column:
    """``struct<key, value>`` of each name; the last of equal ones counts."""
    good = F.filter(items, lambda x: x["key"].isNotNull())
    last = F.filter(good, lambda x, i: ~F.exists(F.slice(good, i + 2, F.size(good) + 1), lambda y: y["key"] == x["key"]))
    return F.transform(last, lambda x: F.named_struct(F.lit("key"), x["key"], F.lit("value"), json_value(x["value"], depth)))


def attribute_map(items: Column) -> Column:
    """A map from the attributes' names to their values as JSON text."""
    return F.map_from_entries(_entries(F.coalesce(items, F.array().cast(_ATTRS))))


def nanos(c: Column) -> Column:
    """Seconds, correctly rounded; null where there is no time."""
    n = c.try_cast("decimal(20,0)")
    return F.when(n != 0, (n / F.lit(1000000000).cast("decimal(10,0)")).cast("double"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Raw spans of the files below ``path``."""
    return spans(json_text.documents(spark, path, SCHEMA))


def spans(docs: DataFrame) -> DataFrame:
    """Raw spans of ``doc``s; a span without a start is left out."""
    either = lambda a, b: F.coalesce(F.when(F.size(a) > 0, a), b)
    rs = docs.select(F.explode(either(F.col("doc.resourceSpans"), F.col("doc.resource_spans"))).alias("r"))
    ss = rs.select(attribute_map(F.col("r.resource.attributes")).alias("resource_attrs"), F.explode(either(F.col("r.scopeSpans"), F.col("r.scope_spans"))).alias("s"))
    x = ss.select("resource_attrs", F.explode("s.spans").alias("x")).select("resource_attrs", "x.*")
    both = lambda a, b: F.coalesce(present(F.col(a)), present(F.col(b)))
    code = F.upper(F.coalesce("status.code", F.lit("0")))
    failed = (code == "2") | F.contains(code, F.lit("ERROR"))
    out = x.select(
        F.coalesce(both("spanId", "span_id"), F.lit("")).alias("span_id"), F.coalesce(both("traceId", "trace_id"), F.lit("")).alias("trace_id"), both("parentSpanId", "parent_span_id").alias("parent_id"),
        F.coalesce("name", F.lit("")).alias("name"), nanos(both("startTimeUnixNano", "start_time_unix_nano")).alias("ts_start"), nanos(both("endTimeUnixNano", "end_time_unix_nano")).alias("ts_end"),
        attribute_map(F.col("attributes")).alias("attrs"), F.when(failed, "error").otherwise("ok").alias("status"), F.when(failed, F.col("status.message")).alias("error_type"), "resource_attrs",
    )
    return out.filter("ts_start IS NOT NULL").select(*RAW_SPAN.fieldNames())
