"""Transcripts of coding agents: one JSON record per line, one session per file.

Order matters, so a file is read whole and its lines are numbered; the rest is windows
over (file, line). Texts never leave: only names, models, counters and times do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import present
from ..schema import RAW_SPAN
from . import json_text

_BLOCKS = "array<struct<type:string,id:string,name:string,tool_use_id:string,is_error:boolean>>"
_USAGE = (
    "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint,"
    "cache_creation:struct<ephemeral_5m_input_tokens:bigint,ephemeral_1h_input_tokens:bigint>,output_tokens_details:struct<thinking_tokens:bigint>>"
)
SCHEMA = (
    "struct<type:string,uuid:string,parentUuid:string,sessionId:string,session_id:string,requestId:string,promptId:string,timestamp:string,cwd:string,isSidechain:boolean,effort:string,"
    f"message:struct<model:string,content:string,usage:{_USAGE}>>"
)


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, line`` and the fields of every record that can be read."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path, wholetext=True)
    lines = whole.select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value")).filter(F.trim("value") != "")
    return parsed(lines)


def parsed(lines: DataFrame) -> DataFrame:
    """The records of ``file, line, value``; one that is cut off parses in part, and only whole ones count."""
    return lines.filter(F.try_parse_json("value").isNotNull()).select("file", "line", F.from_json("value", SCHEMA).alias("r")).filter("r IS NOT NULL").select("file", "line", "r.*")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Raw spans of the files below ``path``."""
    return spans(records(spark, path))


def spans(found: DataFrame) -> DataFrame:
    """Raw spans: a turn for each run of records of one request, and the tool calls in it."""
    r = found.withColumn("ts", json_text.seconds(F.col("timestamp"))).withColumn("blocks", F.from_json("message.content", _BLOCKS))
    w = Window.partitionBy("file").orderBy("line")
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    is_turn = (F.col("type") == "assistant") & F.col("ts").isNotNull()
    key = F.coalesce(present(F.col("requestId")), F.col("uuid"))
    r = r.withColumns({"is_turn": F.coalesce(is_turn, F.lit(False)), "key": key, "stem": F.regexp_extract("file", r"([^/]+)\.jsonl$", 1), "folder": F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)})
    r = r.withColumn("opens", ~F.coalesce(F.lag("is_turn").over(w) & F.col("is_turn") & (F.lag("key").over(w) == F.col("key")), F.lit(False)))
    project = F.first(F.when(F.col("cwd") != "", F.regexp_extract(F.regexp_replace("cwd", "/+$", ""), r"([^/]*)$", 1)), ignorenulls=True).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    r = r.withColumns(
        {
            "island": F.sum(F.col("opens").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "seen_ts": F.last("ts", ignorenulls=True).over(so_far),
            "task": F.last(F.when(~F.col("is_turn"), present(F.col("promptId"))), ignorenulls=True).over(so_far),
            "project": F.coalesce(project, F.col("folder")),
        }
    )
    one = lambda c: F.min_by(c, F.col("line"))
    turns = r.filter("is_turn").groupBy("file", "island").agg(
        one(F.col("seen_ts")).alias("seen_ts"), F.max_by("ts", "line").alias("ts_end"), one(F.coalesce(present(F.col("sessionId")), present(F.col("session_id")), F.col("stem"))).alias("session"),
        one(F.coalesce("key", F.lit(""))).alias("span_id"), one(F.col("task")).alias("task"), one(present(F.col("parentUuid"))).alias("parent_id"), one(F.col("message.model")).alias("model"),
        one(F.col("message.usage")).alias("usage"), one(present(F.col("effort"))).alias("effort"), F.max("project").alias("project"), F.max(F.coalesce("isSidechain", F.lit(False))).alias("side"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line", "blocks"))), lambda x: F.coalesce(x["blocks"], F.array().cast(_BLOCKS)))).alias("blocks"),
    )
    turns = turns.withColumns(
        {
            "nth": F.row_number().over(Window.partitionBy("file", "span_id").orderBy("island")),
            "agent": F.when(F.col("side"), F.concat("project", F.lit("/subagent"))).otherwise(F.col("project")),
            "task": F.coalesce("task", "session"),
            "ts_start": F.when(F.col("seen_ts") <= F.col("ts_end"), F.col("seen_ts")).otherwise(F.col("ts_end")),
        }
    )
    # A request that comes in several runs is paid once.
    paid = lambda c: F.when(F.col("nth") == 1, c)
    w5, w1 = F.col("usage.cache_creation.ephemeral_5m_input_tokens"), F.col("usage.cache_creation.ephemeral_1h_input_tokens")
    split = (F.coalesce(w5, F.lit(0)) > 0) | (F.coalesce(w1, F.lit(0)) > 0)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("blocks", lambda b: b["type"]), lambda t: present(t).isNotNull()))), ",")
    chat_attrs = F.map_concat(
        json_text.attrs(
            gen_ai__operation__name=F.lit("chat"), gen_ai__request__model=F.col("model"), gen_ai__conversation__id=F.col("session"), gen_ai__task__id=F.col("task"), gen_ai__agent__name=F.col("agent"),
            gen_ai__usage__input_tokens=paid(F.col("usage.input_tokens")), gen_ai__usage__output_tokens=paid(F.col("usage.output_tokens")), gen_ai__usage__cache_read_input_tokens=paid(F.col("usage.cache_read_input_tokens")),
            reasoning_tokens=paid(F.col("usage.output_tokens_details.thinking_tokens")), effort=F.col("effort"), content_kinds=present(kinds),
        ),
        json_text.attrs(
            **{
                "anthropic__usage__cache_creation__ephemeral_5m_input_tokens": paid(F.when(split, w5).otherwise(F.col("usage.cache_creation_input_tokens"))),
                "anthropic__usage__cache_creation__ephemeral_1h_input_tokens": paid(F.when(split, w1)),
            }
        ),
    )
    service = json_text.attrs(service__name=F.lit("coding-agent"))
    chats = turns.select(
        "span_id", F.col("session").alias("trace_id"), "parent_id", F.lit("chat").alias("name"), F.coalesce("ts_start", F.lit(0.0)).alias("ts_start"), "ts_end", chat_attrs.alias("attrs"),
        F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error_type"), service.alias("resource_attrs"),
    )
    done = r.filter("type = 'user'").select("file", "line", "ts", F.posexplode("blocks").alias("b", "x")).filter("x.type = 'tool_result' AND x.tool_use_id <> ''")
    done = done.groupBy(F.col("file").alias("_file"), F.col("x.tool_use_id").alias("_id")).agg(F.max_by(F.struct("ts", F.coalesce("x.is_error", F.lit(False)).alias("failed")), F.struct("line", "b")).alias("done"))
    calls = turns.select("file", "session", "span_id", "ts_end", "task", "agent", F.explode("blocks").alias("x")).filter("x.type = 'tool_use'")
    calls = calls.join(done, (F.col("file") == F.col("_file")) & (F.col("x.id") == F.col("_id")), "left").withColumn("failed", F.coalesce("done.failed", F.lit(False)))
    tools = calls.select(
        F.coalesce("x.id", F.lit("")).alias("span_id"), F.col("session").alias("trace_id"), present(F.col("span_id")).alias("parent_id"), F.coalesce(present(F.col("x.name")), F.lit("unknown")).alias("name"),
        F.coalesce("ts_end", F.lit(0.0)).alias("ts_start"), F.col("done.ts").alias("ts_end"),
        json_text.attrs(gen_ai__tool__name=F.col("x.name"), gen_ai__conversation__id=F.col("session"), gen_ai__task__id=F.col("task"), gen_ai__agent__name=F.col("agent")).alias("attrs"),
        F.when(F.col("failed"), "error").otherwise("ok").alias("status"), F.when(F.col("failed"), "tool_error").alias("error_type"), service.alias("resource_attrs"),
    )
    return chats.unionByName(tools).select(*RAW_SPAN.fieldNames())
