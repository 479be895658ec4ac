"""Dumps of chat sessions: messages with roles and tool calls, without times.

Only names leave a session: models, tools, ids and the outcome; never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import present
from ..schema import RAW_SPAN
from . import json_text

_CALLS = "array<struct<name:string,function:struct<name:string>>>"
_MESSAGES = f"array<struct<role:string,tool_calls_json:string,tool_calls:{_CALLS}>>"
SCHEMA = (
    "struct<session_id:string,id:string,instance_id:string,agent_framework:string,recorded_model:string,model:string,source_dataset:string,resolved:boolean,ground_truth_meta_json:string,"
    f"messages_json:string,messages:{_MESSAGES}>"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Raw spans of the files below ``path``."""
    return spans(json_text.documents(spark, path, SCHEMA))


def spans(docs: DataFrame) -> DataFrame:
    """Raw spans on a clock that ticks once a step: each assistant message, then its tools.

    A session without an id is called by its number in its file.
    """
    places, docs = docs, docs.select("file", "block", "nr", "doc.*")
    resolved = F.coalesce(F.from_json("ground_truth_meta_json", "resolved boolean")["resolved"], F.col("resolved"))
    s = docs.select(
        "file", "block", "nr",
        F.coalesce(present(F.col("session_id")), present(F.col("id")), present(F.col("instance_id"))).alias("case"),
        F.coalesce(present(F.col("recorded_model")), F.col("model")).alias("model"),
        F.coalesce(present(F.col("agent_framework")), F.lit("agent")).alias("agent"),
        F.coalesce(present(F.col("source_dataset")), F.lit("messages")).alias("service"),
        F.when(resolved, "resolved").when(~resolved, "failed").alias("outcome"),
        F.posexplode(F.coalesce(F.from_json("messages_json", _MESSAGES), F.col("messages"))).alias("m", "msg"),
    ).filter("msg.role = 'assistant'")
    calls = F.coalesce(F.from_json("msg.tool_calls_json", _CALLS), F.col("msg.tool_calls"), F.array().cast(_CALLS))
    names = F.filter(F.transform(calls, lambda c: F.coalesce(present(c["function"]["name"]), present(c["name"]))), lambda n: n.isNotNull())
    steps = s.select("*", F.posexplode(F.concat(F.array(F.lit("chat")), names)).alias("j", "name"))
    # Only sessions without an id need their number; these rows hold names, no texts.
    nameless = json_text.numbered(places).withColumnsRenamed({"file": "_file", "block": "_block", "nr": "_nr"})
    at = (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")) & (F.col("nr") == F.col("_nr"))
    found = steps.filter("case IS NULL").join(nameless, at).withColumn("case", F.col("i").cast("string")).select(steps.columns)
    steps = steps.filter("case IS NOT NULL").unionByName(found)
    w = Window.partitionBy("file", "block", "nr").orderBy("m", "j")
    steps = steps.withColumn("clock", (F.row_number().over(w) - 1).cast("long"))
    own = F.concat_ws("#", "case", F.max(F.when(F.col("j") == 0, F.col("clock"))).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("string"))
    steps = steps.withColumn("chat_id", own)
    prev = F.max_by(F.when(F.col("j") == 0, F.col("chat_id")), F.when(F.col("j") == 0, F.col("clock"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    is_chat = F.col("j") == 0
    return steps.select(
        F.when(is_chat, F.col("chat_id")).otherwise(F.concat("chat_id", F.lit("."), (F.col("j") - 1).cast("string"))).alias("span_id"),
        F.col("case").alias("trace_id"), F.when(is_chat, prev).otherwise(F.col("chat_id")).alias("parent_id"), "name",
        F.col("clock").cast("double").alias("ts_start"), (F.col("clock") + 1).cast("double").alias("ts_end"),
        json_text.attrs(
            gen_ai__operation__name=F.when(is_chat, "chat"), gen_ai__request__model=F.when(is_chat, F.col("model")), gen_ai__tool__name=F.when(~is_chat, F.col("name")),
            gen_ai__conversation__id=F.col("case"), gen_ai__task__id=F.col("case"), gen_ai__agent__name=F.col("agent"), outcome=F.col("outcome"),
        ).alias("attrs"),
        F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error_type"), json_text.attrs(service__name=F.col("service")).alias("resource_attrs"),
    ).select(*RAW_SPAN.fieldNames())
