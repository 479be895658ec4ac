"""Registered queries from raw records to the event log: each format, written from the tables and read by its adapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import abstraction, mining, normalize, pricing
from ..sources import chat, detect, json_text, otlp, tables, transcripts
from .catalogue import CANON, LABELS, _labels, query
from .staging import shared_dir, staged

_PRICES = {"gpt-5": (2.0, 10.0), "claude-x": (3.0, 15.0)}
_EVENT = ("case_id", "event_id", "activity", "ts_start", "ts_end", "parent_id", "agent", "resource", "tokens_in", "tokens_cached", "tokens_cache_write", "tokens_out", "cost_usd", "status", "error_type")


_KINDS = {"stringValue": "string", "intValue": "string", "doubleValue": "double", "boolValue": "boolean"}


def _value(kind: str, c: Column) -> Column:
    return F.struct(*[(c if k == kind else F.lit(None)).cast(t).alias(k) for k, t in _KINDS.items()])


def _pair(key: str, kind: str, c: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(F.lit(key).alias("key"), _value(kind, c).alias("value")))


def _pairs(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def otlp_lines(spark, sf_dir: str) -> DataFrame:
    """``events`` as OTLP exports: an object for each user's day, with a container span above its events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind, micros = F.col("event_type"), F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    trace = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyyMMdd"))
    of = lambda *kinds, then: F.when(kind.isin(*kinds), then)
    odd = F.col("event_id") % 2 == 1
    cents = (F.col("value").cast("decimal(18,2)") * 100).cast("long")
    attributes = _pairs(
        _pair("gen_ai.operation.name", "stringValue", F.when(kind.isin("view", "click"), "chat").when(kind == "signup", "execute")),
        _pair("gen_ai.request.model", "stringValue", F.when(kind == "view", "gpt-5-mini").when(kind == "click", "claude-x").when(kind == "signup", F.concat(F.lit("mystery-"), (F.col("user_id") % 3).cast("string")))),
        _pair("gen_ai.usage.input_tokens", "intValue", of("view", then=cents)), _pair("gen_ai.usage.cached_input_tokens", "doubleValue", of("view", then=F.col("value"))),
        _pair("gen_ai.usage.prompt_tokens", "doubleValue", of("click", "signup", then=F.col("value") * 100)), _pair("gen_ai.usage.output_tokens", "intValue", of("click", then=F.col("event_id") % 100)),
        _pair("gen_ai.usage.cache_read_tokens", "intValue", of("click", then=F.lit(5))), _pair(normalize.DECLARED, "boolValue", of("click", then=odd)),
        _pair("gen_ai.usage.cache_creation_input_tokens", "stringValue", of("click", then=F.when(odd, "7").otherwise("7.5"))),
        _pair("tool.name", "stringValue", F.when(kind == "purchase", "buy").when(kind == "error", "call")),
    )
    failed = kind == "error"
    status = F.struct(F.when(failed & odd, "STATUS_CODE_ERROR").when(failed, "2").otherwise("1").alias("code"), F.when(failed, "broken").alias("message"))
    nano = lambda c: F.concat(c.cast("string"), F.lit("000"))
    span = F.struct(
        trace.alias("traceId"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("spanId"), F.concat(F.lit("root-"), trace).alias("parentSpanId"), kind.alias("name"),
        nano(micros).alias("startTimeUnixNano"), F.when(kind != "signup", nano(micros + F.col("event_id") % 1000 * 1000)).alias("endTimeUnixNano"), attributes.alias("attributes"), status.alias("status"),
    )
    days = e.select(trace.alias("trace"), "user_id", micros.alias("micros"), span.alias("span")).groupBy("trace", "user_id").agg(F.collect_list("span").alias("spans"), F.min("micros").alias("first"))
    root = F.struct(
        F.col("trace").alias("traceId"), F.concat(F.lit("root-"), "trace").alias("spanId"), F.lit("run").alias("name"), nano(F.col("first")).alias("startTimeUnixNano"),
        _pairs(_pair("session.id", "stringValue", F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")))).alias("attributes"),
    )
    texts = F.concat(F.lit('{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"shop"}}]},"scopeSpans":[{"spans":['), F.to_json(root), F.lit(']},{"spans":'), F.to_json("spans"), F.lit("}]}]}"))
    return days.select(texts.alias("value"))


def _otlp_spans(spark, sf_dir: str) -> DataFrame:
    return staged(otlp.spans(json_text.parsed_lines(otlp_lines(spark, sf_dir), otlp.SCHEMA)), "spans")


def _prices(spark):
    return pricing.price_table(spark, _PRICES)


OTLP = """src AS (SELECT *, event_id % 2 = 1 AS odd, CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents, user_id || '-' || strftime(ts, '%Y%m%d') AS trace, epoch_us(ts) AS us FROM events),
tok AS (SELECT *, CASE event_type WHEN 'view' THEN cents WHEN 'click' THEN CAST(trunc(value * 100) AS BIGINT) WHEN 'signup' THEN CAST(trunc(value * 100) AS BIGINT) ELSE 0 END AS tin,
  CASE event_type WHEN 'view' THEN CAST(trunc(value) AS BIGINT) WHEN 'click' THEN 5 ELSE 0 END AS cached, CASE WHEN event_type = 'click' THEN event_id % 100 ELSE 0 END AS tout, CASE WHEN event_type = 'click' AND odd THEN 7 ELSE 0 END AS written FROM src),
net AS (SELECT * REPLACE (CASE WHEN (event_type = 'view' OR event_type = 'click' AND odd) AND tin > 0 AND cached > 0 THEN greatest(tin - cached, 0) ELSE tin END AS tin) FROM tok),
otlp AS (SELECT trace AS case_id, user_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id, event_type,
  CASE event_type WHEN 'view' THEN 'chat:gpt-5-mini' WHEN 'click' THEN 'chat:claude-x' WHEN 'signup' THEN 'execute:mystery-' || user_id % 3 WHEN 'purchase' THEN 'tool:buy' ELSE 'tool:call' END AS activity,
  us / 1e6 AS ts_start, CASE WHEN event_type <> 'signup' THEN (us + event_id % 1000 * 1000) / 1e6 END AS ts_end, 'root-' || trace AS parent_id, 'shop' AS agent,
  CASE event_type WHEN 'view' THEN 'gpt-5-mini' WHEN 'click' THEN 'claude-x' WHEN 'signup' THEN 'mystery-' || user_id % 3 WHEN 'purchase' THEN 'buy' ELSE 'call' END AS resource,
  tin AS tokens_in, cached AS tokens_cached, CAST(written AS BIGINT) AS tokens_cache_write, tout AS tokens_out,
  CASE event_type WHEN 'view' THEN (tin + cached * 0.1::DOUBLE) * 2 / 1e6 WHEN 'click' THEN ((tin + cached * 0.1::DOUBLE + written * 1.25::DOUBLE) * 3 + tout * 15) / 1e6 ELSE 0 END AS cost_usd,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, CASE WHEN event_type = 'error' THEN 'broken' END AS error_type FROM net)"""


@query(f"WITH {OTLP} SELECT {', '.join(_EVENT)} FROM otlp")
def otlp_events(spark, sf_dir):
    return normalize.normalize(_otlp_spans(spark, sf_dir), _prices(spark)).select(*_EVENT)


@query(f"WITH {OTLP} SELECT 's' || user_id % 7 AS case_id, event_id FROM otlp")
def otlp_sessions(spark, sf_dir):
    return normalize.normalize(_otlp_spans(spark, sf_dir), _prices(spark), case="session").select("case_id", "event_id")


@query("SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id, CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 2 = 1 THEN 'true' ELSE 'false' END END AS declared, CASE WHEN event_type = 'click' THEN event_id % 100 END AS counted FROM events")
def otlp_attributes(spark, sf_dir):
    """Values keep their types in the event's attributes."""
    log = normalize.normalize(_otlp_spans(spark, sf_dir), _prices(spark))
    at = lambda name: F.get_json_object("attrs", f"$['{name}']")
    return log.select("event_id", at(normalize.DECLARED).alias("declared"), at("gen_ai.usage.output_tokens").cast("long").alias("counted"))


@query(f"WITH {OTLP} SELECT 'leaves' AS how, count(*) AS n FROM otlp UNION ALL SELECT 'all', count(*) + count(DISTINCT case_id) FROM otlp")
def otlp_flatten(spark, sf_dir):
    spans = _otlp_spans(spark, sf_dir)
    count = lambda how: normalize.normalize(spans, _prices(spark), flatten=how).agg(F.lit(how).alias("how"), F.count("*").alias("n"))
    return count("leaves").unionByName(count("all"))


@query(f"WITH {OTLP} SELECT activity, count(*) AS n, CAST(sum(CAST(cost_usd AS DECIMAL(28,9))) AS DOUBLE) AS cost, CAST(sum(CAST(CASE WHEN ts_end IS NULL THEN 0 ELSE ts_end - ts_start END AS DECIMAL(28,9))) AS DOUBLE) AS duration, CAST(sum(tokens_in + tokens_cached + tokens_out) AS BIGINT) AS tokens, CAST(count(*) FILTER (WHERE status = 'error') AS BIGINT) AS errors FROM otlp GROUP BY activity")
def otlp_nodes(spark, sf_dir):
    """Over the event log as its writer and reader leave it."""
    path = f"{shared_dir(spark)}/otlp-log"
    detect.write_log(normalize.normalize(_otlp_spans(spark, sf_dir), _prices(spark)), path)
    return mining.nodes(detect.read_log(spark, path))


@query("SELECT DISTINCT 'mystery-' || user_id % 3 AS source FROM events WHERE event_type = 'signup' AND trunc(value * 100) > 0")
def unknown_conventions(spark, sf_dir):
    return normalize.unknown_conventions(_otlp_spans(spark, sf_dir))


@query("SELECT DISTINCT 'mystery-' || user_id % 3 AS model FROM events WHERE event_type = 'signup' AND trunc(value * 100) > 0")
def unknown_models(spark, sf_dir):
    return pricing.unknown_models(normalize.normalize(_otlp_spans(spark, sf_dir), _prices(spark)), _prices(spark))


_TOOL = "array<struct<type:string,id:string,name:string,tool_use_id:string,is_error:boolean>>"


def transcript_lines(spark, sf_dir: str) -> DataFrame:
    """``conversations`` as transcripts: a file for each, assistant turns that call a tool every fourth line."""
    from pyspark.sql import Window

    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")
    w = Window.partitionBy("conv_id").orderBy("turn")
    called = (F.col("role") == "assistant") & (turn % 4 == 1)
    tool = F.concat(F.lit("t-"), conv, F.lit("-"), turn.cast("string"))
    c = c.withColumns({"tool": F.when(called, tool), "before": F.lag(F.when(called, tool)).over(w)})
    at = F.concat(F.replace(F.timestamp_add("SECOND", (F.col("conv_id") * 100 + turn).cast("int"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    empty = F.lit(None).cast("string")
    block = lambda kind, id_=empty, name=empty, of=empty, bad=F.lit(None).cast("boolean"): F.struct(F.lit(kind).alias("type"), id_.alias("id"), name.alias("name"), of.alias("tool_use_id"), bad.alias("is_error"))
    asked = F.when(F.col("before").isNotNull(), F.array(block("tool_result", of=F.col("before"), bad=F.col("conv_id") % 5 == 0)))
    said = F.when(F.col("tool").isNotNull(), F.array(block("text"), block("tool_use", F.col("tool"), F.concat(F.lit("Tool"), (turn % 3).cast("string"))))).otherwise(F.array(block("text")))
    usage = F.struct(
        F.lit(100).alias("input_tokens"), turn.cast("long").alias("output_tokens"), F.lit(50).alias("cache_read_input_tokens"), F.lit(9).alias("cache_creation_input_tokens"),
        F.when(F.col("conv_id") % 2 == 0, F.struct(F.lit(3).alias("ephemeral_5m_input_tokens"), F.lit(4).alias("ephemeral_1h_input_tokens"))).alias("cache_creation"),
    )
    mine = F.col("role") == "assistant"
    record = F.struct(
        F.col("role").alias("type"), F.concat(F.lit("u-"), conv, F.lit("-"), turn.cast("string")).alias("uuid"), conv.alias("sessionId"), at.alias("timestamp"), F.concat(F.lit("/work/p"), (F.col("conv_id") % 3).cast("string")).alias("cwd"),
        F.when(mine, F.concat(F.lit("r-"), conv, F.lit("-"), F.floor(turn / 4).cast("string"))).alias("requestId"), F.when(F.col("role") == "user", F.concat(F.lit("p-"), conv, F.lit("-"), turn.cast("string"))).alias("promptId"),
        (mine & (F.col("conv_id") % 4 == 0)).alias("isSidechain"),
        F.struct(F.when(mine, "claude-x").alias("model"), F.when(mine, said).otherwise(asked).alias("content"), F.when(mine, usage).alias("usage")).alias("message"),
    )
    return c.select(F.concat(F.lit("/logs/"), conv, F.lit(".jsonl")).alias("file"), turn.cast("int").alias("line"), F.to_json(record).alias("value"))


TRANSCRIPT = """c AS (SELECT conv_id, turn, role, 1767225600.0 + conv_id * 100 + turn AS ts, role = 'assistant' AS mine, 'r-' || conv_id || '-' || turn // 4 AS key FROM conversations),
l AS (SELECT *, lag(ts) OVER w AS seen, last_value(CASE WHEN role = 'user' THEN 'p-' || conv_id || '-' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prompt,
  CASE WHEN mine AND lag(mine) OVER w AND lag(key) OVER w = key THEN 0 ELSE 1 END AS opens, lead(role) OVER w AS next_role, lead(ts) OVER w AS next_ts FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM l),
turns AS (SELECT conv_id, island, min(turn) AS turn, max(turn) AS last_turn, arg_min(seen, turn) AS seen, max(ts) AS ts_end, arg_min(key, turn) AS key, arg_min(prompt, turn) AS prompt FROM i WHERE mine GROUP BY conv_id, island),
paid AS (SELECT *, row_number() OVER (PARTITION BY conv_id, key ORDER BY island) = 1 AS once, coalesce(prompt, CAST(conv_id AS VARCHAR)) AS task, first_value(coalesce(prompt, CAST(conv_id AS VARCHAR))) OVER (PARTITION BY conv_id, key ORDER BY island) AS first_task,
  'p' || conv_id % 3 || CASE WHEN conv_id % 4 = 0 THEN '/subagent' ELSE '' END AS agent FROM turns),
trans AS (
  SELECT first_task AS case_id, key AS event_id, 'chat:claude-x' AS activity, CASE WHEN seen <= ts_end THEN seen ELSE ts_end END AS ts_start, ts_end, CAST(NULL AS VARCHAR) AS parent_id, agent, 'claude-x' AS resource,
    CASE WHEN once THEN 100 ELSE 0 END::BIGINT AS tokens_in, CASE WHEN once THEN 50 ELSE 0 END::BIGINT AS tokens_cached, CASE WHEN NOT once THEN 0 WHEN conv_id % 2 = 0 THEN 7 ELSE 9 END::BIGINT AS tokens_cache_write, CASE WHEN once THEN turn ELSE 0 END::BIGINT AS tokens_out,
    CASE WHEN once THEN ((100 + 50 * 0.1::DOUBLE + CASE WHEN conv_id % 2 = 0 THEN 3 * 1.25::DOUBLE + 4 * 2.0::DOUBLE ELSE 9 * 1.25::DOUBLE END) * 3 + turn * 15) / 1e6 ELSE 0 END AS cost_usd, 'ok' AS status, CAST(NULL AS VARCHAR) AS error_type FROM paid
  UNION ALL
  SELECT p.task, 't-' || i.conv_id || '-' || i.turn, 'tool:Tool' || i.turn % 3, p.ts_end, CASE WHEN i.next_role = 'user' THEN i.next_ts END, p.key, p.agent, 'Tool' || i.turn % 3, 0, 0, 0, 0, 0,
    CASE WHEN i.next_role = 'user' AND i.conv_id % 5 = 0 THEN 'error' ELSE 'ok' END, CASE WHEN i.next_role = 'user' AND i.conv_id % 5 = 0 THEN 'tool_error' END FROM i JOIN paid AS p USING (conv_id, island) WHERE i.mine AND i.turn % 4 = 1)"""


@query(f"WITH {TRANSCRIPT} SELECT {', '.join(_EVENT)} FROM trans")
def transcript_events(spark, sf_dir):
    spans = transcripts.spans(transcripts.parsed(transcript_lines(spark, sf_dir)))
    return normalize.normalize(staged(spans, "spans"), _prices(spark), case="task").select(*_EVENT)


def chat_lines(spark, sf_dir: str) -> DataFrame:
    """``conversations`` as dumps of chat sessions; every tenth has no id of its own."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    tools = F.when(F.col("turn") % 2 == 1, F.array(*[F.struct(F.lit(n).alias("name")) for n in ("ls", "cat")])).otherwise(F.array(F.struct(F.lit("grep").alias("name"))))
    message = F.struct("turn", F.struct("role", F.when(F.col("role") == "assistant", tools).alias("tool_calls")).alias("m"))
    s = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(message)), lambda x: x["m"]).alias("messages"))
    named = F.when(F.col("conv_id") % 10 != 9, F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    record = F.struct(named.alias("session_id"), F.when(F.col("conv_id") % 2 == 0, "gpt-5").alias("model"), F.when(F.col("conv_id") % 3 == 0, F.lit(False)).when(F.col("conv_id") % 3 == 1, F.lit(True)).alias("resolved"), "messages")
    return s.select(F.lit("/dump.jsonl").alias("file"), F.floor(F.col("conv_id") / 64).alias("block"), F.col("conv_id").cast("long").alias("nr"), F.to_json(record).alias("value"))


CHAT = """s AS (SELECT conv_id, CASE WHEN conv_id % 10 <> 9 THEN 'c' || conv_id ELSE CAST(row_number() OVER (ORDER BY conv_id) - 1 AS VARCHAR) END AS case_id FROM (SELECT DISTINCT conv_id FROM conversations)),
st AS (SELECT case_id, conv_id, turn, j, CASE WHEN j = 0 THEN 'chat' WHEN turn % 2 = 0 THEN 'grep' WHEN j = 1 THEN 'ls' ELSE 'cat' END AS name, row_number() OVER (PARTITION BY conv_id ORDER BY turn, j) - 1 AS clock
  FROM conversations JOIN s USING (conv_id), unnest(range(0, 2 + turn % 2)) AS r(j) WHERE role = 'assistant'),
own AS (SELECT *, case_id || '#' || max(CASE WHEN j = 0 THEN clock END) OVER (PARTITION BY conv_id ORDER BY clock ROWS UNBOUNDED PRECEDING) AS chat_id,
  case_id || '#' || max(CASE WHEN j = 0 THEN clock END) OVER (PARTITION BY conv_id ORDER BY clock ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM st)"""


@query(
    f"""WITH {CHAT} SELECT case_id, CASE WHEN j = 0 THEN chat_id ELSE chat_id || '.' || (j - 1) END AS event_id, CASE WHEN j > 0 THEN 'tool:' || name WHEN conv_id % 2 = 0 THEN 'chat:gpt-5' ELSE 'chat' END AS activity,
  clock::DOUBLE AS ts_start, clock::DOUBLE + 1 AS ts_end, CASE WHEN j = 0 THEN prev ELSE chat_id END AS parent_id, CASE conv_id % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'resolved' END AS outcome FROM own"""
)
def chat_events(spark, sf_dir):
    spans = chat.spans(json_text.parsed_lines(chat_lines(spark, sf_dir), chat.SCHEMA))
    log = normalize.normalize(spans, _prices(spark))
    return log.select("case_id", "event_id", "activity", "ts_start", "ts_end", "parent_id", F.get_json_object("attrs", "$.outcome").alias("outcome"))


@query(f"WITH {LABELS}, {CANON}, d AS (SELECT DISTINCT c FROM canon), names AS (SELECT DISTINCT left(c, 4) AS a FROM d), k AS (SELECT (SELECT count(*) FROM d) > 400 AND (SELECT count(*) FROM names) > 12 AS twice) SELECT c AS label, CASE WHEN twice THEN left(c, 2) ELSE left(c, 4) END AS activity FROM d, k")
def vocabulary_build(spark, sf_dir):
    """Chunks of labels are clustered by their first letters, then the names of the clusters once more."""
    from ..functions.columns import canonical

    labels = [r[0] for r in _labels(spark, sf_dir).select(canonical(F.col("activity_raw"))).distinct().collect()]
    built = abstraction.build(labels, lambda part, target: {x: x[:2] if all(len(y) <= 4 for y in part) else x[:4] for x in part})
    return spark.createDataFrame(sorted(built.items()), "label string, activity string")
