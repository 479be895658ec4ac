"""From raw spans to the canonical event log: flatten, case notion, fields, price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import present
from ..plans.staging import staged
from ..sources import json_text
from ..sources.tables import canonical_columns
from . import pricing

# Attribute names of each field, the first that is there wins.
ALIASES = {
    "tokens_in": ("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens", "llm.token_count.prompt"),
    "tokens_out": ("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens", "llm.token_count.completion"),
    "tokens_cached": ("gen_ai.usage.cache_read_input_tokens", "gen_ai.usage.cached_input_tokens", "gen_ai.usage.cache_read_tokens", "llm.token_count.prompt_cache_hit"),
    "cache_write": ("gen_ai.usage.cache_creation_input_tokens", "gen_ai.usage.cache_write_tokens", "llm.token_count.prompt_cache_write"),
    "cache_write_5m": ("anthropic.usage.cache_creation.ephemeral_5m_input_tokens",),
    "cache_write_1h": ("anthropic.usage.cache_creation.ephemeral_1h_input_tokens",),
    "model": ("gen_ai.response.model", "gen_ai.request.model", "llm.model_name"),
    "tool": ("gen_ai.tool.name", "tool.name"),
    "agent": ("gen_ai.agent.name", "agent.name"),
    "session": ("gen_ai.conversation.id", "session.id", "gen_ai.session.id"),
    "task": ("gen_ai.task.id", "task.id"),
    "operation": ("gen_ai.operation.name",),
}
# A span with one of these attributes is an operation.
MARKERS = ("gen_ai.operation.name", "gen_ai.tool.name", "tool.name", "llm.request.type", "llm.model_name")
# Model prefixes whose input count includes, or leaves out, what the cache served.
FOLDED = ("gpt-", "o1", "o3", "o4", "chatgpt", "text-embedding")
EXCLUSIVE = ("claude-", "anthropic.claude", "gemini-", "models/gemini")
DECLARED = "tracemill.input_includes_cache"
#: Values, as JSON text, that declare nothing.
FALSE = ("false", "0", "0.0", "-0.0", '""', "[]", "{}")
MAX_DEPTH = 64


def raw_attribute(field: str, attrs: str = "attrs") -> Column:
    """The first alias that has a value, as JSON text. Each alias is named once, as filters repeat what they are pushed through."""
    return F.get(F.filter(F.array(*[F.try_element_at(attrs, F.lit(k)) for k in ALIASES[field]]), lambda v: v != "null"), F.lit(0))


def attribute(field: str, attrs: str = "attrs") -> Column:
    return json_text.text_of(raw_attribute(field, attrs))


def number(field: str) -> Column:
    return count_of(raw_attribute(field))


def count_of(v: Column) -> Column:
    """A JSON value as a count: a fraction is cut off, and what is no number counts 0; a text counts only if it is written as an integer."""

    def read(x: Column) -> Column:
        text = F.btrim(json_text.text_of(x), F.lit(" \t\n\r"))
        part = F.when(~F.startswith(x, F.lit('"')), text.try_cast("double"))
        return F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")), F.when(x == "true", 1), F.when(F.abs(part) < 9e18, part.cast("bigint")))

    return F.coalesce(F.get(F.transform(F.array(v), read), F.lit(0)), F.lit(0)).cast("long")


def is_operation() -> Column:
    return F.arrays_overlap(F.map_keys("attrs"), F.array(*[F.lit(m) for m in MARKERS]))


def activity_name(tool: Column, op: Column, model: Column) -> Column:
    return F.coalesce(F.concat(F.lit("tool:"), tool), F.concat(op, F.lit(":"), model), op, present(F.col("name")), F.lit("unknown"))


def leaves(spans: DataFrame) -> DataFrame:
    """Spans that are nobody's parent."""
    parents = spans.select(F.col("parent_id").alias("_parent")).filter("_parent IS NOT NULL").distinct()
    return spans.join(parents, F.col("span_id") == F.col("_parent"), "left_anti")


def inherit(nodes: DataFrame, value: str, depth: int = MAX_DEPTH) -> DataFrame:
    """``id`` and ``value`` from the nearest ancestor that has one, at most ``depth`` steps up.

    ``nodes`` has ``id, parent_id`` and the value. Pointers double: after each of at most seven joins
    a node looks twice as far. Each round is staged; it stops when no pointer is open. Of rows of one id the
    first counts, by ``at`` if there is such a column, else the least.
    """
    order = F.struct(F.col("at") if "at" in nodes.columns else F.lit(0).alias("at"), F.coalesce("parent_id", F.lit("")).alias("p"), F.coalesce(value, F.lit("")).alias("v"))
    reach = nodes.groupBy("id").agg(F.min_by(F.struct("parent_id", value), order).alias("x"))
    open_ = F.when(F.col("x." + value).isNull() & (F.col("x.parent_id") != F.col("id")), F.col("x.parent_id"))
    state = staged(reach.select("id", F.col("x." + value).alias("v"), open_.alias("up"), F.lit(1).alias("far")), "inherit")
    step = 1
    while step <= depth and state.filter("up IS NOT NULL").limit(1).count():
        there = state.select(F.col("id").alias("_id"), F.col("v").alias("_v"), F.col("up").alias("_up"), F.col("far").alias("_far"))
        joined = state.join(there, F.col("up") == F.col("_id"), "left")
        # What an ancestor found counts only within the depth; else the pointer moves on.
        found = F.col("_v").isNotNull() & (F.col("far") + F.coalesce("_far", F.lit(0)) - 1 <= depth)
        state = staged(joined.select(
            "id", F.coalesce("v", F.when(found, F.col("_v"))).alias("v"),
            F.when(F.col("v").isNull() & F.col("_v").isNull(), F.col("_up")).alias("up"),
            F.when(F.col("v").isNull(), F.col("far") + F.coalesce("_far", F.lit(0))).otherwise(F.col("far")).alias("far"),
        ), "inherit")
        step *= 2
    return state.select("id", F.col("v").alias(value))


def includes_cache(model: Column) -> Column:
    """Whether the input count includes cached tokens: declared, else by model, else unknown (null)."""
    of = lambda names: "^/*(" + "|".join(names) + ")"
    declared = F.get(F.filter(F.array(F.try_element_at("attrs", F.lit(DECLARED))), lambda v: v != "null"), F.lit(0))
    return F.when(declared.isNotNull(), ~declared.isin(*FALSE)).when(F.lower(model).rlike(of(FOLDED)), True).when(F.lower(model).rlike(of(p.replace(".", r"\.") for p in EXCLUSIVE)), False)


def normalize(spans: DataFrame, prices: DataFrame, flatten: str = "genai", case: str = "trace") -> DataFrame:
    """The event log of raw spans. ``flatten``: genai, leaves or all. ``case``: trace, session, task or attr:NAME."""
    if flatten not in ("genai", "leaves", "all"):
        raise ValueError(f"unknown flatten {flatten!r}")
    kept = spans.filter(is_operation()) if flatten == "genai" else leaves(spans) if flatten == "leaves" else spans
    trace = present(F.col("trace_id"))
    if case == "trace":
        notion = trace
    elif case.startswith("attr:"):
        notion = F.coalesce(present(json_text.plain(F.element_at("attrs", case[5:]))), trace)
    elif case in ("session", "task"):
        notion = trace
        for field in ("session", "task")[: 1 + (case == "task")]:
            own = spans.select(F.col("span_id").alias("id"), "parent_id", present(attribute(field)).alias(field), F.col("ts_start").alias("at"))
            kept = kept.join(inherit(own, field).withColumnsRenamed({"id": f"_{field}_id", field: f"_{field}"}), F.col("span_id") == F.col(f"_{field}_id"), "left")
            notion = F.coalesce(F.col(f"_{field}"), notion)
    else:
        raise ValueError(f"unknown case notion {case!r}")
    # The raw values first, each once; what follows reads them by name.
    raw = kept.withColumns({"_case": F.coalesce(notion, F.lit("unknown")), **{f"_raw_{f}": raw_attribute(f) for f in ALIASES}})
    plain = {f"_{f}": present(json_text.text_of(F.col(f"_raw_{f}"))) for f in ("model", "tool", "agent", "operation")}
    counts = {f"_{f}": count_of(F.col(f"_raw_{f}")) for f in ("tokens_in", "tokens_out", "tokens_cached", "cache_write", "cache_write_5m", "cache_write_1h")}
    fields = raw.withColumns({**plain, **counts}).withColumns(
        {
            "_agent": F.coalesce("_agent", json_text.plain(F.element_at("resource_attrs", "service.name"))),
            "_in": F.col("_tokens_in"), "_out": F.col("_tokens_out"), "_cached": F.col("_tokens_cached"), "_w1": F.col("_cache_write_1h"),
            "_w5": F.when((F.col("_cache_write_5m") == 0) & (F.col("_cache_write_1h") == 0), F.col("_cache_write")).otherwise(F.col("_cache_write_5m")),
            "_activity": activity_name(F.col("_tool"), F.col("_operation"), F.col("_model")),
        }
    )
    fields = fields.withColumn("_folded", includes_cache(F.col("_model")))
    fields = fields.withColumn("_in", F.greatest(F.col("_in") - F.when(F.col("_folded"), F.col("_cached")).otherwise(0), F.least("_in", F.lit(0))))
    priced = pricing.with_prices(fields, "_model", prices)
    return canonical_columns(
        priced, case_id=F.col("_case"), event_id=F.col("span_id"), activity_raw=F.col("_activity"), activity=F.col("_activity"), ts_start=F.col("ts_start"), ts_end=F.col("ts_end"),
        parent_id=F.col("parent_id"), agent=F.col("_agent"), resource=F.coalesce("_model", "_tool"), tokens_in=F.col("_in"), tokens_cached=F.col("_cached"),
        tokens_cache_write=F.col("_w5") + F.col("_w1"), tokens_out=F.col("_out"), cost_usd=pricing.cost("_in", "_out", "_cached", "_w5", "_w1"),
        status=F.col("status"), error_type=F.col("error_type"), attrs=json_text.object_text(F.map_entries("attrs")),
    )


def unknown_conventions(spans: DataFrame) -> DataFrame:
    """Sources of which it is unknown whether their input count includes the cache."""
    s = spans.filter(is_operation()).withColumn("_model", present(attribute("model")))
    return s.filter(includes_cache(F.col("_model")).isNull() & ((number("tokens_cached") > 0) | (number("tokens_in") > 0))).select(F.coalesce("_model", "name").alias("source")).distinct()
