"""Event logs derived from relational tables, each in the canonical columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COLUMNS, EVENT


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / F.lit(1e6)


def canonical_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """The event columns, from those given; the others have their defaults."""
    zero = {"tokens_in", "tokens_cached", "tokens_cache_write", "tokens_out", "cost_usd"}
    default = {"status": F.lit("ok"), "attrs": F.lit("{}")}
    out = []
    for field in EVENT.fields:
        c = columns.get(field.name, default.get(field.name, F.lit(0) if field.name in zero else F.lit(None)))
        out.append(c.cast(field.dataType).alias(field.name))
    assert not columns.keys() - set(COLUMNS)
    return df.select(*out)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_user_day(spark: SparkSession, sf_dir: str, by_day: bool = True) -> DataFrame:
    """``events``; a case is a user's day, or all of a user."""
    e = _table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    failed = F.col("event_type") == "error"
    return canonical_columns(
        e,
        case_id=F.concat_ws("-", user, F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyyMMdd")) if by_day else user,
        event_id=F.lpad(F.col("event_id").cast("string"), 12, "0"),
        activity_raw=F.col("event_type"), activity=F.col("event_type"), ts_start=epoch(F.col("ts")), resource=F.col("event_type"),
        tokens_cached=F.when(F.col("event_type").isin("view", "click"), F.col("value").cast("decimal(18,2)") * 100).otherwise(0),
        cost_usd=F.col("value"), status=F.when(failed, "error").otherwise("ok"), error_type=F.when(failed, F.col("event_type")),
    )


def log_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_user_day(spark, sf_dir, by_day=False)


def log_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as turns and ``lineitem`` as their calls; a case is a customer."""
    from pyspark.sql import Window

    o = _table(spark, sf_dir, "orders")
    turn = F.concat(F.lit("O-"), F.col("o_orderkey").cast("string"))
    turns = canonical_columns(
        o, case_id=F.col("o_custkey"), event_id=turn, activity_raw=F.concat(F.lit("turn:"), "o_orderstatus"), activity=F.concat(F.lit("turn:"), "o_orderstatus"),
        ts_start=epoch(F.col("o_orderdate")), resource=F.col("o_orderpriority"), cost_usd=F.col("o_totalprice"),
    )
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    lines = _table(spark, sf_dir, "lineitem").withColumn("_nth", nth).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    call = F.concat(F.lit("tool:"), "l_returnflag", "l_linestatus")
    calls = canonical_columns(
        lines, case_id=F.col("o_custkey"), event_id=F.concat(F.lit("L-"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")),
        activity_raw=call, activity=call, ts_start=epoch(F.col("o_orderdate")) + F.col("_nth"), parent_id=turn,
    )
    return turns.unionByName(calls)


def log_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations``; assistant turns carry all earlier text as their prompt."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = _table(spark, sf_dir, "conversations").withColumn("size", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    name = lambda t: F.concat_ws("#", F.col("conv_id").cast("string"), F.lpad(t.cast("string"), 6, "0"))
    c = c.withColumns({"prompt": F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "prev": F.lag("turn").over(w)})
    chat = F.col("role") == "assistant"
    activity = F.when(chat, "chat").otherwise(F.concat(F.lit("tool:"), F.col("role")))
    paid = (F.col("prompt") * 2 + F.col("size") * 10).cast("decimal(28,9)") / F.lit(1000000)
    return canonical_columns(
        c, case_id=F.col("conv_id"), event_id=name(F.col("turn")), activity_raw=activity, activity=activity, ts_start=F.col("turn"), parent_id=F.when(F.col("prev").isNotNull(), name(F.col("prev"))),
        tokens_in=F.when(chat, F.col("prompt")).otherwise(0), tokens_out=F.when(chat, F.col("size")).otherwise(0), cost_usd=F.when(chat, paid).otherwise(0),
    )
