"""Analysis: cycles, failures, tails, context carry and drift between two logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cost, in_case, is_error, money, present, prompt_size
from ..plans.staging import ranged
from . import mining

MAX_PERIOD = 4
RECOVERY = 2


def cycle_occurrences(steps: DataFrame, max_period: int = MAX_PERIOD) -> DataFrame:
    """Blocks that repeat next to each other, found from left to right in each case.

    ``steps`` is the result of ``mining.collapse_batches``. At a step the period that covers most
    wins, the shorter of equals. How often a block of period p repeats follows from the
    first step at or after it that differs from the step p ahead; that step also knows the running
    cost where the repeats end. Both come from one pass from the last step to the first. The choice of
    what comes after what reads the candidates of a case once, in their order, and keeps one number.
    """
    up, down = Window.partitionBy("case_id").orderBy("pos"), Window.partitionBy("case_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    paid = F.col("cost").cast("decimal(28,9)")
    s = steps.select("case_id", "pos", "activity", F.sum(paid).over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    periods = range(1, max_period + 1)
    # The running cost up to each of the next steps; past the end it stays what it is.
    ahead = [F.col("upto")]
    for p in periods:
        ahead.append(F.coalesce(F.lead("upto", p).over(up), ahead[-1]))
    s = s.select(
        "case_id", "pos", F.array(*ahead[:-1]).alias("costs"), F.array("activity", *[F.lead("activity", p).over(up) for p in periods[:-1]]).alias("next"),
        *[F.coalesce(F.lead("activity", p).over(up) == F.col("activity"), F.lit(False)).alias(f"_e{p}") for p in periods],
    )
    stop = [F.last(F.when(~F.col(f"_e{p}"), F.struct("pos", "costs")), ignorenulls=True).over(down).alias(f"_s{p}") for p in periods]
    s = s.select("case_id", "pos", "costs", "next", *stop)
    tried = []
    for p in periods:
        reps = F.floor((F.col(f"_s{p}.pos") - F.col("pos")) / p) + 1
        # The last repeat ends a few steps after the one that differs.
        end = (F.col("pos") + reps * p - 1 - F.col(f"_s{p}.pos")).cast("int")
        extra = F.get(F.col(f"_s{p}.costs"), end) - F.get("costs", F.lit(p - 1))
        tried.append(F.when(reps > 1, F.struct((reps * p).cast("long").alias("covers"), F.lit(-p).alias("short"), reps.cast("long").alias("reps"), extra.alias("extra"))))
    s = s.select("case_id", "pos", "next", F.greatest(*tried).alias("best")).filter("best IS NOT NULL")
    rows = s.select("case_id", "pos", (-F.col("best.short")).alias("period"), "best.reps", F.slice("next", F.lit(1), -F.col("best.short")).alias("block"), F.col("best.extra").alias("extra_cost"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, free = object(), 0
        for batch in batches:
            kept = []
            for k, (c, pos, period, reps) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("case_id", "pos", "period", "reps")), strict=True)):
                if c != case:
                    case, free = c, 0
                if pos >= free:
                    kept.append(k)
                    free = pos + period * reps
            yield batch.take(pa.array(kept, pa.int64()))

    # The windows left the rows of a case together and in order; the sort only says so.
    chosen = rows.sortWithinPartitions("case_id", "pos").mapInArrow(choose, rows.schema)
    turned = F.transform(F.sequence(F.lit(0), F.col("period") - 1), lambda k: F.concat(F.slice(F.col("block"), k + 1, F.col("period") - k), F.slice(F.col("block"), F.lit(1), k)))
    return chosen.select("case_id", "pos", "period", "reps", F.array_min(turned).alias("pattern"), "extra_cost")


def cycles(occurrences: DataFrame) -> DataFrame:
    """Per pattern (its least rotation): extra iterations, cases, extra cost and events, most repeats."""
    return occurrences.groupBy("pattern").agg(
        F.sum(F.col("reps") - 1).alias("occurrences"), F.countDistinct("case_id").alias("cases"), money(F.col("extra_cost")).alias("extra_cost"),
        F.sum((F.col("reps") - 1) * F.col("period")).alias("extra_events"), F.max("reps").alias("max_repeats"),
    )


def failure_cost(log: DataFrame, window: int = RECOVERY) -> DataFrame:
    """One row: cost of failing events and of the ``window`` events after each, and the cases that have any."""
    near = F.max(is_error()).over(in_case().rowsBetween(-window, 0))
    marked = log.select("case_id", cost().alias("cost"), is_error().alias("err"), near.alias("near"))
    return marked.agg(money(F.when(F.col("near") == 1, F.col("cost"))).alias("failure_cost"), F.countDistinct(F.when(F.col("err") == 1, F.col("case_id"))).alias("failed_cases"))


def error_kinds(log: DataFrame) -> DataFrame:
    return log.filter(is_error() == 1).groupBy(F.coalesce(present(F.col("error_type")), F.col("activity")).alias("kind")).agg(F.count("*").alias("n"))


def upper_median(rows: DataFrame, value: str, by: str) -> DataFrame:
    """One row: the element at ``n // 2`` of the sorted values. Only the range of rows that holds it is sorted."""
    r = ranged(rows.select(value, by), F.col(value), F.col(by))
    ends = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = r.groupBy("bucket").agg(F.count("*").alias("_k"))
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_k").over(ends), F.lit(0)), "_n": F.sum("_k").over(Window.partitionBy())})
    holds = sizes.filter("_before <= _n div 2 AND _n div 2 < _before + _k").select("bucket", (F.expr("_n div 2") - F.col("_before")).alias("_place"))
    placed = r.join(F.broadcast(holds), "bucket").withColumn("_row", F.row_number().over(Window.partitionBy("bucket").orderBy(value, by)) - 1)
    return placed.filter("_row = _place").select(F.col(value).alias("median"))


def tail_variants(found: DataFrame, min_n: int = 2, rare: float = 0.05, dear: float = 2.0) -> DataFrame:
    """Paths of several runs that few cases take and that cost far more than the median path."""
    v = found.withColumn("cost_avg", F.col("cost") / F.col("n"))
    n_cases = found.agg(F.sum("n").alias("n_cases"))
    out = v.crossJoin(F.broadcast(n_cases)).crossJoin(F.broadcast(upper_median(v, "cost_avg", "example_case")))
    return out.filter((F.col("n") >= min_n) & (F.col("n") / F.col("n_cases") < rare) & (F.col("cost_avg") > dear * F.col("median"))).drop("n_cases", "median")


def escalation(res: DataFrame, of_cost: float = 0.2, of_calls: float = 0.1) -> DataFrame:
    """The dearest resource that takes much of the cost with few of the calls."""
    whole = res.agg(F.sum("n").alias("all_n"), F.sum("cost").alias("all_cost"))
    out = res.crossJoin(F.broadcast(whole)).withColumns({"cost_share": F.col("cost") / F.col("all_cost"), "call_share": F.col("n") / F.col("all_n")})
    return out.filter((F.col("cost_share") > of_cost) & (F.col("call_share") < of_calls)).orderBy(F.col("cost").desc(), "resource").limit(1).drop("all_n", "all_cost")


def cache_totals(log: DataFrame) -> DataFrame:
    t = log.agg(F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_cached"), F.lit(0)).alias("tokens_cached"))
    return t.withColumn("hit_rate", F.coalesce(F.try_divide(F.col("tokens_cached").cast("double"), F.col("tokens_in") + F.col("tokens_cached")), F.lit(0.0)))


def prompt_rate(log: DataFrame) -> DataFrame:
    """One row: dollars per prompt token over the events that have both."""
    paid = log.filter((prompt_size() > 0) & (cost() > 0))
    return paid.agg(F.coalesce(F.try_divide(money(cost()), F.sum(prompt_size()).cast("double")), F.lit(0.0)).alias("rate"))


def carried_turns(log: DataFrame) -> DataFrame:
    """One row per turn but the last of a case: ``k``, prompt growth to the next turn, and for how many turns it is carried."""
    turns = log.filter(prompt_size() > 0).select("case_id", "ts_start", "event_id", "activity", prompt_size().alias("prompt"))
    w = in_case()
    turns = turns.withColumns({"k": F.row_number().over(w) - 1, "delta": F.lead("prompt").over(w) - F.col("prompt"), "last": F.count("*").over(Window.partitionBy("case_id")) - 1})
    # Read from the end of the case, so that the frame only grows.
    later = Window.partitionBy("case_id").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    reset = F.min(F.when(F.col("delta") < 0, F.col("k"))).over(later)
    return turns.withColumn("remaining", F.coalesce(reset, F.col("last")) - F.col("k")).filter("delta IS NOT NULL").select("case_id", "k", "activity", "delta", "remaining")


def context_cost(log: DataFrame) -> DataFrame:
    """Per activity: what its results added to the prompt, and what it cost to carry that on.

    Growth between two turns is shared by the events between them, or is the
    turn's own if there are none; it is carried until the prompt next shrinks.
    """
    turns = carried_turns(log).filter("delta > 0")
    w = in_case().rowsBetween(Window.unboundedPreceding, 0)
    placed = log.select("case_id", "activity", (prompt_size() > 0).alias("is_turn"), (F.sum((prompt_size() > 0).cast("long")).over(w) - 1).alias("k"))
    between = placed.filter("NOT is_turn AND k >= 0").groupBy("case_id", "k", "activity").agg(F.count("*").alias("m"))
    joined = turns.withColumnRenamed("activity", "own").join(between, ["case_id", "k"], "left")
    size = F.sum("m").over(Window.partitionBy("case_id", "k"))
    shares = joined.withColumn("size", F.coalesce(size, F.lit(1))).select(
        F.coalesce("activity", "own").alias("step"), F.coalesce("m", F.lit(1)).alias("m"), (F.col("delta").cast("double") / F.col("size")).alias("share"), "remaining"
    )
    out = shares.groupBy("step").agg(
        F.sum("m").alias("n"), money(F.col("share") * F.col("m")).alias("added"), money(F.col("share") * F.col("m") * F.col("remaining")).alias("carried_tokens")
    )
    return out.crossJoin(F.broadcast(prompt_rate(log))).select("step", "n", (F.col("added") / F.col("n")).alias("added_avg"), "carried_tokens", (F.col("carried_tokens") * F.col("rate")).alias("est_usd"))


def drift_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events per case of every activity in two logs."""

    def side(log: DataFrame, name: str) -> DataFrame:
        n_cases = log.agg(F.countDistinct("case_id").alias("c"))
        return log.groupBy("activity").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n_cases)).select("activity", (F.col("n") / F.col("c")).alias(name))

    both = side(before, "before").join(side(after, "after"), "activity", "full")
    return both.select("activity", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("before", "after")]).withColumn("delta", F.col("after") - F.col("before"))


def drift_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges that only one of two edge tables has."""
    key = ["src", "dst"]
    new = after.join(before, key, "left_anti").select(F.lit("new").alias("kind"), "src", "dst", "n")
    return new.unionByName(before.join(after, key, "left_anti").select(F.lit("gone").alias("kind"), "src", "dst", "n"))


def drift_variants(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that only one of two variant tables has."""
    new = after.join(before, "seq", "left_anti").select(F.lit("appeared").alias("kind"), "seq", "n")
    return new.unionByName(before.join(after, "seq", "left_anti").select(F.lit("vanished").alias("kind"), "seq", "n"))


def drift_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: cost per case, mean length, paths and reuse of two logs."""

    def side(log: DataFrame, name: str) -> DataFrame:
        v = mining.variants(mining.case_rollup(log))
        n = F.sum("n")
        return v.agg(
            (money(F.col("cost")) / n).alias(f"cost_per_case_{name}"), (F.sum(F.size("seq") * F.col("n")) / n).alias(f"len_{name}"), F.count("*").alias(f"variants_{name}"),
            (F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)) / n).alias(f"reuse_{name}"),
        )

    both = side(before, "before").crossJoin(side(after, "after"))
    return both.withColumn("enumerable", F.greatest("variants_before", "variants_after") <= 50).withColumn("reuse", F.least("reuse_before", "reuse_after")).drop("reuse_before", "reuse_after")
