"""Mining: variants, directly-follows edges, nodes, batches, rework and totals.

An event log is a DataFrame with the columns of ``schema.EVENT``. All operators
partition by case (or by what they group by) and aggregate partially first; the
batch parents, which may span cases, take one more shuffle by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import END, START, cost, duration, event_tokens, in_case, is_error, money, path_text, present
from ..plans.staging import ranged, running


def batch_parents(log: DataFrame) -> DataFrame:
    """``parent_id, n``: events of the log that have several children in it."""
    # Children and ids are counted by one aggregation over one scan.
    ends = F.array(F.struct(F.col("parent_id").alias("key"), F.lit(1).alias("child")), F.struct(F.col("event_id").alias("key"), F.lit(0).alias("child")))
    keys = log.select(F.explode(ends).alias("x")).select("x.*").filter("key IS NOT NULL")
    found = keys.groupBy("key").agg(F.sum("child").alias("n"), F.min("child").alias("least"))
    return found.filter("n > 1 AND least = 0").select(F.col("key").alias("parent_id"), "n")


def with_batches(log: DataFrame) -> DataFrame:
    """Adds ``batch``: the parent's id where the event belongs to a batch, else null."""
    parents = batch_parents(log).select(F.col("parent_id").alias("batch"))
    return log.join(parents, F.col("parent_id") == F.col("batch"), "left")


def case_rollup(log: DataFrame) -> DataFrame:
    """One row per case: ``seq``, ``n_events, cost, duration, errors``."""
    step = F.struct("ts_start", "event_id", "activity")
    return (
        log.groupBy("case_id")
        .agg(
            F.sort_array(F.collect_list(step)).alias("steps"), F.count("*").alias("n_events"), money(cost()).alias("cost"), money(duration()).alias("duration"), F.sum(is_error()).alias("errors"),
        )
        .withColumn("seq", F.transform("steps", lambda s: s["activity"]))
        .drop("steps")
    )


def variants(rollup: DataFrame) -> DataFrame:
    """One row per distinct sequence of activities; the example is the first case in order."""
    return rollup.groupBy("seq").agg(
        F.count("*").alias("n"), money(F.col("cost")).alias("cost"), money(F.col("duration")).alias("duration"), F.sum("errors").alias("errors"), F.min("case_id").alias("example_case")
    )


def top_variants(found: DataFrame, k: int = 20) -> DataFrame:
    return found.orderBy(F.col("cost").desc(), "example_case").limit(k)


def variant_reuse(found: DataFrame) -> DataFrame:
    """One row: cases, variants, and the share of cases whose path others took too."""
    shared = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    cases = F.coalesce(F.sum("n"), F.lit(0))
    return found.agg(cases.alias("n_cases"), F.count("*").alias("n_variants"), F.coalesce(F.try_divide(shared.cast("double"), cases), F.lit(0.0)).alias("variant_reuse"))


def pareto(found: DataFrame, min_n: int = 1) -> DataFrame:
    """Paths by cost per case, dearest first, with the running shares of all cost and of all cases.

    Cases and cost of all paths are the whole, also of those under ``min_n`` runs. The running
    sums are made within ranges of the order, so that no task sees all paths.
    """
    whole = found.agg(F.sum("n").alias("all_n"), F.sum(F.col("cost").cast("decimal(28,9)")).alias("all_cost"))
    order = [F.col("cost_avg").desc(), F.col("example_case")]
    kept = ranged(found.filter(F.col("n") >= min_n).withColumn("cost_avg", F.col("cost") / F.col("n")), *order)
    kept = running(kept, order, run=F.col("cost").cast("decimal(28,9)"), run_n=F.col("n")).crossJoin(F.broadcast(whole))
    share = F.when(F.col("all_cost") != 0, F.col("run").cast("double") / F.col("all_cost").cast("double")).otherwise(F.lit(0.0))
    return kept.select(
        "seq", "example_case", "n", "cost_avg", (F.col("n") / F.col("all_n")).alias("case_share"), share.alias("cum_cost_share"), (F.col("run_n") / F.col("all_n")).alias("cum_case_share")
    )


def nodes(log: DataFrame) -> DataFrame:
    return log.groupBy("activity").agg(
        F.count("*").alias("n"), money(cost()).alias("cost"), money(duration()).alias("duration"), F.sum(event_tokens()).alias("tokens"), F.sum(is_error()).alias("errors")
    )


def resources(log: DataFrame) -> DataFrame:
    """Per resource, of the events that cost something."""
    paid = log.filter(present(F.col("resource")).isNotNull() & (cost() > 0))
    return paid.groupBy("resource").agg(F.count("*").alias("n"), money(cost()).alias("cost"), F.sum(event_tokens()).alias("tokens"))


def totals(log: DataFrame) -> DataFrame:
    """One row: cases, events, cost, tokens, first and last time."""
    ts = F.when(F.coalesce("ts_start", F.lit(0.0)) != 0, F.col("ts_start"))
    last = F.when(ts.isNotNull(), F.when(F.coalesce("ts_end", F.lit(0.0)) != 0, F.col("ts_end")).otherwise(ts))
    return log.agg(
        F.countDistinct("case_id").alias("n_cases"), F.count("*").alias("n_events"), money(cost()).alias("total_cost"), F.coalesce(F.sum(event_tokens()), F.lit(0)).alias("total_tokens"), F.min(ts).alias("t_min"), F.max(last).alias("t_max")
    )


def edges(batched: DataFrame) -> DataFrame:
    """Directly-follows edges of a log with ``batch``; cost and duration are the target's."""
    w = in_case()
    e = batched.select(
        F.coalesce(F.lag("activity").over(w), F.lit(START)).alias("src"),
        F.col("activity").alias("dst"),
        F.lead("activity").over(w).isNull().alias("is_last"),
        cost().alias("cost"),
        duration().alias("duration"),
        F.coalesce((F.lag("batch").over(w) == F.col("batch")).cast("long"), F.lit(0)).alias("parallel"),
    )
    out = F.when(F.col("is_last"), F.array(_edge("src", "dst"), _final())).otherwise(F.array(_edge("src", "dst")))
    return (
        e.select(F.explode(out).alias("e"))
        .select("e.*")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"), money(F.col("cost")).alias("cost"), money(F.col("duration")).alias("duration"), F.sum("parallel").alias("parallel"))
    )


def _edge(src: str, dst: str):
    return F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col("cost"), F.col("duration"), F.col("parallel"))


def _final():
    zero = F.lit(0.0)
    return F.struct(F.col("dst").alias("src"), F.lit(END).alias("dst"), zero.alias("cost"), zero.alias("duration"), F.lit(0).cast("long").alias("parallel"))


def parallel_counters(log: DataFrame) -> DataFrame:
    """One row: batches, events in them, turns that they saved, their share of all events."""
    # Every child of a batch parent is an event of the log, so the children are the events.
    found = batch_parents(log).agg(F.count("*").alias("batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("parallel_events"))
    all_ = log.agg(F.count("*").alias("n_events"))
    saved = F.greatest(F.col("parallel_events") - F.col("batches"), F.lit(0))
    return found.crossJoin(F.broadcast(all_)).select(
        "batches", "parallel_events", saved.alias("turns_saved"), F.coalesce(F.try_divide(F.col("parallel_events").cast("double"), F.col("n_events")), F.lit(0.0)).alias("parallel_rate")
    )


def rework_events(batched: DataFrame) -> DataFrame:
    """Events at which an activity comes again in its case; a batch, or twins of one id, come once."""
    key = F.coalesce("batch", "event_id")
    again = Window.partitionBy("case_id", "activity", "_key").orderBy("ts_start", "event_id")
    nth = Window.partitionBy("case_id", "activity").orderBy("ts_start", "event_id")
    first = batched.withColumn("_key", key).withColumn("_again", F.row_number().over(again)).filter("_again = 1")
    return first.withColumn("_nth", F.row_number().over(nth)).filter("_nth > 1").drop("_key", "_again", "_nth")


def loop_cost(batched: DataFrame) -> DataFrame:
    return rework_events(batched).groupBy("activity").agg(F.count("*").alias("rework"), money(cost()).alias("loop_cost"))


def rework_rate(batched: DataFrame) -> DataFrame:
    found = rework_events(batched).agg(F.count("*").alias("rework_events"))
    all_ = batched.agg(F.count("*").alias("n_events"))
    return found.crossJoin(F.broadcast(all_)).select("rework_events", "n_events", F.coalesce(F.try_divide(F.col("rework_events").cast("double"), F.col("n_events")), F.lit(0.0)).alias("rework_rate"))


def collapse_batches(batched: DataFrame) -> DataFrame:
    """Runs of one activity in one batch become one step: ``case_id, pos, activity, cost, n``."""
    w = in_case()
    same = (F.lag("batch").over(w) == F.col("batch")) & (F.lag("activity").over(w) == F.col("activity"))
    steps = batched.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("pos", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return steps.groupBy("case_id", "pos").agg(F.min("activity").alias("activity"), money(cost()).alias("cost"), F.count("*").alias("n"))


def prefix_tree(found: DataFrame, max_depth: int = 18) -> DataFrame:
    """Cost and runs of every prefix of the paths."""
    cut = F.transform(F.sequence(F.lit(1), F.least(F.size("seq"), F.lit(max_depth))), lambda k: F.struct(k.alias("depth"), F.slice(F.col("seq"), F.lit(1), k).alias("prefix")))
    rows = found.filter(F.size("seq") > 0).select(F.explode(cut).alias("p"), "n", "cost").select("p.*", "n", "cost")
    return rows.groupBy("depth", "prefix").agg(F.sum("n").alias("n"), money(F.col("cost")).alias("cost"))


def reuse_depth(tree: DataFrame, least: float = 0.5) -> DataFrame:
    """One row: the first depth (from 0) at which most runs have a path of their own, or null."""
    by_depth = tree.groupBy("depth").agg(F.sum("n").alias("all_n"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("shared"))
    return by_depth.filter((F.col("all_n") > 0) & (F.col("shared") / F.col("all_n") < least)).agg(F.min(F.col("depth") - 1).alias("reuse_depth"))


def hub(found: DataFrame, share: float = 0.7) -> DataFrame:
    """The activity at an end of nearly every transition, if there is one; a self-loop touches it twice."""
    touch = found.select(F.explode(F.array("src", "dst")).alias("activity"), "n").filter(~F.col("activity").isin(START, END)).groupBy("activity").agg(F.sum("n").alias("touches"))
    whole = found.agg(F.sum("n").alias("transitions"))
    best = touch.orderBy(F.col("touches").desc(), "activity").limit(1)
    return best.crossJoin(F.broadcast(whole)).filter(F.col("touches") / F.col("transitions") >= share)


def spine(found: DataFrame, node_rows: DataFrame, n_cases: DataFrame, max_nodes: int = 25, min_edge: float = 0.02) -> DataFrame:
    """Edges between the dearest activities that at least ``min_edge`` of the cases take."""
    keep = node_rows.orderBy(F.col("cost").desc(), "activity").limit(max_nodes).select("activity")
    keep = keep.unionByName(keep.sparkSession.createDataFrame([(START,), (END,)], "activity string"))
    out = found.join(F.broadcast(keep.withColumnRenamed("activity", "src")), "src", "left_semi").join(F.broadcast(keep.withColumnRenamed("activity", "dst")), "dst", "left_semi")
    return out.crossJoin(F.broadcast(n_cases.select("n_cases"))).filter(F.col("n") >= min_edge * F.col("n_cases")).drop("n_cases")
