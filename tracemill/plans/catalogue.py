"""Registered queries over the derived event logs, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import canonical, path_digest, path_text
from ..operators import abstraction, analysis, conformance, mining, normalize, pricing
from ..sources import tables
from .flow import parse_flow
from .staging import staged

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

DAY = """log AS (SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS case_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id, event_type AS activity, epoch_us(ts) / 1e6 AS ts_start,
  CAST(NULL AS DOUBLE) AS ts_end, CAST(NULL AS VARCHAR) AS batch, event_type AS resource, value AS cost, CAST(CASE WHEN event_type IN ('view', 'click') THEN CAST(value AS DECIMAL(18,2)) * 100 ELSE 0 END AS BIGINT) AS prompt,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS err FROM events)"""
USER = DAY.replace("CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d')", "CAST(user_id AS VARCHAR)")
ORDER = """raw AS (
  SELECT CAST(o_custkey AS VARCHAR) AS case_id, 'O-' || o_orderkey AS event_id, 'turn:' || o_orderstatus AS activity, epoch_us(o_orderdate) / 1e6 AS ts_start, CAST(NULL AS VARCHAR) AS parent_id, o_orderpriority AS resource, o_totalprice AS cost FROM orders
  UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'L-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'tool:' || l_returnflag || l_linestatus,
    epoch_us(o_orderdate) / 1e6 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), 'O-' || l_orderkey, NULL, 0 FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), parents AS (SELECT parent_id, count(*) AS n FROM raw WHERE parent_id IS NOT NULL AND parent_id IN (SELECT event_id FROM raw) GROUP BY parent_id HAVING count(*) > 1),
log AS (SELECT raw.*, parents.parent_id AS batch, CAST(NULL AS DOUBLE) AS ts_end, 0 AS err, 0::BIGINT AS prompt FROM raw LEFT JOIN parents USING (parent_id))"""
MONEY = "CAST(coalesce(sum(CAST({} AS DECIMAL(28,9))), 0) AS DOUBLE)"
M = MONEY.format("cost")
CASES = f"cases AS (SELECT case_id, string_agg(activity, '>' ORDER BY ts_start, event_id) AS path, count(*) AS n_events, {M} AS cost, sum(err) AS errors FROM log GROUP BY case_id)"
PATHS = f"paths AS (SELECT path, count(*) AS n, {M} AS cost, CAST(sum(errors) AS BIGINT) AS errors, min(case_id) AS example_case, any_value(n_events) AS len FROM cases GROUP BY path)"
DAY_PATHS = f"WITH {DAY}, {CASES}, {PATHS}"
W = "(PARTITION BY case_id ORDER BY ts_start, event_id)"
#: Drift compares the days before and from this one.
CUT = 1705363200.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _order_log(spark, sf_dir):
    """The derived log as a table, as an ingest would leave it; batches read it more than once."""
    return staged(tables.log_order(spark, sf_dir), "log")


def _day_paths(spark, sf_dir):
    return mining.variants(mining.case_rollup(tables.log_user_day(spark, sf_dir)))


@query(f"WITH {DAY}, {CASES} SELECT case_id, path, n_events, cost, CAST(errors AS BIGINT) AS errors FROM cases")
def case_rollup(spark, sf_dir):
    return mining.case_rollup(tables.log_user_day(spark, sf_dir)).select("case_id", path_text(F.col("seq")).alias("path"), "n_events", "cost", "errors")


@query(f"{DAY_PATHS} SELECT path, n, cost, errors, example_case FROM paths")
def variants(spark, sf_dir):
    return _day_paths(spark, sf_dir).select(path_text(F.col("seq")).alias("path"), "n", "cost", "errors", "example_case")


@query(f"{DAY_PATHS} SELECT path, n, cost, example_case FROM paths ORDER BY cost DESC, example_case LIMIT 20")
def top_variants(spark, sf_dir):
    return mining.top_variants(_day_paths(spark, sf_dir)).select(path_text(F.col("seq")).alias("path"), "n", "cost", "example_case")


@query(f"{DAY_PATHS} SELECT example_case, array_to_string(string_split(path, '>')[1:3], ' → ') || CASE WHEN len > 3 THEN ' …+' || (len - 3) || ' more' ELSE '' END AS digest FROM paths")
def path_digests(spark, sf_dir):
    return _day_paths(spark, sf_dir).select("example_case", path_digest(F.col("seq"), 3).alias("digest"))


REUSE = "SELECT CAST(sum(n) AS BIGINT) AS n_cases, count(*) AS n_variants, coalesce(sum(n) FILTER (WHERE n > 1), 0) / sum(n)::DOUBLE AS variant_reuse FROM paths"


@query(f"{DAY_PATHS} {REUSE}")
def variant_reuse(spark, sf_dir):
    return mining.variant_reuse(_day_paths(spark, sf_dir))


@query(f"WITH {USER}, {CASES}, {PATHS} {REUSE}")
def variant_reuse_user(spark, sf_dir):
    return mining.variant_reuse(mining.variants(mining.case_rollup(tables.log_user(spark, sf_dir))))


@query(
    f"""{DAY_PATHS} SELECT example_case, n, cost / n AS cost_avg, n / (SELECT sum(n) FROM paths)::DOUBLE AS case_share,
  CAST(sum(CAST(cost AS DECIMAL(28,9))) OVER (ORDER BY cost / n DESC, example_case ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST((SELECT sum(CAST(cost AS DECIMAL(28,9))) FROM paths) AS DOUBLE) AS cum_cost_share,
  sum(n) OVER (ORDER BY cost / n DESC, example_case ROWS UNBOUNDED PRECEDING) / (SELECT sum(n) FROM paths)::DOUBLE AS cum_case_share FROM paths WHERE n >= 2"""
)
def pareto(spark, sf_dir):
    return mining.pareto(_day_paths(spark, sf_dir), min_n=2).drop("seq")


@query(f"WITH {DAY} SELECT activity, count(*) AS n, {M} AS cost, 0.0::DOUBLE AS duration, CAST(sum(prompt) AS BIGINT) AS tokens, CAST(sum(err) AS BIGINT) AS errors FROM log GROUP BY activity")
def nodes(spark, sf_dir):
    return mining.nodes(tables.log_user_day(spark, sf_dir))


@query(f"WITH {DAY} SELECT count(DISTINCT case_id) AS n_cases, count(*) AS n_events, {M} AS total_cost, CAST(sum(prompt) AS BIGINT) AS total_tokens, min(ts_start) AS t_min, max(ts_start) AS t_max FROM log")
def totals(spark, sf_dir):
    return mining.totals(tables.log_user_day(spark, sf_dir))


RESOURCES = f"res AS (SELECT resource, count(*) AS n, {M} AS cost FROM log WHERE resource <> '' AND cost > 0 GROUP BY resource)"


@query(f"WITH {ORDER}, {RESOURCES} SELECT resource, n, cost, 0::BIGINT AS tokens FROM res")
def resources(spark, sf_dir):
    return mining.resources(_order_log(spark, sf_dir))


EDGES = f"""steps AS (SELECT *, lag(activity) OVER w AS prev, lead(activity) OVER w AS nxt, CASE WHEN lag(batch) OVER w = batch THEN 1 ELSE 0 END AS par FROM log WINDOW w AS {W}),
arcs AS (SELECT coalesce(prev, 'START') AS src, activity AS dst, cost, par FROM steps UNION ALL SELECT activity, 'END', 0, 0 FROM steps WHERE nxt IS NULL),
edges AS (SELECT src, dst, count(*) AS n, {M} AS cost, 0.0::DOUBLE AS duration, CAST(sum(par) AS BIGINT) AS parallel FROM arcs GROUP BY src, dst)"""


def _edges(log):
    return mining.edges(mining.with_batches(log))


@query(f"WITH {DAY}, {EDGES} SELECT * FROM edges")
def edges(spark, sf_dir):
    return _edges(tables.log_user_day(spark, sf_dir))


@query(f"WITH {ORDER}, {EDGES} SELECT * FROM edges")
def edges_parallel(spark, sf_dir):
    return _edges(_order_log(spark, sf_dir))


@query(f"WITH {ORDER} SELECT parent_id, n FROM parents")
def batch_parents(spark, sf_dir):
    return mining.batch_parents(_order_log(spark, sf_dir))


@query(f"WITH {ORDER} SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS parallel_events, CAST(sum(n) - count(*) AS BIGINT) AS turns_saved, sum(n) / (SELECT count(*) FROM log)::DOUBLE AS parallel_rate FROM parents")
def parallel_counters(spark, sf_dir):
    return mining.parallel_counters(_order_log(spark, sf_dir))


REWORK = """firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, activity, coalesce(batch, event_id) ORDER BY ts_start, event_id) AS again FROM log) WHERE again = 1),
rework AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, activity ORDER BY ts_start, event_id) AS nth FROM firsts) WHERE nth > 1)"""


@query(f"WITH {ORDER}, {REWORK} SELECT activity, count(*) AS rework, {M} AS loop_cost FROM rework GROUP BY activity")
def loop_cost(spark, sf_dir):
    return mining.loop_cost(mining.with_batches(_order_log(spark, sf_dir)))


@query(f"WITH {DAY}, {REWORK} SELECT (SELECT count(*) FROM rework) AS rework_events, count(*) AS n_events, (SELECT count(*) FROM rework) / count(*)::DOUBLE AS rework_rate FROM log")
def rework_rate(spark, sf_dir):
    return mining.rework_rate(mining.with_batches(tables.log_user_day(spark, sf_dir)))


COLLAPSE = f"""marked AS (SELECT *, CASE WHEN lag(batch) OVER w = batch AND lag(activity) OVER w = activity THEN 0 ELSE 1 END AS new FROM log WINDOW w AS {W}),
placed AS (SELECT *, CAST(sum(new) OVER (PARTITION BY case_id ORDER BY ts_start, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS pos FROM marked),
flat AS (SELECT case_id, pos, min(activity) AS activity, {M} AS cost, count(*) AS n FROM placed GROUP BY case_id, pos)"""


@query(f"WITH {ORDER}, {COLLAPSE} SELECT * FROM flat")
def collapsed_log(spark, sf_dir):
    return mining.collapse_batches(mining.with_batches(_order_log(spark, sf_dir)))


def _cycle_parts() -> str:
    """Greedy choice by recursion over the positions of each case; the patterns are in ``cyc``."""
    eq = ", ".join(f"lead(activity, {p}) OVER w = activity AS e{p}" for p in range(1, 5))
    runs = ", ".join(f"(min(CASE WHEN coalesce(e{p}, false) THEN NULL ELSE pos END) OVER (PARTITION BY case_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - pos) // {p} + 1 AS r{p}" for p in range(1, 5))
    best = " UNION ALL ".join(f"SELECT case_id, pos, {p} AS p, r{p} AS reps FROM runs WHERE r{p} > 1" for p in range(1, 5))
    return f"""{COLLAPSE}, eqs AS (SELECT *, {eq} FROM flat WINDOW w AS (PARTITION BY case_id ORDER BY pos)), runs AS (SELECT case_id, pos, {runs} FROM eqs),
best AS (SELECT case_id, pos, p, reps FROM (SELECT *, row_number() OVER (PARTITION BY case_id, pos ORDER BY p * reps DESC, p) AS k FROM ({best})) WHERE k = 1),
walk AS (
  SELECT case_id, 0::BIGINT AS pos FROM (SELECT DISTINCT case_id FROM flat)
  UNION ALL SELECT w.case_id, CAST(w.pos + coalesce(b.p * b.reps, 1) AS BIGINT) FROM walk AS w JOIN flat AS f ON f.case_id = w.case_id AND f.pos = w.pos LEFT JOIN best AS b ON b.case_id = w.case_id AND b.pos = w.pos
), hits AS (SELECT b.* FROM walk AS w JOIN best AS b ON b.case_id = w.case_id AND b.pos = w.pos),
spans AS (SELECT h.case_id, h.pos, h.p, h.reps, list(f.activity ORDER BY f.pos) AS block FROM hits AS h JOIN flat AS f ON f.case_id = h.case_id AND f.pos >= h.pos AND f.pos < h.pos + h.p GROUP BY ALL),
keyed AS (SELECT *, list_min(list_transform(range(1, p + 1), lambda k: list_concat(block[k:p], block[1:k - 1]))) AS pattern FROM spans),
money AS (SELECT h.case_id, h.pos, sum(CAST(f.cost AS DECIMAL(28,9))) AS extra FROM hits AS h JOIN flat AS f ON f.case_id = h.case_id AND f.pos >= h.pos + h.p AND f.pos < h.pos + h.p * h.reps GROUP BY h.case_id, h.pos),
cyc AS (SELECT array_to_string(pattern, '>') AS pattern, CAST(sum(reps - 1) AS BIGINT) AS occurrences, count(DISTINCT case_id) AS cases, CAST(sum(extra) AS DOUBLE) AS extra_cost, CAST(sum((reps - 1) * p) AS BIGINT) AS extra_events, CAST(max(reps) AS BIGINT) AS max_repeats
FROM keyed JOIN money USING (case_id, pos) GROUP BY pattern)"""


def _cycle_sql(log: str) -> str:
    return f"WITH RECURSIVE {log}, {_cycle_parts()} SELECT * FROM cyc"


def _cycles(log):
    found = analysis.cycles(analysis.cycle_occurrences(mining.collapse_batches(mining.with_batches(log))))
    return found.withColumn("pattern", path_text(F.col("pattern")))


@query(_cycle_sql(DAY))
def cycles(spark, sf_dir):
    return _cycles(tables.log_user_day(spark, sf_dir))


@query(_cycle_sql(USER))
def cycles_user(spark, sf_dir):
    return _cycles(tables.log_user(spark, sf_dir))


@query(_cycle_sql(ORDER))
def cycles_order(spark, sf_dir):
    return _cycles(_order_log(spark, sf_dir))


@query(
    f"WITH {DAY}, near AS (SELECT *, max(err) OVER (PARTITION BY case_id ORDER BY ts_start, event_id ROWS 2 PRECEDING) AS close FROM log) SELECT {MONEY.format('cost').replace('), 0)', ') FILTER (WHERE close = 1), 0)')} AS failure_cost, count(DISTINCT case_id) FILTER (WHERE err = 1) AS failed_cases FROM near"
)
def failure_cost(spark, sf_dir):
    return analysis.failure_cost(tables.log_user_day(spark, sf_dir))


@query(f"WITH {DAY} SELECT activity AS kind, count(*) AS n FROM log WHERE err = 1 GROUP BY activity")
def error_kinds(spark, sf_dir):
    return analysis.error_kinds(tables.log_user_day(spark, sf_dir))


MEDIAN = "med AS (SELECT avg_cost AS median FROM (SELECT cost / n AS avg_cost, row_number() OVER (ORDER BY cost / n, example_case) AS k, count(*) OVER () AS c FROM paths) WHERE k = c // 2 + 1)"


@query(f"{DAY_PATHS}, {MEDIAN} SELECT median FROM med")
def variant_median(spark, sf_dir):
    v = _day_paths(spark, sf_dir).withColumn("cost_avg", F.col("cost") / F.col("n"))
    return analysis.upper_median(v, "cost_avg", "example_case")


@query(f"{DAY_PATHS}, {MEDIAN} SELECT path, n, cost, cost / n AS cost_avg FROM paths, med WHERE n >= 2 AND n / (SELECT sum(n) FROM paths)::DOUBLE < 0.05 AND cost / n > 2 * median")
def tail_variants(spark, sf_dir):
    return analysis.tail_variants(_day_paths(spark, sf_dir)).select(path_text(F.col("seq")).alias("path"), "n", "cost", "cost_avg")


@query(
    f"WITH {ORDER}, {RESOURCES} SELECT resource, n, cost, 0::BIGINT AS tokens, cost / (SELECT sum(cost) FROM res) AS cost_share, n / (SELECT sum(n) FROM res)::DOUBLE AS call_share FROM res WHERE cost / (SELECT sum(cost) FROM res) > 0.15 AND n / (SELECT sum(n) FROM res)::DOUBLE < 0.5 ORDER BY cost DESC, resource LIMIT 1"
)
def escalation(spark, sf_dir):
    return analysis.escalation(mining.resources(_order_log(spark, sf_dir)), of_cost=0.15, of_calls=0.5)


@query(f"WITH {DAY} SELECT 0::BIGINT AS tokens_in, CAST(sum(prompt) AS BIGINT) AS tokens_cached, 1.0::DOUBLE AS hit_rate FROM log")
def cache_totals(spark, sf_dir):
    return analysis.cache_totals(tables.log_user_day(spark, sf_dir))


RATE = f"rate AS (SELECT {M} / sum(prompt)::DOUBLE AS rate FROM log WHERE prompt > 0 AND cost > 0)"
TURNS = f"""t0 AS (SELECT *, row_number() OVER w - 1 AS k, lead(prompt) OVER w - prompt AS delta, count(*) OVER (PARTITION BY case_id) - 1 AS last FROM log WHERE prompt > 0 WINDOW w AS {W}),
turns AS (SELECT *, coalesce(min(CASE WHEN delta < 0 THEN k END) OVER (PARTITION BY case_id ORDER BY ts_start, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), last) - k AS remaining FROM t0)"""


@query(f"WITH {USER}, {RATE} SELECT rate FROM rate")
def prompt_rate(spark, sf_dir):
    return analysis.prompt_rate(tables.log_user(spark, sf_dir))


@query(f"WITH {USER}, {TURNS} SELECT case_id, k, activity, CAST(delta AS BIGINT) AS delta, remaining FROM turns WHERE delta IS NOT NULL")
def carry_until(spark, sf_dir):
    return analysis.carried_turns(tables.log_user(spark, sf_dir))


@query(
    f"""WITH {USER}, {RATE}, {TURNS}, placed AS (SELECT case_id, activity, prompt, CAST(sum(CASE WHEN prompt > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY ts_start, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS k FROM log),
gaps AS (SELECT case_id, k, activity FROM placed WHERE prompt = 0), sized AS (SELECT case_id, k, count(*) AS size FROM gaps GROUP BY case_id, k),
parts AS (
  SELECT g.activity AS step, t.delta::DOUBLE / s.size AS share, t.remaining FROM turns AS t JOIN sized AS s USING (case_id, k) JOIN gaps AS g USING (case_id, k) WHERE t.delta > 0
  UNION ALL SELECT t.activity, t.delta::DOUBLE, t.remaining FROM turns AS t LEFT JOIN sized AS s USING (case_id, k) WHERE t.delta > 0 AND s.size IS NULL)
SELECT step, count(*) AS n, {MONEY.format('share')} / count(*) AS added_avg, {MONEY.format('share * remaining')} AS carried_tokens, {MONEY.format('share * remaining')} * (SELECT rate FROM rate) AS est_usd FROM parts GROUP BY step"""
)
def context_cost(spark, sf_dir):
    return analysis.context_cost(tables.log_user(spark, sf_dir))


@query(f"{DAY_PATHS}, tree AS (SELECT depth, array_to_string(string_split(path, '>')[1:depth], '>') AS prefix, n, cost FROM paths, unnest(range(1, least(len, 18) + 1)) AS r(depth)) SELECT CAST(depth AS INTEGER) AS depth, prefix, CAST(sum(n) AS BIGINT) AS n, {M} AS cost FROM tree GROUP BY depth, prefix")
def prefix_tree(spark, sf_dir):
    return mining.prefix_tree(_day_paths(spark, sf_dir)).withColumn("prefix", path_text(F.col("prefix")))


@query(f"{DAY_PATHS}, tree AS (SELECT depth, array_to_string(string_split(path, '>')[1:depth], '>') AS prefix, sum(n) AS n FROM paths, unnest(range(1, least(len, 18) + 1)) AS r(depth) GROUP BY ALL) SELECT CAST(min(depth) - 1 AS INTEGER) AS reuse_depth FROM (SELECT depth, sum(n) AS a, coalesce(sum(n) FILTER (WHERE n > 1), 0) AS s FROM tree GROUP BY depth) WHERE s / a::DOUBLE < 0.5")
def reuse_depth(spark, sf_dir):
    return mining.reuse_depth(mining.prefix_tree(_day_paths(spark, sf_dir)))


@query(f"WITH {ORDER}, {EDGES}, touch AS (SELECT activity, CAST(sum(n) AS BIGINT) AS touches FROM (SELECT src AS activity, n FROM edges UNION ALL SELECT dst, n FROM edges) WHERE activity NOT IN ('START', 'END') GROUP BY activity), t AS (SELECT CAST(sum(n) AS BIGINT) AS transitions FROM edges) SELECT activity, touches, transitions FROM (SELECT * FROM touch ORDER BY touches DESC, activity LIMIT 1), t WHERE touches / transitions::DOUBLE >= 0.2")
def hub(spark, sf_dir):
    return mining.hub(_edges(_order_log(spark, sf_dir)), share=0.2)


@query(f"WITH {DAY}, {EDGES}, keep AS (SELECT activity FROM (SELECT activity, {M} AS c FROM log GROUP BY activity ORDER BY c DESC, activity LIMIT 4) UNION ALL SELECT 'START' UNION ALL SELECT 'END') SELECT * FROM edges WHERE src IN (SELECT activity FROM keep) AND dst IN (SELECT activity FROM keep) AND n >= 0.02 * (SELECT count(DISTINCT case_id) FROM log)")
def spine(spark, sf_dir):
    log = tables.log_user_day(spark, sf_dir)
    return mining.spine(_edges(log), mining.nodes(log), mining.totals(log), max_nodes=4)


def _halves(spark, sf_dir, cut=CUT):
    log = tables.log_user_day(spark, sf_dir)
    return log.filter(F.col("ts_start") < cut), log.filter(F.col("ts_start") >= cut)


HALF = {k: f"{k}_log AS (SELECT * FROM log WHERE ts_start {op} {CUT})" for k, op in (("b", "<"), ("a", ">="))}


def _half_sql(k: str, *parts: str) -> str:
    names = ("cases", "paths", "steps", "arcs", "edges", "log")
    out = ", ".join(parts)
    for n in names:
        out = out.replace(f"FROM {n} ", f"FROM {k}_{n} ").replace(f"{n} AS (", f"{k}_{n} AS (")
    return out


DRIFT = f"WITH {DAY}, {HALF['b']}, {HALF['a']}"


@query(
    f"""{DRIFT}, f AS (SELECT activity, count(*) / (SELECT count(DISTINCT case_id) FROM b_log)::DOUBLE AS before FROM b_log GROUP BY activity), g AS (SELECT activity, count(*) / (SELECT count(DISTINCT case_id) FROM a_log)::DOUBLE AS after FROM a_log GROUP BY activity)
SELECT activity, coalesce(before, 0) AS before, coalesce(after, 0) AS after, coalesce(after, 0) - coalesce(before, 0) AS delta FROM f FULL JOIN g USING (activity)"""
)
def drift_nodes(spark, sf_dir):
    return analysis.drift_nodes(*_halves(spark, sf_dir))


BOTH_PATHS = f"{DRIFT}, {_half_sql('b', CASES, PATHS)}, {_half_sql('a', CASES, PATHS)}"


@query(f"{BOTH_PATHS} SELECT 'appeared' AS kind, path, n FROM a_paths WHERE path NOT IN (SELECT path FROM b_paths) UNION ALL SELECT 'vanished', path, n FROM b_paths WHERE path NOT IN (SELECT path FROM a_paths)")
def drift_variants(spark, sf_dir):
    before, after = (mining.variants(mining.case_rollup(x)) for x in _halves(spark, sf_dir))
    return analysis.drift_variants(before, after).select("kind", path_text(F.col("seq")).alias("path"), "n")


#: The first hours have few transitions, so that many are new after them.
EARLY = 1704067200.0 + 6 * 3600
EARLY_DRIFT = DRIFT.replace(str(CUT), str(EARLY))


@query(f"{EARLY_DRIFT}, {_half_sql('b', EDGES)}, {_half_sql('a', EDGES)} SELECT 'new' AS kind, src, dst, n FROM a_edges WHERE (src, dst) NOT IN (SELECT (src, dst) FROM b_edges) UNION ALL SELECT 'gone', src, dst, n FROM b_edges WHERE (src, dst) NOT IN (SELECT (src, dst) FROM a_edges)")
def drift_edges(spark, sf_dir):
    before, after = (_edges(x) for x in _halves(spark, sf_dir, EARLY))
    return analysis.drift_edges(before, after)


def _side_sql(k: str, name: str) -> str:
    return f"{name} AS (SELECT {M} / sum(n) AS cost_per_case_{name}, sum(len * n) / sum(n)::DOUBLE AS len_{name}, count(*) AS variants_{name}, coalesce(sum(n) FILTER (WHERE n > 1), 0) / sum(n)::DOUBLE AS reuse_{name} FROM {k}_paths)"


@query(f"{BOTH_PATHS}, {_side_sql('b', 'before')}, {_side_sql('a', 'after')} SELECT * EXCLUDE (reuse_before, reuse_after), greatest(variants_before, variants_after) <= 50 AS enumerable, least(reuse_before, reuse_after) AS reuse FROM before, after")
def drift_summary(spark, sf_dir):
    return analysis.drift_summary(*_halves(spark, sf_dir))


# Declared processes over the user-day log.
FLOW = "view -> any* -> purchase"
FLOW_CASES = f"WITH {DAY}, {CASES}, c AS (SELECT *, CASE WHEN string_split(path, '>')[1] <> 'view' THEN 1 ELSE 0 END + CASE WHEN string_split(path, '>')[-1] <> 'purchase' THEN 1 ELSE 0 END AS e FROM cases)"


@query(f"{FLOW_CASES} SELECT count(*) FILTER (WHERE e = 0) AS fitting, count(*) AS n_cases, 1 - sum(e) / sum(n_events + 2)::DOUBLE AS fitness FROM c")
def fitness(spark, sf_dir):
    return conformance.fitness(parse_flow(FLOW), _day_paths(spark, sf_dir))


@query(f"{FLOW_CASES} SELECT path, any_value(e) AS edits FROM c GROUP BY path")
def alignment_cost(spark, sf_dir):
    return conformance.aligned(parse_flow(FLOW), _day_paths(spark, sf_dir)).select(path_text(F.col("seq")).alias("path"), "edits")


#: Every error is a move on the log, and no run is ever done: both without a choice between equal alignments.
OPEN_FLOW = "(view | click | signup | purchase)* -> done"


@query(
    f"""WITH {DAY} SELECT 'log' AS kind, 'error' AS activity, count(*) AS n, count(DISTINCT case_id) AS cases, {M} AS cost FROM log WHERE activity = 'error' HAVING count(*) > 0
UNION ALL SELECT 'model', 'click | done | purchase | signup … +1 more', count(DISTINCT case_id), count(DISTINCT case_id), 0 FROM log"""
)
def deviations(spark, sf_dir):
    return conformance.deviations(parse_flow(OPEN_FLOW), tables.log_user_day(spark, sf_dir))


@query(f"{FLOW_CASES} SELECT path, CAST(sum(e) AS BIGINT) AS moves FROM c WHERE e > 0 GROUP BY path")
def alignment_moves(spark, sf_dir):
    paths = _day_paths(spark, sf_dir)
    found = conformance.moves(parse_flow(FLOW), paths).groupBy("path").agg(F.sum("n").alias("moves"))
    return paths.select(conformance.path_key(F.col("seq")).alias("key"), path_text(F.col("seq")).alias("path")).join(found.withColumnRenamed("path", "key"), "key").drop("key")


@query(f"WITH {DAY}, {CASES}, r AS (SELECT n_events, row_number() OVER (ORDER BY n_events) - 1 AS k, count(*) OVER () AS c FROM cases) SELECT n_events AS steps_p95 FROM r WHERE k = round_even(0.95 * (c - 1), 0)")
def steps_p95(spark, sf_dir):
    return conformance.steps_p95(mining.case_rollup(tables.log_user_day(spark, sf_dir)))


PLACES = f"p AS (SELECT case_id, activity, cost, row_number() OVER w AS pos, lag(activity) OVER w AS prev, count(*) OVER (PARTITION BY case_id) AS size, row_number() OVER (PARTITION BY case_id, activity ORDER BY ts_start, event_id) AS nth FROM log WINDOW w AS {W}), q AS (SELECT *, max(CASE WHEN activity = 'purchase' THEN pos END) OVER (PARTITION BY case_id) AS last_b, min(CASE WHEN activity = 'purchase' THEN pos END) OVER (PARTITION BY case_id) AS first_b FROM p)"
_PER_CASE = "SELECT case_id, 1::BIGINT AS n, 0.0::DOUBLE AS cost FROM q GROUP BY case_id HAVING {}"
_PER_STEP = "SELECT case_id, count(*) AS n, {} AS cost FROM q WHERE {} GROUP BY case_id"
_RULES = (
    (conformance.Rule("always", "view"), _PER_CASE.format("max(CASE WHEN activity = 'view' THEN 1 ELSE 0 END) = 0")),
    (conformance.Rule("never", "error"), _PER_STEP.format(M, "activity = 'error'")),
    (conformance.Rule("first", "view"), _PER_CASE.format("max(CASE WHEN activity = 'view' AND pos = 1 THEN 1 ELSE 0 END) = 0")),
    (conformance.Rule("last", "purchase"), _PER_CASE.format("max(CASE WHEN activity = 'purchase' AND pos = size THEN 1 ELSE 0 END) = 0")),
    (conformance.Rule("after", "view", "purchase"), _PER_STEP.format("0.0::DOUBLE", "activity = 'view' AND pos >= coalesce(last_b, 0)")),
    (conformance.Rule("before", "view", "purchase"), _PER_STEP.format("0.0::DOUBLE", "activity = 'view' AND pos <= coalesce(first_b, 1000000000)")),
    (conformance.Rule("forbid", "error", "purchase"), _PER_STEP.format(M, "activity = 'purchase' AND prev = 'error'")),
    (conformance.Rule("max", "click", n=1), _PER_STEP.format(M, "activity = 'click' AND nth > 1")),
)
for _rule, _sql in _RULES:

    def _violations(spark, sf_dir, rule=_rule):
        return conformance.rule_violations(tables.log_user_day(spark, sf_dir), rule)

    QUERIES[f"rule_{_rule.kind}"] = _violations
    ORACLE[f"rule_{_rule.kind}"] = f"WITH {DAY}, {PLACES} {_sql}"

# Labels, prices and spans.
LABELS = "labels AS (SELECT 'tool:' || p_type || '(' || p_size || ' [x])' AS label, p_retailprice AS cost FROM part UNION ALL SELECT 'read-' || p_partkey, p_retailprice FROM part UNION ALL SELECT 'chat:' || p_brand, 0 FROM part UNION ALL SELECT p_name || ' /tmp/' || p_partkey || '.txt', 0 FROM part UNION ALL SELECT p_brand || '_retry_' || p_size, p_retailprice FROM part)"


def _labels(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    key, size, price = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.col("p_retailprice")
    pairs = (
        (F.concat(F.lit("tool:"), "p_type", F.lit("("), size, F.lit(" [x])")), price), (F.concat(F.lit("read-"), key), price), (F.concat(F.lit("chat:"), "p_brand"), F.lit(0.0)),
        (F.concat("p_name", F.lit(" /tmp/"), key, F.lit(".txt")), F.lit(0.0)), (F.concat("p_brand", F.lit("_retry_"), size), price),
    )
    rows = p.select(F.explode(F.array(*[F.struct(a.alias("label"), b.cast("double").alias("cost")) for a, b in pairs])).alias("x")).select("x.*")
    return tables.canonical_columns(rows, activity_raw=F.col("label"), activity=F.col("label"), cost_usd=F.col("cost"))


def _canonical_sql(c: str) -> str:
    s = c
    for _ in range(3):
        s = f"regexp_replace(regexp_replace({s}, '\\s*\\([^()]*\\)', '', 'g'), '\\s*\\[[^\\[\\]]*\\]', '', 'g')"
    for pattern in (r"(?i)[-_](attempt|try|retry|n)[-_]?\d+$", r"[\s:=]+[~./]?[\w.-]*/[\w./-]*", r"[-_/]\d[\w.]*$"):
        s = f"regexp_replace({s}, '{pattern}', '', 'g')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'), ' :/-_')"


CANON = f"canon AS (SELECT label, cost, CASE WHEN contains(s, ':') THEN CASE WHEN split_part(s, ':', 1) IN ('chat', 'completion', 'embedding', 'text_completion') THEN split_part(s, ':', 1) ELSE s END WHEN s = '' THEN 'unknown' ELSE s END AS c FROM (SELECT label, cost, {_canonical_sql('label')} AS s FROM labels))"


@query(f"WITH {LABELS}, {CANON} SELECT DISTINCT label, c AS canonical FROM canon")
def canonical_labels(spark, sf_dir):
    return _labels(spark, sf_dir).select(F.col("activity_raw").alias("label")).distinct().withColumn("canonical", canonical(F.col("label")))


_MAPPING, _OVERRIDES = {"read": "look up", "tool:ECONOMY": "economy", "chat": ""}, {"tool:SMALL": "small things"}
VOCABULARY = "voc AS (SELECT label, cost, c, CASE c WHEN 'read' THEN 'look up' WHEN 'tool:ECONOMY' THEN 'economy' WHEN 'tool:SMALL' THEN 'small things' ELSE c END AS activity FROM canon)"


def _abstracted(spark, sf_dir):
    return abstraction.apply_vocabulary(_labels(spark, sf_dir), abstraction.vocabulary(spark, _MAPPING, _OVERRIDES))


@query(f"WITH {LABELS}, {CANON}, {VOCABULARY} SELECT activity, count(*) AS n FROM voc GROUP BY activity")
def vocabulary_apply(spark, sf_dir):
    return _abstracted(spark, sf_dir).groupBy("activity").agg(F.count("*").alias("n"))


@query(f"WITH {LABELS}, {CANON}, {VOCABULARY}, l AS (SELECT activity, c, sum(CAST(cost AS DECIMAL(28,9))) AS cost FROM voc GROUP BY activity, c) SELECT activity, count(*) FILTER (WHERE cost > 0) AS paid_labels, count(*) FILTER (WHERE NOT cost > 0) AS free_labels, CAST(sum(cost) AS DOUBLE) / CAST((SELECT sum(cost) FROM l) AS DOUBLE) AS share FROM l GROUP BY activity")
def vocabulary_audit(spark, sf_dir):
    return abstraction.audit(_abstracted(spark, sf_dir))


_PRICES = {"Brand#1": (5.0, 25.0), "Brand#12": (2.0, 10.0), "Brand#2": (3.0, 15.0), "Brand#21": (1.0, 5.0)}
PRICES = "prices AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}', {i}::DOUBLE, {o}::DOUBLE)" for k, (n, (i, o)) in enumerate(_PRICES.items())) + ") AS v(ord, name, input, output))"
PRICED = f"{PRICES}, priced AS (SELECT model, name AS price_name, input, output FROM (SELECT model, prices.*, row_number() OVER (PARTITION BY model ORDER BY name <> model, ord) AS k FROM (SELECT DISTINCT p_brand AS model FROM part) LEFT JOIN prices ON starts_with(model, name)) WHERE k = 1)"


@query(f"WITH {PRICED} SELECT * FROM priced")
def price_prefix_match(spark, sf_dir):
    models = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("model")).distinct()
    return pricing.match_models(models, pricing.price_table(spark, _PRICES))


@query(f"WITH {PRICED} SELECT p_partkey, coalesce(((p_size * 100 + p_size * 10 * 0.1::DOUBLE + p_size * 1.25::DOUBLE + p_size * 2 * 2.0::DOUBLE) * input + p_size * 5 * output) / 1e6, 0) AS cost_usd FROM part JOIN priced ON model = p_brand")
def cost_expression(spark, sf_dir):
    s = F.col("p_size").cast("long")
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", (s * 100).alias("i"), (s * 5).alias("o"), (s * 10).alias("c"), s.alias("w5"), (s * 2).alias("w1"))
    return pricing.with_prices(p, "p_brand", pricing.price_table(spark, _PRICES)).select("p_partkey", pricing.cost("i", "o", "c", "w5", "w1").alias("cost_usd"))


@query("SELECT p_partkey, CASE WHEN m LIKE 'gpt-%' OR m LIKE 'o3%' THEN true WHEN m LIKE 'claude-%' THEN false END AS folded FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'gpt-' || p_brand WHEN 1 THEN 'o3' WHEN 2 THEN 'claude-' || p_brand ELSE p_brand END AS m FROM part)")
def cache_fold(spark, sf_dir):
    m = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("/GPT-"), "p_brand")).when(F.col("p_size") % 4 == 1, "o3").when(F.col("p_size") % 4 == 2, F.concat(F.lit("claude-"), "p_brand")).otherwise(F.col("p_brand"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("attrs", F.create_map().cast("map<string,string>"))
    return p.select("p_partkey", normalize.includes_cache(m).alias("folded"))


@query(
    """WITH RECURSIVE s AS (SELECT conv_id || '#' || turn AS id, CASE WHEN turn > 0 THEN conv_id || '#' || (turn - 1) END AS parent_id, CASE WHEN turn % 3 = 1 OR role = 'system' THEN conv_id || '/' || role END AS session FROM conversations),
up AS (SELECT id, id AS at, session, parent_id, 0 AS d FROM s UNION ALL SELECT up.id, s.id, s.session, s.parent_id, d + 1 FROM up JOIN s ON s.id = up.parent_id WHERE up.session IS NULL AND d < 64)
SELECT id, max(session) AS session FROM up GROUP BY id"""
)
def ancestor_inherit(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    name = lambda t: F.concat_ws("#", F.col("conv_id").cast("string"), t.cast("string"))
    own = F.when((F.col("turn") % 3 == 1) | (F.col("role") == "system"), F.concat_ws("/", F.col("conv_id").cast("string"), "role"))
    return normalize.inherit(c.select(name(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent_id"), own.alias("session")), "session")


@query(f"WITH {ORDER} SELECT event_id, activity FROM log WHERE NOT EXISTS (FROM raw AS c WHERE c.parent_id = log.event_id)")
def flatten_leaves(spark, sf_dir):
    return normalize.leaves(_order_log(spark, sf_dir).withColumnRenamed("event_id", "span_id")).select(F.col("span_id").alias("event_id"), "activity")
