"""Registered queries of findings, rules and verdicts: every number that a report or a check decides by."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conformance
from ..sources import tables
from . import findings
from .catalogue import CASES, CUT, DAY, M, MONEY, OPEN_FLOW, ORDER, PATHS, PLACES, RATE, RESOURCES, TURNS, USER, W, _RULES, _cycle_parts, _order_log, query
from .flow import parse_flow

CHAT_LOG = f"""sized AS (SELECT *, length(coalesce(text, '')) AS size, lag(turn) OVER v AS before FROM conversations WINDOW v AS (PARTITION BY conv_id ORDER BY turn)),
grown AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS earlier FROM sized),
raw AS (SELECT CAST(conv_id AS VARCHAR) AS case_id, conv_id || '#' || lpad(CAST(turn AS VARCHAR), 6, '0') AS event_id, CASE WHEN role = 'assistant' THEN 'chat' ELSE 'tool:' || role END AS activity, turn::DOUBLE AS ts_start,
  CASE WHEN before IS NOT NULL THEN conv_id || '#' || lpad(CAST(before AS VARCHAR), 6, '0') END AS parent_id, CAST(NULL AS VARCHAR) AS resource, CASE WHEN role = 'assistant' THEN (earlier * 2 + size * 10) / 1e6 ELSE 0 END AS cost,
  CASE WHEN role = 'assistant' THEN earlier ELSE 0 END AS prompt, 0 AS err FROM grown),
parents AS (SELECT parent_id, count(*) AS n FROM raw WHERE parent_id IS NOT NULL GROUP BY parent_id HAVING count(*) > 1),
log AS (SELECT raw.*, parents.parent_id AS batch FROM raw LEFT JOIN parents USING (parent_id))"""


def _findings_sql(log: str, cached: bool) -> str:
    """All detectors over one log; ``cached``: the prompt is served by the cache, so none of it is input."""
    tokens = "SELECT 0 AS tin, CAST(coalesce(sum(prompt), 0) AS BIGINT) AS hit FROM log" if cached else "SELECT CAST(coalesce(sum(prompt), 0) AS BIGINT) AS tin, 0 AS hit FROM log"
    return f"""WITH RECURSIVE {log}, {CASES}, {PATHS}, {_cycle_parts().replace('placed', 'positioned')},
whole AS (SELECT CAST(sum(CAST(cost AS DECIMAL(28,9))) AS DOUBLE) AS total, count(DISTINCT case_id) AS n_cases FROM log), reuse AS (SELECT coalesce(sum(n) FILTER (WHERE n > 1), 0) / sum(n)::DOUBLE AS r FROM paths),
loops AS (SELECT CASE WHEN cases / n_cases::DOUBLE > 0.5 THEN 'rhythm' ELSE 'cycle' END AS kind, extra_cost, extra_cost / total AS share FROM (SELECT * FROM cyc ORDER BY extra_cost DESC, pattern LIMIT 2), whole WHERE extra_cost > 0 AND extra_cost >= 0.02 * total),
med AS (SELECT avg_cost AS median FROM (SELECT cost / n AS avg_cost, row_number() OVER (ORDER BY cost / n, example_case) AS k, count(*) OVER () AS c FROM paths) WHERE k = c // 2 + 1),
tail AS (SELECT {MONEY.format('p.cost')} AS c FROM paths AS p, med, whole WHERE n >= 2 AND n / n_cases::DOUBLE < 0.05 AND p.cost / n > 2 * median), fired AS (SELECT r >= 0.5 AND c > 0.1 * total AS yes FROM tail, whole, reuse),
par AS (SELECT cost / n AS ca, example_case, CAST(sum(CAST(cost AS DECIMAL(28,9))) OVER v AS DOUBLE) / (SELECT total FROM whole) AS cc, sum(n) OVER v / (SELECT sum(n) FROM paths)::DOUBLE AS cn FROM paths WHERE n >= 2 WINDOW v AS (ORDER BY cost / n DESC, example_case ROWS UNBOUNDED PRECEDING)),
half AS (SELECT * FROM par WHERE cc >= 0.5 ORDER BY ca DESC, example_case LIMIT 1),
near AS (SELECT *, max(err) OVER (PARTITION BY case_id ORDER BY ts_start, event_id ROWS 2 PRECEDING) AS close FROM log),
fail AS (SELECT {MONEY.format('cost').replace('), 0)', ') FILTER (WHERE close = 1), 0)')} AS c, count(DISTINCT case_id) FILTER (WHERE err = 1) AS k FROM near),
{RESOURCES}, esc AS (SELECT * FROM res, (SELECT sum(cost) AS rc, sum(n) AS rn FROM res) WHERE cost / rc > 0.2 AND n / rn::DOUBLE < 0.1 ORDER BY cost DESC, resource LIMIT 1), tok AS ({tokens}),
{RATE}, {TURNS}, placed AS (SELECT case_id, activity, prompt, CAST(sum(CASE WHEN prompt > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY ts_start, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS k FROM log),
gaps AS (SELECT case_id, k, activity FROM placed WHERE prompt = 0), gap_size AS (SELECT case_id, k, count(*) AS size FROM gaps GROUP BY case_id, k),
parts AS (SELECT g.activity AS step, t.delta::DOUBLE / s.size AS share, t.remaining FROM turns AS t JOIN gap_size AS s USING (case_id, k) JOIN gaps AS g USING (case_id, k) WHERE t.delta > 0
  UNION ALL SELECT t.activity, t.delta::DOUBLE, t.remaining FROM turns AS t LEFT JOIN gap_size AS s USING (case_id, k) WHERE t.delta > 0 AND s.size IS NULL),
ctx AS (SELECT step, {MONEY.format('share * remaining')} * (SELECT coalesce(rate, 0) FROM rate) AS usd FROM parts GROUP BY step ORDER BY usd DESC, step LIMIT 1)
SELECT kind, CASE WHEN kind = 'rhythm' THEN 0 ELSE extra_cost END AS impact_usd, share FROM loops
UNION ALL SELECT 'tail', c, c / total FROM tail, whole, fired WHERE yes
UNION ALL SELECT 'concentration', 0, cc FROM half, fired, reuse WHERE NOT yes AND r >= 0.5 AND cn <= 0.25
UNION ALL SELECT 'errors', c, c / total FROM fail, whole WHERE k > 0 AND c > 0.05 * total
UNION ALL SELECT 'escalation', cost, cost / total FROM esc, whole
UNION ALL SELECT 'cache', 0, 0 FROM tok WHERE tin > 100000 AND hit / (tin + hit)::DOUBLE < 0.05
UNION ALL SELECT 'context', usd, usd / total FROM ctx, whole WHERE usd > 0.03 * total
UNION ALL SELECT 'not_applicable', 0, 0 FROM reuse WHERE r < 0.5"""


def _found(spark, log):
    rows = [(f.kind, float(f.impact_usd), float(f.share)) for f in findings.findings(findings.mine(log), limit=100)]
    return spark.createDataFrame(rows, "kind string, impact_usd double, share double")


@query(_findings_sql(DAY, True))
def findings_day(spark, sf_dir):
    return _found(spark, tables.log_user_day(spark, sf_dir))


@query(_findings_sql(USER, True))
def findings_user(spark, sf_dir):
    return _found(spark, tables.log_user(spark, sf_dir))


@query(_findings_sql(ORDER, True))
def findings_order(spark, sf_dir):
    return _found(spark, _order_log(spark, sf_dir))


@query(_findings_sql(CHAT_LOG, False))
def findings_chat(spark, sf_dir):
    return _found(spark, tables.log_chat(spark, sf_dir))


#: The user-day log again, by day and kind of event: few paths that many runs share.
SHORT = DAY.replace("CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d')", "CAST(event_id AS VARCHAR)")


@query(_findings_sql(SHORT, True))
def findings_shared(spark, sf_dir):
    """Runs of one event each, so that paths are shared and the detectors of rare paths apply."""
    log = tables.log_user_day(spark, sf_dir)
    return _found(spark, log.withColumn("case_id", F.ltrim("event_id", F.lit("0"))).withColumn("case_id", F.when(F.col("case_id") == "", "0").otherwise(F.col("case_id"))))


_STATS = " UNION ALL ".join(f"SELECT {k}::INTEGER AS rule, * FROM ({sql})" for k, (_, sql) in enumerate(_RULES))


@query(f"WITH {DAY}, {PLACES}, v AS ({_STATS}), e AS (SELECT rule, string_agg(case_id, ',' ORDER BY case_id) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY case_id) AS k FROM v) WHERE k <= 3 GROUP BY rule) SELECT rule, count(*) AS cases, CAST(sum(n) AS BIGINT) AS events, {M} AS cost, any_value(examples) AS examples FROM v JOIN e USING (rule) GROUP BY rule")
def rule_stats(spark, sf_dir):
    return conformance.rule_stats(tables.log_user_day(spark, sf_dir), [r for r, _ in _RULES])


#: The first day against the rest: a log to compare with.
LIMITS = {"fitness_min": 0.9, "usd_per_case_max": 50.0, "steps_p95_max": 100.0, "off_model_share_max": 0.1, "usd_per_case_increase_max": 0.01, "steps_increase_max": 0.5, "fitness_drop_max": -0.5}
PROCESS = {"name": "shop", "flow": OPEN_FLOW, "rules": [{"never": "error", "allow": 0.01}, {"first": "view", "warn": True}, {"max": 3, "of": "click"}, {"always": "ghost", "allow": 1.0}], "thresholds": LIMITS}


def _side(k: str, op: str) -> str:
    return f"""{k}_log AS (SELECT * FROM log WHERE ts_start {op} {CUT}), {k}_cases AS (SELECT case_id, count(*) AS n, sum(err) AS errors, {M} AS cost FROM {k}_log GROUP BY case_id),
{k}_p95 AS (SELECT n FROM (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS c FROM {k}_cases) WHERE i = round_even(0.95 * (c - 1), 0)),
{k} AS (SELECT 1 - sum(errors + 1) / sum(n + 1)::DOUBLE AS fitness, {M} / count(*) AS usd, (SELECT n FROM {k}_p95)::DOUBLE AS p95, (SELECT {M} FROM {k}_log WHERE err = 1) / {M} AS off, count(*) AS n_cases FROM {k}_cases)"""


_SIDES = f"WITH {DAY}, {_side('b', '<')}, {_side('a', '>=')}"


@query(f"""{_SIDES}, m AS (SELECT 'fitness_min' AS threshold, a.fitness AS value FROM a UNION ALL SELECT 'usd_per_case_max', usd FROM a UNION ALL SELECT 'steps_p95_max', p95 FROM a UNION ALL SELECT 'off_model_share_max', off FROM a
  UNION ALL SELECT 'usd_per_case_increase_max', (a.usd - b.usd) / b.usd FROM a, b UNION ALL SELECT 'steps_increase_max', (a.p95 - b.p95) / b.p95 FROM a, b UNION ALL SELECT 'fitness_drop_max', b.fitness - a.fitness FROM a, b),
t AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in LIMITS.items())}) AS v(threshold, lim)) SELECT threshold, value, lim AS "limit", CASE WHEN threshold = 'fitness_min' THEN value < lim ELSE value > lim END AS failed FROM m JOIN t USING (threshold)""")
def verdict(spark, sf_dir):
    """Every threshold of a declared process, with the days before the cut as the baseline."""
    log = tables.log_user_day(spark, sf_dir)
    rep = conformance.check(conformance.Process.from_dict(PROCESS), log.filter(F.col("ts_start") >= CUT), log.filter(F.col("ts_start") < CUT))
    return spark.createDataFrame(rep.compared, "threshold string, value double, limit double, failed boolean")


_OWN = f"p AS (SELECT case_id, activity, cost, row_number() OVER w AS pos, row_number() OVER (PARTITION BY case_id, activity ORDER BY ts_start, event_id) AS nth FROM log WINDOW w AS {W})"


@query(f"""WITH {DAY}, {_OWN}, k AS (SELECT count(DISTINCT case_id) AS n, {M} AS total FROM log),
v AS (SELECT 'never error' AS what, count(DISTINCT case_id) AS cases, {M} AS cost, 0.01 AS allow FROM p WHERE activity = 'error' UNION ALL SELECT 'first view', count(DISTINCT case_id), 0, 0 FROM p WHERE pos = 1 AND activity <> 'view'
  UNION ALL SELECT 'max 3 of click', count(DISTINCT case_id), {M}, 0 FROM p WHERE activity = 'click' AND nth > 3 UNION ALL SELECT 'always ghost', count(DISTINCT case_id), 0, 1 FROM p)
SELECT 'rule' AS kind, what, cost AS impact_usd, cost / total AS share FROM v, k WHERE cases / n::DOUBLE > allow
UNION ALL SELECT 'conformance', 'flow', (SELECT {M} FROM log WHERE err = 1), (SELECT {M} FROM log WHERE err = 1) / total FROM k
UNION ALL SELECT 'unseen', x, 0, 0 FROM (SELECT unnest(['ghost', 'done']) AS x) WHERE x NOT IN (SELECT activity FROM log)""")
def conformance_findings(spark, sf_dir):
    """What a check finds: the runs off the flow, rules that are broken, declared activities that never occur."""
    rep = conformance.check(conformance.Process.from_dict(PROCESS), tables.log_user_day(spark, sf_dir))
    rows = [(f.kind, f.title.rsplit(":", 1)[0] if f.kind == "rule" else "flow", float(f.impact_usd), float(f.share)) for f in findings.conformance_findings(rep, limit=100)]
    return spark.createDataFrame(rows + [("unseen", a, 0.0, 0.0) for a in rep.unseen], "kind string, what string, impact_usd double, share double")


assert parse_flow(OPEN_FLOW).shortest_run() == 1  # the SQL above counts on it
