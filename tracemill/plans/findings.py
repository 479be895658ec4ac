"""Findings: what a log says at a glance, from aggregates of a few rows each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cost, money
from ..operators import analysis, conformance, mining


@dataclass
class Finding:
    kind: str
    title: str
    detail: str = ""
    impact_usd: float = 0.0
    share: float = 0.0
    evidence: list[str] = field(default_factory=list)


@dataclass
class Model:
    """Everything mined from one log; the frames are lazy."""

    log: DataFrame
    totals: dict
    variants: DataFrame
    nodes: DataFrame
    edges: DataFrame
    resources: DataFrame
    parallel: dict
    rework: dict
    reuse: float


def mine(log: DataFrame) -> Model:
    batched = mining.with_batches(log)
    paths = mining.variants(mining.case_rollup(log))
    first = lambda df: df.first().asDict()
    return Model(
        log, first(mining.totals(log)), paths, mining.nodes(log), mining.edges(batched), mining.resources(log),
        first(mining.parallel_counters(log)), first(mining.rework_rate(batched)), first(mining.variant_reuse(paths))["variant_reuse"],
    )


def findings(m: Model, limit: int = 5) -> list[Finding]:
    """The detectors in their order, sorted by impact and share; impacts overlap and do not add up."""
    total = m.totals["total_cost"] or 1.0
    n_cases = m.totals["n_cases"] or 1
    out: list[Finding] = []
    applies = m.reuse >= 0.5

    loops = analysis.cycles(analysis.cycle_occurrences(mining.collapse_batches(mining.with_batches(m.log))))
    for c in loops.orderBy(F.desc("extra_cost"), "pattern").limit(2).collect():
        if c["extra_cost"] > 0 and c["extra_cost"] >= 0.02 * total:
            path = " → ".join(c["pattern"])
            rhythm = c["cases"] / n_cases > 0.5
            impact = 0.0 if rhythm else c["extra_cost"]
            what = f"{c['occurrences']} repeats in {c['cases']} runs, up to {c['max_repeats']} in a row"
            out.append(Finding("rhythm" if rhythm else "cycle", f"{'Rhythm' if rhythm else 'Loop'}: {path}", what, impact, c["extra_cost"] / total))

    tail = analysis.tail_variants(m.variants)
    tail_cost = tail.agg(money(F.col("cost")).alias("c")).first()["c"]
    fired = applies and tail_cost > 0.1 * total
    if applies and not fired:
        half = mining.pareto(m.variants, min_n=2).filter("cum_cost_share >= 0.5").orderBy(F.desc("cost_avg"), "example_case").limit(1).collect()
        for r in half:
            if r["cum_case_share"] <= 0.25:
                out.append(Finding("concentration", f"{r['cum_cost_share']:.0%} of the cost in {r['cum_case_share']:.0%} of the runs", "", 0.0, r["cum_cost_share"]))
    if fired:
        rows = tail.orderBy(F.desc("cost"), "example_case").limit(5).collect()
        out.append(Finding("tail", "Rare paths that cost far more than the median", "", tail_cost, tail_cost / total, [" → ".join(r["seq"][:12]) for r in rows]))

    f = analysis.failure_cost(m.log).first()
    if f["failed_cases"] and f["failure_cost"] > 0.05 * total:
        kinds = analysis.error_kinds(m.log).orderBy(F.desc("n"), "kind").limit(3).collect()
        out.append(Finding("errors", f"Failures in {f['failed_cases']} runs", "failing steps and the two after each", f["failure_cost"], f["failure_cost"] / total, [f"{k['kind']}: {k['n']}" for k in kinds]))

    for e in analysis.escalation(m.resources).collect():
        out.append(Finding("escalation", f"{e['resource']}: {e['cost_share']:.0%} of the cost in {e['call_share']:.0%} of the calls", "", e["cost"], e["cost"] / total))

    c = analysis.cache_totals(m.log).first()
    if c["tokens_in"] > 100_000 and c["hit_rate"] < 0.05:
        out.append(Finding("cache", f"The cache serves {c['hit_rate']:.1%} of the input"))

    for s in analysis.context_cost(m.log).orderBy(F.desc("est_usd"), "step").limit(1).collect():
        if s["est_usd"] > 0.03 * total:
            out.append(Finding("context", f"Context added by {s['step']}", f"{s['added_avg']:.0f} tokens a time, carried to later turns", s["est_usd"], s["est_usd"] / total))

    if not applies:
        out.append(Finding("not_applicable", "Most runs take a path of their own", f"{m.reuse:.0%} of the runs share a path"))
    return sorted(out, key=lambda x: (-x.impact_usd, -x.share))[:limit]


def conformance_findings(rep: conformance.Report, limit: int = 3) -> list[Finding]:
    out = []
    if rep.fitness is not None and rep.fitting < rep.n_cases:
        share = rep.off_model_share
        trivial = share < 0.01 and rep.off_model_cost > 0
        out.append(Finding("conformance", f"{rep.n_cases - rep.fitting} of {rep.n_cases} runs leave the declared flow", f"fitness {rep.fitness:.3f}", 0.0 if trivial else rep.off_model_cost, share))
    for rule, s in rep.rules:
        if s["cases"] / max(rep.n_cases, 1) > rule.allow:
            out.append(Finding("rule", f"{rule.text}: {s['cases']} runs", s["examples"] or "", s["cost"], s["cost"] / rep.total_cost if rep.total_cost else 0.0))
    return sorted(out, key=lambda x: (-x.impact_usd, -x.share))[:limit]


def spend_by_case(log: DataFrame) -> DataFrame:
    return log.groupBy("case_id").agg(money(cost()).alias("cost"))
