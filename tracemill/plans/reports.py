"""Reports in Markdown and HTML, from the few rows that they show."""

from __future__ import annotations

import html
from datetime import UTC, datetime

from pyspark.sql import functions as F

from ..functions.columns import END, START
from ..operators import analysis, conformance, mining
from . import graph
from .findings import Finding, Model

FLAME_WIDTH, FLAME_LEAST, FLAME_DEPTH, FLAME_COVERAGE = 1000.0, 1.4, 18, 0.15


def usd(x: float) -> str:
    return f"${x:,.2f}" if abs(x) >= 1 else f"${x:.4f}"


def cell(text: object) -> str:
    return str(text).replace("|", "\\|").replace("\n", " ")


def period(t: dict) -> str:
    if not t.get("t_min"):
        return ""
    a, b = (datetime.fromtimestamp(t[k], UTC) for k in ("t_min", "t_max"))
    return f"{a:%d.%m.%Y} – {b:%d.%m.%Y}, {max(1, round((t['t_max'] - t['t_min']) / 86400))} days"


def _table(head: list[str], rows: list[list[object]]) -> str:
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(cell(x) for x in r) + " |" for r in rows])


def mermaid(edges: list[dict], nodes: dict[str, dict], total: float, off: set[str] = frozenset()) -> str:
    """A flow chart; opposite edges are one line, hot nodes (over 15 and 5 % of the cost) are marked."""
    name: dict[str, str] = {}
    out = ["flowchart LR"]
    pairs: dict[tuple[str, str], list[int]] = {}
    for e in edges:
        key = (e["src"], e["dst"])
        if key[::-1] in pairs and e["src"] != e["dst"]:
            pairs[key[::-1]][1] += e["n"]
        else:
            pairs.setdefault(key, [0, 0])[0] += e["n"]
    for a in sorted({x for k in pairs for x in k}):
        name[a] = f"n{len(name)}"
        label = a.replace('"', "'")
        share = nodes.get(a, {}).get("cost", 0.0) / total if total else 0.0
        out.append(f'  {name[a]}["{label}"]' + (":::off" if a in off else ":::hot" if share > 0.15 else ":::warm" if share > 0.05 else ""))
    loops = {e["src"]: graph.loop_label(e) for e in edges if e["src"] == e["dst"]}
    for (a, b), (n, back) in pairs.items():
        if a == b:
            out.append(f"  {name[a]} -->|{loops[a]}| {name[a]}")
            continue
        out.append(f"  {name[a]} <-->|{n} / {back}| {name[b]}" if back else f"  {name[a]} -->|{n}| {name[b]}")
    return "\n".join([*out, "  classDef hot fill:#f96", "  classDef warm fill:#fd9", "  classDef off fill:#f55"])


def _spine(m: Model, max_nodes: int, min_edge: float) -> tuple[list[dict], dict[str, dict]]:
    n = m.log.sparkSession.createDataFrame([(m.totals["n_cases"],)], "n_cases long")
    edges = [r.asDict() for r in mining.spine(m.edges, m.nodes, n, max_nodes, min_edge).orderBy(F.desc("n"), "src", "dst").collect()]
    nodes = {r["activity"]: r.asDict() for r in m.nodes.orderBy(F.desc("cost"), "activity").limit(max_nodes).collect()}
    return edges, nodes


def _summary(m: Model) -> list[tuple[str, str]]:
    t = m.totals
    return [
        ("Runs", f"{t['n_cases']:,}"), ("Events", f"{t['n_events']:,}"), ("Spend", usd(t["total_cost"])), ("Spend a run", usd(t["total_cost"] / t["n_cases"] if t["n_cases"] else 0.0)),
        ("Tokens", f"{t['total_tokens']:,}"), ("Runs on a shared path", f"{m.reuse:.0%}"), ("Rework", f"{m.rework['rework_rate']:.1%}"),
        ("Parallel calls", f"{m.parallel['parallel_events']:,} in {m.parallel['batches']:,} batches"), ("Period", period(t)),
    ]


def markdown(m: Model, found: list[Finding], max_nodes: int = 25, min_edge: float = 0.02) -> str:
    edges, nodes = _spine(m, max_nodes, min_edge)
    top = mining.top_variants(m.variants, 10).collect()
    res = m.resources.orderBy(F.desc("cost"), "resource").limit(10).collect()
    loops = mining.loop_cost(mining.with_batches(m.log)).orderBy(F.desc("loop_cost"), "activity").limit(10).collect()
    parts = ["# Process report", _table(["", ""], [[a, b] for a, b in _summary(m)]), "## Findings", "Impacts overlap and do not add up."]
    parts += [f"- **{f.title}** ({usd(f.impact_usd)}, {f.share:.1%}) {f.detail}" + "".join(f"\n  - {e}" for e in f.evidence) for f in found] or ["None."]
    parts += ["## Process", "```mermaid\n" + mermaid(edges, nodes, m.totals["total_cost"]) + "\n```"]
    parts += ["## Dearest paths", _table(["path", "runs", "spend"], [[" → ".join(v["seq"][:12]) + (f" …+{len(v['seq']) - 12} more" if len(v["seq"]) > 12 else ""), v["n"], usd(v["cost"])] for v in top])]
    parts += ["## Resources", _table(["resource", "calls", "spend", "tokens"], [[r["resource"], r["n"], usd(r["cost"]), r["tokens"]] for r in res])]
    parts += ["## Repeats", _table(["activity", "repeats", "spend"], [[r["activity"], r["rework"], usd(r["loop_cost"])] for r in loops])]
    return "\n\n".join(parts) + "\n"


def flame_blocks(rows: list[dict], total: float) -> list[tuple[int, float, float, list[str]]]:
    """``(depth, x, width, prefix)`` of an icicle; slivers go with all below them, and so do rows that cover little."""
    kids: dict[tuple, list[dict]] = {}
    for r in rows:
        kids.setdefault(tuple(r["prefix"][:-1]), []).append(r)
    out, todo = [], [((), total, 0.0, FLAME_WIDTH)]
    while todo:
        prefix, cost, x, width = todo.pop()
        for r in sorted(kids.get(prefix, ()), key=lambda r: (-r["cost"], r["prefix"])):
            w = width * r["cost"] / cost if cost else 0.0
            if w < FLAME_LEAST:
                continue
            out.append((len(prefix), x, w, list(r["prefix"])))
            todo.append((tuple(r["prefix"]), r["cost"], x, w))
            x += w
    cover: dict[int, float] = {}
    for d, _, w, _ in out:
        cover[d] = cover.get(d, 0.0) + w
    last = next((d for d in range(FLAME_DEPTH) if cover.get(d, 0.0) < FLAME_COVERAGE * FLAME_WIDTH), FLAME_DEPTH)
    return [b for b in out if b[0] < last]


def html_report(m: Model, found: list[Finding], max_nodes: int = 60, min_edge: float = 0.01) -> str:
    edges, nodes = _spine(m, max_nodes, min_edge)
    least = m.totals["total_cost"] * FLAME_LEAST / FLAME_WIDTH
    tree = mining.prefix_tree(m.variants, FLAME_DEPTH)
    rows = [r.asDict() for r in tree.filter(F.col("cost") >= least).collect()]  # at most 1000 / 1.4 for each depth
    # The hub is in every run, so the colours go to what differs between them.
    hub = next((r["activity"] for r in mining.hub(m.edges).collect()), None)
    often = [r["activity"] for r in m.nodes.orderBy(F.desc("n"), "activity").limit(4).collect() if r["activity"] != hub][:3]
    colours, e = dict(zip(often, ("#2b6cb0", "#b7791f", "#2f855a"), strict=False)) | ({hub: "#cbd5e0"} if hub else {}), html.escape
    blocks = flame_blocks(rows, m.totals["total_cost"])
    height = 22 * (1 + max((b[0] for b in blocks), default=0))
    svg = [f'<svg viewBox="0 0 {FLAME_WIDTH:.0f} {height}" width="100%">']
    for d, x, w, prefix in blocks:
        fill = colours.get(prefix[-1], "#a0aec0")
        text = f'<text x="{x + 3:.1f}" y="{22 * d + 15}" font-size="11">{e(prefix[-1][: int(w / 7)])}</text>' if w > 40 else ""
        svg.append(f'<g><title>{e(" → ".join(prefix))}</title><rect x="{x:.1f}" y="{22 * d}" width="{w:.1f}" height="20" fill="{fill}"/>{text}</g>')
    carry = analysis.context_cost(m.log).orderBy(F.desc("est_usd"), "step").limit(7).collect()
    carry = ([c for c in carry if c["step"] != hub] or carry)[:6]
    most = max((c["est_usd"] for c in carry), default=0.0) or 1.0
    bars = "".join(f"<div><span>{e(c['step'])}</span><b style='display:inline-block;background:#2b6cb0;height:10px;width:{300 * c['est_usd'] / most:.0f}px'></b> {usd(c['est_usd'])}</div>" for c in carry)
    top = mining.top_variants(m.variants, 15).collect()
    row = lambda *c: "<tr>" + "".join(f"<td>{e(str(x))}</td>" for x in c) + "</tr>"
    res = m.resources.orderBy(F.desc("cost"), "resource").limit(15).collect()
    return "\n".join(
        [
            "<!doctype html><meta charset='utf-8'><title>Process report</title><style>body{font:14px sans-serif;max-width:1100px;margin:2em auto}td{padding:2px 10px}.tile{display:inline-block;margin:8px 24px 8px 0}</style>",
            "<h1>Process report</h1>", "".join(f"<div class='tile'><small>{e(a)}</small><br><b>{e(b)}</b></div>" for a, b in _summary(m)),
            "<h2>Findings</h2>", "".join(f"<p><b>{e(f.title)}</b> {usd(f.impact_usd)} {e(f.detail)}<br><small>{e('; '.join(f.evidence))}</small></p>" for f in found),
            "<h2>Where runs go</h2>", *svg, "</svg>", "<h2>Context carried on</h2>", bars, "<h2>Process</h2>", graph.svg(edges, nodes, m.totals["total_cost"], hub, colours), "<h2>Transitions</h2><table>", *(row(x["src"], x["dst"], x["n"]) for x in edges if x["src"] != START and x["dst"] != END), "</table>",
            "<h2>Dearest paths</h2><table>", *(row(" → ".join(v["seq"][:12]), v["n"], usd(v["cost"])) for v in top), "</table>",
            "<h2>Resources</h2><table>", *(row(r["resource"], r["n"], usd(r["cost"])) for r in res), "</table>",
        ]
    )


def drift_markdown(before, after) -> str:
    """Two logs beside each other."""
    s = analysis.drift_summary(before, after).first()
    grown = lambda a, b: f"{(b - a) / a:+.0%}" if a else "–"
    rows = [[w, f"{s[k + '_before']:.4g}", f"{s[k + '_after']:.4g}", grown(s[k + "_before"], s[k + "_after"])] for w, k in (("spend a run", "cost_per_case"), ("steps a run", "len"), ("paths", "variants"))]
    change = (s["cost_per_case_after"] - s["cost_per_case_before"]) / s["cost_per_case_before"] if s["cost_per_case_before"] else 0.0
    head = "Runs became dearer." if change > 0.1 else "Runs became cheaper." if change < -0.1 else "The spend of a run stayed within 10 %."
    nodes = analysis.drift_nodes(before, after).filter(F.abs("delta") > 0.01).orderBy(F.abs("delta").desc(), "activity").limit(8).collect()
    of = lambda log: mining.edges(mining.with_batches(log))
    edges = analysis.drift_edges(of(before), of(after))
    parts = ["# Drift", head, _table(["", "before", "after", "change"], rows), "## Activities a run", _table(["activity", "before", "after"], [[r["activity"], f"{r['before']:.2f}", f"{r['after']:.2f}"] for r in nodes])]
    for kind in ("new", "gone"):
        top = edges.filter(F.col("kind") == kind).orderBy(F.desc("n"), "src", "dst").limit(8).collect()
        parts += [f"## {kind.capitalize()} transitions", _table(["from", "to", "n"], [[r["src"], r["dst"], r["n"]] for r in top])]
    if s["enumerable"]:
        paths = analysis.drift_variants(*(mining.variants(mining.case_rollup(x)) for x in (before, after)))
        for kind in ("appeared", "vanished"):
            top = paths.filter(F.col("kind") == kind).orderBy(F.desc("n"), "seq").limit(5).collect()
            parts += [f"## Paths that {kind}", _table(["path", "runs"], [[" → ".join(r["seq"]), r["n"]] for r in top])]
    return "\n\n".join(parts) + "\n"


def check_markdown(rep: conformance.Report, m: Model, max_nodes: int = 18, min_edge: float = 0.05) -> str:
    edges, nodes = _spine(m, max_nodes, min_edge)
    off = {d["activity"] for d in rep.deviations if d["kind"] == "log"}
    parts = [f"# {rep.process.name}: {'passed' if rep.ok else 'FAILED'}", *(f"- {x}" for x in rep.failures), *(f"- warning: {x}" for x in rep.warnings)]
    rows = [["runs", rep.n_cases], ["spend a run", usd(rep.usd_per_case)], ["run length p95", f"{rep.steps_p95:.0f}"]]
    if rep.fitness is not None:
        rows += [["fitness", f"{rep.fitness:.3f}"], ["fitting runs", rep.fitting], ["off-model spend", usd(rep.off_model_cost)]]
    parts += [_table(["metric", "value"], rows)]
    parts += [_table(["rule", "runs", "events", "spend", "examples"], [[r.text, s["cases"], s["events"], usd(s["cost"]), s["examples"]] for r, s in rep.rules])]
    parts += ["## Deviations", _table(["kind", "activity", "n", "runs", "spend"], [[d["kind"], d["activity"], d["n"], d["cases"], usd(d["cost"])] for d in rep.deviations[:12]])]
    return "\n\n".join([*parts, "```mermaid\n" + mermaid(edges, nodes, rep.total_cost, off) + "\n```"]) + "\n"
