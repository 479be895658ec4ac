"""Secret scans with an incremental blob ledger, with Spark expressions only.

Every version of every path is addressed by the SHA-256 of its text. A ledger
holds which (blob, rule, rule version) have been scanned and what was found, so a
run scans each distinct blob once, with only the rules that have not seen it,
and joins the findings back to all paths that hold the blob.

Distinct blobs are found with a partial aggregation before the shuffle, so a
group of copies leaves one row per task. Findings are joined on the blob id; the paths of
a blob with very many are dealt to several tasks by their measured number.

Defined results: a null text is an empty blob; a path or version may be null or
repeated, each row gets its result; an empty table gives no rows; other columns
are ignored. Positions are code points from 0, ends exclusive. Matches of one
rule never overlap: they are the leftmost ones of its pattern, less those that
its length condition drops.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``group`` of the match must have ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1


# The rules in the order in which they are listed.
ASSIGN = r"""((?:(?i)password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE_KINDS = ("assign", "access", "hex")
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's matches: between the pieces that the pattern splits off stand the matches."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        good = F.length(F.regexp_extract(x["match"], rule.pattern, rule.group)) >= rule.least if rule.least else F.lit(True)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(found, F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)), lambda m, p: F.struct(m.alias("match"), p.alias("piece")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, zero, step)["out"]).otherwise(F.array().cast(SPANS))


def _versions(versions: DataFrame, path: str, version: str, text: str) -> DataFrame:
    rows = versions.select(F.col(path).alias("path"), F.col(version).alias("version"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumn("blob_id", F.sha2("text", 256))


def blob_store(versions: DataFrame, path: str = "path", version: str = "version", text: str = "text") -> DataFrame:
    """``blob_id, text``: every distinct text once."""
    return _versions(versions, path, version, text).select("blob_id", "text").dropDuplicates(["blob_id"])


def unseen(blobs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob_id, kind, rule_version, spans`` for every blob of a ``blob_store`` and rule that ``ledger`` (of the same columns) had not seen."""
    keys = {r.kind: f"{r.kind}/{r.version}" for r in rules}
    seen = F.array().cast("array<string>")
    if ledger is not None:
        known = ledger.groupBy("blob_id").agg(F.collect_set(F.concat_ws("/", "kind", F.col("rule_version").cast("string"))).alias("_seen"))
        blobs = blobs.join(known, "blob_id", "left")
        seen = F.coalesce("_seen", seen)
    blobs = blobs.withColumn("_seen", seen)
    blobs = blobs.filter(F.size(F.array_except(F.array(*[F.lit(k) for k in keys.values()]), F.col("_seen"))) > 0)
    new = [
        F.when(
            ~F.array_contains("_seen", keys[r.kind]),
            F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version"), _spans(F.col("text"), r, k).alias("spans")),
        )
        for k, r in enumerate(rules)
    ]
    return blobs.select("blob_id", F.explode(F.filter(F.array(*new), lambda x: x.isNotNull())).alias("x")).select("blob_id", "x.kind", "x.rule_version", "x.spans")


def scan(
    versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, blobs: DataFrame | None = None, path: str = "path", version: str = "version", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Findings by path, and the rows to append to the ledger.

    The first result has ``path, version, blob_id, spans`` for every row of
    ``versions``; the second is that of ``unseen``. ``blobs`` is a stored ``blob_store`` that holds
    the texts of ``versions``; without one it is made here.
    """
    rows = _versions(versions, path, version, text)
    scanned = unseen(blobs if blobs is not None else blob_store(versions, path, version, text), ledger, rules)
    keys = {r.kind: f"{r.kind}/{r.version}" for r in rules}
    current = scanned
    if ledger is not None:
        is_current = F.concat_ws("/", "kind", F.col("rule_version").cast("string")).isin(*keys.values())
        current = scanned.unionByName(ledger.filter(is_current).select("blob_id", "kind", "rule_version", "spans"))
    found = current.filter(F.size("spans") > 0).groupBy("blob_id").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    paths = rows.select("path", "version", "blob_id")
    found = common.staged(found.join(paths.groupBy("blob_id").agg(F.count("*").alias("k")), "blob_id"), "found")
    joined = common.join_spread(paths, found, "blob_id", F.struct("path", "version"), "left")
    return joined.select("path", "version", "blob_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")), scanned
