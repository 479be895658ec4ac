"""Activity vocabulary: labels to activities, built once over distinct labels."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import canonical, present

#: Labels that a clustering backend gets at once.
CHUNK = 400


def vocabulary(spark: SparkSession, mapping: dict[str, str], overrides: dict[str, str] | None = None) -> DataFrame:
    """``label, mapped, overridden``; one row per label of a vocabulary file."""
    overrides = overrides or {}
    rows = [(k, mapping.get(k), overrides.get(k)) for k in sorted(mapping.keys() | overrides.keys())]
    return spark.createDataFrame(rows, "label string, mapped string, overridden string")


def apply_vocabulary(log: DataFrame, words: DataFrame) -> DataFrame:
    """Sets ``activity``: the override of the label, of its canonical form, its mapping, or the canonical form itself."""
    labels = log.select("activity_raw").distinct().withColumn("canon", canonical(F.col("activity_raw")))
    by_raw = words.select(F.col("label").alias("activity_raw"), present(F.col("overridden")).alias("o1"))
    by_canon = words.select(F.col("label").alias("canon"), present(F.col("overridden")).alias("o2"), present(F.col("mapped")).alias("m"))
    found = labels.join(by_raw, "activity_raw", "left").join(by_canon, "canon", "left").select("activity_raw", F.coalesce("o1", "o2", "m", "canon").alias("activity"))
    return log.drop("activity").join(found, "activity_raw", "left").select(log.columns)


def audit(log: DataFrame) -> DataFrame:
    """Per activity: labels that cost something and that cost nothing, and its share of the spend."""
    by_label = log.groupBy("activity", canonical(F.col("activity_raw")).alias("label")).agg(F.sum(F.col("cost_usd").cast("decimal(28,9)")).alias("cost"))
    whole = by_label.agg(F.sum("cost").alias("total"))
    paid = F.col("cost") > 0
    out = by_label.groupBy("activity").agg(F.sum(paid.cast("long")).alias("paid_labels"), F.sum((~paid).cast("long")).alias("free_labels"), F.sum("cost").alias("c"))
    share = F.when(F.col("total") > 0, F.col("c").cast("double") / F.col("total").cast("double")).otherwise(F.lit(0.0))
    return out.crossJoin(F.broadcast(whole)).select("activity", "paid_labels", "free_labels", share.alias("share"))


def build(labels: Iterable[str], cluster: Callable[[list[str], int], dict[str, str]] | None = None, target: int = 12) -> dict[str, str]:
    """A mapping of canonical labels: chunks are clustered, then the names that came of them once more."""
    return build_counted(labels, cluster, target)[0]


def build_counted(labels: Iterable[str], cluster: Callable[[list[str], int], dict[str, str]] | None = None, target: int = 12) -> tuple[dict[str, str], dict[str, int]]:
    """The mapping, and how many labels the backend left out (they stand for themselves) and invented (they are dropped)."""
    todo = sorted(set(labels))
    if cluster is None:
        return {x: x for x in todo}, {"missing_from_llm": len(todo), "invented_by_llm": 0}
    found: dict[str, str] = {}
    invented: set[str] = set()
    for k in range(0, len(todo), CHUNK):
        part = todo[k : k + CHUNK]
        got = cluster(part, target)
        invented |= got.keys() - set(todo)
        found.update({x: got[x] for x in part if got.get(x)})
    missing = len(todo) - len(found)
    names = sorted(set(found.values()))
    if len(todo) > CHUNK and len(names) > target:
        merged = cluster(names, target)
        found = {x: merged.get(a) or a for x, a in found.items()}
    return {x: found.get(x, x) for x in todo}, {"missing_from_llm": missing, "invented_by_llm": len(invented)}


def stability(labels: Iterable[str], cluster: Callable[[list[str], int], dict[str, str]] | None, runs: int, target: int = 12) -> float:
    """Mean share of label pairs that two of the runs treat alike."""
    todo = sorted(set(labels))
    made = [build(todo, cluster, target) for _ in range(runs)]
    scores = [rand_index(a, b) for i, a in enumerate(made) for b in made[i + 1 :]]
    return sum(scores) / len(scores) if scores else 1.0


def merged_paid_and_free(log: DataFrame) -> DataFrame:
    """``activity, paid, free, share``: activities that merge steps that cost something with steps that cost nothing."""
    by_label = log.groupBy("activity", canonical(F.col("activity_raw")).alias("label")).agg((F.sum(F.col("cost_usd").cast("decimal(28,9)")) > 0).alias("paid"))
    names = lambda paid: F.array_join(F.sort_array(F.collect_set(F.when(F.col("paid") == paid, F.col("label")))), ", ")
    lists = by_label.groupBy("activity").agg(names(True).alias("paid"), names(False).alias("free"))
    mixed = audit(log).filter("paid_labels > 0 AND free_labels > 0").select("activity", "share")
    return lists.join(mixed, "activity")


def rand_index(a: dict[str, str], b: dict[str, str]) -> float:
    """Share of label pairs that two mappings treat alike; 1 for under two labels."""
    keys = sorted(a.keys() & b.keys())
    pairs = [(x, y) for i, x in enumerate(keys) for y in keys[i + 1 :]]
    return sum((a[x] == a[y]) == (b[x] == b[y]) for x, y in pairs) / len(pairs) if pairs else 1.0
