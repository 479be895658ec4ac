"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with Spark expressions only.

A document's key is -ln(u) / weight, with u from a hash of its id, so a heavier
document tends to come first. A source first gives as many complete epochs as
its budget holds; the rest goes to its documents in the order of their keys,
as long as the prefix sum of their sizes fits. What the next document leaves open
is given, in the same order, to smaller ones in two more passes; the last
document may cross the limit if that is nearer.

The prefix sum has two levels, so that a source with a third of all rows is not
sorted in one task: a document falls into one of ``BUCKETS`` key ranges of its
source, sums by (source, range) are small, and rows are sorted only within
their range.

Defined results: a null text has size 0; a null source is a source, ordered last;
rows of one id have equal keys and are told apart by their size and text, so a rerun takes the same; no total or a
source without words has target 0 and nothing taken; an empty table gives no
rows; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BUCKETS = 1024
#: Tasks over which the documents of a source are dealt.
SALTS = 64
#: Passes of the fractional selection.
PASSES = 3
#: A target stops at so many times its source's size.
MAX_EPOCHS = 3
#: Weights of the sources in their order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: Sampling weight by the label `quality`; unlabelled documents weigh 1.
QUALITY_WEIGHTS = {0: 0.5, 1: 2.0}


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight; u is the same for an id in every run."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size`` to the same with ``target``: shares of all sizes by weight.

    With the sources ordered by the level at which they reach their limit, each
    row knows what is left for those not yet full; the first that stays below
    its limit fixes the level for all after it.
    """
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = sizes.withColumn("n", n).withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), ((F.col("n") - 1) % len(WEIGHTS) + 1).cast("int")))
    w = w.withColumn("limit", F.lit(float(MAX_EPOCHS)) * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("w"))
    by_ratio = Window.orderBy("ratio", "n")
    w = w.withColumns(
        {
            "total": F.sum("source_size").over(Window.partitionBy()).cast("double"),
            "used": F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weights": F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    w = w.withColumn("level", (F.col("total") - F.col("used")) / F.col("weights")).withColumn("full", F.col("ratio") <= F.col("level"))
    level = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.struct("ratio", "n"))).over(Window.partitionBy())
    return w.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.col("w") * level)).select("source", "source_size", "target")


def mix(docs: DataFrame, weights: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and the columns in ``carry`` for every row of ``docs``.

    ``weights`` has ``doc_id, weight``, one row for an id, weights above 0.
    """
    rows = docs.select(*carry, F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), common.word_count(F.col(text)).alias("size"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"))
    if weights is not None:
        w = weights.select(F.col("doc_id").alias("_id"), F.col("weight").cast("double").alias("weight"))
        rows = rows.join(w, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    rows = rows.withColumn("key", sampling_key(F.col("doc_id"), F.coalesce("weight", F.lit(1.0)), seed)).drop("weight")
    rows = common.staged(rows.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * BUCKETS).cast("int")), "mix")

    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
    budget = F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))
    targets = common.staged(targets.withColumn("rest", budget), "targets")

    # A source's few numbers are there in every salt, so that its documents are dealt over several tasks.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    rows, left = rows.withColumns({"picked": F.lit(False), "salt": F.pmod("bucket", F.lit(SALTS))}), targets.select("source", F.col("rest").alias("left"))
    for k in range(PASSES):
        rows = common.staged(_pick(rows, left.select("*", salts), nearest=k == PASSES - 1), "mix")
        used = rows.filter("picked").groupBy("source").agg(F.sum("size").alias("used"))
        left = targets.alias("t").join(used.alias("u"), F.expr("t.source <=> u.source"), "left").select("t.source", (F.col("t.rest") - F.coalesce("u.used", F.lit(0))).alias("left"))
    out = rows.alias("r").join(targets.select("*", salts).alias("t"), F.expr("r.source <=> t.source AND r.salt = t.salt"))
    taken = F.col("size") * (F.col("epochs") + F.when(F.col("picked"), 1).otherwise(0))
    return out.select(*[f"r.{c}" for c in carry], "r.doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _pick(rows: DataFrame, left: DataFrame, nearest: bool) -> DataFrame:
    """Picks, of the documents not yet picked that fit into what is left, the first by key until it is used up.

    ``nearest``: also the document that crosses the limit, if that brings the sum nearer to it.
    """
    open_ = rows.alias("r").join(left.alias("l"), F.expr("r.source <=> l.source AND r.salt = l.salt")).select("r.*", "l.left")
    fits = ~F.col("picked") & (F.col("size") > 0) & (F.col("left") > 0) & (F.col("size") <= (2 * F.col("left") if nearest else F.col("left")))
    open_ = open_.withColumn("part", F.when(fits, F.col("size")).otherwise(0))
    by_bucket = open_.groupBy("source", "bucket").agg(F.sum("part").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = by_bucket.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("ahead"))
    w = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    near = open_.withColumn("within", F.coalesce(F.sum("part").over(w), F.lit(0)))
    placed = near.alias("r").join(ahead.alias("a"), F.expr("r.source <=> a.source AND r.bucket = a.bucket")).select("r.*", (F.col("ahead") + F.col("within")).alias("ahead"))
    enough = 2 * F.col("ahead") + F.col("size") <= 2 * F.col("left") if nearest else F.col("ahead") + F.col("size") <= F.col("left")
    return placed.withColumn("picked", F.col("picked") | ((F.col("part") > 0) & enough)).drop("left", "part", "within", "ahead")


def quality_weights(labels: DataFrame) -> DataFrame:
    """``doc_id, weight`` from the label ``quality``; the best label counts where an id has several."""
    best = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    weight = F.coalesce(F.element_at(F.create_map(*[x for k, v in QUALITY_WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), F.col("quality").cast("int")), F.lit(1.0))
    return best.select("doc_id", weight.alias("weight"))
