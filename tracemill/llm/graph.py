"""Connected components of an edge list, in rounds that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a, b``); the root is the component's least node.

    Alternates two star contractions until nothing changes: each node links its
    larger neighbours to its least one, then its smaller neighbours and itself.
    Every round writes its edges into the shared folder, so the plan stays short
    and a lost executor costs one round. The edges of a hot node are reduced by a
    partial minimum before the shuffle; its neighbours are rows, never a list.
    """
    e = common.staged(edges.select("a", "b").filter("a <> b").distinct(), "components")
    while True:
        # Large star: for each node, its neighbours above it move to the least of all.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: for each node, its neighbours below it and itself move to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        new = common.staged(small, "components")
        # Stars only: no root has a root of its own, and every node has one.
        open_chains = new.join(new.select(F.col("a").alias("x")).distinct(), F.col("b") == F.col("x"), "left_semi").limit(1).count()
        several = new.groupBy("a").count().filter("count > 1").limit(1).count()
        e = new
        if not open_chains and not several:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
