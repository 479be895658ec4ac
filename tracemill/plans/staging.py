"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a new local folder, but on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: the plan ends here, and a lost executor costs no more than a step."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``bucket``: rows in this order are in ascending buckets, about as many in each, ties included."""
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(buckets, *order).withColumn("bucket", F.spark_partition_id()), "ranged")


def running(ranged_rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Adds the running sums of the columns in the order of ``ranged``: sums of whole buckets first, then rows within their bucket."""
    whole = ranged_rows.groupBy("bucket").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("bucket", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    own = Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged_rows.withColumns({f"_own_{k}": F.sum(c).over(own) for k, c in sums.items()})
    # One row for each bucket, so as many as there are shuffle partitions.
    joined = rows.join(F.broadcast(whole), "bucket").withColumns({k: F.col(f"_{k}") + F.col(f"_own_{k}") for k in sums})
    return joined.drop(*[f"_{k}" for k in sums], *[f"_own_{k}" for k in sums], "bucket")
