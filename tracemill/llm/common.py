"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything between two runs of it is a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words without keeping them: separators inside the trimmed text, and one more."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    return F.when(body == "", F.lit(0)).otherwise(F.regexp_count(body, F.lit(SPACE + "+")) + 1).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset a new local one, but on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    Later steps then start from files that outlive any executor, and a costly
    projection that several branches read is made once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than this part of all rows is hot; so fewer keys are hot than this, whatever the data.
HOT_PARTS = 1024


def join_spread(rows: DataFrame, table: DataFrame, key: str, by: Column, how: str = "inner") -> DataFrame:
    """Inner or left join of ``rows`` with ``table``, which has one row for a key and counts the key's rows in ``k``.

    The rows of a hot key are dealt by the hash of ``by`` to as many tasks as it has parts of ``1 / HOT_PARTS`` of all
    rows, where its row of the table stands too: at most twice ``HOT_PARTS`` copies in all. The hot keys, fewer
    than ``HOT_PARTS``, are broadcast. ``table`` is read three times.
    """
    part = (table.agg(F.sum("k").alias("k")).first()["k"] or 0) / HOT_PARTS
    parts = F.ceil(F.col("k") / F.lit(max(part, 1.0))).cast("int")
    hot = table.filter(F.col("k") > F.lit(max(part, 1.0))).select(F.col(key).alias("_key"), parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left")
    dealt = dealt.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")), F.lit(0)).cast("int")).drop("_key", "_parts")
    last = F.when(F.col("k") > F.lit(max(part, 1.0)), parts - 1).otherwise(F.lit(0))
    return dealt.join(table.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))), [key, "_salt"], how).drop("_salt")
