"""From raw documents to shards of a training mix.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read
again as the next one's ``docs``. Within a stage a row is addressed by a number that it gets
when the stage's input is written with it, so rows are never mistaken for one another, whatever
their ids, nulls and texts.

Defined results, of every stage: ids may be null, repeated or shared by different texts; other
columns are ignored, also those whose names an operator uses inside; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import common, decontaminate, mixing, ngram_join, quality, sharding

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number each, written once, so that every reader sees the same."""
    return common.staged(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a null or empty text fails them, equal rows get equal decisions."""
    docs = _numbered(docs)
    kept = quality.quality_rules(docs, doc_id="_row").filter("kept").select(F.col("doc_id").alias("_row"))
    return docs.join(kept, "_row", "left_semi").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by five-word shingles at a similarity of 0.8; of repeated rows one stays.

    Null and empty texts link with nothing and stay.
    """
    docs = _numbered(docs)
    found = ngram_join.similarity_join(docs, doc_id="_row", width=5, percent=80)
    first = found.filter("doc_id = component_id").select(F.col("doc_id").alias("_row"))
    return docs.join(first, "_row", "left_semi").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts stay, and so does all without a benchmark."""
    docs = _numbered(docs)
    found = decontaminate.find_contamination(docs, common.table(spark, sf_dir, "benchmark"), doc_id="_row")
    return docs.join(found.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; texts without words are taken never."""
    docs = _numbered(docs)
    mixed = mixing.mix(docs, mixing.quality_weights(common.table(spark, sf_dir, "labels")), carry=("_row",))
    times = mixed.filter("taken > 0").select("_row", (F.col("taken") / F.col("size")).cast("int").alias("_times"))
    out = docs.join(times, "_row")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document; equal texts share a shard where they fit into a tenth of one."""
    return sharding.shard(docs, shards=40)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("sharding", sharding_stage),
]

#: Edit-distance matching and the similarity graph over whole tables have no practical SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
