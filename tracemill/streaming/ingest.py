"""Continuous ingest of OTLP lines into an event log. An extension; the batch operators do not need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import normalize
from ..sources import json_text, otlp


def follow(spark: SparkSession, source: str, log: str, checkpoint: str, prices: DataFrame, case: str = "trace"):
    """Appends the events of every new file of lines below ``source`` to ``log``.

    The lines of a batch are the rows that the batch readers parse and normalise; case notions that
    look across files (session, task) see the lines of one batch.
    """
    lines = spark.readStream.format("text").option("pathGlobFilter", json_text.LINES).load(source)

    def add(batch: DataFrame, epoch: int) -> None:
        spans = otlp.spans(json_text.parsed_lines(batch, otlp.SCHEMA))
        normalize.normalize(spans, prices, case=case).write.mode("append").parquet(log)

    return lines.writeStream.outputMode("append").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
