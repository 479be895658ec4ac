"""Choice of the source format, and the event log's own files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COLUMNS, EVENT
from . import chat, otlp, transcripts

HEAD = 8192


@dataclass(frozen=True)
class Adapter:
    """A format: what its head looks like, and how it is read into raw spans."""

    name: str
    detect: Callable[[str, str], bool]
    read: Callable[[SparkSession, str], DataFrame]
    case: str = "trace"


def _json(path: str) -> bool:
    return path.lower().endswith((".json", ".jsonl", ".ndjson"))


def _is_otlp(path: str, head: str) -> bool:
    return _json(path) and ("resourceSpans" in head or "resource_spans" in head)


def _is_transcript(path: str, head: str) -> bool:
    return path.lower().endswith(".jsonl") and '"sessionId"' in head and '"parentUuid"' in head


def _is_chat(path: str, head: str) -> bool:
    return _json(path) and ('"messages_json"' in head or '"messages"' in head and '"role"' in head)


ADAPTERS = [Adapter("otlp", _is_otlp, otlp.read), Adapter("transcript", _is_transcript, transcripts.read, "task"), Adapter("messages", _is_chat, chat.read)]


def register(adapter: Adapter) -> None:
    ADAPTERS.append(adapter)


def pick(spark: SparkSession, path: str, name: str | None = None) -> Adapter:
    """The adapter of that name, or the first that knows the head of the first file."""
    for a in ADAPTERS:
        if a.name == name:
            return a
    if name:
        raise ValueError(f"unknown adapter {name!r}; there are {', '.join(a.name for a in ADAPTERS)}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").orderBy("path").limit(1).collect()
    if files:
        first = files[0]["path"]
        head = "".join(r["h"] for r in spark.read.text(first).select(F.substring("value", 1, HEAD).alias("h")).limit(20).collect())
        for a in ADAPTERS:
            if a.detect(first, head):
                return a
    raise ValueError(f"no adapter knows the format of {path}")


def write_log(log: DataFrame, path: str) -> int:
    """Writes an event log as Parquet; returns the number of events."""
    log.select(*COLUMNS).write.mode("overwrite").parquet(path)
    return read_log(log.sparkSession, path).count()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).parquet(path)
