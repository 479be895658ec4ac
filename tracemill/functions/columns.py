"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

START, END = "START", "END"


def in_case():
    """The order of the events of a case; ties by event id."""
    return Window.partitionBy("case_id").orderBy("ts_start", "event_id")


def present(c: Column) -> Column:
    """A string that is neither null nor empty, else null."""
    return F.nullif(c, F.lit(""))


def money(c: Column) -> Column:
    """Exact sum of amounts, independent of the order of the rows."""
    return F.coalesce(F.sum(c.cast("decimal(28,9)")), F.lit(0)).cast("double")


def duration() -> Column:
    """Seconds that an event took; 0 where the end is missing or 0."""
    return F.when(F.coalesce("ts_end", F.lit(0.0)) != 0, F.col("ts_end") - F.col("ts_start")).otherwise(F.lit(0.0))


def cost() -> Column:
    return F.coalesce("cost_usd", F.lit(0.0))


def _tokens(*names: str) -> Column:
    out = F.lit(0).cast("long")
    for n in names:
        out = out + F.coalesce(F.col(n), F.lit(0))
    return out


def event_tokens() -> Column:
    """Tokens of an event; cache writes do not count."""
    return _tokens("tokens_in", "tokens_cached", "tokens_out")


def prompt_size() -> Column:
    return _tokens("tokens_in", "tokens_cached", "tokens_cache_write")


def is_error() -> Column:
    return (F.coalesce("status", F.lit("")) != "ok").cast("long")


def path_text(seq: Column) -> Column:
    return F.array_join(seq, ">")


def path_digest(seq: Column, steps: int = 12) -> Column:
    """The first steps of a path, and how many more there are."""
    more = F.size(seq) - steps
    return F.concat(F.array_join(F.slice(seq, 1, steps), " → "), F.when(more > 0, F.concat(F.lit(" …+"), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))


# What a label loses, in this order. Classes are Unicode-aware.
_ARGUMENTS = (r"(?U)\s*\([^()]*\)", r"(?U)\s*\[[^\[\]]*\]")
_ATTEMPT = r"(?Ui)[-_](attempt|try|retry|n)[-_]?\d+$"
_PATH = r"(?U)[\s:=]+[~./]?[\w.-]*/[\w./-]*"
_ID_TAIL = r"(?U)[-_/]\d[\w.]*$"
# Prefixes after which a label names a model.
MODEL_PREFIXES = ("chat", "completion", "embedding", "text_completion")


def canonical(label: Column) -> Column:
    """A label without what depends on the arguments of the call."""
    s = label
    for _ in range(3):
        for pattern in _ARGUMENTS:
            s = F.regexp_replace(s, pattern, "")
    for pattern in (_ATTEMPT, _PATH, _ID_TAIL):
        s = F.regexp_replace(s, pattern, "")
    s = F.btrim(F.regexp_replace(s, r"(?U)\s+", " "), F.lit(" :/-_"))
    prefix = F.substring_index(s, ":", 1)
    rest = F.substring(s, F.length(prefix) + 2, F.length(s))
    parted = F.when(prefix.isin(*MODEL_PREFIXES) | (rest == ""), prefix).otherwise(s)
    return F.when(F.contains(s, F.lit(":")), parted).otherwise(F.coalesce(present(s), F.lit("unknown")))
