"""Reading JSON documents: one object, an array, or one object per line; and values as JSON text.

Attributes of spans are maps from names to JSON text, so that a count, a text and a
flag stay apart: ``12``, ``"12"`` and ``false``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Files of lines, and files that are read whole.
LINES, WHOLE = "*.{[jJ][sS][oO][nN][lL],[nN][dD][jJ][sS][oO][nN]}", "*.[jJ][sS][oO][nN]"


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``file, block, nr, doc``: every object below ``path``, in the order of ``block, nr``; what cannot be read is left out.

    Each file goes by its own suffix: files of lines are split among tasks, a ``.json`` file is read whole.
    """
    text = lambda pattern, **how: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, **how)
    file = F.col("_metadata.file_path").alias("file")
    lines = text(LINES).select(file, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nr"), "value")
    whole = text(WHOLE, wholetext=True).select(file, F.lit(0).cast("long").alias("block"), F.trim("value").alias("value"))
    many = F.when(
        F.startswith("value", F.lit("[")), F.from_json("value", f"array<{schema}>")
    ).otherwise(F.when(F.col("value").rlike(r"\}\s*\n\s*\{"), F.transform(F.split("value", "\n"), lambda x: _parsed(x, schema))).otherwise(F.array(_parsed(F.col("value"), schema))))
    docs = whole.select("file", "block", F.posexplode(many).alias("nr", "doc")).withColumn("nr", F.col("nr").cast("long"))
    return parsed_lines(lines, schema).unionByName(docs.filter("doc IS NOT NULL"))


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """``doc`` instead of ``value``, for every line that holds an object, or each of an array of them."""
    value = F.trim("value")
    many = F.when(F.startswith(value, F.lit("[")), F.from_json(value, f"array<{schema}>")).otherwise(F.array(_parsed(value, schema)))
    rest = [c for c in lines.columns if c != "value"]
    return lines.filter(value != "").select(*rest, F.explode(many).alias("doc")).filter("doc IS NOT NULL")


def _parsed(text: Column, schema: str) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema))


def numbered(docs: DataFrame) -> DataFrame:
    """``file, block, nr, i``: the number of each object in its file, however the file is split.

    Objects are counted within their block; the blocks of a file before it add a prefix sum.
    """
    rows = docs.select("file", "block", "nr")
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("nr")) - 1
    return rows.withColumn("own", own).join(blocks, ["file", "block"]).select("file", "block", "nr", (F.col("before") + F.col("own")).alias("i"))


def encoded(value: Column) -> Column:
    """A value as JSON text."""
    one = F.to_json(F.array(value))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def plain(value: Column) -> Column:
    """The text of a JSON value, without the quotes of a string; null for a JSON null."""
    return F.when(value != "null", F.get_json_object(value, "$"))


def text_of(value: Column) -> Column:
    """The same for a value that is no JSON null."""
    return F.get_json_object(value, "$")


def object_text(entries: Column) -> Column:
    """A JSON object of ``struct<key, value>``, the values already JSON text."""
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(encoded(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def attrs(**pairs: Column) -> Column:
    """A map of the pairs that have a value, as JSON text; a name's ``__`` stands for a dot."""
    entries = F.array(*[F.struct(F.lit(k.replace("__", ".")).alias("key"), F.when(v.isNotNull(), encoded(v)).alias("value")) for k, v in pairs.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def seconds(iso: Column) -> Column:
    """Epoch seconds of an ISO-8601 time, null if it is none."""
    return F.unix_micros(F.try_to_timestamp(iso)) / F.lit(1e6)
