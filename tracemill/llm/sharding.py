"""Sharding by sampled splitters, with Spark expressions only.

Records are ordered by a hash of their text, so equal texts are neighbours. A
sample of keys is drawn, each with a chance in proportion to its size; quantiles
of the sample split the key space into ranges. The ranges are then measured over
all records, and an overfull one is subdivided: by the text, or, where one text alone has
more than twice a range's share (fewer than ``ranges`` texts can), that text by a hash of the
id, and a row that alone is repeated so often by a number that each repetition gets. Prefix sums over the ranges, and within each range, give every
record its place in bytes and in rows, from which the shard and the slot follow.

The law is ``bytes``: a shard ends where its share of all bytes does. Equal texts stay together
if all of them have no more than ``whole`` of a shard's share: their middle decides for all, so that
a shard's size is off by no more than that part; the records of a larger group, and of a
text without copies, are placed by their own middle. No task holds more than a piece of a range, and
only the splitters (``ranges - 1`` numbers) come to the driver. What is broadcast has a
row for each range, hot text, hot row, piece or shard: at most ``ranges`` of the first three, six times as many pieces, and ``shards``.

Defined results: a null text has no bytes and the checksum 0 of an empty text; a null id
is hashed as such; repeated rows are interchangeable and get a place each; an
empty table gives no rows; other columns are ignored. A record that is larger
than a shard's share takes one shard, and the shards whose share it spans are short or empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes that a record takes besides its text.
OVERHEAD = 16
#: Expected number of sampled keys for each range.
SAMPLES_PER_RANGE = 32


def _range_of(key: Column, splitters: list[int]) -> Column:
    """The number of splitters at or below the key, by binary search."""
    if not splitters:
        return F.lit(0)
    n = 1 << (len(splitters)).bit_length()
    padded = F.array(*[F.lit(x) for x in splitters]).cast("array<bigint>")
    steps = F.array(*[F.lit(n >> k) for k in range(1, n.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, s: at + F.when(F.coalesce(F.get(padded, at + s - 1) <= key, F.lit(False)), s).otherwise(0))


def shard(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", ranges: int = 512, seed: int = 23, whole: float = 0.1) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot`` for every row of ``docs``."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(body).alias("key"),
        F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(seed)).alias("sub"),
        F.monotonically_increasing_id().alias("number"),
    )
    rows = common.staged(rows, "shard")

    total = rows.agg(F.sum("size").alias("s")).first()["s"] or 0
    # Chance of a key: its size over the bytes that one sample stands for, at most 1.
    each = max(1.0, total / (SAMPLES_PER_RANGE * ranges))
    u = (F.col("sub").bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / float(1 << 52)
    sample = rows.filter(u * each < F.col("size"))
    quantiles = [k / ranges for k in range(1, ranges)]
    found = sample.agg(F.percentile_approx("key", quantiles, 100 * ranges).alias("q")).first()["q"]
    splitters = sorted(set(found or []))

    placed = rows.withColumn("range", _range_of(F.col("key"), splitters).cast("int"))
    # A hot text is a range of its own after the one it is in; other overfull ranges are subdivided by the text.
    share = F.lit(2.0 * max(1.0, total / ranges))
    hot = placed.groupBy("key").agg(F.sum("size").alias("key_size")).filter(F.col("key_size") > share).select("key", F.ceil(F.col("key_size") / share).cast("int").alias("hot_pieces"))
    placed = placed.join(F.broadcast(hot), "key", "left").withColumn("hot", F.col("hot_pieces").isNotNull())
    full = placed.filter("NOT hot").groupBy("range").agg(F.sum("size").alias("range_size"))
    pieces = F.greatest(F.ceil(F.col("range_size") / share), F.lit(1)).cast("int")
    placed = placed.join(F.broadcast(full.select("range", pieces.alias("pieces"))), "range", "left")
    by_text, by_id = F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int"), F.pmod("sub", F.col("hot_pieces")).cast("int")
    placed = placed.withColumns({"hot_key": F.when(F.col("hot"), F.col("key")), "piece": F.when(F.col("hot"), by_id).otherwise(by_text)})
    # Repetitions of one row are interchangeable, so any number may deal them.
    again = placed.filter("hot").groupBy("key", "sub").agg(F.sum("size").alias("row_size")).filter(F.col("row_size") > share)
    placed = placed.join(F.broadcast(again.select("key", "sub", F.ceil(F.col("row_size") / share).cast("int").alias("parts"))), ["key", "sub"], "left")
    part = F.pmod(F.xxhash64("number"), F.col("parts")).cast("int")
    placed = placed.withColumns({"hot_row": F.when(F.col("parts").isNotNull(), F.col("sub")), "part": part})

    at = ["range", "hot", "hot_key", "piece", "hot_row", "part"]
    piece = placed.groupBy(*at).agg(F.sum("size").alias("piece_size"), F.count("*").alias("piece_rows"))
    ahead = Window.orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    piece = piece.select(
        F.struct(*at).alias("_at"),
        F.coalesce(F.sum("piece_size").over(ahead), F.lit(0)).alias("bytes_ahead"),
        F.coalesce(F.sum("piece_rows").over(ahead), F.lit(0)).alias("rows_ahead"),
    )
    within = Window.partitionBy(*at).orderBy("key", "sub", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*at).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumns({"_bytes": F.coalesce(F.sum("size").over(within), F.lit(0)), "_rows": F.count("*").over(within), "_upto": F.sum("size").over(upto)})
    placed = placed.withColumn("_group", F.sum("size").over(Window.partitionBy(*at, "key"))).withColumn("_at", F.struct(*at))
    placed = placed.alias("p").join(F.broadcast(piece.alias("q")), F.col("p._at").eqNullSafe(F.col("q._at"))).select("p.*", "bytes_ahead", "rows_ahead")
    # The middle of a group of equal texts, or of a record, decides, so that one across a border goes to the nearer shard.
    alike = ~F.col("hot") & (F.col("_group") <= F.lit(whole * total / shards))
    middle = 2 * F.col("bytes_ahead") + F.when(alike, 2 * F.col("_upto") - F.col("_group")).otherwise(2 * F.col("_bytes") + F.col("size"))
    placed = placed.withColumn("shard", F.least(F.floor(middle * shards / F.lit(2.0 * max(1, total))), F.lit(shards - 1)).cast("int"))
    placed = placed.withColumn("place", F.col("rows_ahead") + F.col("_rows"))
    first = placed.groupBy("shard").agg(F.min("place").alias("first_place"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first_place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
