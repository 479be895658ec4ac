"""Prices of models, and what an event costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cache reads and writes (kept five minutes, an hour) as multiples of the input price.
CACHE_READ, CACHE_WRITE_5M, CACHE_WRITE_1H = 0.1, 1.25, 2.0


def price_table(spark: SparkSession, models: dict[str, tuple[float, float]]) -> DataFrame:
    """``ord, name, input, output`` in dollars per million tokens, in the order of ``models``."""
    rows = [(k, name, float(i), float(o)) for k, (name, (i, o)) in enumerate(models.items())]
    return spark.createDataFrame(rows, "ord int, name string, input double, output double")


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    import yaml

    with open(path) as f:
        models = (yaml.safe_load(f) or {}).get("models") or {}
    return price_table(spark, {k: (v["input"], v["output"]) for k, v in models.items()})


def match_models(models: DataFrame, prices: DataFrame) -> DataFrame:
    """``model, price_name, input, output``: the price of the name itself, else the first that is a prefix of it.

    ``models`` has distinct names; the price table is a configuration file, so the
    product of both is small.
    """
    fits = models.join(F.broadcast(prices), F.startswith("model", "name"), "left")
    rank = F.struct(F.when(F.col("name") == F.col("model"), 0).otherwise(1), F.col("ord"))
    return fits.groupBy("model").agg(F.min_by(F.struct("name", "input", "output"), rank).alias("p")).select("model", F.col("p.name").alias("price_name"), "p.input", "p.output")


def with_prices(events: DataFrame, model: str, prices: DataFrame) -> DataFrame:
    """Adds ``input`` and ``output`` prices, null for an unknown model."""
    found = match_models(events.select(F.col(model).alias("model")).filter("model IS NOT NULL").distinct(), prices).drop("price_name").withColumnRenamed("model", "_priced")
    return events.join(found, F.col(model) == F.col("_priced"), "left").drop("_priced")


def cost(tin: str, tout: str, cached: str, w5: str, w1: str) -> Column:
    """Dollars for the tokens of an event, 0 without a price."""
    paid = (F.col(tin) + F.col(cached) * CACHE_READ + F.col(w5) * CACHE_WRITE_5M + F.col(w1) * CACHE_WRITE_1H) * F.col("input") + F.col(tout) * F.col("output")
    return F.coalesce(paid / 1e6, F.lit(0.0))


def unknown_models(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Models that used tokens and have no price."""
    used = events.filter("tokens_in + tokens_cached + tokens_cache_write + tokens_out > 0 AND resource IS NOT NULL").select(F.col("resource").alias("model")).distinct()
    return match_models(used, prices).filter("price_name IS NULL").select("model")
