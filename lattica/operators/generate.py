"""Generated arrays and write workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def signal(spark: SparkSession, n: int, amplitude: float = 15.0, frequency: float = 0.2) -> DataFrame:
    """(pos, val) of ``n`` items of a sine."""
    return spark.range(n).select(F.col("id").alias("pos"), (amplitude * F.sin(frequency * F.col("id"))).alias("val"))


def appends(spark: SparkSession, times: int, items: int) -> DataFrame:
    """(txn, pos, val): ``times`` transactions, each of which appends ``items`` items."""
    return spark.range(times * items).select(F.expr(f"id div {items}").alias("txn"), F.col("id").alias("pos"), F.col("id").alias("val"))


def random_writes(spark: SparkSession, times: int, size: int, items: int, seed: int = 10) -> DataFrame:
    """(txn, pos, val): ``times`` transactions, each of which writes ``items`` items in a row from a
    random place of an array of ``size`` on."""
    start = F.pmod(F.xxhash64(F.lit(seed), F.expr(f"id div {items}")), F.lit(max(1, size - items + 1)))
    return spark.range(times * items).select(F.expr(f"id div {items}").alias("txn"), (start + F.col("id") % items).alias("pos"), F.col("id").alias("val"))
