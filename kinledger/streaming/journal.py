"""Balances that follow the journal as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ledger.model import TRANSACTIONS


def read_journal(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """Transactions appended as Parquet files to a folder."""
    reader = spark.readStream.schema(TRANSACTIONS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def entries(transactions: DataFrame) -> DataFrame:
    """Each transaction as one or two entries (asset, owner, change): what leaves and what arrives."""
    left = F.when(F.col("sender").isNotNull(), F.struct(F.col("sender").alias("owner"), (-F.col("burned_amount")).alias("change")))
    came = F.when(F.col("receiver").isNotNull(), F.struct(F.col("receiver").alias("owner"), F.col("minted_amount").alias("change")))
    return transactions.select("id", "created_at", "asset", F.explode(F.array_compact(F.array(left, came))).alias("e")).select("id", "created_at", "asset", "e.owner", "e.change")


def _once(transactions: DataFrame, late: str) -> DataFrame:
    """Each transaction once, if it is delivered again within the watermark."""
    return transactions.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])


def running_balances(transactions: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """(asset, owner, balance) as of what has arrived; a transaction that is delivered twice within
    the watermark counts once. Write it in update or complete mode. A balance has no end, so the
    state keeps a row for each asset and owner that ever had an entry, and no more."""
    return entries(_once(transactions, late)).groupBy("asset", "owner").agg(F.sum("change").alias("balance"))


def hourly_volume(transactions: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """(hour, asset, n, minted): tumbling windows, each final once the watermark has passed it. A
    transaction that is delivered twice within the watermark counts once."""
    sums = _once(transactions, late).groupBy(F.window("created_at", "1 hour").alias("w"), "asset").agg(F.count("*").alias("n"), F.sum("minted_amount").alias("minted"))
    return sums.select(F.col("w.start").alias("hour"), "asset", "n", "minted")
