"""Cutting amounts into fragments, and choosing fragments first in, first out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model import ALIVE, MOST_FRAGMENTS


def fragment_sizes(amount: Column, unit: Column, most: Column | int = MOST_FRAGMENTS) -> Column:
    """Array of amounts: chunks of ``unit``, larger if more than ``most`` chunks would be needed, and the rest."""
    most = F.lit(most) if isinstance(most, int) else most
    chunk = F.greatest(unit, F.ceil(amount / most).cast("long"))
    n = F.ceil(amount / chunk).cast("long")
    sizes = F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: F.least(chunk, amount - (i - 1) * chunk))
    return F.when(amount > 0, sizes).otherwise(F.array().cast("array<bigint>"))


def fragments(df: DataFrame, most: Column | int = MOST_FRAGMENTS) -> DataFrame:
    """Rows of ``df`` (amount, unit, ...) once for each fragment: position and fragment replace amount."""
    others = [c for c in df.columns if c not in ("amount", "unit")]
    return df.select(*others, F.posexplode(fragment_sizes(F.col("amount"), F.col("unit"), most)).alias("position", "fragment"))


def fifo_select(objects: DataFrame, locks: DataFrame, state: str = ALIVE) -> DataFrame:
    """The fragments that cover each lock (asset, owner, required), oldest first, ties by id.

    A fragment is taken if what is before it (``before``) doesn't reach the requirement. An
    owner may hold any number of fragments, so they are summed by hour first: the running sum over
    an owner's hours says in which the requirement runs out, later hours are dropped unsorted,
    and rows are ordered within one owner's hour only.
    """
    wanted = locks.select("asset", "owner", "required")
    held = objects.where(F.col("state") == state).join(wanted, ["asset", "owner"]).withColumn("__hour", F.date_trunc("hour", "created_at"))
    hours = held.groupBy("asset", "owner", "__hour").agg(F.sum("amount").alias("__sum"), F.first("required").alias("__required"))
    over = Window.partitionBy("asset", "owner").orderBy("__hour").rowsBetween(Window.unboundedPreceding, 0)
    hours = hours.withColumn("__before", F.sum("__sum").over(over) - F.col("__sum")).where("__before < __required")
    hours = hours.select(*(F.col(c).alias(f"__of_{c}") for c in ("asset", "owner", "__hour")), "__before")
    same = (F.col("asset") == F.col("__of_asset")) & (F.col("owner") == F.col("__of_owner")) & F.col("__hour").eqNullSafe(F.col("__of___hour"))
    running = Window.partitionBy("asset", "owner", "__hour").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    found = held.join(hours, same).withColumn("before", F.col("__before") + F.sum("amount").over(running) - F.col("amount"))
    return found.where("before < required").drop("__hour", "__before", "__of_asset", "__of_owner", "__of___hour")


def shortfalls(objects: DataFrame, locks: DataFrame, state: str = ALIVE) -> DataFrame:
    """(asset, owner, required, available) of each lock that can't be covered."""
    sums = objects.where(F.col("state") == state).groupBy("asset", "owner").agg(F.sum("amount").alias("available"))
    joined = locks.join(sums, ["asset", "owner"], "left").withColumn("available", F.coalesce("available", F.lit(0).cast("long")))
    return joined.where("available < required").select("asset", "owner", "required", "available")
