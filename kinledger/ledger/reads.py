"""Balances, holdings, portfolios and the journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..compat import DEFAULT, Compat
from .model import ALIVE, RESERVED, idempotency_hash, to_display


def _sum_of(state: str, name: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("state") == state, F.col("amount"))), F.lit(0)).cast("long").alias(name)


def balances(objects: DataFrame) -> DataFrame:
    """(asset, owner, available, reserved, total) of each owner and asset, in one pass of partial sums."""
    sums = objects.groupBy("asset", "owner").agg(_sum_of(ALIVE, "available"), _sum_of(RESERVED, "reserved"))
    return sums.withColumn("total", F.col("available") + F.col("reserved"))


def balance(objects: DataFrame, asset: object, owner: object) -> DataFrame:
    """One row, zeros for an owner without any."""
    mine = objects.where((F.col("asset") == F.lit(asset)) & (F.col("owner") == F.lit(owner)))
    return mine.agg(_sum_of(ALIVE, "available"), _sum_of(RESERVED, "reserved")).withColumn("total", F.col("available") + F.col("reserved"))


def holdings(objects: DataFrame, assets: DataFrame, owner: object | None = None, compat: Compat = DEFAULT) -> DataFrame:
    """(owner, asset, code, decimals, available, reserved, total, quantity) of what isn't empty."""
    mine = objects if owner is None else objects.where(F.col("owner") == F.lit(owner))
    sums = mine.groupBy("owner", "asset").agg(_sum_of(ALIVE, "available"), _sum_of(RESERVED, "reserved"), F.sum("amount").alias("ever"))
    sums = sums.withColumn("total", F.col("available") + F.col("reserved")).where("ever > 0" if compat.legacy_holdings else "total > 0").drop("ever")
    named = sums.join(assets.select(F.col("id").alias("asset"), "code", "decimals"), "asset")
    return named.select("owner", "asset", "code", "decimals", "available", "reserved", "total", to_display(F.col("total"), F.col("decimals")).alias("quantity"))


def valued(held: DataFrame, rates: DataFrame) -> DataFrame:
    """Holdings with rate and value; an asset without a rate (code, rate) is worth 0."""
    rate = F.coalesce("rate", F.lit(0.0))
    return held.join(rates.select("code", "rate"), "code", "left").withColumn("rate", rate).withColumn("value", F.col("quantity") * F.col("rate"))


def portfolio_value(held: DataFrame, rates: DataFrame) -> DataFrame:
    """(owner, value)."""
    return valued(held, rates).groupBy("owner").agg(F.sum("value").alias("value"))


def sorted_holdings(held: DataFrame, by: str = "quantity", *, largest: bool = True) -> DataFrame:
    """Holdings in order of quantity or value, ties by code and owner."""
    return held.orderBy(F.col(by).desc() if largest else F.col(by).asc(), "code", "owner")


def holding(held: DataFrame, code: str) -> DataFrame:
    """The holding of one asset, by its code."""
    return held.where(F.col("code") == F.lit(code))


def journal(transactions: DataFrame, assets: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Transactions with the asset's code and, if there is one, the idempotency key's hash."""
    out = transactions.join(assets.select(F.col("id").alias("asset"), "code"), "asset", "left")
    if keys is not None:
        out = out.join(keys.select(F.col("transaction_id").alias("id"), F.col("key").alias("idempotency_key")), "id", "left")
    return out


def transaction(transactions: DataFrame, assets: DataFrame, id_: object, keys: DataFrame | None = None) -> DataFrame:
    return journal(transactions.where(F.col("id") == F.lit(id_)), assets, keys)


def of_owner(transactions: DataFrame, owner: object, since: object, until: object) -> DataFrame:
    """What the owner sent or received, both ends of the span included."""
    mine = (F.col("sender") == F.lit(owner)) | (F.col("receiver") == F.lit(owner))
    return transactions.where(mine & F.col("created_at").between(F.lit(since), F.lit(until)))


def of_asset(transactions: DataFrame, asset: object, since: object, until: object) -> DataFrame:
    return transactions.where((F.col("asset") == F.lit(asset)) & F.col("created_at").between(F.lit(since), F.lit(until)))


def by_idempotency_key(transactions: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The transaction that an idempotency key stands for, if it was used."""
    used = keys.where(F.col("key") == idempotency_hash(F.lit(key))).select(F.col("transaction_id").alias("id"))
    return transactions.join(used, "id", "left_semi")
