"""Running a plan on the ledger's tables: the tables afterwards.

Fragments that cover the plan's locks are burned, what they hold beyond it comes back as
change in at most as many fragments as were burned, and each receiver gets new ones. All of
a plan's effects are in one set of DataFrames, published together (``sources.store``), so a
reader sees all or nothing, and a writer that started from an older version is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.metrics import Metrics
from .fragments import fifo_select, fragment_sizes, shortfalls
from .model import ALIVE, ASSETS, BURNED, IDEMPOTENCY, MOST_FRAGMENTS, RESERVED, TRANSACTIONS, VALUE_OBJECTS, Asset, AssetNotFound, DuplicateIdempotencyKey, InsufficientFunds, idempotency_hash
from .plan import Operation, Plan
from .reads import balance


@dataclass(frozen=True)
class Ledger:
    assets: DataFrame
    objects: DataFrame
    transactions: DataFrame
    keys: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Ledger:
        return cls(*(spark.createDataFrame([], ddl) for ddl in (ASSETS, VALUE_OBJECTS, TRANSACTIONS, IDEMPOTENCY)))

    @property
    def spark(self) -> SparkSession:
        return self.assets.sparkSession

    def tables(self) -> dict[str, DataFrame]:
        return {"assets": self.assets, "objects": self.objects, "transactions": self.transactions, "keys": self.keys}

    def create_asset(self, code: str, unit: int, decimals: int = 0) -> Ledger:
        """Add an asset, or change unit and decimals of the one with this code; its id stays."""
        if self.assets.where(F.col("code") == code).isEmpty():
            new = self.spark.createDataFrame([(str(uuid.uuid4()), code, unit, decimals)], ASSETS)
            return Ledger(self.assets.unionByName(new), self.objects, self.transactions, self.keys)
        mine = F.col("code") == code
        set_ = {"unit": F.lit(unit).cast("long"), "decimals": F.lit(decimals)}
        assets = self.assets.select(*((F.when(mine, set_[c]).otherwise(F.col(c)) if c in set_ else F.col(c)).alias(c) for c in self.assets.columns))
        return Ledger(assets, self.objects, self.transactions, self.keys)

    def asset(self, code: str) -> Asset:
        row = self.assets.where(F.col("code") == code).first()
        if row is None:
            raise AssetNotFound(code)
        return Asset(row["id"], row["code"], row["unit"], row["decimals"])

    def plan(self) -> Plan:
        def told(name: str):
            return lambda asset, owner: balance(self.objects, asset, owner).first()[name]

        return Plan(told("available"), told("reserved"))

    def atomic(self, make: Callable[[Plan], None], now: datetime | None = None, metrics: Metrics | None = None) -> Ledger:
        """Make a plan, check it, and run it; an error leaves this ledger as it is. Metrics, if given,
        get each operation's amount (histogram) and one more success (counter)."""
        plan = self.plan()
        make(plan)
        plan.validate()
        after = run(self, plan, now)
        if metrics is not None:
            for op in plan.operations:
                metrics.record("ledger.amount", op.amount)
            metrics.count("ledger.success")
        return after


def _settled(plan: Plan) -> dict[tuple[str, str], int]:
    out: dict[tuple[str, str], int] = {}
    for op in plan.operations:
        if op.kind == "settle":
            out[op.asset, op.owner] = out.get((op.asset, op.owner), 0) + op.amount
    return out


def _spent(ledger: Ledger, needs: dict[tuple[str, str], int], state: str) -> tuple[DataFrame, DataFrame]:
    """The fragments that cover ``needs``, and the change: asset, owner, amount, most (fragments)."""
    locks = ledger.spark.createDataFrame([(*k, v) for k, v in needs.items()], "asset string, owner string, required long")
    if short := shortfalls(ledger.objects, locks, state).first():
        raise InsufficientFunds(f"{short['owner']}: {short['available']} of {short['required']}")
    taken = fifo_select(ledger.objects, locks, state)
    change = taken.groupBy("asset", "owner").agg((F.sum("amount") - F.first("required")).alias("amount"), F.count("*").alias("most"))
    return taken.select("id"), change.where("amount > 0")


def run(ledger: Ledger, plan: Plan, now: datetime | None = None) -> Ledger:
    """The ledger after the plan. The plan is small; fragments stay distributed."""
    spark, now = ledger.spark, now or datetime.now(UTC).replace(tzinfo=None)
    keyed = [op for op in plan.operations if op.key is not None]
    hashes = spark.createDataFrame([(op.key,) for op in keyed], "key string").select(idempotency_hash(F.col("key")).alias("key"))
    if len({op.key for op in keyed}) < len(keyed) or keyed and not ledger.keys.join(hashes, "key", "left_semi").isEmpty():
        raise DuplicateIdempotencyKey(", ".join(sorted({op.key for op in keyed})))

    receipts = [(f"{i}", op.asset, op.to, op.amount, RESERVED if op.kind == "reserve" else ALIVE, op.to if op.kind == "reserve" else None, MOST_FRAGMENTS) for i, op in enumerate(plan.operations) if op.to is not None]
    made = spark.createDataFrame(receipts, "why string, asset string, owner string, amount long, state string, reserved_for string, most long")
    gone = []
    for needs, state in ((plan.locks(), ALIVE), (_settled(plan), RESERVED)):
        if needs:
            taken, change = _spent(ledger, needs, state)
            gone.append(taken)
            kept_for = F.col("owner") if state == RESERVED else F.lit(None).cast("string")
            made = made.unionByName(change.select(F.lit(f"change {state}").alias("why"), "asset", "owner", "amount", F.lit(state).alias("state"), kept_for.alias("reserved_for"), "most"))
    objects = ledger.objects
    if gone:
        spent = (gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])).select(F.col("id").alias("__spent"))
        state = F.when(F.col("__spent").isNotNull(), BURNED).otherwise(F.col("state"))
        objects = objects.join(spent, F.col("id") == F.col("__spent"), "left").withColumn("state", state).select(*ledger.objects.columns)
    cut = made.join(ledger.assets.select(F.col("id").alias("asset"), "unit"), "asset")
    cut = cut.select("why", "asset", "owner", "state", "reserved_for", F.posexplode(fragment_sizes(F.col("amount"), F.col("unit"), F.col("most"))).alias("place", "amount"))
    # ids follow from the run and the fragment's place in it: a task that runs again makes the same
    name = F.sha2(F.concat_ws(":", F.lit(uuid.uuid4().hex), "why", "asset", "owner", F.col("place").cast("string")), 256)
    fresh = cut.select(name.alias("id"), "asset", "owner", "amount", "state", "reserved_for", F.lit(now).alias("created_at"))
    entries = [(str(uuid.uuid4()), op) for op in plan.operations]
    written = spark.createDataFrame([_entry(id_, op, now) for id_, op in entries], TRANSACTIONS)
    used = spark.createDataFrame([(op.key, id_, now) for id_, op in entries if op.key is not None], IDEMPOTENCY).withColumn("key", idempotency_hash(F.col("key")))
    return Ledger(ledger.assets, objects.unionByName(fresh), ledger.transactions.unionByName(written), ledger.keys.unionByName(used))


def _entry(id_: str, op: Operation, now: datetime) -> tuple:
    burned = op.amount if op.kind != "mint" else 0
    minted = op.amount if op.kind != "burn" else 0
    return (id_, op.asset, op.owner, op.to, burned, minted, op.metadata, now)
