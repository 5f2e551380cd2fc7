"""Named counters, and numbers for all rows of a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from ..sources.store import Conflict, SnapshotStore


class Sequences:
    """Counters as a small table (name, value): 1 until first asked for the next, which is 2."""

    def __init__(self, values: dict[str, int] | None = None) -> None:
        self.values = dict(values or {})

    def value(self, name: str) -> int:
        return self.values.get(name, 1)

    def next_value(self, name: str) -> int:
        self.values[name] = self.value(name) + 1
        return self.values[name]

    def take(self, name: str, n: int) -> int:
        """Move the counter by ``n``; the first of the numbers taken."""
        first = self.value(name) + 1
        self.values[name] = self.value(name) + n
        return first


class StoredSequences:
    """Counters as the table ``sequences`` of a store. A change is a commit from the version that was
    read, so of two that ask at once one asks again: no number is given twice."""

    def __init__(self, store: SnapshotStore, attempts: int = 20) -> None:
        self.store, self.attempts = store, attempts

    def _read(self, version: int) -> dict[str, int]:
        table = self.store.read(version).get("sequences")
        return {r["name"]: r["value"] for r in table.collect()} if table is not None else {}

    def value(self, name: str) -> int:
        return self._read(self.store.version()).get(name, 1)

    def next_value(self, name: str) -> int:
        return self.take(name, 1)

    def take(self, name: str, n: int) -> int:
        """Move the counter by ``n``; the first of the numbers taken."""
        for _ in range(self.attempts):
            base = self.store.version()
            values = Sequences(self._read(base))
            first = values.take(name, n)
            try:
                self.store.commit(base, {"sequences": self.store.spark.createDataFrame(list(values.values.items()), "name string, value long")})
            except Conflict:
                continue
            return first
        raise Conflict(f"{name}: others were first {self.attempts} times")


#: Buckets of rows where ``numbered`` cuts a numeric or time order itself.
BUCKETS = 256


def _quantiles(df: DataFrame, name: str) -> Column | None:
    """The number of quantiles of a leading number or time that a row has reached; None for other types."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType)):
        return None
    value = F.col(name).cast("timestamp").cast("double") if not isinstance(kind, NumericType) else F.col(name).cast("double")
    bounds = df.select(value.alias("v")).approxQuantile("v", [i / BUCKETS for i in range(1, BUCKETS)], 1 / BUCKETS)
    if not bounds:
        return F.lit(0)
    # nulls come first in the order
    return F.when(value.isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b <= value)))


def numbered(df: DataFrame, order: Sequence[str], first: int = 1, buckets: Column | None = None, into: str = "number") -> DataFrame:
    """Consecutive numbers from ``first`` in ``order``, which must be a total order.

    Rows are numbered within ``buckets`` (a Column that never falls along the order, such as a
    date) and offset by the buckets before; only one row a bucket meets in one task. Without,
    buckets are quantiles of the leading column, if it is a number or a time; a text has
    none, and one task numbers all rows.
    """
    bucket = _quantiles(df, order[0]) if buckets is None else buckets
    bucket = F.lit(0) if bucket is None else bucket
    split = df.withColumn("__bucket", bucket)
    sizes = split.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__bucket")) - F.col("__n")
    offsets = sizes.select(F.col("__bucket").alias("__of"), before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    joined = split.withColumn("__place", place).join(offsets, F.col("__bucket").eqNullSafe(F.col("__of")))
    return joined.withColumn(into, (F.col("__place") + F.col("__before") + F.lit(first - 1)).cast("long")).drop("__bucket", "__place", "__of", "__before")
