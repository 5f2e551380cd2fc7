"""Types bound to DataFrames: Parquet tables, views, in-memory rows or a database over JDBC."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EdgeType, ObjectType


class Catalog:
    """The DataFrame of each type. Binding selects a type's columns, so scans read no others."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._bound: dict[str, DataFrame] = {}
        self._deferred: dict[str, Callable[[], DataFrame]] = {}

    def bind(self, kind: ObjectType | EdgeType, df: DataFrame, columns: Mapping[str, object] | None = None) -> Catalog:
        """Bind ``df``; ``columns`` maps a type's names to columns or expressions of ``df``."""
        if columns is not None:
            df = df.select(*((F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()))
        self._bound[kind.name] = kind.conform(df)
        return self

    def defer(self, kind: ObjectType | EdgeType, make: Callable[[], DataFrame]) -> Catalog:
        """Bind what ``make`` gives, once it is asked for."""
        self._deferred[kind.name] = make
        return self

    def parquet(self, kind: ObjectType | EdgeType, path: str, columns: Mapping[str, object] | None = None) -> Catalog:
        return self.bind(kind, self.spark.read.parquet(path), columns)

    def rows(self, kind: ObjectType | EdgeType, rows: Iterable[tuple]) -> Catalog:
        return self.bind(kind, self.spark.createDataFrame(list(rows), kind.schema))

    def jdbc(self, kind: ObjectType | EdgeType, url: str, source: str, *, column: str | None = None, bounds: tuple[int, int, int] | None = None, **options: str) -> Catalog:
        """A table over JDBC; ``column`` and ``bounds`` (low, high, partitions) make the read parallel."""
        reader = self.spark.read.format("jdbc").option("url", url).option("dbtable", source).options(**options)
        if column and bounds:
            low, high, n = bounds
            reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
        return self.bind(kind, reader.load())

    def __getitem__(self, kind: ObjectType | EdgeType) -> DataFrame:
        if kind.name not in self._bound and kind.name in self._deferred:
            self.bind(kind, self._deferred[kind.name]())
        if kind.name not in self._bound:
            raise KeyError(f"{kind.name} isn't bound")
        return self._bound[kind.name]

    def everything(self, kinds: Iterable[ObjectType]) -> DataFrame:
        """Objects of several types in one DataFrame: type, id, owner, times and the rest as JSON."""
        parts = [self[k].select(F.lit(k.name).alias("type"), "id", "owner", "created_at", "updated_at", F.to_json(F.struct(*k.fields)).alias("data")) for k in kinds]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
