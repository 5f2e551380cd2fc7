"""Reads of objects and edges, as one DataFrame plan each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..compat import DEFAULT, Compat
from ..functions.predicates import Filter, combined
from ..model import SYSTEM_OWNER, EdgeType, ObjectType
from ..plans.metrics import Metrics
from ..plans.query import EdgeQuery, Query, listed
from ..sources.catalog import Catalog
from .traverse import ManyPivots, Pivot
from .unions import union_of

class Engine:
    """What can be asked of a catalog. Results are lazy; counts are one-row DataFrames (``n``)."""

    def __init__(self, catalog: Catalog, compat: Compat = DEFAULT, metrics: Metrics | None = None) -> None:
        self.catalog, self.compat, self.metrics = catalog, compat, metrics

    def _told(self, name: str, df: DataFrame) -> DataFrame:
        return df if self.metrics is None else self.metrics.observed(name, df)

    # objects

    def among(self, df: DataFrame, column: str, keys: Sequence) -> DataFrame:
        """Rows whose ``column`` is one of ``keys``: a pushed-down list if short, else a semi join."""
        return listed(df, column, keys)[1]

    def fetch_object(self, kind: ObjectType, id_: object) -> DataFrame:
        return self.catalog[kind].where(F.col("id") == F.lit(id_))

    def fetch_objects(self, kind: ObjectType, ids: Sequence) -> DataFrame:
        return self.among(self.catalog[kind], "id", ids)

    def fetch_owned_objects(self, kind: ObjectType, owner: object) -> DataFrame:
        return self.catalog[kind].where(F.col("owner") == F.lit(owner))

    def fetch_owned_object(self, kind: ObjectType, owner: object) -> DataFrame:
        """One of the owner's objects: the one of the least id."""
        return self.fetch_owned_objects(kind, owner).orderBy("id").limit(1)

    def fetch_owned_objects_batch(self, kind: ObjectType, owners: Sequence) -> DataFrame:
        return self.among(self.catalog[kind], "owner", owners)

    def find_object(self, kind: ObjectType, filters: Sequence[Filter], owner: object = SYSTEM_OWNER) -> DataFrame:
        """The newest object (greatest id) of the owner that passes all filters."""
        return Query(owner=owner, filters=tuple(filters), limit=1).apply(self.catalog[kind], kind, self.compat)

    def query_objects(self, kind: ObjectType, query: Query) -> DataFrame:
        return self._told("query", query.apply(self.catalog[kind], kind, self.compat))

    def count_objects(self, kind: ObjectType, query: Query | None = None) -> DataFrame:
        return (query or Query.wide()).count(self.catalog[kind], kind, self.compat)

    # edges

    def fetch_edge(self, kind: EdgeType, src: object, dst: object) -> DataFrame:
        return self.catalog[kind].where((F.col("src") == F.lit(src)) & (F.col("dst") == F.lit(dst)))

    def query_edges(self, kind: EdgeType, src: object, query: EdgeQuery = EdgeQuery()) -> DataFrame:
        return self._told("query_edges", query.apply(self.catalog[kind], kind, "src", "dst", src, self.compat))

    def query_reverse_edges(self, kind: EdgeType, dst: object, query: EdgeQuery = EdgeQuery()) -> DataFrame:
        return self._told("query_edges", query.apply(self.catalog[kind], kind, "dst", "src", dst, self.compat))

    def _count(self, kind: EdgeType, near: str, at: object, query: EdgeQuery) -> DataFrame:
        condition = combined([F.col(near) == F.lit(at)], query.filters, kind.indexed, self.compat)
        return self.catalog[kind].where(condition).agg(F.count("*").alias("n"))

    def count_edges(self, kind: EdgeType, src: object, query: EdgeQuery = EdgeQuery()) -> DataFrame:
        return self._count(kind, "src", src, query)

    def count_reverse_edges(self, kind: EdgeType, dst: object, query: EdgeQuery = EdgeQuery()) -> DataFrame:
        return self._count(kind, "dst", dst, query)

    # traversal

    def preload_object(self, kind: ObjectType, id_: object) -> Pivot:
        return Pivot(self, kind, id_)

    def preload_objects(self, kind: ObjectType, query: Query) -> ManyPivots:
        return ManyPivots(self, kind, query)

    # two types at once

    def _union(self, first: ObjectType, second: ObjectType) -> DataFrame:
        return union_of({k.name: self.catalog[k] for k in (first, second)})

    def fetch_union_object(self, first: ObjectType, second: ObjectType, id_: object) -> DataFrame:
        return self._union(first, second).where(F.col("id") == F.lit(id_))

    def fetch_union_objects(self, first: ObjectType, second: ObjectType, ids: Sequence) -> DataFrame:
        return self.among(self._union(first, second), "id", ids)

    def fetch_owned_union_objects(self, first: ObjectType, second: ObjectType, owner: object) -> DataFrame:
        return self._union(first, second).where(F.col("owner") == F.lit(owner))

    def fetch_owned_union_object(self, first: ObjectType, second: ObjectType, owner: object) -> DataFrame:
        return self.fetch_owned_union_objects(first, second, owner).orderBy("id", "type").limit(1)
