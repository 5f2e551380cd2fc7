"""One-hop traversal from one object, or from all that a query finds.

Every terminal is one plan: pivots, edges and the objects at the far end are equi-joined,
with filters of each side below the join. Flat results have a row for each pair; ``nested``
groups them under their pivot.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Self

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import COMPARISONS, Filter, Sort, combined, eq, ordering
from ..model import EdgeType, ObjectType
from ..plans.query import EdgeQuery, Filterable, Query

if TYPE_CHECKING:
    from .engine import Engine

FORWARD, REVERSE = ("src", "dst"), ("dst", "src")


@dataclass(frozen=True)
class _Sides(Filterable):
    """Filters and sorts of the objects at the far end, and of the edges (``edge_...``)."""

    edges: EdgeQuery = EdgeQuery()

    def edge_filter(self, field: str, value: object, comparison: str = "eq", joined: str = "and") -> Self:
        return replace(self, edges=self.edges.filter(field, value, comparison, joined))

    def edge_sort_asc(self, field: str) -> Self:
        return replace(self, edges=self.edges.sort_asc(field))

    def edge_sort_desc(self, field: str) -> Self:
        return replace(self, edges=self.edges.sort_desc(field))

    def with_edge_query(self, query: EdgeQuery) -> Self:
        return replace(self, edges=query)

    def obj_eq(self, field: str, value: object) -> Self:
        return replace(self, filters=(*self.filters, eq(field, value)))


def _edge_method(comparison: str, joined: str):
    def method(self, field: str, value: object):
        return self.edge_filter(field, value, comparison, joined)

    method.__doc__ = f"Add a filter on the edge: {'or' if joined == 'or' else 'and'} ``field`` {comparison} ``value``."
    return method


for _c in COMPARISONS:
    setattr(_Sides, f"edge_{_c}", _edge_method(_c, "and"))
    setattr(_Sides, f"edge_or_{_c}", _edge_method(_c, "or"))


def _where(df: DataFrame, condition) -> DataFrame:
    return df if condition is None else df.where(condition)


def _prefixed(edges: DataFrame) -> DataFrame:
    return edges.select(*(F.col(c).alias(f"edge_{c}") for c in edges.columns))


def nested(flat: DataFrame, edge: EdgeType, target: ObjectType) -> DataFrame:
    """Pairs as two structs, ``edge`` and ``object``."""
    fields = [f.name for f in edge.schema]
    return flat.select(F.struct(*(F.col(f"edge_{f}").alias(f) for f in fields)).alias("edge"), F.struct(*(f.name for f in target.schema)).alias("object"))


class Pivot:
    """One object, by id."""

    def __init__(self, engine: Engine, kind: ObjectType, id_: object) -> None:
        self.engine, self.kind, self.id = engine, kind, id_

    def get(self) -> DataFrame:
        return self.engine.fetch_object(self.kind, self.id)

    def edge(self, edge: EdgeType, target: ObjectType) -> Traversal:
        return Traversal(engine=self.engine, pivot=self.id, edge=edge, target=target)

    def preload(self, child: ObjectType) -> DataFrame:
        """The object with each object that it owns: parent_ and child_ columns, a childless one once."""
        return owned(self.get(), self.engine.fetch_owned_objects(child, self.id))


def owned(parents: DataFrame, children: DataFrame) -> DataFrame:
    p = parents.select(*(F.col(c).alias(f"parent_{c}") for c in parents.columns))
    c = children.select(*(F.col(c).alias(f"child_{c}") for c in children.columns))
    return p.join(c, F.col("parent_id") == F.col("child_owner"), "left")


@dataclass(frozen=True, kw_only=True)
class Traversal(_Sides):
    """From one pivot over one type of edge to one type of object."""

    engine: Engine
    pivot: object
    edge: EdgeType
    target: ObjectType

    def _pairs(self, ends: tuple[str, str], *, cut: bool = True) -> DataFrame:
        near, far = ends
        compat, catalog = self.engine.compat, self.engine.catalog
        edges = catalog[self.edge].where(self.edges.where(self.edge, far, compat, scope=(F.col(near) == F.lit(self.pivot),)))
        scope = [F.col("id") < F.lit(self.cursor)] if cut and self.cursor is not None else []
        objects = _where(catalog[self.target], combined(scope, self.filters, self.target.indexed, compat))
        pairs = _prefixed(edges).join(objects, F.col(f"edge_{far}") == F.col("id"))
        if not cut:
            return pairs
        order = [*ordering(self.edges.sorts, lambda f: F.col(f"edge_{f}"), "id", compat)[:-1], *ordering(self.sorts, self.target.indexed, "id", compat)]
        if self.limit is not None:
            return pairs.orderBy(*order).limit(self.limit)
        return pairs.orderBy(*order) if self.sorts or self.edges.sorts else pairs

    def _objects(self, pairs: DataFrame) -> DataFrame:
        return pairs.select(*(f.name for f in self.target.schema))

    def collect_with_target(self) -> DataFrame:
        """Edges (``edge_`` columns) with the objects they lead to."""
        return self._pairs(FORWARD)

    def collect_reverse_with_target(self) -> DataFrame:
        return self._pairs(REVERSE)

    def collect(self) -> DataFrame:
        """The objects that the pivot's edges lead to."""
        return self._objects(self._pairs(FORWARD))

    def collect_reverse(self) -> DataFrame:
        """The objects whose edges lead to the pivot."""
        return self._objects(self._pairs(REVERSE))

    def collect_edges(self) -> DataFrame:
        """The pivot's edges; filters on objects don't matter."""
        return self.engine.query_edges(self.edge, self.pivot, replace(self.edges, limit=self.limit, cursor=self.cursor))

    def collect_reverse_edges(self) -> DataFrame:
        return self.engine.query_reverse_edges(self.edge, self.pivot, replace(self.edges, limit=self.limit, cursor=self.cursor))

    def collect_both_with_target(self) -> DataFrame:
        """Both directions with ``direction``; a loop stands in each. Sort, limit and cursor don't matter."""
        return self._pairs(FORWARD, cut=False).withColumn("direction", F.lit("forward")).unionByName(self._pairs(REVERSE, cut=False).withColumn("direction", F.lit("reverse")))

    def collect_both(self) -> DataFrame:
        return self.collect_both_with_target().select("direction", *(f.name for f in self.target.schema))

    def collect_both_edges(self) -> DataFrame:
        """Edges of both directions in one scan; a loop gives two rows."""
        edges, at = self.engine.catalog[self.edge], F.lit(self.pivot)
        touching = edges.where((F.col("src") == at) | (F.col("dst") == at))
        sides = F.array_compact(F.array(F.when(F.col("src") == at, "forward"), F.when(F.col("dst") == at, "reverse")))
        return _where(touching, combined([], self.edges.filters, self.edge.indexed, self.engine.compat)).withColumn("direction", F.explode(sides))


class ManyPivots:
    """All objects that a query finds."""

    def __init__(self, engine: Engine, kind: ObjectType, query: Query) -> None:
        self.engine, self.kind, self.query = engine, kind, query

    def parents(self) -> DataFrame:
        return self.engine.query_objects(self.kind, self.query)

    def edge(self, edge: EdgeType, target: ObjectType) -> BatchTraversal:
        return BatchTraversal(engine=self.engine, pivots=self, edge=edge, target=target)

    def preload(self, child: ObjectType) -> DataFrame:
        """Each parent with each object that it owns: parent_ and child_ columns, a childless one once."""
        return owned(self.parents(), self.engine.catalog[child])


@dataclass(frozen=True, kw_only=True)
class BatchTraversal(_Sides):
    """From many pivots over one type of edge. Flat rows: ``parent_id``, and nulls for a pivot without any.

    ``limit`` is over all pivots' rows together; ``per_parent`` is for each pivot.
    """

    engine: Engine
    pivots: ManyPivots
    edge: EdgeType
    target: ObjectType
    per_parent: int | None = None

    def per_parent_limit(self, n: int) -> Self:
        return replace(self, per_parent=n)

    def _ids(self) -> DataFrame:
        return self.pivots.parents().select(F.col("id").alias("parent_id"))

    def _edges(self, ends: tuple[str, str]) -> DataFrame:
        """The pivots' edges: those of others go before they meet objects or are counted. Where all
        objects are pivots there is nothing to cut, and no join."""
        near, _ = ends
        condition = combined([], self.edges.filters, self.edge.indexed, self.engine.compat)
        edges = _prefixed(_where(self.engine.catalog[self.edge], condition)).withColumn("parent_id", F.col(f"edge_{near}"))
        cut = not self.pivots.query.everything or self.limit is not None
        return edges.join(self._ids(), "parent_id", "left_semi") if cut else edges

    def _under(self, found: DataFrame, order: list) -> DataFrame:
        ids = self._ids()
        if self.per_parent is not None:
            place = F.row_number().over(Window.partitionBy("parent_id").orderBy(*order))
            found = found.withColumn("__place", place).where(F.col("__place") <= self.per_parent).drop("__place")
        if self.limit is not None:
            found = found.orderBy(*order, "parent_id").limit(self.limit)
        return ids.join(found, "parent_id", "left")

    def _pairs(self, ends: tuple[str, str]) -> DataFrame:
        compat = self.engine.compat
        objects = _where(self.engine.catalog[self.target], combined([], self.filters, self.target.indexed, compat))
        pairs = self._edges(ends).join(objects, F.col(f"edge_{ends[1]}") == F.col("id"))
        order = [*ordering(self.edges.sorts, lambda f: F.col(f"edge_{f}"), "id", compat)[:-1], *ordering(self.sorts, self.target.indexed, "id", compat)]
        return self._under(pairs, order)

    def collect_with_target(self) -> DataFrame:
        return self._pairs(FORWARD)

    def collect_reverse_with_target(self) -> DataFrame:
        return self._pairs(REVERSE)

    def collect(self) -> DataFrame:
        return self._pairs(FORWARD).select("parent_id", *(f.name for f in self.target.schema))

    def collect_reverse(self) -> DataFrame:
        return self._pairs(REVERSE).select("parent_id", *(f.name for f in self.target.schema))

    def _only_edges(self, ends: tuple[str, str]) -> DataFrame:
        order = ordering(self.edges.sorts, lambda f: F.col(f"edge_{f}"), f"edge_{ends[1]}", self.engine.compat)
        return self._under(self._edges(ends), order)

    def collect_edges(self) -> DataFrame:
        return self._only_edges(FORWARD)

    def collect_reverse_edges(self) -> DataFrame:
        return self._only_edges(REVERSE)

    def _count(self, ends: tuple[str, str]) -> DataFrame:
        """Edges are counted by end before they meet the pivots: partial sums, then one join."""
        counts = self._edges(ends).groupBy("parent_id").agg(F.count("*").alias("n"))
        return self._ids().join(counts, "parent_id", "left").select("parent_id", F.coalesce("n", F.lit(0)).alias("n"))

    def count(self) -> DataFrame:
        """parent_id and n, 0 for a pivot without edges; filters on objects don't matter."""
        return self._count(FORWARD)

    def count_reverse(self) -> DataFrame:
        return self._count(REVERSE)


def grouped(flat: DataFrame, key: str = "parent_id", into: str = "children") -> DataFrame:
    """Flat rows as one row a pivot with an array of structs, empty for a pivot without any."""
    rest = [c for c in flat.columns if c != key]
    some = F.expr(" or ".join(f"`{c}` is not null" for c in rest))
    return flat.groupBy(key).agg(F.collect_list(F.when(some, F.struct(*rest))).alias(into))
