"""Immutable query builders: scope, filters, sort, limit and keyset cursor.

A builder holds a description and compiles to one DataFrame plan; Catalyst pushes what it
can to the scan. The same filter methods serve objects, edges and both sides of a traversal.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Self

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..compat import DEFAULT, Compat
from ..functions.predicates import COMPARISONS, Filter, Sort, combined, ordering
from ..model import NIL_OWNER, SYSTEM_OWNER, EdgeType, ObjectType

#: The scope of all owners.
ALL = object()
#: More keys than this are joined as a table instead of listed in the predicate.
MOST_LISTED = 10_000


def listed(df: DataFrame, column: str, keys: Sequence, also: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that aren't, and those that are: ``column`` one of ``keys`` and ``also`` true. A short
    list becomes a predicate that reaches the scan, a long one a join."""
    if len(keys) <= MOST_LISTED:
        mine = F.col(column).isin(list(keys))
        mine = F.coalesce(mine if also is None else mine & also, F.lit(False))
        return df.where(~mine), df.where(mine)
    kind = df.schema[column].dataType
    wanted = df.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keys)], StructType([StructField("__key", kind)]))
    on = F.col(column) == F.col("__key")
    on = on if also is None else on & also
    return df.join(wanted, on, "left_anti"), df.join(wanted, on, "left_semi")


@dataclass(frozen=True)
class Filterable:
    filters: tuple[Filter, ...] = ()
    sorts: tuple[Sort, ...] = ()
    limit: int | None = None
    cursor: object = None

    def filter(self, field: str, value: object, comparison: str = "eq", joined: str = "and") -> Self:
        return replace(self, filters=(*self.filters, Filter(field, value, comparison, joined)))

    def sort_asc(self, field: str) -> Self:
        return replace(self, sorts=(*self.sorts, Sort(field)))

    def sort_desc(self, field: str) -> Self:
        return replace(self, sorts=(*self.sorts, Sort(field, True)))

    def with_limit(self, n: int) -> Self:
        return replace(self, limit=n)

    def with_cursor(self, key: object) -> Self:
        return replace(self, cursor=key)

    def paginate(self, key: object = None) -> Self:
        return self if key is None else self.with_cursor(key)


def _method(comparison: str, joined: str):
    def method(self, field: str, value: object):
        return self.filter(field, value, comparison, joined)

    method.__doc__ = f"Add a filter: {'or' if joined == 'or' else 'and'} ``field`` {comparison} ``value``."
    return method


for _c in COMPARISONS:
    setattr(Filterable, f"where_{_c}", _method(_c, "and"))
    setattr(Filterable, f"or_{_c}", _method(_c, "or"))


def finish(df: DataFrame, order: list, sorts: tuple[Sort, ...], limit: int | None) -> DataFrame:
    """Sort and cut. Without a limit and a sort no order is made: a global sort would cost a
    shuffle, and a DataFrame's rows have no order for later steps anyway."""
    if limit is not None:
        return df.orderBy(*order).limit(limit)
    return df.orderBy(*order) if sorts else df


@dataclass(frozen=True)
class Query(Filterable):
    """Objects of an owner, by default the system's."""

    owner: object = SYSTEM_OWNER

    @classmethod
    def of(cls, owner: object) -> Query:
        return cls(owner=owner)

    @classmethod
    def wide(cls) -> Query:
        """Whatever the owner."""
        return cls(owner=ALL)

    @property
    def everything(self) -> bool:
        """Does it find all objects."""
        return self.owner is ALL and not self.filters and self.limit is None and self.cursor is None

    def scope(self, compat: Compat = DEFAULT) -> list:
        if self.owner is not ALL:
            return [F.col("owner") == F.lit(self.owner)]
        return [F.col("owner").cast("string") > F.lit(NIL_OWNER)] if compat.legacy_nil_scope else []

    def where(self, kind: ObjectType, compat: Compat = DEFAULT, *, cursor: bool = True):
        scope = self.scope(compat)
        if cursor and self.cursor is not None:
            scope.append(F.col("id") < F.lit(self.cursor))
        return combined(scope, self.filters, kind.indexed, compat)

    def apply(self, df: DataFrame, kind: ObjectType, compat: Compat = DEFAULT) -> DataFrame:
        condition = self.where(kind, compat)
        return finish(df if condition is None else df.where(condition), ordering(self.sorts, kind.indexed, "id", compat), self.sorts, self.limit)

    def count(self, df: DataFrame, kind: ObjectType, compat: Compat = DEFAULT) -> DataFrame:
        """One row, ``n``; neither cursor nor limit matters."""
        condition = self.where(kind, compat, cursor=False)
        return (df if condition is None else df.where(condition)).agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class EdgeQuery(Filterable):
    """Edges at one end; the cursor is on the other end."""

    def where(self, kind: EdgeType, far: str, compat: Compat = DEFAULT, *, cursor: bool = True, scope: tuple = ()):
        parts = list(scope)
        if cursor and self.cursor is not None:
            parts.append(F.col(far) < F.lit(self.cursor))
        return combined(parts, self.filters, kind.indexed, compat)

    def apply(self, df: DataFrame, kind: EdgeType, near: str, far: str, at: object, compat: Compat = DEFAULT) -> DataFrame:
        for s in self.sorts:
            if s.field not in (*kind.fields, "src", "dst"):
                raise ValueError(f"{kind.name} has no field {s.field!r} to sort by")
        found = df.where(self.where(kind, far, compat, scope=(F.col(near) == F.lit(at),)))
        return finish(found, ordering(self.sorts, kind.indexed, far, compat), self.sorts, self.limit)
