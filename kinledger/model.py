"""Typed objects and typed edges, declared once and bound to DataFrames.

An ``ObjectType`` names its fields with Spark types and says which are indexed, unique,
private or part of a named view. The registry checks names when a type is declared, so a
typing error in an index or a view fails there and not in the middle of a job.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Owner of objects that nobody else owns, and the owner that stands for none. Fixed values.
SYSTEM_OWNER = "00000000-0000-7000-8000-000000000001"
NIL_OWNER = "00000000-0000-0000-0000-000000000000"

META = {"id": None, "owner": None, "created_at": "timestamp_ntz", "updated_at": "timestamp_ntz"}
RESERVED_OBJECT = frozenset({"id", "owner", "type", "created_at", "updated_at"})
RESERVED_EDGE = frozenset({"from", "to", "type", "src", "dst"})
KINDS = frozenset({"search", "sort"})


class SchemaError(ValueError):
    """A declaration that names a field it doesn't have, or one it may not use."""


def _schema(fields: Mapping[str, str]) -> dict[str, StructField]:
    return {name: StructType.fromDDL(f"`{name}` {kind}").fields[0] for name, kind in fields.items()}


def _indexes(name: str, fields: Mapping[str, str], declared: Sequence[str]) -> dict[str, frozenset[str]]:
    """``"field:search+sort"`` declarations, kinds merged by field."""
    out: dict[str, frozenset[str]] = {}
    for text in declared:
        of, _, kinds = text.partition(":")
        wanted = frozenset(kinds.split("+")) if kinds else frozenset({"search"})
        if of not in fields:
            raise SchemaError(f"{name}: index on unknown field {of!r}")
        if wanted - KINDS:
            raise SchemaError(f"{name}: unknown kind of index in {text!r}")
        out[of] = out.get(of, frozenset()) | wanted
    return out


@dataclass(frozen=True)
class ObjectType:
    """A kind of node. ``fields`` maps names to DDL types; ids and owners share ``key``'s type."""

    name: str
    fields: Mapping[str, str]
    index: Sequence[str] = ()
    unique: Sequence[Sequence[str]] = ()
    views: Mapping[str, Sequence[str]] = field(default_factory=dict)
    private: frozenset[str] = frozenset()
    defaults: Mapping[str, object] = field(default_factory=dict)
    index_expr: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)
    key: str = "string"

    def __post_init__(self) -> None:
        for name in self.fields:
            if name in RESERVED_OBJECT:
                raise SchemaError(f"{self.name}: {name!r} is reserved")
        known = {*self.fields, *META}
        for what, names in (("private", self.private), ("defaults", self.defaults), ("index_expr", self.index_expr)):
            if bad := set(names) - set(self.fields):
                raise SchemaError(f"{self.name}: {what} names unknown fields {sorted(bad)}")
        for view, names in self.views.items():
            if bad := set(names) - known:
                raise SchemaError(f"{self.name}: view {view} names unknown fields {sorted(bad)}")
            if bad := set(names) & self.private:
                raise SchemaError(f"{self.name}: view {view} names private fields {sorted(bad)}")
        for group in self.unique:
            if bad := set(group) - {*self.fields, "owner"}:
                raise SchemaError(f"{self.name}: unique names fields it may not use {sorted(bad)}")
        self.indexes  # noqa: B018  checks the declarations

    @property
    def indexes(self) -> dict[str, frozenset[str]]:
        """Indexed fields; both times are always among them."""
        both = dict.fromkeys(("created_at", "updated_at"), KINDS)
        return both | _indexes(self.name, self.fields, self.index)

    @property
    def schema(self) -> StructType:
        meta = {k: v or self.key for k, v in META.items()}
        return StructType([*_schema(meta).values(), *_schema(self.fields).values()])

    def conform(self, df: DataFrame) -> DataFrame:
        """``df`` with exactly this type's columns: missing ones take their default or null, null
        values take their default, others go."""
        out = []
        for f in self.schema:
            c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
            if f.name in self.defaults:
                c = F.coalesce(c, F.lit(self.defaults[f.name]).cast(f.dataType))
            out.append(c.alias(f.name))
        return df.select(*out)

    def indexed(self, name: str) -> Column:
        """The value by which a field is searched and sorted."""
        c = F.col(name)
        return self.index_expr[name](c) if name in self.index_expr else c

    def public(self, df: DataFrame) -> DataFrame:
        """The default view: what isn't private, with id and times, without the owner."""
        return df.select("id", "created_at", "updated_at", *(f for f in self.fields if f not in self.private))

    def view(self, name: str, df: DataFrame) -> DataFrame:
        if name not in self.views:
            raise SchemaError(f"{self.name} has no view {name!r}")
        return df.select(*self.views[name])


@dataclass(frozen=True)
class EdgeType:
    """A kind of relationship from ``src`` to ``dst`` with properties; one edge a pair."""

    name: str
    fields: Mapping[str, str] = field(default_factory=dict)
    index: Sequence[str] = ()
    key: str = "string"

    def __post_init__(self) -> None:
        for name in self.fields:
            if name in RESERVED_EDGE:
                raise SchemaError(f"{self.name}: {name!r} is reserved")
        self.indexes  # noqa: B018

    @property
    def indexes(self) -> dict[str, frozenset[str]]:
        ends = dict.fromkeys(("src", "dst"), frozenset({"search"}))
        return ends | _indexes(self.name, self.fields, self.index)

    @property
    def schema(self) -> StructType:
        return StructType([*_schema({"src": self.key, "dst": self.key}).values(), *_schema(self.fields).values()])

    def conform(self, df: DataFrame) -> DataFrame:
        return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema))

    def indexed(self, name: str) -> Column:
        return F.col(name)
