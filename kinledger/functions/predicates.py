"""Filters, their combination and orderings as Columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..compat import DEFAULT, Compat

COMPARISONS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "contains_all", "begins_with")


@dataclass(frozen=True)
class Filter:
    """``field comparison value``; ``joined`` says how it stands to the filter before it."""

    field: str
    value: object
    comparison: str = "eq"
    joined: str = "and"

    def __post_init__(self) -> None:
        if self.comparison not in COMPARISONS:
            raise ValueError(f"unknown comparison {self.comparison!r}")
        if self.joined not in ("and", "or"):
            raise ValueError(f"unknown operator {self.joined!r}")


def eq(field: str, value: object) -> Filter:
    return Filter(field, value)


def _is_list(value: object) -> bool:
    return isinstance(value, (list, tuple, set, frozenset))


def _like(column: Column, before: str, value: str, after: str, compat: Compat) -> Column:
    """A case-insensitive match; ``value`` stands for itself unless wildcards are asked for."""
    if compat.legacy_like:
        return column.ilike(before + value + after)
    c, v = F.lower(column), F.lower(F.lit(value))
    if before:
        return F.contains(c, v)
    return F.startswith(c, v) if after else c == v


def predicate(f: Filter, column: Column, compat: Compat = DEFAULT) -> Column | None:
    """The filter on a column. Null fields match nothing. None: it doesn't filter (an empty list)."""
    if _is_list(f.value):
        values = list(f.value)
        if f.comparison not in ("contains", "contains_all"):
            raise ValueError(f"{f.comparison} doesn't take a list")
        if not values:
            return None
        if f.comparison == "contains":
            return F.arrays_overlap(column, F.array(*map(F.lit, values)))
        return reduce(and_, (F.array_contains(column, v) for v in values))
    if f.comparison in ("contains", "contains_all", "begins_with"):
        if not isinstance(f.value, str):
            raise ValueError(f"{f.comparison} takes a text or a list")
        ends = {"contains": ("%", "%"), "contains_all": ("", ""), "begins_with": ("", "%")}[f.comparison]
        return _like(column, ends[0], f.value, ends[1], compat)
    value = F.lit(f.value)
    return {"eq": column == value, "ne": column != value, "gt": column > value, "gte": column >= value, "lt": column < value, "lte": column <= value}[f.comparison]


def combined(scope: Sequence[Column], filters: Sequence[Filter], column_of: Callable[[str], Column], compat: Compat = DEFAULT) -> Column | None:
    """``scope`` and the filters as one Column, and binding tighter than or; None: no condition.

    By default the filters stand in brackets: ``scope and (f1 op2 f2 ...)``. With legacy_or
    each filter's operator stands after it and nothing is bracketed.
    """
    kept = [(f.joined, c) for f in filters if (c := predicate(f, column_of(f.field), compat)) is not None]
    if compat.legacy_or:
        joined = ["and", *(op for op, _ in kept)]
        terms = [(op, c) for op, (_, c) in zip(joined, kept)]
        groups: list[list[Column]] = [list(scope)]
        for op, c in terms:
            if op == "or" and groups[-1]:
                groups.append([])
            groups[-1].append(c)
        groups = [g for g in groups if g]
        return reduce(or_, (reduce(and_, g) for g in groups)) if groups else None
    inner: list[list[Column]] = []
    for i, (op, c) in enumerate(kept):
        if op == "or" or not i:
            inner.append([])
        inner[-1].append(c)
    parts = [*scope, *([reduce(or_, (reduce(and_, g) for g in inner))] if inner else [])]
    return reduce(and_, parts) if parts else None


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False


def ordering(sorts: Sequence[Sort], column_of: Callable[[str], Column], last: str, compat: Compat = DEFAULT) -> list[Column]:
    """Sort keys in call order, nulls as the largest value, and ``last`` descending to break ties."""
    out = []
    for s in sorts:
        c = column_of(s.field)
        if compat.legacy_text_sort and s.field not in ("created_at", "updated_at"):
            c = c.cast("string")
        out.append(c.desc_nulls_first() if s.descending else c.asc_nulls_last())
    return [*out, F.col(last).desc()]
