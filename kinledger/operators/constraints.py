"""Unique constraints and last-write-wins edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ObjectType
from ..plans.query import listed


def unique_key(kind: ObjectType, group: Sequence[str]) -> tuple[str, Column]:
    """The label of a constraint, and its hash for a row: of type, label and values."""
    label = "+".join(group)
    if len(group) == 1:
        value = F.coalesce(F.col(group[0]).cast("string"), F.lit(""))
    else:
        value = F.concat_ws(":", *(x for f in group for x in (F.lit(f), F.coalesce(F.col(f).cast("string"), F.lit("")))))
    return label, F.sha2(F.concat_ws("::", F.lit(kind.name), F.lit(label), value), 256)


def unique_hashes(df: DataFrame, kind: ObjectType) -> DataFrame:
    """(id, type, field, key) of each object and constraint, in one pass."""
    pairs = [F.struct(F.lit(label).alias("field"), key.alias("key")) for label, key in (unique_key(kind, g) for g in kind.unique)]
    if not pairs:
        raise ValueError(f"{kind.name} has no unique constraint")
    return df.select("id", F.lit(kind.name).alias("type"), F.explode(F.array(*pairs)).alias("u")).select("id", "type", "u.field", "u.key")


def violations(df: DataFrame, kind: ObjectType) -> DataFrame:
    """(field, key, n) of each value that more than one object has."""
    return unique_hashes(df, kind).groupBy("field", "key").agg(F.count("*").alias("n")).where("n > 1")


def conflicts(existing: DataFrame, new: DataFrame, kind: ObjectType) -> DataFrame:
    """(id, field) of each new object whose value an existing one with another id, or a new one of a lesser id, has."""
    taken = unique_hashes(existing, kind).select("field", "key", F.col("id").alias("other"))
    mine = unique_hashes(new, kind)
    first = mine.groupBy("field", "key").agg(F.min("id").alias("first"))
    among = mine.join(first, ["field", "key"]).where(F.col("id") != F.col("first")).select("id", "field")
    return mine.join(taken, ["field", "key"]).where(F.col("id") != F.col("other")).select("id", "field").unionByName(among).distinct()


def last_writes(rows: DataFrame, order: Sequence[Column] = (), keys: Sequence[str] = ("src", "dst")) -> DataFrame:
    """One row for each value of ``keys``, by default one edge a (src, dst): the first in ``order``,
    and of equals, or without an order, the one of the greatest values."""
    rest = [F.col(c).desc_nulls_last() for c in rows.columns if c not in keys]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *(rest or [F.lit(0)])))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def upsert_edges(existing: DataFrame, written: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """Existing edges, replaced or joined by written ones of the same ends. Of several writes to one
    edge ``last_writes`` chooses, so a rerun gives the same."""
    new = last_writes(written, order)
    return existing.join(new, ["src", "dst"], "left_anti").unionByName(new)


# constraints as a table (id, type, field, key), so that a check doesn't hash all objects again


def insert_unique_hashes(stored: DataFrame, new: DataFrame, kind: ObjectType) -> tuple[DataFrame, DataFrame]:
    """The table with the hashes of ``new`` objects, and the conflicts (id, field) that forbid it: what
    another object has stored, or a new one of a lesser id wants too."""
    mine = unique_hashes(new, kind)
    first = mine.groupBy("field", "key").agg(F.min("id").alias("first"))
    among = mine.join(first, ["field", "key"]).where(F.col("id") != F.col("first")).select("id", "field")
    taken = stored.where(F.col("type") == kind.name).select("field", "key", F.col("id").alias("other"))
    found = mine.join(taken, ["field", "key"]).where(F.col("id") != F.col("other")).select("id", "field").unionByName(among).distinct()
    return stored.unionByName(mine.join(stored, ["id", "type", "field", "key"], "left_anti").select(*stored.columns)), found


def hashes_of_object(stored: DataFrame, id_: object) -> DataFrame:
    """What an object has stored: field, key."""
    return stored.where(F.col("id") == F.lit(id_)).select("field", "key")


def delete_unique_hashes(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Without these keys; a single one is a list of one."""
    return listed(stored, "key", keys)[0]


def top_per_owner(df: DataFrame, n: int, by: Column, owner: str = "owner") -> DataFrame:
    """The first ``n`` rows of each owner, with ``place``. Spark cuts each task's groups before the shuffle."""
    place = F.row_number().over(Window.partitionBy(owner).orderBy(by, F.col("id")))
    return df.withColumn("place", place.cast("long")).where(F.col("place") <= n)
