"""Changes as DataFrame to DataFrame: what a table holds afterwards.

Parquet has no row updates; a change is a new version of the table, which
``sources.store`` publishes at once. Functions that report give (table after, rows affected).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ObjectType
from ..plans.query import listed
from .constraints import conflicts, last_writes


def _parted(df: DataFrame, mine: Column) -> tuple[DataFrame, DataFrame]:
    """The rows for which ``mine`` is false or null, and those for which it is true."""
    mine = F.coalesce(mine, F.lit(False))
    return df.where(~mine), df.where(mine)


class UniqueViolation(ValueError):
    """A unique value that another object has; ``field`` names the constraint."""

    def __init__(self, field: str) -> None:
        super().__init__(f"unique constraint on {field}")
        self.field = field


def create_objects(existing: DataFrame, new: DataFrame, kind: ObjectType) -> DataFrame:
    """Append, unless a unique value is taken: the conflict is looked for before anything is written."""
    if kind.unique and (found := conflicts(existing, new, kind).orderBy("field").first()):
        raise UniqueViolation(found["field"])
    return existing.unionByName(kind.conform(new))


def update_objects(existing: DataFrame, updates: DataFrame, kind: ObjectType, now: Column | None = None) -> DataFrame:
    """Replace the fields of objects with an update's (id and some fields), and set updated_at.
    Ids without an object are ignored; owner and created_at stay. Of several updates of one id the
    one of the greatest values counts: an object stays one row."""
    updates = last_writes(updates, keys=("id",))
    now = F.lit(now) if now is not None else F.current_timestamp().cast("timestamp_ntz")
    fields = [c for c in updates.columns if c in kind.fields]
    wanted = updates.select(F.col("id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in fields))
    hit = F.col("__id").isNotNull()
    joined = existing.join(wanted, F.col("id") == F.col("__id"), "left")
    out = []
    for f in kind.schema:
        c = F.col(f.name)
        if f.name in fields:
            c = F.when(hit, F.col(f"__{f.name}").cast(f.dataType)).otherwise(c)
        elif f.name == "updated_at":
            c = F.when(hit, now).otherwise(c)
        out.append(c.alias(f.name))
    return joined.select(*out)


def update_objects_checked(existing: DataFrame, updates: DataFrame, kind: ObjectType, now: Column | None = None) -> DataFrame:
    """``update_objects``, unless a changed unique value is taken."""
    after = update_objects(existing, updates, kind, now)
    changed = after.join(updates.select("id"), "id", "left_semi")
    if kind.unique and (found := conflicts(after, changed, kind).orderBy("field").first()):
        raise UniqueViolation(found["field"])
    return after


def delete_object(existing: DataFrame, id_: object, owner: object) -> tuple[DataFrame, DataFrame]:
    """Without the object, if the owner has it, and the row that went (none otherwise)."""
    mine = (F.col("id") == F.lit(id_)) & (F.col("owner") == F.lit(owner))
    return _parted(existing, mine)


def delete_objects(existing: DataFrame, ids: Sequence, owner: object) -> tuple[DataFrame, DataFrame]:
    return listed(existing, "id", ids, F.col("owner") == F.lit(owner))


def delete_owned_objects(existing: DataFrame, owner: object) -> tuple[DataFrame, DataFrame]:
    return _parted(existing, F.col("owner") == F.lit(owner))


def transfer_object(existing: DataFrame, id_: object, owner: object, to: object, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Change the owner of an object that ``owner`` has; the second result is empty if nobody's changed."""
    now = F.lit(now) if now is not None else F.current_timestamp().cast("timestamp_ntz")
    mine = F.coalesce((F.col("id") == F.lit(id_)) & (F.col("owner") == F.lit(owner)), F.lit(False))
    changed = {"owner": F.when(mine, F.lit(to)).otherwise(F.col("owner")), "updated_at": F.when(mine, now).otherwise(F.col("updated_at"))}
    after = existing.select(*(changed.get(c, F.col(c)).cast(existing.schema[c].dataType).alias(c) for c in existing.columns))
    return after, existing.where(mine)


def update_edge(existing: DataFrame, src: object, dst: object, values: dict[str, object], to: object = None) -> DataFrame:
    """Set properties of the edge (src, dst) and, with ``to``, its far end; an edge that stands at
    (src, to) already is replaced. Without an edge (src, dst) nothing changes."""
    mine = (F.col("src") == F.lit(src)) & (F.col("dst") == F.lit(dst))
    set_ = dict(values)
    if to is not None and to != dst:
        set_["dst"] = to
        # one row at most, so the broadcast is bounded; none if there is no edge to move
        moved = existing.where(mine).limit(1).select(F.col("src").alias("__src"), F.lit(to).cast(existing.schema["dst"].dataType).alias("__dst"))
        existing = existing.join(F.broadcast(moved), (F.col("src") == F.col("__src")) & (F.col("dst") == F.col("__dst")), "left_anti")
    return existing.select(*((F.when(mine, F.lit(set_[c])).otherwise(F.col(c)).cast(existing.schema[c].dataType) if c in set_ else F.col(c)).alias(c) for c in existing.columns))


def delete_edge(existing: DataFrame, src: object, dst: object) -> DataFrame:
    return _parted(existing, (F.col("src") == F.lit(src)) & (F.col("dst") == F.lit(dst)))[0]


def delete_object_edges(existing: DataFrame, src: object) -> DataFrame:
    """Without any edge that leaves ``src``."""
    return _parted(existing, F.col("src") == F.lit(src))[0]
