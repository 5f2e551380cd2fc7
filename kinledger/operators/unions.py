"""Tagged unions of object types."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_of(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of all parts with ``type``; a field that a type doesn't have is null."""
    tagged = [df.select(F.lit(name).alias("type"), "*") for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def as_variants(union: DataFrame, parts: Mapping[str, DataFrame]) -> DataFrame:
    """One struct column a type, in order (first, second, ...), of which one is not null."""
    names = ("first", "second", "third", "fourth")
    return union.select(*(F.when(F.col("type") == name, F.struct(*df.columns)).alias(names[i]) for i, (name, df) in enumerate(parts.items())))
