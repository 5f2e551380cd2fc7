"""What the operators of this subpackage share: scratch tables and paths."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (a
    local session, as in tests) a temporary folder of this machine is taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="kinledger-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is ``written`` inside is deleted at the end, unless it outlives the scope: then it is the
    surrounding scope's, or the caller's if there is none."""
    _scopes.append([])
    try:
        yield
    finally:
        _delete(spark, _scopes.pop())


def written(df: DataFrame, name: str, *, outlives: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: its lineage ends there,
    and a lost executor costs one read instead of the work before it. A result that is lazy reads
    tables which must outlive the scope in which they are made."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    for scope in _scopes[: len(_scopes) - outlives][-1:]:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folders: Iterable[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` made and nothing reads any more."""
    _delete(spark, {name.rsplit("/", 1)[0] for df in tables for name in df.inputFiles()})


def extended(schema: StructType, fields: str) -> StructType:
    """``schema`` and more fields, written as DDL."""
    return StructType([*schema.fields, *StructType.fromDDL(fields).fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
