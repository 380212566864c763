"""Helpers shared by the operators: table access, size-checked broadcasts, code for Python workers."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifeledger.session import work_folder

#: Bytes of a side that may be broadcast, its rows, and bytes that a row costs beside its values. The three
#: together bound what an executor holds; larger sides are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 1_000_000
ROW_BYTES = 32

#: White space that separates words, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_value(module: str) -> None:
    """Pickle this module's functions by value, so that Python workers need not import the library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def _bytes(name: str, kind: T.DataType) -> Column:
    """Bytes of a value: texts and lists by their length, everything else as one word."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + F.lit(8)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.aggregate(c, F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + F.lit(16)), F.lit(0))
        wide = 4 if isinstance(kind.elementType, (T.IntegerType, T.FloatType)) else 8
        return F.coalesce(F.size(c) * F.lit(wide), F.lit(0)) + F.lit(16)
    return F.lit(8)


def bounded(side: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` with a broadcast hint if its rows and bytes have been summed to be few, else as it is (shuffle join)."""
    size = sum((_bytes(f.name, f.dataType) for f in side.schema), F.lit(ROW_BYTES)).cast("long")
    rows, total = side.agg(F.count(F.lit(1)), F.sum(size)).first()
    return F.broadcast(side) if rows <= most and (total or 0) <= BROADCAST_BYTES else side


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words between ``SPACE`` runs; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), 0)


by_value(__name__)
