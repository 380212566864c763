"""Extract files, code lists, parameter blocks and prepared tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lifeledger.functions import normalize_name
from lifeledger.session import freeing_shuffles, new_path


def normalize_columns(df: DataFrame) -> DataFrame:
    """Clean every header; two headers that become equal are an error, not a silent overwrite."""
    names = [normalize_name(c) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"headers collide after clean-up: {sorted(names)}")
    return df.toDF(*names)


def read_extract(
    spark: SparkSession,
    paths: Sequence[str],
    schema: StructType | str | None = None,
    fmt: str = "parquet",
    years: Sequence[int] | None = None,
    year_column: str = "extract_year",
) -> DataFrame:
    """Stack the files of one extract by column name; a column a file lacks is null there.

    Parquet layouts are merged inside one scan. CSV files with one declared schema are one scan
    too; without a schema each file keeps its own header and the frames are stacked by name.
    ``years`` keeps those partitions of a table written with ``year_column`` as partition key.
    """
    if fmt == "parquet":
        reader = spark.read.option("mergeSchema", "true")
        df = (reader.schema(schema) if schema else reader).parquet(*paths)
    elif schema:
        df = spark.read.schema(schema).option("header", "true").csv(list(paths))
    else:
        frames = [spark.read.option("header", "true").csv(p) for p in paths]
        df = reduce(
            lambda a, b: a.unionByName(b, allowMissingColumns=True),
            [normalize_columns(f) for f in frames],
        )
    df = normalize_columns(df)
    return df.where(F.col(year_column).isin(list(years))) if years else df


def align(df: DataFrame, mapping: Mapping[str, str | Column]) -> DataFrame:
    """Bring a frame to a target layout: target column -> source column or expression."""
    return df.select(
        *[(F.col(src) if isinstance(src, str) else src).alias(dst) for dst, src in mapping.items()]
    )


def save_table(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> str:
    """Write a prepared table below the shared work folder and return its path."""
    path = new_path(df.sparkSession, name)
    if partition_by:
        # Few files per partition value, while a hot value is still split over several tasks.
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    with freeing_shuffles(df.sparkSession):
        df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return path


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_lookup(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A code list from CSV with a declared schema; a row that breaks it is an error."""
    return spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", "true").csv(path)
    return path


# The report's order of the living states in the cost block, and all states of the model.
COST_BLOCK_STATES = [0, 2, 1, 3]
MODEL_STATES = 6


def load_state_costs(vector: DataFrame, subgroups: int) -> DataFrame:
    """(state, subgroup, cost) from a cost vector (position, cost).

    The vector holds one block of ``subgroups`` prices for each living state, in the order of
    ``COST_BLOCK_STATES``; positions count from 0. The other states of the model cost nothing.
    A position that is missing, doubled or out of range is an error.
    """
    size = subgroups * len(COST_BLOCK_STATES)
    grid = vector.sparkSession.range(size).select(F.col("id").cast("int").alias("position"))
    given = vector.groupBy(F.col("position").cast("int").alias("position")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("cost").cast("double")).alias("cost")
    )
    joined = grid.withColumn("inside", F.lit(True)).join(given, "position", "full")
    wrong = F.col("inside").isNull() | F.col("n").isNull() | (F.col("n") != 1) | F.col("cost").isNull()
    cost = F.when(wrong, F.raise_error(F.concat(
        F.lit("cost vector: position missing, doubled or out of range: "), F.coalesce(F.col("position").cast("string"), F.lit("null"))
    )).cast("double")).otherwise(F.col("cost"))
    block = F.floor(F.col("position") / F.lit(subgroups)).cast("int")
    living = joined.select(
        F.get(F.array(*[F.lit(x) for x in COST_BLOCK_STATES]), block).alias("state"),
        F.pmod("position", F.lit(subgroups)).alias("subgroup"), cost.alias("cost"),
    )
    rest = MODEL_STATES - len(COST_BLOCK_STATES)
    free = vector.sparkSession.range(rest * subgroups).select(
        (F.floor(F.col("id") / F.lit(subgroups)) + len(COST_BLOCK_STATES)).cast("int").alias("state"),
        (F.col("id") % F.lit(subgroups)).cast("int").alias("subgroup"), F.lit(0.0).alias("cost"),
    )
    return living.unionByName(free)


def load_markov_params(blocks: DataFrame, keys: Sequence[str] = ("subgroup", "t")) -> DataFrame:
    """Wide probability blocks (one column per probability index) to rows of (keys, ix, p).

    Value columns are named by their index after the last non-digit, e.g. ``p0`` ... ``p15``.
    """
    values = [c for c in blocks.columns if c not in keys]
    long = blocks.unpivot(list(keys), values, "name", "p")
    return long.select(
        *keys, F.regexp_extract("name", r"(\d+)$", 1).cast("int").alias("ix"), F.col("p").cast("double")
    )
