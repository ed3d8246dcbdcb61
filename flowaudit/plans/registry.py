"""Named queries: a DataFrame builder and, where SQL can say the same, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder) -> DataFrame`` under ``name``."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Split a table that comes as fewer file splits than there are cores.

    For row-local work that costs far more than reading; a table with enough splits
    is returned as it is, without a shuffle.  Rows go by the hash of a nearly unique
    key, which unlike round-robin needs no sort to be repeatable.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns for comparison (adding 0 turns -0.0 into 0.0)."""
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return df.select(*[
        (F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if c in doubles else F.col(f"`{c}`") for c in df.columns])


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")
