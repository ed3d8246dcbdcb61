"""Stored explanations and results: partitioned tables, resume by anti join, config hash."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

PARTITIONS = ("dataset", "explainer_key")


def config_hash(section: dict) -> str:
    """First 16 hex digits of the SHA-256 of the canonical JSON of a config section."""
    return hashlib.sha256(json.dumps(section, sort_keys=True, default=str).encode()).hexdigest()[:16]


def write_table(df: DataFrame, path: str, partitions=PARTITIONS, config: dict | None = None) -> None:
    """Overwrite only the partitions present in ``df``; other explainers' results stay."""
    if config is not None:
        df = df.withColumn("config_hash", F.lit(config_hash(config)))
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path))


def append_table(df: DataFrame, path: str, partitions=PARTITIONS, config: dict | None = None) -> None:
    if config is not None:
        df = df.withColumn("config_hash", F.lit(config_hash(config)))
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def read_table(spark: SparkSession, path: str, config: dict | None = None) -> DataFrame | None:
    """Stored rows made under the same config, or None when nothing is stored."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return None
    return df.filter(F.col("config_hash") == config_hash(config)) if config is not None else df


def missing(wanted: DataFrame, stored: DataFrame | None, keys: list[str]) -> DataFrame:
    """The wanted rows (or pairs) whose key is not stored yet."""
    return wanted if stored is None else wanted.join(stored.select(*keys).distinct(), keys, "left_anti")


def resume(wanted: DataFrame, path: str, keys: list[str], compute, partitions=PARTITIONS,
           config: dict | None = None) -> DataFrame:
    """Compute and append only what is missing, then return everything stored for ``wanted``.

    ``compute(rows) -> DataFrame`` sees the missing rows only.
    """
    spark = wanted.sparkSession
    todo = missing(wanted, read_table(spark, path, config), keys)
    if todo.limit(1).count():
        append_table(compute(todo), path, partitions, config)
    return read_table(spark, path, config).join(wanted.select(*keys).distinct(), keys, "left_semi")


def write_summary(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Result tables as CSV with header, or JSON lines (NaN becomes null)."""
    if fmt == "csv":
        df.write.mode("overwrite").csv(path, header=True)
        return
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    clean = {c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in doubles}
    (df.withColumns(clean) if clean else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
