"""CSV readers with explicit schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from flowaudit.operators.fixed_values import KDD_FEATURES
from flowaudit.operators.prep import clean, drop_metadata, find_label

KDD_TEXT = ("protocol_type", "service", "flag")


def read_kdd(spark: SparkSession, path: str) -> DataFrame:
    """Headerless KDD file: 41 named features and ``label``; ``difficulty_level`` is dropped."""
    kind = lambda c: T.StringType() if c in KDD_TEXT else T.DoubleType()
    schema = T.StructType([
        *[T.StructField(c, kind(c)) for c in KDD_FEATURES], T.StructField("label", T.StringType()),
        T.StructField("difficulty_level", T.DoubleType())])
    return spark.read.schema(schema).csv(path, header=False).drop("difficulty_level")


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names of one file, as written."""
    return spark.read.option("enforceSchema", True).csv(path, header=True).columns


def read_flow_csv(spark: SparkSession, path: str) -> DataFrame:
    """One CSV file as text columns with blanks stripped from the header names."""
    names = _header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).csv(path, header=True).toDF(*[n.strip() for n in names])


def list_files(spark: SparkSession, directory: str, suffix: str = ".csv") -> list[str]:
    """Files below a directory in name order (listing only, no content)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    found, it = [], path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    while it.hasNext():
        name = it.next().getPath().toString()
        if name.endswith(suffix) and not name.rsplit("/", 1)[1].startswith(("_", ".")):
            found.append(name)
    return sorted(found)


def read_flow_directory(spark: SparkSession, directory: str) -> DataFrame:
    """All CSV files of a directory, united by column name, with their file in ``source_file``.

    Files with the same header are read in one scan, however many there are.
    """
    files = list_files(spark, directory)
    if not files:
        raise FileNotFoundError(f"no CSV files in {directory}")
    groups: dict[tuple, list[str]] = {}
    for f in files:
        groups.setdefault(tuple(_header(spark, f)), []).append(f)
    parts = []
    for names, paths in groups.items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        part = spark.read.schema(schema).csv(paths, header=True).withColumn("source_file", F.col("_metadata.file_path"))
        parts.append(part.toDF(*[n.strip() for n in part.columns]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_large_flows(spark: SparkSession, directory: str) -> DataFrame:
    """Many large files: medians are taken per file and duplicates stay."""
    df = drop_metadata(read_flow_directory(spark, directory))
    label = find_label(df)
    features = [c for c in df.columns if c not in (label, "source_file")]
    return clean(df, label, features, by=["source_file"], dedup=False)


def with_position(df: DataFrame) -> DataFrame:
    """0-based row position within the file set, without sorting rows globally.

    Rows keep their order inside a file block; blocks are numbered by file and
    offset, and a prefix sum of the (few) block counts gives each block's start.
    """
    tagged = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_o"))
    tagged = tagged.withColumn("_m", F.monotonically_increasing_id())
    blocks = tagged.groupBy("_f", "_o").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = W.orderBy("_f", "_o").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("_f", "_o", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = tagged.join(F.broadcast(starts), ["_f", "_o"])
    return out.withColumn("position", F.col("_start") + F.col("_m") - F.col("_first")).drop(
        "_f", "_o", "_m", "_first", "_start")


def attach_labels(data: DataFrame, labels: DataFrame, label: str = "Label") -> DataFrame:
    """Join a data file and a label file by row position; unequal lengths raise."""
    n, m = data.count(), labels.count()
    if n != m:
        raise ValueError(f"{n} data rows but {m} labels")
    left, right = with_position(data), with_position(labels.select(label))
    return left.join(right, "position").drop("position")
