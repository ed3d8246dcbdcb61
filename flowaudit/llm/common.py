"""Shared folder tables, text slices for Arrow batches, word hashes and connected components."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowaudit.session import ship_package, shuffles_dropped

U64 = np.uint64
#: Text bytes handled at once inside a task, whatever the size of the Arrow batch.
SLICE_BYTES = 4 << 20


# ---------------------------------------------------------------- tables in the shared folder
def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where a local session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Workspace:
    """Tables of one operator call: written once, read back, so that lost executors cost no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.named: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with shuffles_dropped(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """The same, in hash buckets of ``key``: joins on it read it in place. ``df`` should come dealt by ``key``, or each task writes a file a bucket."""
        self.named.append(f"llm_{name}_{uuid.uuid4().hex}")
        with shuffles_dropped(self.spark):
            df.write.format("parquet").bucketBy(buckets, key).option("path", self.path(name)).option("compression", "zstd").saveAsTable(self.named[-1])
        return self.spark.table(self.named[-1])

    def forget(self) -> None:
        """Take the bucketed tables out of the catalog, and delete them."""
        for name in self.named:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.drop(name.split("_")[1])
        self.named = []

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(spark: SparkSession, factor: int = 1) -> int:
    """A number of groups that grows with the session's shuffle partitions."""
    return factor * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer takes for the size of ``df`` (for files, their bytes); 0 where it knows nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


#: Bits of a membership bitmap: 8 MB, whatever the number of ids.
MEMBER_BITS = 1 << 26


def flagged(df: DataFrame, key: str, ids: DataFrame, wanted: str, name: str) -> DataFrame:
    """``df`` with a column ``name``: whether ``key`` may be among ``ids.wanted``; false only where it isn't. No shuffle of ``df``.

    The ids' hashes set bits of one bitmap of fixed size, which is broadcast. With very many ids the bitmap fills up and flags more rows.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(MEMBER_BITS))
    bits = ids.select(place(wanted).alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    at = df.withColumns({"_bucket": F.bitmap_bucket_number(place(key)), "_bit": F.bitmap_bit_position(place(key))})
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0
    return at.join(F.broadcast(bits), "_bucket", "left").select(*df.columns, F.coalesce(hit, F.lit(False)).alias(name))


def members(df: DataFrame, key: str, ids: DataFrame, wanted: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``ids.wanted``: all that are, and few others, without a shuffle of ``df``.

    An exact join follows; this only keeps most of ``df`` out of it.
    """
    return flagged(df, key, ids, wanted, "_member").where("_member").select(df.columns)


# ---------------------------------------------------------------- texts inside tasks
def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``limit`` bytes; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size.astype(np.int64)) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 texts; null is the empty text."""
    values = batch.column(column).cast(pa.large_binary()).to_pylist()
    return [x or b"" for x in values]


def release_memory() -> None:
    """Give freed memory back to the system at a task's end: idle workers stay alive beside those of the next tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


#: Odd multipliers of the words of a shingle or window, from a fixed seed.
ODD = np.array([xxhash.xxh3_64_intdigest(b"place %d" % i) | 1 for i in range(64)], np.uint64)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """One hash for every run of ``width`` consecutive word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += h[k : k + n] * ODD[k]
    return mix(out)


# ---------------------------------------------------------------- components
def components(edges: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), by alternating large and small stars.

    Every round is two aggregates and two joins on node ids and is written to the shared folder; no
    neighbourhood is gathered, so a node with a third of the edges is a skewed join key, not a group.
    """
    current = work.table(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    mark, rounds = None, 0
    while True:
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        small = small.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        rounds += 1
        current = work.table(small, f"{name}-{rounds}")
        work.drop(f"{name}-{rounds - 1}")
        seen = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    pairs = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.union(current.select(F.col("b"), F.col("b")).distinct())


def share(n: int, percent: int) -> int:
    """The smallest whole number that is at least ``percent`` of ``n``."""
    return math.ceil(n * percent / 100) if n * percent % 100 == 0 else n * percent // 100 + 1
