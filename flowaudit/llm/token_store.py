"""Token ids in ORC: run-length coded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from flowaudit.llm import common
from flowaudit.llm.tokens import Encoder

#: Written uncompressed stripes of about this size; one reading task takes whole stripes.
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1000
#: Stored (compressed) input of one file.
FILE_BYTES = 64 << 20
#: Text encoded at once; larger parts repeat more words.
ENCODED_BYTES = 18 << 20


@cache
def _encoder(path: str, keep_blank: bool) -> Encoder:
    return Encoder(path, keep_blank)


@contextmanager
def encoder_of(path: str, keep_blank: bool):
    """The worker's encoder for one task. What it remembers is dropped at the end: a task's text is enough to fill it again, and idle workers stay small."""
    encoder = _encoder(path, keep_blank)
    try:
        yield encoder
    finally:
        encoder.forget()
        common.release_memory()


def write_token_ids(documents: DataFrame, path: str, tokenizer: str, end_id: int = 0, partitions: int | None = None) -> None:
    """Encode whole texts and write (doc_id, n_tokens, part, ids) as ORC, ascending by doc_id.

    One range partitioning by doc_id orders the files, ``part`` counts them in that order, and rows ascend
    in each. Stripes are read in parallel; min/max row indexes and Bloom filters on doc_id skip stripes.
    Null texts are empty (the end id only), rows without doc_id come first, repeated rows stay, columns
    other than doc_id and text are ignored, an empty table gives no rows.
    """
    n = partitions or max(common.spread(documents.sparkSession), common.estimated_bytes(documents) // FILE_BYTES)

    def encode(batches):
        with encoder_of(tokenizer, True) as encoder:
            for batch in batches:
                for part in common.slices(batch, limit=ENCODED_BYTES):
                    ids, bounds = encoder(part.column("text"))
                    ids = np.insert(ids, bounds[1:], end_id)
                    bounds = (bounds + np.arange(len(bounds))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)), part.column("part"),
                         pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))], ["doc_id", "n_tokens", "part", "ids"])

    ordered = documents.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    rows = ordered.withColumn("part", F.spark_partition_id()).mapInArrow(encode, "doc_id long, n_tokens long, part int, ids array<int>")
    (rows.write.format("orc").option("compression", "zstd").option("orc.stripe.size", STRIPE_BYTES)
     .option("orc.row.index.stride", ROW_INDEX_STRIDE).option("orc.create.index", "true")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").save(path))


def read_token_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; with ``doc_ids`` the scan skips stripes and row groups by index and Bloom filter."""
    stored = spark.read.schema("doc_id long, n_tokens long, part int, ids array<int>").orc(path)
    return stored if doc_ids is None else stored.where(F.col("doc_id").isin(doc_ids))


def token_positions(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: doc_id, start (ids before it in doc_id order), n_tokens and ids_crc32, from the files.

    Running sums stay inside a file's rows; what the files before hold is added from one row per file.
    """

    def digest(batches):
        for batch in batches:
            lists = batch.column("ids")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4").tobytes()
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "part", "n_tokens", "ids_crc32"])

    stored = read_token_ids(spark, path)
    rows = stored.select("doc_id", "part", "ids").mapInArrow(digest, "doc_id long, part int, n_tokens long, ids_crc32 long")
    files = stored.groupBy("part").agg(F.sum("n_tokens").alias("held"))  # as many rows as files
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    # rows that repeat an id differ at most in their text; ties go by length, then checksum, whatever order they are read in
    inside = W.partitionBy("part").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    return rows.join(F.broadcast(files), "part").select(
        "doc_id", (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")
