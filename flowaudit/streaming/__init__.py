"""Row-local operators on streams: the batch functions applied to streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowaudit.operators import constraints, packets
from flowaudit.operators.schemas import FlowSchema


def repair_stream(stream: DataFrame, schema: FlowSchema) -> DataFrame:
    """Flow rows repaired as they arrive (stateless projection, append mode)."""
    return constraints.enforce(stream, schema)


def packet_stream(stream: DataFrame) -> DataFrame:
    """Packets repaired as they arrive, with a ``valid`` flag."""
    return packets.repair_packets(stream).withColumn("valid", packets.packet_is_valid())


def score_stream(stream: DataFrame, scorer, features: str = "features") -> DataFrame:
    """Class probabilities of arriving rows."""
    return stream.withColumn("proba", scorer.proba(F.col(features)))
