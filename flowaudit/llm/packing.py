"""Hierarchical best-fit packing of token pieces into sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowaudit.llm import common
from flowaudit.llm.token_store import ENCODED_BYTES, encoder_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Items packed by one task of a round; rounds merge until one group of this size holds all open bins.
GROUP_ITEMS = 200_000
#: Free tokens up to which a bin is closed before the last round.
CLOSED_FREE = 8


def token_pieces(documents: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Encode whole texts, append the end id, cut what is longer than ``size``: one row per piece.

    A null text is the empty text (one piece with the end id); other columns are ignored.
    """

    def cut(batches):
        with encoder_of(tokenizer, False) as encoder:
            for batch in batches:
                for part in common.slices(batch, limit=ENCODED_BYTES):
                    yield pieces_of(part, *encoder(part.column("text")))

    def pieces_of(part, ids, bounds):
        ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
        bounds = bounds + np.arange(len(bounds))
        raw, rows = ids.tobytes(), []
        for doc, a, b in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            for k, s in enumerate(range(a, b, size)):
                e = min(s + size, b)
                rows.append((doc, k, s - a, e - s, zlib.crc32(raw[4 * s : 4 * e])))
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
            ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select("doc_id", "text").mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, offset in it), longest items first, each into the fullest bin that has room."""
    order = np.argsort(-lengths, kind="stable").tolist()
    wanted = lengths.tolist()
    place, offset = np.empty(len(wanted), np.int64), np.empty(len(wanted), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]  # by free tokens
    having, bins = 0, 0  # having: bit f is set when a bin with f free tokens is open
    for i in order:
        need = wanted[i]
        fitting = having >> need
        if fitting:
            free = need + (fitting & -fitting).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                having &= ~(1 << free)
        else:
            free, b = size, bins
            bins += 1
        place[i], offset[i] = b, size - free
        left = free - need
        if left:
            open_bins[left].append(b)
            having |= 1 << left
    return place, offset


def pack(pieces: DataFrame, work: common.Workspace, size: int = 2048, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Add (sequence_id, offset) to ``pieces`` (length, and what identifies them).

    Full pieces are sequences at once. The others are dealt by hash into groups of about ``group_items``,
    packed best-fit in each; nearly full bins are closed, and the open ones are items of the next round in
    fewer groups, until one group holds them or a round no longer merges much. A bin is (id, length) only, so a round's
    items are a few bytes each, and every round is a table in the shared folder.

    ``pieces`` must be a stored table with a distinct ``item`` per row. Ties go by length and then arrival;
    sequence ids are any numbers, sequences have no gaps.
    """
    items = pieces.where(F.col("length") < size).select("item", "length")
    total, rounds, chain, last = items.count(), 0, [], None
    schema = "item long, bin long, offset long, length long, filled long"
    while True:
        groups = max(1, -(-total // group_items))
        final = groups == 1 or (last is not None and total > 0.9 * last)

        def fit(table):
            lengths = table.column("length").to_numpy()
            place, offset = best_fit(lengths, size)
            filled = np.bincount(place, lengths).astype(np.int64) if len(place) else np.empty(0, np.int64)
            first = np.empty(len(filled), np.int64)
            ids = table.column("item").to_numpy()
            first[place[offset == 0]] = ids[offset == 0]
            return pa.table({"item": ids, "bin": first[place], "offset": offset, "length": lengths, "filled": filled[place]})

        dealt = items.withColumn("g", F.pmod(F.xxhash64("item", F.lit(rounds)), F.lit(groups)))
        packed = work.table(dealt.groupBy("g").applyInArrow(fit, schema), f"round-{rounds}")
        chain.append(packed.select("item", "bin", "offset"))
        rounds += 1
        if final:
            break
        # a bin is named after its first item, so that it is that item in the next round
        items = packed.where((F.col("offset") == 0) & (F.col("filled") < size - CLOSED_FREE)).select(F.col("bin").alias("item"), F.col("filled").alias("length"))
        last, total = total, items.count()
        if total == 0:
            break
    placed = chain[0]
    for step in chain[1:]:
        step = step.select(F.col("item").alias("bin"), F.col("bin").alias("outer"), F.col("offset").alias("shift"))
        placed = placed.join(step, "bin", "left").select(
            "item", F.coalesce("outer", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    kept = [c for c in pieces.columns if c != "item"]
    full = pieces.where(F.col("length") == size).select(*kept, F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < size).join(placed, "item").select(*kept, F.col("bin").alias("sequence_id"), "offset")
    return full.union(rest)


def best_fit_packing(documents: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack whole documents into sequences of at most ``size`` tokens: one row per piece with its place.

    Defined for null and empty texts (the end id alone) and an empty table (no rows). Repeated rows are
    packed as often as they occur.
    """
    work = common.Workspace(documents.sparkSession, "packing")
    pieces = work.table(token_pieces(documents, tokenizer, size, end_id).withColumn("item", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, work, size)
