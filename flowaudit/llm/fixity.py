"""Merkle audit of WARC replicas: trees over ordered offset ranges, compared from the root down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowaudit.llm import common

#: Bytes of the lowest offset ranges, how many ranges form the next one, and levels above the records.
RANGE_BYTES = 1 << 16
FANOUT = 16
LEVELS = 4


def warc_records(pages: DataFrame, records_per_file: int = 1000) -> DataFrame:
    """(archive, page_id, tie, record): pages as WARC/1.1 response records in files of consecutive page ids, row by row.

    Null html is an empty body, a null url is written as "urn:none"; rows with a null page_id are left out; of repeated
    ids every row is a record, ordered by ``tie``, a hash of url and html.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.lit("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("page_id"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce("url", F.lit("urn:none"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.sha2(body, 256)),
        F.concat(F.lit("Content-Length: "), F.length(body)), F.lit("\r\n"))
    return pages.where("page_id is not null").select(
        F.floor(F.col("page_id") / records_per_file).cast("long").alias("archive"), "page_id", F.xxhash64("url", "html").alias("tie"),
        F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary")).alias("record"))


def placed(records: DataFrame, **hashed: Column) -> DataFrame:
    """(archive, offset, page_id, and each of ``hashed``, binary columns, as their SHA-256): a record begins where those before it in its file end.

    Lengths and hashes are taken before anything is shuffled, so the window sorts numbers, never record bytes. A null stays null.
    """
    numbers = records.select("archive", "page_id", "tie", F.length("record").alias("size"), *[F.sha2(c, 256).alias(n) for n, c in hashed.items()])
    before = W.partitionBy("archive").orderBy("page_id", "tie").rowsBetween(W.unboundedPreceding, -1)
    return numbers.select("archive", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("offset"), "page_id", *hashed)


def leaves(records: DataFrame) -> DataFrame:
    """(archive, offset, hash) of records (archive, offset, record)."""
    return records.select("archive", "offset", F.sha2("record", 256).alias("hash"))


def _joined() -> Column:
    """SHA-256 over the children's places and hashes in order, so that a moved record or range changes every node above it."""
    children = F.array_sort(F.collect_list(F.struct("place", "hash")))
    return F.sha2(F.array_join(F.transform(children, lambda x: F.concat_ws(":", x["place"], x["hash"])), ","), 256)


def merkle_levels(nodes: DataFrame, work: common.Workspace, name: str) -> list[DataFrame]:
    """Stored tables (archive, place, above, hash), lowest level first: records by offset, ranges of RANGE_BYTES, then FANOUT ranges of the level below, at
    the top one node per archive. Each level is made from the stored one below it.

    A node gathers at most FANOUT hashes, or the records of one range, so groups stay small however large an archive is.
    """
    level = nodes.select("archive", F.col("offset").alias("place"), "hash")
    # several records at one offset are one leaf
    level = level.groupBy("archive", "place").agg(F.array_join(F.array_sort(F.collect_list("hash")), "").alias("hash"))
    out = []
    for k in range(LEVELS + 1):
        step = RANGE_BYTES if k == 0 else FANOUT
        above = F.lit(0).cast("long") if k >= LEVELS - 1 else F.floor(F.col("place") / step)
        out.append(work.table(level.select("archive", "place", above.alias("above"), "hash"), f"{name}-{k}"))
        level = out[-1].groupBy("archive", "above").agg(_joined().alias("hash")).withColumnRenamed("above", "place")
    return out


def audit(first: DataFrame, second: DataFrame, name: str = "fixity") -> DataFrame:
    """(archive, offset, first_hash, second_hash, first_root, second_root, ranges, compared): leaves in which two replicas differ.

    ``first`` and ``second`` hold (archive, offset, hash). Only roots are compared at first; then, level by level, the children of nodes that
    differ are picked from both replicas and only those are joined, so nothing below equal branches is ever compared. Hashes
    cover places, so a shifted or swapped record is found as well as a changed, lost or added one. A leaf that one side lacks has a
    null hash there; of equal offsets in one replica the hashes are compared as an ordered list. ``ranges`` is how many lowest ranges of the archive had to be
    opened, ``compared`` how many nodes of it were joined on all levels. Rows with a null archive or offset are no leaves; empty replicas have no
    differences; other columns are ignored.
    """
    work = common.Workspace(first.sparkSession, name)
    known = "archive is not null and offset is not null and hash is not null"
    sides = [merkle_levels(x.where(known), work, n) for x, n in ((first, "first"), (second, "second"))]
    opened, compared, roots = None, None, None
    for k in range(LEVELS, -1, -1):
        a, b = (s[k] for s in sides)
        if opened is not None:
            parents = opened.select("archive", F.col("place").alias("above"))
            a, b = (x.join(parents, ["archive", "above"], "left_semi") for x in (a, b))
        a, b = (x.select("archive", "place", F.col("hash").alias(f"{n}_hash")) for x, n in ((a, "first"), (b, "second")))
        joined = work.table(a.join(b, ["archive", "place"], "full"), f"compared-{k}")
        count = joined.groupBy("archive").agg(F.count("*").alias("n"))
        compared = count if compared is None else compared.unionAll(count)
        if k == 0:
            ranges = opened.groupBy("archive").agg(F.count("*").alias("ranges"))
        opened = joined.where(~F.col("first_hash").eqNullSafe(F.col("second_hash")))
        if k == LEVELS:
            roots = opened.select("archive", F.col("first_hash").alias("first_root"), F.col("second_hash").alias("second_root"))
    compared = compared.groupBy("archive").agg(F.sum("n").alias("compared"))
    return opened.withColumnRenamed("place", "offset").join(roots, "archive").join(ranges, "archive").join(compared, "archive")


def damaged(record: Column, page_id: Column, every: int = 97) -> Column:
    """The record in a replica with known damage for drills: of every ``every`` records one has its last byte before the end replaced, and one in ten of those is lost (null)."""
    text = page_id.cast("string")
    hit = F.crc32(text.cast("binary")) % every == 0
    lost = F.crc32(F.concat(text, F.lit("x")).cast("binary")) % 10 == 0
    cut = F.concat(F.substring(record, F.lit(1), F.length(record) - 5), F.lit("?").cast("binary"), F.lit("\r\n\r\n").cast("binary"))
    return F.when(~hit, record).when(~lost, cut)
