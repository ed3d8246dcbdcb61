"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowaudit.llm import common

#: Members of a bucket block; larger buckets are compared block by block.
BLOCK = 256
#: Pairs whose cosines are computed at once.
PAIRS = 50_000


def projections(dim: int, tables: int, width: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((dim, tables * width)), rng.random(tables * width)


def _mixed(cells: np.ndarray, tables: int, width: int) -> np.ndarray:
    """One 32-bit key per table from its quantised projections."""
    cells = cells.astype(np.int64).view(np.uint64).reshape(len(cells), tables, width)
    out = np.zeros(cells.shape[:2], np.uint64)
    for k in range(width):
        out = common.mix(out ^ (cells[:, :, k] + common.ODD[k]))
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, tables: int = 48, width: int = 10, cell: float = 1.5,
) -> DataFrame:
    """Per row (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors are scaled to length 1; each table joins ``width`` projections cut into cells of ``cell``, so two vectors at
    cosine 0.9 meet in a table with probability 0.066, in one of 48 with 0.96; nearer ones almost always. What shares a bucket is compared by
    exact cosine in double precision, a pair only in the first table in which it meets. Equal
    vectors are one vector with a count. Large buckets are cut into blocks of BLOCK; a task compares two
    blocks and returns a count and one tree edge per vector, never the pairs.

    Vectors of different dimension never share a bucket; each dimension has its own projections.

    Defined results: null, empty, zero or non-finite vectors link with nothing and are kept; a null vec_id is kept without component;
    rows that repeat a vec_id with its vector count once among links and each get a row; an empty table gives an empty one; other columns are ignored.
    """
    spark = vectors.sparkSession
    work = common.Workspace(spark, "vectors")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = ~bad & F.exists("v", lambda x: x != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False)))
    same = work.table(good.groupBy("v").agg(F.min("vec_id").alias("id"), F.countDistinct("vec_id").alias("copies")), "same")
    if same.isEmpty():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    def keys(batches):
        planes = {}
        lists = lambda x, t: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), t))
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                if dim not in planes:
                    planes[dim] = projections(dim, tables, width)
                plane, shift = planes[dim]
                v = part.column("v").flatten().to_numpy().reshape(-1, dim)
                v = v / np.abs(v).max(axis=1, keepdims=True)
                v = v / np.linalg.norm(v, axis=1, keepdims=True)
                made = _mixed(np.floor(v @ plane / cell + shift), tables, width)
                d = pa.array(np.full(len(v), dim, np.int32))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("copies"), d, lists(v, pa.float64()), lists(made, pa.int32())], ["id", "copies", "d", "v", "keys"])

    hashed = work.table(same.mapInArrow(keys, "id long, copies long, d int, v array<double>, keys array<int>"), "hashed")
    members = hashed.select("id", "d", F.posexplode("keys").alias("t", "key"))
    full = members.groupBy("d", "t", "key").agg(F.count("*").alias("held")).where("held > 1")
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks.cast("long")).cast("int")
    placed = members.join(full, ["d", "t", "key"]).withColumn("blocks", blocks).withColumn("own", own)
    placed = placed.select("id", "d", "t", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    placed = placed.select("id", "t", F.xxhash64("d", "t", "key", F.least("own", "with"), F.greatest("own", "with")).alias("cell"), "own", (F.col("own") == F.col("with")).alias("within"))
    # a block pair {x, y} gets block x from "with = y" and block y from "with = x"; {x, x} gets x once
    carried = placed.join(hashed, "id").repartition(common.spread(spark, 2), "cell").sortWithinPartitions("d", "cell", "own")

    def links(batches):
        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            cells, d = now.column("cell").to_numpy(), now.column("d").to_numpy()
            ends = np.flatnonzero((cells[1:] != cells[:-1]) | (d[1:] != d[:-1])) + 1
            end = int(ends[-1]) if len(ends) else 0  # the last cell may go on in the next batch
            rest = now.slice(end)
            yield from by_dimension(now.slice(0, end))
        if rest is not None:
            yield from by_dimension(rest)

    def by_dimension(rows):
        d = rows.column("d").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(d)) + 1).tolist(), len(d)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield from compare(rows.slice(a, b - a), int(d[a]))

    def compare(rows, dim):
        rows = rows.combine_chunks()
        cells, t = rows.column("cell").to_numpy(), rows.column("t").to_numpy()
        ids, copies, part = rows.column("id").to_numpy(), rows.column("copies").to_numpy(), rows.column("own").to_numpy()
        within = rows.column("within").to_numpy()
        flat = lambda c: rows.column(c).chunk(0).flatten().to_numpy()
        v, made = flat("v").reshape(-1, dim), flat("keys").reshape(-1, tables)
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        size = np.diff(np.append(first, len(cells)))
        last = np.repeat(first + size, size)
        after = np.where(within, last - np.arange(len(cells)) - 1, 0)
        # across two blocks: rows of the first block meet all rows of the second
        change = np.flatnonzero((cells[1:] == cells[:-1]) & (part[1:] != part[:-1])) + 1
        begin = np.arange(len(cells)) + 1
        for c in change.tolist():
            a = int(first[np.searchsorted(first, c, "right") - 1])
            after[a:c], begin[a:c] = last[c] - c, c
        count, parent = np.zeros(len(cells), np.int64), np.arange(len(cells))
        edge = np.cumsum(after)
        start = 0
        while start < len(cells):
            stop = max(start + 1, int(np.searchsorted(edge, (edge[start - 1] if start else 0) + PAIRS, "right")))
            n = after[start:stop]
            i = np.repeat(np.arange(start, stop), n)
            j = np.repeat(begin[start:stop], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            near = np.einsum("ij,ij->i", v[i], v[j]) >= threshold
            i, j = i[near], j[near]
            earlier = (made[i] == made[j]) & (np.arange(tables) < t[i][:, None])
            new = ~earlier.any(axis=1)
            i, j = i[new], j[new]
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            while len(i):
                a, b = parent[i], parent[j]
                low = np.minimum(a, b)
                if (a == b).all():
                    break
                np.minimum.at(parent, a, low)
                np.minimum.at(parent, b, low)
                while (parent[parent] != parent).any():
                    parent = parent[parent]
            start = stop
        hit = count > 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(count[hit]), pa.array(ids[parent[hit]])], ["id", "links", "root"])

    found = work.table(carried.select("id", "d", "t", "cell", "own", "within", "copies", "v", "keys").mapInArrow(links, "id long, links long, root long"), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    reached = common.components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), work)
    joined = good.join(same.select("v", "id", "copies"), "v").select("vec_id", "id", "copies").distinct()
    joined = joined.join(counts, "id", "left").join(reached.withColumnRenamed("node", "id"), "id", "left").select(
        "vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return rows.select("vec_id").join(joined, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id").isNull() | (F.coalesce("component_id", "vec_id") == F.col("vec_id"))).alias("kept"))
