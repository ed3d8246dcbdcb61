"""Table helpers: size-checked small sides, exact ranks and exact top-n without one-task sorts."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowaudit.functions.hashing import hash64
from flowaudit.session import shuffles_dropped

SMALL_ROWS = 200_000


def local_rows(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """A small driver-side table, handed over through Arrow as a local relation of known size."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, to_arrow_schema(schema))]
    return spark.createDataFrame(pa.table(arrays, names=schema.names), schema)


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast ``df`` only after checking its size; otherwise leave it to a shuffle join.

    At most ``max_rows + 1`` rows reach the driver.  A larger result is returned
    untouched, so the join that uses it stays exact and merely shuffles.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if folder is None:
        import tempfile

        folder = tempfile.mkdtemp(prefix="flowaudit-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the cluster's shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: computed once, and nothing of it lives on executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_nulls_alike(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys`` where null equals null; the keys appear once."""
    if not keys:
        return left.crossJoin(right)
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(right, on, how).drop(*[f"_r_{k}" for k in keys])


def hash_levels(df: DataFrame, by: list[str], quotas: DataFrame, cuts: list[str], seed: int, key: str,
                buckets: int = 1024) -> DataFrame:
    """Cut every group, in pseudo-random order, at exact row counts; adds ``level``.

    ``quotas`` has the ``by`` columns and the cumulative counts ``cuts``: the first
    ``cuts[0]`` rows of a group get level 0, those up to ``cuts[1]`` level 1, and so on.
    The order is a hash of the row's key, so it does not depend on partitioning.

    The hash range is cut into buckets; a bucket wholly inside one level needs no
    ranking.  Only the bucket in which a cut falls is ranked, so a group with a third
    of all rows is never sorted in one task and most rows are not shuffled.
    """
    h = df.withColumn("_h", hash64(seed, F.col(key)))
    h = h.withColumn("_b", F.pmod(F.shiftrightunsigned("_h", 20), F.lit(buckets)).cast("int"))
    per_bucket = h.groupBy(*by, "_b").agg(F.count("*").alias("_rows"))
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    edges = per_bucket.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    edges = join_nulls_alike(edges, quotas, by)
    level = lambda rank: sum((F.when(rank > F.col(c), 1).otherwise(0) for c in cuts), F.lit(0))
    edges = edges.select(*by, "_b", "_before", *cuts, level(F.col("_before") + 1).alias("_first"),
                         level(F.col("_before") + F.col("_rows")).alias("_last"))
    edges = small_side(edges, max_rows=2_000_000)
    h = join_nulls_alike(h, edges, [*by, "_b"])
    helper = ["_h", "_b", "_before", "_first", "_last", *cuts]
    sure = h.filter("_first = _last").withColumn("level", F.col("_first")).drop(*helper)
    rn = F.row_number().over(W.partitionBy(*by, "_b").orderBy("_h", key))
    edge = h.filter("_first < _last").withColumn("_rank", F.col("_before") + rn)
    return sure.unionByName(edge.withColumn("level", level(F.col("_rank"))).drop(*helper, "_rank"))


def smallest_per_group(df: DataFrame, by: list[str], quota: DataFrame, seed: int, key: str,
                       buckets: int = 1024) -> DataFrame:
    """Flag exactly ``n_take`` pseudo-random rows per group (``quota(*by, n_take)``) as ``taken``."""
    out = hash_levels(df, by, quota.select(*by, "n_take"), ["n_take"], seed, key, buckets)
    return out.withColumn("taken", F.col("level") == 0).drop("level")


def _local_totals(d: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Sorted rows of a range partition with ``<name>_below`` (sums over the group's earlier rows in the partition) and ``_part``.

    Totals are carried from batch to batch; only the current group's are held.
    """
    schema = T.StructType([*d.schema.fields, *[T.StructField(n + "_below", T.LongType()) for n in names], T.StructField("_part", T.IntegerType())])

    def run(batches):
        part, last, carried = TaskContext.get().partitionId(), None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in by:
                v = batch[c].to_numpy(zero_copy_only=False)
                new[1:] |= (v[1:] != v[:-1]) & ~((v[1:] != v[1:]) & (v[:-1] != v[:-1]))  # NaN is a key like any other
            first = tuple(repr(batch[c][0].as_py()) for c in by)
            if first != last:
                carried = dict.fromkeys(names, 0)
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            below = {}
            for name in names:
                w = batch[name].to_numpy(zero_copy_only=False)
                before = np.cumsum(w) - w
                below[name] = before - before[start] + np.where(start == 0, carried[name], 0)
                carried[name] = int(below[name][-1] + w[-1])
            last = tuple(repr(batch[c][n - 1].as_py()) for c in by)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(below[m], pa.int64()) for m in names], pa.array(np.full(n, part, np.int32))], names=schema.names)

    return d.mapInArrow(run, schema)


def value_ranks(df: DataFrame, by: list[str], value: str, weights: dict[str, Column] | None = None) -> DataFrame:
    """Distinct values per group with counts, values below, and tie-averaged rank.

    Rows are first collapsed to distinct values (map-side combined), which are dealt in ranges of
    (group, value), so a huge group is many partitions of the order.  Each partition adds its running totals in one
    pass over its sorted rows; what the partitions before it hold of the same group is carried forward from one row per group and
    partition.  One plan at every size.  ``weights`` adds per-value sums and their
    running totals (``<name>`` and ``<name>_below``).
    """
    weights = {"cnt": F.lit(1), **(weights or {})}
    names = list(weights)
    d = df.groupBy(*by, value).agg(*[F.sum(w).cast("bigint").alias(n) for n, w in weights.items()])
    order = [*by, value]
    d = stored(_local_totals(d.repartitionByRange(*order).sortWithinPartitions(*order), by, names), "value-ranks")
    totals = d.groupBy(*by, "_part").agg(*[F.sum(n).alias("_t_" + n) for n in names])
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*by, "_part", *[F.coalesce(F.sum("_t_" + n).over(before), F.lit(0)).alias("_o_" + n) for n in names])
    d = join_nulls_alike(d, small_side(totals), [*by, "_part"])
    d = d.withColumns({n + "_below": F.col(n + "_below") + F.col("_o_" + n) for n in names})
    d = d.withColumn("avg_rank", F.col("cnt_below") + (F.col("cnt") + 1) / 2.0)
    return d.select(*by, value, *weights, *[n + "_below" for n in weights], "avg_rank")


def long_form(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Wide numeric columns -> ``(*keep, feature, value)`` rows."""
    quoted = lambda c: F.col("`" + c + "`")
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), quoted(c).cast("double").alias("value")) for c in columns])
    return df.select(*[quoted(k) for k in keep or []], F.explode(cells).alias("_c")).select(
        *[quoted(k) for k in keep or []], "_c.feature", "_c.value"
    )


#: Accuracy of the quantile sketches: a bracket holds about 6 in so many rows of a large group.
SKETCH_ACCURACY = 10_000


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Exact, linearly interpolated quantiles per group: ``(*by, prob, quantile)``.

    ``percentile`` keeps every distinct value of a group in one hash map.  Here one mergeable sketch per group gives a
    bracket around each wanted rank, whose error the sketch bounds; rows below a bracket are counted exactly, and only those
    inside are ranked, range-partitioned like all ranks.  A group too small for the bound is one bracket as a whole.  Brackets,
    counts and ranks are tables, so nothing per group comes to the driver.
    """
    rows = df.select(*by, F.lit(0).alias("_all"), F.col(value).cast("double").alias("_value"))
    rows = rows.filter(F.col("_value").isNotNull() & ~F.isnan("_value"))
    keys, reach = [*by, "_all"], 3.0 / accuracy
    v, small = F.col("_value"), F.col("_rows") < 2 * accuracy
    ends = [max(0.0, p - reach) for p in probs] + [min(1.0, p + reach) for p in probs]
    groups = rows.groupBy(*keys).agg(
        F.count("*").alias("_rows"), F.min("_value").alias("_min"), F.max("_value").alias("_max"), F.percentile_approx("_value", ends, accuracy).alias("_ends"))
    part = lambda at: F.slice("_ends", at + 1, len(probs))
    groups = groups.select(*keys, "_rows", F.when(small, F.array("_min")).otherwise(part(0)).alias("_lows"),
                           F.when(small, F.array("_max")).otherwise(part(len(probs))).alias("_highs"))
    groups = small_side(stored(groups, "quantile-brackets"))
    bracketed = join_nulls_alike(rows, groups, keys)
    low, high = (lambda i, c=c: F.get(c, i) for c in ("_lows", "_highs"))
    count = lambda test: F.array(*[F.count(F.when(test(F.lit(i)), 1)) for i in range(len(probs))])
    below = stored(bracketed.groupBy(*keys).agg(
        F.first("_rows").alias("_rows"), count(lambda i: v < low(i)).alias("_under"), count(lambda i: v <= high(i)).alias("_upto")), "quantile-counts")
    # the sketch's bound is checked by the counts; a bracket that misses its rank is made eight times as wide
    missed = [~small & ((F.get("_under", F.lit(i)) > F.floor(F.lit(float(p)) * (F.col("_rows") - 1))) | (F.get("_upto", F.lit(i)) <= F.ceil(F.lit(float(p)) * (F.col("_rows") - 1))))
              for i, p in enumerate(probs)]
    if below.filter(reduce(lambda a, b: a | b, missed)).limit(1).count():
        return exact_quantiles(df, by, value, probs, max(1, accuracy // 8))
    ids = F.filter(F.sequence(F.lit(0), F.size("_lows") - 1), lambda i: v.between(low(i), high(i)))
    inside = bracketed.select(*keys, "_value", F.explode(ids).alias("_id"))
    ranks = value_ranks(inside, [*keys, "_id"], "_value")
    wanted = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_rows") - 1)
        share = pos - F.floor(pos)
        for step, weight in ((0, 1.0 - share), (1, share)):
            wanted.append(F.struct(F.when(small, 0).otherwise(i).alias("_id"), F.lit(float(p)).alias("prob"), (F.floor(pos) + step).alias("_rank"),
                                   weight.alias("_share"), F.when(small, 0).otherwise(F.get("_under", F.lit(i))).alias("_under")))
    plan = below.select(*keys, F.explode(F.array(*wanted)).alias("_w")).select(*keys, "_w.*").filter("_share > 0")
    picked = join_nulls_alike(ranks.select(*keys, "_id", "_value", "cnt", "cnt_below"), plan, [*keys, "_id"])
    first = F.col("_under") + F.col("cnt_below")
    picked = picked.filter((first <= F.col("_rank")) & (F.col("_rank") < first + F.col("cnt")))
    return picked.groupBy(*by, "prob").agg(F.sum(F.col("_value") * F.col("_share")).alias("quantile"))


def order_chunks(df: DataFrame, by: list[str], order: str, chunk_rows: int = 2_000_000, pieces: int = 256) -> DataFrame | None:
    """Adds ``_chunk``: groups with more than ``chunk_rows`` rows are cut along ``order``.

    None when there is no such group.  Chunks follow the order column (equal values stay
    together), so running totals over a group become totals over its chunks plus a
    window inside each chunk.
    """
    hot = df.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > chunk_rows).select(*by)
    if not hot.limit(1).count():
        return None
    hot = small_side(hot, 1_000_000)
    cuts = join_nulls_alike(df, hot, by, "left_semi").groupBy(*by).agg(F.percentile_approx(
        order, [i / pieces for i in range(1, pieces)], 4 * pieces).alias("_cuts"))
    out = join_nulls_alike(df, small_side(cuts), by, "left")
    place = F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    return out.withColumn("_chunk", F.when(F.col("_cuts").isNull(), 0).otherwise(place)).drop("_cuts")


def with_running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None,
                 firsts: dict[str, str] | None = None, previous: dict[str, str] | None = None,
                 chunk_rows: int = 2_000_000) -> DataFrame:
    """Ordered per-group columns that stay parallel inside a huge group.

    Adds ``pos`` (1-based place), the sum over all earlier rows for each of ``sums`` (0 for
    the first row), the group's first value for each of ``firsts`` (new name -> column)
    and the preceding row's value for each of ``previous``.
    """
    sums, firsts, previous = sums or {}, firsts or {}, previous or {}
    df = df.withColumns(sums) if sums else df
    chunked = order_chunks(df, by, order[0], chunk_rows)
    key = [*by, "_chunk"] if chunked is not None else by
    d = chunked if chunked is not None else df
    w = W.partitionBy(*key).orderBy(*order)
    earlier = w.rowsBetween(W.unboundedPreceding, -1)
    made = {"pos": F.row_number().over(w), **{n: F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in sums}}
    made |= {n: F.first(c).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) for n, c in firsts.items()}
    made |= {n: F.lag(c).over(w) for n, c in previous.items()}
    out = d.withColumns(made)
    if chunked is None:
        return out
    place = F.struct(*order)
    totals = d.groupBy(*key).agg(
        F.count("*").alias("_c_pos"), *[F.sum(n).alias(f"_c_{n}") for n in sums],
        *[F.min_by(c, place).alias(f"_f_{n}") for n, c in firsts.items()],
        *[F.max_by(c, place).alias(f"_l_{n}") for n, c in previous.items()])
    cw = W.partitionBy(*by).orderBy("_chunk")
    before = cw.rowsBetween(W.unboundedPreceding, -1)
    carry = {f"_c_{n}": F.coalesce(F.sum(f"_c_{n}").over(before), F.lit(0)) for n in ("pos", *sums)}
    carry |= {f"_f_{n}": F.first(f"_f_{n}").over(cw.rowsBetween(W.unboundedPreceding, W.currentRow)) for n in firsts}
    carry |= {f"_l_{n}": F.lag(f"_l_{n}").over(cw) for n in previous}
    out = join_nulls_alike(out, totals.withColumns(carry), key)
    fixed = {n: F.col(n) + F.col(f"_c_{n}") for n in ("pos", *sums)}
    fixed |= {n: F.col(f"_f_{n}") for n in firsts}
    # only a chunk's first row looks back into the chunk before it
    at_start = F.col("pos") == 1
    fixed |= {n: F.when(at_start, F.col(f"_l_{n}")).otherwise(F.col(n)) for n in previous}
    return out.withColumns(fixed).drop("_chunk", *carry)
