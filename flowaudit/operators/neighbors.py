"""Rule-abiding neighbourhoods, exact nearest rows and reference points."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowaudit.functions import arrays as A, hashing as H
from flowaudit.functions.tables import checkpointed, join_nulls_alike, local_rows, long_form, small_side, stored, with_running
from flowaudit.functions.vectors import matrix
from flowaudit.operators.constraints import col, enforce, pack, unpack
from flowaudit.operators.schemas import FlowSchema

#: Least number of slices of a pool: no slice is drawn more often than once in so many draws.
LEAST_SLICES = 1024


@dataclass(frozen=True)
class Pool:
    """An empirical distribution as a guide table: ``table(_proto, _slice, _options)`` over ``slices`` equal slices of the cumulative share.

    A slice lists the values that reach into it with the share at which each ends. A draw looks up one slice and takes the first
    option that ends beyond it. There are at least as many slices as values, so a slice has two options on average and a
    value with a third of all rows is spread over a third of the slices.
    """

    table: DataFrame
    slices: int


def value_pools(train: DataFrame, schema: FlowSchema) -> dict[str, Pool]:
    """Empirical distributions to draw from: the protocol, and each discrete feature per protocol."""
    discrete = [c for c in schema.discrete if c != schema.protocol]
    proto = col(schema.protocol) if schema.protocol else F.lit(0.0)
    keyed = train.withColumn("_proto", proto.cast("double"))
    cells = long_form(keyed, discrete, ["_proto"]) if discrete else None
    pools = {}
    if schema.protocol:
        pools[schema.protocol] = _pool(
            keyed.select(F.lit(0.0).alias("_proto"), proto.cast("double").alias("value")).groupBy("_proto", "value").agg(F.count("*").alias("_n")))
    if cells is not None:
        # counted in one pass, then read once per feature
        counts = checkpointed(cells.groupBy("feature", "_proto", "value").agg(F.count("*").alias("_n")))
        for name in discrete:
            pools[name] = _pool(counts.filter(F.col("feature") == name).drop("feature"))
    return pools


def _pool(counts: DataFrame) -> Pool:
    """Guide table of ``counts(_proto, value, _n)``."""
    largest = counts.groupBy("_proto").count().agg(F.max("count")).first()[0] or 0
    slices = max(LEAST_SLICES, int(largest))
    totals = counts.groupBy("_proto").agg(F.sum("_n").alias("_total"))
    running = with_running(counts, ["_proto"], ["value"], {"_lo": F.col("_n")}).drop("pos")  # rows of smaller values
    v = join_nulls_alike(running, small_side(totals), ["_proto"])
    edge = lambda c: c * slices / F.col("_total")
    first, last = F.floor(edge(F.col("_lo"))).cast("int"), F.ceil(edge(F.col("_lo") + F.col("_n"))).cast("int") - 1
    reach = v.withColumn("_slice", F.explode(F.sequence(first, F.greatest(first, last))))
    option = F.struct(((F.col("_lo") + F.col("_n")) / F.col("_total")).alias("to"), F.col("value").alias("value"))
    table = reach.groupBy("_proto", "_slice").agg(F.array_sort(F.collect_list(option)).alias("_options"))
    return Pool(small_side(table), slices)


def _draw(df: DataFrame, pool: Pool, target: str, proto: Column, u: Column, when: Column) -> DataFrame:
    """Replace ``target`` by a draw from ``pool`` where ``when`` holds and the pool has the protocol."""
    df = df.withColumns({"_u": u, "_k": proto}).withColumn("_s", F.floor(F.col("_u") * pool.slices).cast("int"))
    out = df.join(pool.table, (F.col("_k") == F.col("_proto")) & (F.col("_s") == F.col("_slice")), "left")
    beyond = F.get(F.filter("_options", lambda o: o["to"] > F.col("_u")), F.lit(0))
    drawn = F.coalesce(beyond["value"], F.element_at("_options", -1)["value"])
    new = F.when(when & F.col("_options").isNotNull() & drawn.isNotNull(), drawn).otherwise(col(target))
    return out.withColumn(target, new).drop("_u", "_k", "_s", "_proto", "_slice", "_options")


def spread_by_key(rows: DataFrame, key: str) -> DataFrame:
    """Hash-partition rows that are about to be multiplied.

    The partition count is explicit: adaptive execution would otherwise merge the
    (still small) rows into few partitions just before they grow a thousandfold.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def neighbourhood(
    rows: DataFrame,
    schema: FlowSchema,
    samples: int,
    sigma: float | dict[str, float],
    pools: dict[str, Pool] | None = None,
    seed: int = 42,
    repair: bool = True,
    key: str = "row_id",
) -> DataFrame:
    """``samples`` perturbed copies of every row (``sample`` 0 is the row itself), repaired.

    Continuous features get Gaussian noise; with ``pools`` the protocol and the
    discrete features are drawn from training values (discrete ones given the
    drawn protocol), without pools they stay fixed.  Copies are made inside the
    row's task, and rows are hash-partitioned by key beforehand, so a later
    ``groupBy(key)`` needs no shuffle of the copies.
    """
    discrete = [c for c in schema.discrete if c != schema.protocol]
    df = spread_by_key(rows, key).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    k, moved = [F.col(key), F.col("sample")], F.col("sample") > 0
    noisy = {}
    for name in schema.continuous:
        s = sigma[name] if isinstance(sigma, dict) else sigma
        draw = F.lit(float(s)) * H.normal(seed, *k, F.lit(name))
        noisy[name] = F.when(moved, col(name) + draw).otherwise(col(name).cast("double"))
    df = df.withColumns({**noisy, **{d: col(d).cast("double") for d in discrete}})
    if pools and schema.protocol in pools:
        df = _draw(df.withColumn(schema.protocol, col(schema.protocol).cast("double")), pools[schema.protocol],
                   schema.protocol, F.lit(0.0), H.uniform(seed, *k, F.lit("protocol")), moved)
    for name in discrete:
        if pools and name in pools:
            proto = col(schema.protocol).cast("double") if schema.protocol else F.lit(0.0)
            df = _draw(df, pools[name], name, proto, H.uniform(seed, *k, F.lit(name), F.lit("pool")), moved)
    return enforce(df, schema) if repair else df


# --- exact nearest rows -------------------------------------------------------------


#: Pivots grow with the square root of the candidates up to this number; rows that give the principal directions, and how many directions.
MOST_PIVOTS, DIRECTION_ROWS, DIRECTIONS = 8192, 4096, 8


class _Pivots:
    """Pivot rows and leading principal directions of a bounded sample. They steer which cells are visited, never the result."""

    def __init__(self, sample: np.ndarray, pivots: int):
        self.centre = sample[:pivots]
        _, _, axes = np.linalg.svd(sample - sample.mean(axis=0), full_matrices=False)
        self.axes = axes[:DIRECTIONS].T

    def assign(self, df: DataFrame, vector: str) -> DataFrame:
        """Nearest pivot (``_cell``), the distance to it (``_r``) and the place along the directions (``_z``)."""

        @F.pandas_udf("struct<cell int, r double, z array<double>>")
        def nearest(batch: pd.Series) -> pd.DataFrame:
            x = matrix(batch)
            d = _distances(x, self.centre)
            c = d.argmin(axis=1)
            return pd.DataFrame({"cell": c.astype("int32"), "r": d[np.arange(len(c)), c], "z": list(x @ self.axes)})

        return df.withColumn("_p", nearest(vector)).withColumns(
            {"_cell": F.col("_p.cell"), "_r": F.col("_p.r"), "_z": F.col("_p.z")}).drop("_p")


class _Cells:
    """Per key, the cells with their radius, size and box along the directions: what a query needs to rule a cell out."""

    def __init__(self, cells: np.ndarray, radius: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.cells, self.radius, self.size, self.low, self.high = cells.astype(int), radius, size, low, high

    def least_distance(self, to_pivot: np.ndarray, z: np.ndarray) -> np.ndarray:
        """(queries, cells) lower bounds: by the triangle inequality, and by the distance to the cell's box in the projection."""
        out = to_pivot[:, self.cells] - self.radius
        for i in range(len(z)):
            gap = np.maximum(0.0, np.maximum(self.low - z[i], z[i] - self.high))
            out[i] = np.maximum(out[i], np.sqrt((gap * gap).sum(axis=1)))
        return out


def _distances(a: np.ndarray, b: np.ndarray, block: int = 1 << 22) -> np.ndarray:
    """Euclidean distances by explicit differences (no cancellation for near rows)."""
    out = np.empty((len(a), len(b)))
    step = max(1, block // max(1, b.size))
    for s in range(0, len(a), step):
        diff = a[s : s + step, None, :] - b[None, :, :]
        out[s : s + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def nearest_rows(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    by: list[str] | None = None,
    pivots: int | None = None,
    chunk_rows: int = 20_000,
    seed: int = 7,
) -> DataFrame:
    """Exact k nearest candidates per query: ``(query_id, candidate_id, distance, vector, place)``.

    ``queries(query_id, vector, *by)``, ``candidates(candidate_id, vector, *by)``; with
    ``by`` only candidates of the same key count.  A candidate is never its own
    neighbour when both ids are equal and ``query_id`` is marked ``self``.

    Candidates are put into cells around pivot rows, whose number grows with the square root of the
    candidates.  A query first searches the nearest cell that holds enough rows; the k-th distance found there is a true
    bound, and only cells that may hold a nearer row are searched after it: by the triangle inequality around the pivot, and by
    the cell's box along the leading principal directions.  Cells and query groups are cut into chunks, so a
    dense cell is many tasks.  Ids and distances travel back; the vectors of the k nearest are joined last.
    """
    by = by or []
    spark = queries.sparkSession
    pair_schema = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("candidate_id", candidates.schema["candidate_id"].dataType), T.StructField("distance", T.DoubleType())])
    total = candidates.count()
    if not total:
        return spark.createDataFrame([], T.StructType([
            *pair_schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("place", T.IntegerType())]))
    pivots = pivots or min(MOST_PIVOTS, max(16, int(total**0.5)))
    sample = candidates.orderBy(H.hash64(seed, F.col("candidate_id")), "candidate_id").limit(max(pivots, DIRECTION_ROWS))
    guide = _Pivots(matrix(pd.Series([np.asarray(r[0], dtype=float) for r in sample.select("vector").collect()])), pivots)
    # assigned once: the cell statistics and both searches read it
    cand = stored(guide.assign(candidates, "vector"), "nearest-cells")
    width = guide.axes.shape[1]
    ends = [f(F.get("_z", F.lit(i))) for f in (F.min, F.max) for i in range(width)]
    stats = cand.groupBy(*by, "_cell").agg(F.max("_r").alias("radius"), F.count("*").alias("n"), F.array(*ends).alias("ends")).collect()
    table: dict[tuple, list] = {}
    for s in stats:
        table.setdefault(tuple(s[c] for c in by), []).append((s["_cell"], s["radius"], s["n"], s["ends"][:width], s["ends"][width:]))
    known = {key: _Cells(*(np.array(v) for v in zip(*rows))) for key, rows in table.items()}
    own = 1 if "self" in queries.columns else 0  # the row itself may fill a place of the home cell
    need = k + own

    @F.pandas_udf("int")
    def home(batch: pd.Series, keys: pd.DataFrame) -> pd.Series:
        """The nearest cell that holds enough rows; -1 where none does."""
        d = _distances(matrix(batch), guide.centre)
        out = []
        for i, key in enumerate(keys.itertuples(index=False, name=None)):
            c = known.get(tuple(key[: len(by)]))
            enough = c.cells[c.size >= need] if c is not None else []
            out.append(int(enough[d[i, enough].argmin()]) if len(enough) else -1)
        return pd.Series(out, dtype="int32")

    @F.pandas_udf("array<int>")
    def others(batch: pd.Series, keys: pd.DataFrame, bound: pd.Series, first: pd.Series) -> pd.Series:
        """Cells besides the first one that may hold a row within the bound."""
        x = matrix(batch)
        d, z = _distances(x, guide.centre), x @ guide.axes
        limit = bound.fillna(np.inf).to_numpy()
        limit = limit * (1 + 1e-9) + 1e-9
        out: list = [[]] * len(x)
        names = [tuple(r[: len(by)]) for r in keys.itertuples(index=False, name=None)]
        for key in set(names):
            if key in known:
                rows = np.array([i for i, n in enumerate(names) if n == key])
                near = known[key].least_distance(d[rows], z[rows]) <= limit[rows, None]
                near &= known[key].cells[None] != first.to_numpy()[rows, None]
                for i, m in zip(rows.tolist(), near):
                    out[i] = known[key].cells[m].tolist()
        return pd.Series(out)

    key_struct = F.struct(*[F.col(c) for c in by], F.lit(0).alias("_pad"))
    start = stored(queries.select(*by, "query_id", "vector", home("vector", key_struct).alias("_home")), "nearest-queries")
    chunks = F.broadcast(local_rows(
        spark, [(*(s[c] for c in by), s["_cell"], -(-s["n"] // chunk_rows)) for s in stats],
        T.StructType([*[candidates.schema[c] for c in by], T.StructField("_cell", T.IntegerType()), T.StructField("_chunks", T.LongType())])))
    dealt = cand.select(*by, "candidate_id", "vector", "_cell").join(chunks, [*by, "_cell"]).withColumn(
        "_chunk", F.pmod(H.hash64(seed, F.col("candidate_id")), F.col("_chunks")).cast("int")).drop("_chunks")
    skip_self = bool(own)

    def search(qs: pa.Table, cs: pa.Table) -> pa.Table:
        if not qs.num_rows or not cs.num_rows:
            return nothing
        cs = cs.sort_by("candidate_id")
        stack = lambda t: t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)
        cm, cid, qm, qid = stack(cs), cs["candidate_id"].to_numpy(), stack(qs), qs["query_id"].to_numpy()
        limit = qs["_bound"].to_numpy() * (1 + 1e-9) + 1e-9
        found = []
        for s in range(0, len(qm), 256):
            d = _distances(qm[s : s + 256], cm)
            if skip_self:
                d[qid[s : s + 256, None] == cid[None, :]] = np.inf
            top = np.argsort(d, axis=1, kind="stable")[:, :k]
            dist = np.take_along_axis(d, top, axis=1)
            ok = np.isfinite(dist) & (dist <= limit[s : s + 256, None])
            found.append((np.repeat(qid[s : s + 256], top.shape[1])[ok.ravel()], cid[top.ravel()][ok.ravel()], dist[ok]))
        return pa.table([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*found), arrow_pairs)], schema=arrow_pairs)

    arrow_pairs = to_arrow_schema(pair_schema)
    nothing = arrow_pairs.empty_table()

    def searched(visits: DataFrame) -> DataFrame:
        """k nearest of every query in each cell it visits: ``visits(*by, query_id, vector, _cell, _bound)``."""
        q = visits.join(chunks, [*by, "_cell"]).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks").cast("int") - 1))).drop("_chunks")
        # a chunk visited by very many queries is answered in several groups, each with its copy of the chunk
        load = q.groupBy(*by, "_cell", "_chunk").agg(F.ceil(F.count("*") / F.lit(chunk_rows)).cast("int").alias("_parts"))
        load = small_side(load)
        group = [*by, "_cell", "_chunk", "_part"]
        q = q.join(load, group[:-1]).withColumn(
            "_part", F.pmod(H.hash64(seed, F.col("query_id")), F.col("_parts").cast("bigint")).cast("int")).drop("_parts")
        c = dealt.join(load, group[:-1]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        named = [*group, "candidate_id", "vector"]
        right = c.select(*named).toDF(*named)  # fresh column ids: both sides may stem from one table
        return q.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(search, pair_schema)

    place = W.partitionBy("query_id").orderBy("distance", "candidate_id")
    ranked = lambda found: found.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)
    first = start.filter("_home >= 0").withColumnRenamed("_home", "_cell").withColumn("_bound", F.lit(float("inf")))
    near = stored(ranked(searched(first)), "nearest-first")
    bounds = near.filter(F.col("place") == k).select("query_id", F.col("distance").alias("_bound"))
    rest = start.join(bounds, "query_id", "left")
    rest = rest.withColumn("_cells", others("vector", key_struct, F.col("_bound"), F.col("_home"))).filter(F.size("_cells") > 0)
    rest = rest.withColumn("_bound", F.coalesce("_bound", F.lit(float("inf")))).select(*by, "query_id", "vector", "_cells", "_bound")
    # kept once a query, not once a visit
    visits = stored(rest, "nearest-visits").withColumn("_cell", F.explode("_cells")).select(*by, "query_id", "vector", "_cell", "_bound")
    found = ranked(near.drop("place").unionByName(searched(visits)))
    vectors = candidates.select("candidate_id", "vector").dropDuplicates(["candidate_id"])
    return found.join(vectors, "candidate_id").select("query_id", "candidate_id", "distance", "vector", "place")


def reference_points(
    rows: DataFrame,
    train: DataFrame,
    benign: int = 0,
    k: int = 1,
    schema: FlowSchema | None = None,
) -> DataFrame:
    """A benign reference per row: ``(row_id, baseline, fallback)``.

    ``rows(row_id, features, protocol)``, ``train(row_id, features, y, protocol)``.  The
    nearest benign row of the same protocol, or any protocol (``fallback``) when
    there is none.  ``k > 1`` takes the per-feature median of the k nearest and, with
    a ``schema``, repairs it.
    """
    cand = train.filter(F.col("y") == benign).select(
        F.col("row_id").alias("candidate_id"), A.as_doubles(F.col("features")).alias("vector"), "protocol")
    if not cand.limit(1).count():
        raise ValueError("training data has no benign row")
    q = rows.select(F.col("row_id").alias("query_id"), A.as_doubles(F.col("features")).alias("vector"), "protocol")
    have = small_side(cand.select("protocol").distinct())
    hits = nearest_rows(q.join(have, "protocol", "left_semi"), cand, k, ["protocol"]).withColumn("fallback", F.lit(False))
    rest = q.join(have, "protocol", "left_anti")
    if rest.limit(1).count():
        hits = hits.union(nearest_rows(rest, cand, k).withColumn("fallback", F.lit(True)))
    if k <= 1:
        return hits.select(F.col("query_id").alias("row_id"), F.col("vector").alias("baseline"), "fallback")
    near = hits.groupBy("query_id").agg(F.collect_list("vector").alias("_v"), F.first("fallback").alias("fallback"))
    width = F.size(F.get("_v", F.lit(0)))
    median = F.transform(F.sequence(F.lit(0), width - 1), lambda i: A.median_of(
        F.transform("_v", lambda v: F.get(v, i))))
    out = near.select(F.col("query_id").alias("row_id"), median.alias("baseline"), "fallback")
    if schema is None:
        return out
    names = list(schema.features)
    return pack(enforce(unpack(out, "baseline", names), schema), names, "baseline")


def class_baselines(logits: DataFrame, classes: int) -> DataFrame:
    """Per class the training row whose logit is nearest to zero: ``(class_id, row_id, baseline)``.

    ``logits(row_id, features, logits)``; the smallest row id wins ties.  One pass,
    one aggregate per class, no copy of the rows.
    """
    best = [
        F.min_by(F.struct("row_id", F.col("features").alias("baseline")),
                 F.struct(F.abs(F.get("logits", F.lit(c))).alias("a"), F.col("row_id").alias("r"))).alias(f"_c{c}")
        for c in range(classes)
    ]
    cells = F.array(*[F.struct(F.lit(c).alias("class_id"), F.col(f"_c{c}").alias("b")) for c in range(classes)])
    return logits.agg(*best).select(F.explode(cells).alias("_x")).select("_x.class_id", "_x.b.row_id", "_x.b.baseline")
