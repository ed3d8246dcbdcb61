"""Shared helpers against brute force, with heavily skewed keys."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowaudit.functions import arrays as A, hashing as H, kernels as K, stats, tables as T, vectors as V


def skewed(spark, n=3000):
    """A third of all rows share one value and one group."""
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 7919 % 1000) / 10.0).alias("v"))


def test_exact_quantiles(spark):
    df = skewed(spark)
    pdf = df.toPandas()
    got = {(r["g"], r["prob"]): r["quantile"] for r in T.exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.99]).collect()}
    for g, part in pdf.groupby("g"):
        for p in (0.1, 0.5, 0.99):
            assert got[g, p] == pytest.approx(np.percentile(part["v"], p * 100), abs=1e-12)
    for accuracy in (7, 60, 10_000):  # groups bracketed closely, loosely, and as a whole
        for p in (0.0, 0.25, 0.5, 0.97, 1.0):
            whole = T.exact_quantiles(df, [], "v", [p], accuracy=accuracy).first()["quantile"]
            assert whole == pytest.approx(np.percentile(pdf["v"], p * 100))
    wild = df.withColumn("v", F.when(F.col("id") == 1, 1e300).otherwise(F.pow(F.col("v"), 7)))
    w = wild.toPandas()["v"]
    got = T.exact_quantiles(wild, [], "v", [0.5], accuracy=40).first()["quantile"]
    assert got == pytest.approx(np.median(w))


def test_quantiles_of_many_groups_stay_tables(spark, monkeypatch):
    """Medians of 20,000 groups; only the size check of the small side looks at groups on the driver."""
    monkeypatch.setattr(T, "small_side", lambda df, max_rows=0: df)
    df = spark.range(100_000).selectExpr("id % 20000 AS g", "cast(id * 7919 % 1009 AS double) AS v")
    got = T.exact_quantiles(df, ["g"], "v", [0.5]).toPandas().set_index("g")["quantile"]
    want = df.toPandas().groupby("g")["v"].median()
    assert len(got) == 20000 and (got.sort_index() == want.sort_index()).all()


def test_quantiles_skip_nulls(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,), (float("nan"),)], "v double")
    assert T.exact_quantiles(df, [], "v", [0.5]).first()["quantile"] == 3.0


def test_value_ranks(spark):
    df = skewed(spark)
    want = df.toPandas()["v"].rank()
    values = df.toPandas()["v"]
    for merged in ("true", "false"):  # one range partition, or as many as there are
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
        r = T.value_ranks(df, [], "v").toPandas().set_index("v")["avg_rank"]
        assert max(abs(r[v] - w) for v, w in zip(values, want)) < 1e-9
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_value_ranks_of_groups_cut_across_partitions(spark):
    """Groups, null and NaN keys among them, that range partitions and Arrow batches cut anywhere."""
    rows = [(None if k % 5 == 0 else float("nan") if k % 5 == 1 else float(k % 5), float(k * 31 % 97), k % 3) for k in range(1500)]
    df = spark.createDataFrame(rows, "g double, v double, w long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {(repr(r.g), r.v): (r.cnt, r.cnt_below, r.pos, r.pos_below, r.avg_rank) for r in T.value_ranks(df, ["g"], "v", {"pos": F.col("w")}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for g in {repr(r[0]) for r in rows}:
        mine = [r for r in rows if repr(r[0]) == g]
        for v in {r[1] for r in mine}:
            here, under = [r for r in mine if r[1] == v], [r for r in mine if r[1] < v]
            want[g, v] = (len(here), len(under), sum(r[2] for r in here), sum(r[2] for r in under), len(under) + (len(here) + 1) / 2)
    assert got == want


def test_smallest_per_group_is_exact_and_partition_independent(spark):
    df = skewed(spark)
    quota = df.groupBy("g").agg(F.floor(F.count("*") / 5).alias("n_take"))
    runs = []
    for parts in (1, 7):
        out = T.smallest_per_group(df.repartition(parts), ["g"], quota, 1, "id", buckets=16)
        assert out.count() == df.count()
        taken = out.filter("taken")
        counts = {r["g"]: r["count"] for r in taken.groupBy("g").count().collect()}
        assert counts == {r["g"]: r["n_take"] for r in quota.collect()}
        runs.append({r["id"] for r in taken.select("id").collect()})
    assert runs[0] == runs[1]


def test_small_side_falls_back_to_the_table(spark):
    df = spark.range(50)
    assert T.small_side(df, 10) is df
    assert T.small_side(df, 100).count() == 50


def test_hash_draws_do_not_depend_on_partitions(spark):
    draws = [
        sorted(spark.range(500).repartition(p).select(H.uniform(1, F.col("id"), F.lit("x")).alias("u"),
                                                      H.normal(1, F.col("id")).alias("n")).collect())
        for p in (1, 7)]
    assert draws[0] == draws[1]
    u = np.array([d[0] for d in draws[0]])
    n = np.array([d[1] for d in draws[0]])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.05
    assert abs(n.mean()) < 0.15 and abs(n.std() - 1) < 0.1


def test_array_helpers(spark):
    row = spark.createDataFrame([([3.0, -1.0, 3.0, 0.5], [1.0, 2.0, 3.0, 4.0])], "a array<double>, b array<double>").select(
        A.top_k(F.col("a"), 3).alias("top"), A.dot(F.col("a"), F.col("b")).alias("dot"),
        A.distance(F.col("a"), F.col("b"), "linf").alias("linf"), A.median_of(F.col("a")).alias("med"),
        A.softmax(F.col("b")).alias("soft"), A.argmax(F.col("a")).alias("arg"), A.variance(F.col("b")).alias("var")).first()
    assert row["top"] == [0, 2, 3] and row["dot"] == 12.0 and row["linf"] == 3.5 and row["med"] == 1.75
    assert sum(row["soft"]) == pytest.approx(1) and row["arg"] == 0 and row["var"] == 1.25


def test_rank_kernels_against_definitions():
    rng = np.random.default_rng(0)
    m = np.round(rng.normal(size=(20, 9)), 1)
    k = np.round(rng.normal(size=(20, 9)), 1)
    ra, rb = V.average_ranks(m), V.average_ranks(k)
    for row, got in zip(m, ra):
        want = [sum(w < v for w in row) + 0.5 * sum(w == v for w in row) + 0.5 for v in row]
        assert list(got) == want
    ok = np.ones(20, dtype=bool)
    tau = V.kendall(ra, rb, ok, chunk=50)
    for i in range(20):
        num = da = db = 0
        for x in range(9):
            for y in range(x):
                a, b = np.sign(m[i, x] - m[i, y]), np.sign(k[i, x] - k[i, y])
                num, da, db = num + a * b, da + abs(a), db + abs(b)
        assert tau[i] == pytest.approx(num / math.sqrt(da * db))
    assert V.spearman(ra, rb, ok)[3] == pytest.approx(np.corrcoef(ra[3], rb[3])[0, 1])
    assert V.top_mask(np.array([[1.0, 3.0, 3.0]]), 1).tolist() == [[False, True, False]]


def test_p_values():
    # exact signed-rank: all five differences positive -> 2 / 2^5
    assert stats.wilcoxon_p([1, 2, 3, 4, 5]) == pytest.approx(0.0625)
    assert stats.wilcoxon_p([0.0, 0.0]) == 1.0
    assert 0 < stats.wilcoxon_p([1, 1, -1, 2, 3, 3]) < 1
    # t distribution with 8 degrees of freedom, t = 2.306 -> p = 0.05
    r = 2.306004 / math.sqrt(8 + 2.306004**2)
    assert stats.correlation_p(r, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.correlation_p(1.0, 10) == 0.0


def test_ridge_recovers_weights():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = x @ np.array([1.0, -2.0, 0.5]) + 3
    coef, icpt, r2 = K.weighted_ridge(x, y, np.ones(400), 1e-9)
    assert coef == pytest.approx([1, -2, 0.5], abs=1e-6) and icpt == pytest.approx(3) and r2 == pytest.approx(1)


def test_sampled_coalitions_are_additive():
    masks, p, q = K.coalition_design(14, 400)
    rng = np.random.default_rng(2)
    w = rng.normal(size=14)
    y = masks @ w + 0.7
    phi = p @ (y - 0.7) + q * w.sum()
    assert phi == pytest.approx(w, abs=1e-8)


def test_null_groups_are_kept_at_every_size(spark):
    from flowaudit.functions import tables as T
    from flowaudit.operators import prep

    rows = [(i, None if i % 3 == 0 else f"g{i % 2}", float(i * 7 % 101)) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, y string, value double")
    assert {r.y for r in T.value_ranks(df, ["y"], "value").collect()} == {None, "g0", "g1"}
    quantiles = {(r.y, r.prob): r.quantile for r in T.exact_quantiles(df, ["y"], "value", [0.25, 0.5]).collect()}
    assert len(quantiles) == 6
    assert quantiles == {(r.y, r.prob): r.quantile for r in T.exact_quantiles(df, ["y"], "value", [0.25, 0.5], accuracy=50).collect()}
    run = T.with_running(df, ["y"], ["row_id"], sums={"s": F.col("value")})
    cut = T.with_running(df, ["y"], ["row_id"], sums={"s": F.col("value")}, chunk_rows=20)
    key = lambda d: sorted((r.row_id, r.pos, r.s) for r in d.collect())
    assert key(run) == key(cut) and len(key(run)) == 300
    assert prep.stratified_split(df, "y").count() == 300
