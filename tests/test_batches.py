"""Rules, draws and surrogates inside batches against their column or row-by-row forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowaudit.functions import arrays as A, kernels as K, samples as S
from flowaudit.operators import attacks as AT, constraints as C, explainers as X, models as M, schemas as SC
from flowaudit.operators.rule_program import FeasibleProjection, RuleProgram

NAMES = ("proto", "a", "b", "c", "std", "ratio", "sum", "sq", "same", "tcp", "udp", "conn", "twin")
SCHEMA = SC.FlowSchema(
    "t", NAMES, protocol="proto", non_negative=("a", "b", "tcp"), ordered=(SC.Ordered("c", "b", "a"),), spread=(SC.Spread("std", "c", "a"),),
    derived=(SC.Derived("sum", "sum_ratio", ("a", "b", "c")), SC.Derived("ratio", "ratio", ("sum", "b"), 2.0), SC.Derived("sq", "square", ("std",)),
             SC.Derived("same", "equal", ("a",))),
    bounded=(SC.Bounded("a", 0.1, 3), SC.Bounded("conn", -1, 1)), discrete=("udp", "b"), tcp_only=("tcp",), udp_only=("udp",), connection_only=("conn",),
    duplicates=(("a", "twin"),))


def rows(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(scale=3.0, size=(n, len(NAMES)))
    x[:, 0] = rng.choice([1.0, 6.0, 17.0], n)
    x[rng.random(x.shape) < 0.1] = 0.0
    return x


def test_rule_program_equals_columns(spark):
    x = rows()
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "row_id bigint, " + ", ".join(f"{n} double" for n in NAMES))
    got = C.pack(C.enforce(df, SCHEMA), list(NAMES)).orderBy("row_id").collect()
    assert np.array_equal(np.array([r.features for r in got]), RuleProgram(SCHEMA)(x))


def test_projection_equals_columns(spark):
    scales = {n: (-2.0, 4.0) for n in NAMES} | {"proto": (1.0, 17.0), "same": (1.0, 1.0)}
    rng = np.random.default_rng(2)
    o = rng.random((200, len(NAMES)))
    x, eps = np.clip(o + rng.normal(scale=0.2, size=o.shape), 0, 1), rng.choice([0.05, 0.1], (200, 1))
    df = spark.createDataFrame([(k, a.tolist(), b.tolist(), float(e)) for k, (a, b, e) in enumerate(zip(x, o, eps[:, 0]))],
                               "row_id bigint, features array<double>, original array<double>, epsilon double")
    got = C.project_feasible(df, SCHEMA, scales, F.col("epsilon")).orderBy("row_id").collect()
    assert np.allclose(np.array([r.features for r in got]), FeasibleProjection(SCHEMA, scales)(x, o, eps), atol=1e-12)


def test_draws_are_prefixes_and_look_normal():
    ids = np.array([5, -3, 9])
    many, few = S.normals(7, ids, np.arange(1, 4000), 3, 0), S.normals(7, ids[1:2], np.arange(1, 50), 3, 0)
    assert np.array_equal(many[1:2, :49], few)
    assert abs(many.mean()) < 0.02 and abs(many.std() - 1) < 0.02
    assert abs(np.corrcoef(many[0, :, 0], many[0, :, 1])[0, 1]) < 0.06 and not np.array_equal(S.normals(7, ids, np.arange(1, 9), 3, 0, 1), many[:, :8])
    u = S.uniforms(7, ids, np.arange(20000), 1, 0)
    assert abs(np.histogram(u, 10, (0, 1))[0] / 6000 - 1).max() < 0.1


@pytest.mark.parametrize("alpha", [0.01, 1.0])
def test_ridge_from_sums(alpha):
    rng = np.random.default_rng(3)
    x, y, w = rng.normal(size=(4, 60, 5)), rng.normal(size=(4, 60)), rng.random((4, 60))
    y[2] = 1.0  # constant
    parts = [S.moments(x[:, a:b], y[:, a:b], w[:, a:b]) for a, b in ((0, 10), (10, 60))]
    sums = tuple(a + b for a, b in zip(*parts))
    coef, icpt, r2 = S.ridge(sums, alpha)
    top = np.array([[0, 2]] * 4)
    for k in range(4):
        want = K.weighted_ridge(x[k], y[k], w[k], alpha)
        assert np.allclose(coef[k], want[0]) and np.isclose(icpt[k], want[1]) and np.isclose(r2[k], want[2], atol=1e-9)
        assert np.allclose(S.ridge(S.chosen(sums, top), alpha)[0][k], K.weighted_ridge(x[k][:, [0, 2]], y[k], w[k], alpha)[0])


def test_counts_are_prefixes_of_one_pass(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(k, *map(float, rng.normal(size=3))) for k in range(40)], "row_id bigint, a double, b double, c double")
    bins = X.quartile_bins(df, ["a", "b", "c"])
    scorer = M.LinearScorer(((2.0,), (-0.5,), (0.0,)), (0.1,), "sigmoid")
    got = {(r.num_samples, r.run, r.row_id): r for r in X.quartile_lime_counts(df, bins, scorer, (60, 300), (0, 1), 2).collect()}
    assert len(got) == 160
    for count, run in ((60, 1), (300, 0)):
        for r in X.quartile_lime(df, bins, scorer, count, 2, run=run).collect():
            assert np.allclose(r.attrs, got[count, run, r.row_id].attrs) and r.num_samples == count
            assert sum(v != 0 for v in r.attrs) <= 2 and r.predicted_class in (0.0, 1.0)
    strong = [np.argmax(np.abs(r.attrs)) for (c, _, _), r in got.items() if c == 300]
    assert np.mean(np.array(strong) == 0) > 0.9


def test_protocol_lime_equals_one_row_fits(spark):
    """The batch's surrogate against a ridge on the same copies, drawn, repaired and scored one row at a time."""
    x = rows(6, 4)
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "row_id bigint, " + ", ".join(f"{n} double" for n in NAMES))
    rng = np.random.default_rng(1)
    scorer = M.LinearScorer(tuple(map(tuple, rng.normal(size=(len(NAMES), 3)) / 9)), (0.0, 0.1, 0.2))
    moving = [NAMES.index(n) for n in SCHEMA.continuous]
    for r in X.protocol_lime(df, SCHEMA, scorer, 400, 0.5, seed=3).collect():
        near = np.repeat(x[r.row_id][None], 400, axis=0)
        near[1:, moving] += 0.5 * S.normals(3, np.array([r.row_id]), np.arange(1, 400), len(moving), 0)[0]
        near = RuleProgram(SCHEMA)(near)
        p = scorer.predict(near)
        cls = int(p[0].argmax())
        w = np.exp(-((near - near[0]) ** 2).sum(1) / (2 * (0.75 * np.sqrt(len(NAMES))) ** 2))
        coef, icpt, r2 = K.weighted_ridge(near, p[:, cls], w, 1.0)
        assert np.allclose(r.attrs, coef, atol=1e-8) and np.isclose(r.intercept, icpt) and np.isclose(r.r_squared, r2, atol=1e-7)
        assert r.predicted_class == cls and np.isclose(r.local_prediction, near[0] @ coef + icpt)


def test_constrained_attack_is_feasible(spark):
    s = SC.FlowSchema("t", ("a", "b", "c"), bounded=(SC.Bounded("a", 0.3, 0.6),), non_negative=("c",))
    scales = {n: (0.0, 1.0) for n in "abc"}
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, int(k % 2), (0.3 + 0.3 * rng.random(3)).tolist()) for k in range(50)], "row_id bigint, y int, features array<double>")
    scorer = M.LinearScorer(((3.0,), (-2.0,), (1.0,)), (-0.4,), "sigmoid")
    got = AT.pgd(df, scorer, (0.05, 0.1), 20, schema=s, scales=scales).collect()
    assert len(got) == 100
    for r in got:
        x, o = np.array(r.features), np.array(r.original)
        assert np.abs(x - o).max() <= r.epsilon + 1e-12 and 0.3 - 1e-12 <= x[0] <= 0.6 + 1e-12
        # a linear score's worst case is a corner of the ball, cut by the range of a
        way = np.where(r.y == 1, -1, 1) * np.sign([3.0, -2.0, 1.0])
        want = np.clip(o + r.epsilon * way, 0, 1)
        want[0] = np.clip(want[0], 0.3, 0.6)
        assert np.allclose(x, want, atol=1e-9)


def _full_tree(rng, depth, width):
    """A tree with all splits to ``depth``, features repeating on paths."""
    nodes = 2 ** (depth + 1) - 1
    inner = np.arange(nodes) < 2**depth - 1
    left = np.where(inner, 2 * np.arange(nodes) + 1, -1)
    return M.Tree(np.where(inner, rng.integers(0, width, nodes), -1), np.where(inner, rng.normal(scale=0.5, size=nodes), 0.0), left,
                  np.where(inner, left + 1, -1), rng.random((nodes, 3)))


def test_leaf_values_by_tables_and_by_masks():
    rng = np.random.default_rng(5)
    trees, bg, x = [_full_tree(rng, 5, 7) for _ in range(3)], rng.normal(size=(9, 7)), rng.normal(size=(40, 7))
    x[0, 2], bg[0, 1] = np.nan, np.nan
    target = rng.integers(0, 3, len(x))
    tabled, masked = K.LeafTable(trees, (0.5, 0.3, 0.2), bg), K.LeafTable(trees, (0.5, 0.3, 0.2), bg)
    masked.PLACES = 0
    assert np.allclose(tabled.shapley(x, target), masked.shapley(x, target), atol=1e-12)
    assert np.allclose(tabled.interactions(x, target), masked.interactions(x, target), atol=1e-12)
    assert np.allclose(tabled.interactions(x)[np.arange(len(x)), :, :, target], masked.interactions(x, target), atol=1e-12)


def test_leaf_values_need_bounded_memory_and_time():
    import time
    import tracemalloc

    rng = np.random.default_rng(6)
    table = K.LeafTable([_full_tree(rng, 10, 64)], (1.0,), rng.normal(size=(100, 64)))
    x, target = rng.normal(size=(3000, 64)), rng.integers(0, 3, 3000)
    tracemalloc.start()
    table.shapley(x, target)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20  # all pairs of masks took 0.7 GB and more
    start = time.process_time()
    table.interactions(x[:40], target[:40])
    assert time.process_time() - start < 20  # cell by cell of each leaf took about 100 s


def test_draws_make_few_arrays():
    import tracemalloc

    ids, samples = np.arange(20), np.arange(1, 5000)
    S.normals(1, ids, samples, 4, 0)
    tracemalloc.start()
    out = S.normals(1, ids, samples, 4, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4.2 * out.nbytes and X.COPY_CELLS * 8 <= 2 << 20  # blocks near the size of the caches


def test_robustness_metrics_read_stored_pairs(spark, tmp_path):
    """Attack, explanation and join are not part of the metrics' plan, which runs them once for each scan."""
    from flowaudit.plans import modelling

    spark.range(40).selectExpr(
        "id as l_orderkey", "id % 7 as l_partkey", "id % 3 as l_suppkey", "cast(id % 4 as int) as l_linenumber", "cast(id % 50 + 1 as double) as l_quantity",
        "900.0D + id * 100 as l_extendedprice", "id % 10 / 100.0D as l_discount", "id % 8 / 100.0D as l_tax", "if(id % 2 = 0, 'R', 'A') as l_returnflag",
        "'F' as l_linestatus", "date'2020-01-01' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = modelling.robustness_of_explainer(spark, str(tmp_path))
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 5


def test_adversarial_table_equals_its_attacks(spark):
    """One pass gives what the two attacks, the scorer's columns and the distance give one by one, with and without vectors."""
    rng = np.random.default_rng(8)
    # multiples of 1/8 and such weights: many scores lie exactly on the border between the classes
    df = spark.createDataFrame([(k, int(k % 2), (rng.integers(0, 9, 3) / 8).tolist()) for k in range(200)], "row_id bigint, y int, features array<double>")
    scorer = M.LinearScorer(((0.5,), (-1.0,), (0.25,)), (0.125,), "sigmoid")
    s, scales = SC.FlowSchema("t", ("a", "b", "c"), bounded=(SC.Bounded("a", 0.25, 0.75),)), {n: (0.0, 1.0) for n in "abc"}
    for rules in ({}, {"schema": s, "scales": scales}):
        both = AT.fgsm(df, scorer, **rules).unionByName(AT.pgd(df, scorer, **rules))
        label = lambda c: A.argmax(scorer.proba(F.col(c)))
        want = both.select("attack", "epsilon", "row_id", "features", "original", label("original").alias("pred_clean"), label("features").alias("pred_adv"),
                           A.distance(F.col("features"), F.col("original"), "linf").alias("linf"))
        order = lambda r: (r.attack, r.epsilon, r.row_id)
        want = sorted(want.collect(), key=order)
        got = AT.adversarial_table(df, scorer, "m", **rules)
        assert [tuple(r) for r in sorted(got.select(*want[0].asDict()).collect(), key=order)] == [tuple(r) for r in want] and len(want) == 1600
        bare = AT.adversarial_table(df, scorer, "m", vectors=False, **rules)
        assert "features" not in bare.columns and "original" not in bare.columns
        assert sorted(bare.collect()) == sorted(got.select(*bare.columns).collect())
