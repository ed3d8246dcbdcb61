"""Explainers against closed forms and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowaudit.functions import kernels as K
from flowaudit.operators import attacks as AT, constraints as C, explainers as X, models as M, neighbors as N
from flowaudit.operators import quality as Q, schemas as S

NAMES = ("proto", "duration", "bytes", "flags")
SCHEMA = S.FlowSchema("t", NAMES, protocol="proto", non_negative=NAMES[1:], discrete=("flags",))
LINEAR = M.LinearScorer(((0.0, 0.0, 0.0), (0.5, 0.0, 0.1), (0.3, 0.0, 0.1), (0.0, 0.8, 0.1)), (0.0, 0.0, 0.0))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int) + (x[:, 3] > 1)
    return spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))],
                                 "row_id bigint, y int, features array<double>").cache()


@pytest.fixture(scope="module")
def net(data):
    return M.export(M.feed_forward(data, 5, 3, (6,), 30))


@pytest.fixture(scope="module")
def forest(data):
    return M.export(M.random_forest(data, 4, 4))


def brute_shapley(f, x, background):
    d = len(x)
    value = {s: f(np.where(np.array(s, bool), x, background)).mean() for s in itertools.product((0, 1), repeat=d)}
    phi = np.zeros(d)
    for i in range(d):
        for s in value:
            if not s[i]:
                size = sum(s)
                w = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
                phi[i] += w * (value[s[:i] + (1,) + s[i + 1:]] - value[s])
    return phi


def test_exported_models_agree_with_spark(data):
    for model in (M.random_forest(data, 4, 4), M.boosted_trees(data, 3, 3, 3), M.feed_forward(data, 5, 3, (4,), 10)):
        both = M.score(model, data).withColumn("e", M.export(model).proba(F.col("features")))
        gap = F.max(F.array_max(F.zip_with("proba", "e", lambda a, b: F.abs(a - b))))
        assert both.select(gap).first()[0] < 1e-9


def test_tree_shap_equals_brute_force(data, forest):
    bg = X.background_matrix(X.background_rows(data, 12))
    rows = X.tree_shap(data.filter("row_id < 4"), forest, bg).collect()
    for r in rows:
        c = int(r["predicted_class"])
        want = brute_shapley(lambda z, c=c: forest.predict(z)[:, c], np.array(r["features"]), bg)
        assert r["attrs"] == pytest.approx(want, abs=1e-12)


def test_tree_interactions_equal_brute_force(forest, data):
    bg = X.background_matrix(X.background_rows(data, 6))
    x = np.array(data.first()["features"])
    got = K.tree_interactions(forest.trees, forest.weights, x[None], bg)[0, :, :, 1]
    d = len(x)
    f = lambda s: forest.predict(np.where(np.array(s, bool), x, bg))[:, 1].mean()
    for i, j in ((0, 1), (2, 4)):
        want = 0.0
        rest = [k for k in range(d) if k not in (i, j)]
        for bits in itertools.product((0, 1), repeat=d - 2):
            s = [0] * d
            for k, b in zip(rest, bits):
                s[k] = b
            on = lambda *ks: tuple(1 if k in ks else v for k, v in enumerate(s))  # noqa: E731,B023
            size = sum(bits)
            w = math.factorial(size) * math.factorial(d - size - 2) / (2 * math.factorial(d - 1))
            want += w * (f(on(i, j)) - f(on(i)) - f(on(j)) + f(on()))
        assert got[i, j] == pytest.approx(want, abs=1e-12) and got[j, i] == pytest.approx(want, abs=1e-12)


def test_kernel_shap_equals_tree_shap(data, forest):
    bg = X.background_matrix(X.background_rows(data, 12))
    few = data.filter("row_id < 5")
    a = {r["row_id"]: r["attrs"] for r in X.kernel_shap(few.select("row_id", "features"), forest, bg).collect()}
    for r in X.tree_shap(few, forest, bg).collect():
        assert a[r["row_id"]] == pytest.approx(r["attrs"], abs=1e-9)


def test_gradients_match_differences(net):
    x = np.random.default_rng(1).normal(size=(3, 5))
    t = np.array([0, 1, 2])
    for softmax in (True, False):
        f = net.predict if softmax else net.predict_logits
        g = net.gradient(x, t, softmax)
        for j in range(5):
            e = np.zeros(5)
            e[j] = 1e-6
            want = (f(x + e)[range(3), t] - f(x - e)[range(3), t]) / 2e-6
            assert g[:, j] == pytest.approx(want, abs=1e-6)


def test_path_methods_are_complete(data, net):
    for out in (X.integrated_gradients(data, net, 600), X.deeplift(data, net, softmax=False)):
        assert out.select(F.max(F.abs("convergence_delta"))).first()[0] < 1e-3
    bg = X.background_matrix(X.background_rows(data, 10))
    r = X.deep_shap(data, net, bg).first()
    z = net.predict_logits(np.array([r["features"]]))[0, int(r["predicted_class"])]
    assert sum(r["attrs"]) + r["expected_value"] == pytest.approx(z)


def test_sequential_path_shares_the_discrete_jump(spark):
    """Linear four-feature scorer, three classes, class baselines from the training rows."""
    train = spark.createDataFrame(
        [(0, [6.0, 100.0, 500.0, 3.0]), (1, [6.0, 110.0, 510.0, 2.0]), (2, [17.0, 50.0, 200.0, 0.0]),
         (3, [17.0, 60.0, 220.0, 0.0])], "row_id bigint, features array<double>")
    logits = train.withColumn("logits", LINEAR.logits(F.col("features")))
    bases = X.class_baseline_matrix(N.class_baselines(logits, 3), 3)
    assert bases[1].tolist() == [17.0, 50.0, 200.0, 0.0]
    one = spark.createDataFrame([(1, [17.0, 150.0, 600.0, 5.0])], "row_id bigint, features array<double>")
    r = X.sequential_gradients(one, LINEAR, SCHEMA, bases, 100).first()
    assert abs(r["convergence_delta"]) < 1e-3


def test_lime_finds_the_strong_feature(spark):
    names = ("proto", "duration", "pkt_max", "pkt_mean", "pkt_min")
    s = S.FlowSchema("t", names, protocol="proto", non_negative=names[1:],
                     ordered=(S.Ordered("pkt_max", "pkt_mean", "pkt_min"),))
    row = spark.createDataFrame([(1, 6.0, 100.0, 50.0, 30.0, 10.0)], "row_id bigint, " + ", ".join(f"{n} double" for n in names))
    scorer = M.LinearScorer(((0.0,), (0.1,), (0.5,), (0.0,), (0.0,)), (0.0,), "identity")
    r = X.protocol_lime(row, s, scorer, 500, 1.0).first()
    assert 2 in np.argsort(-np.abs(r["attrs"]))[:2] and r["r_squared"] > 0.9 and r["num_samples"] == 500


def test_background_rules(data):
    with pytest.raises(ValueError):
        X.background_rows(data, 10, benign=9)
    assert X.background_rows(data, 10, benign=0).count() == 10


def test_samples_do_not_depend_on_partitions(data):
    a = [sorted(r[0] for r in X.sample_rows(data.repartition(p), 20).select("row_id").collect()) for p in (1, 7)]
    assert a[0] == a[1]


def test_failed_explainer_is_reported(data, net):
    seen = []
    failed = X.explain_all(
        {"DNN_IG": lambda: X.integrated_gradients(data, net), "broken": lambda: 1 / 0}, lambda k, d: seen.append((k, d.count())))
    assert seen == [("DNN_IG", 120)] and failed[0][0] == "broken"


def test_sample_count_tuner(spark):
    """Explanations that agree from 20 samples on: 20 is chosen; none agrees: the largest is."""
    def explain(count, run):
        top = 0 if count >= 20 else run
        return spark.createDataFrame([(1, [1.0 if i == top else 0.01 * i for i in range(6)])], "row_id bigint, attrs array<double>")

    pick = lambda **k: X.stable_sample_count(explain, (10, 20, 40), 3, top_k=1, **k).filter("chosen").first()["num_samples"]
    assert pick() == 20
    assert pick(threshold=1.1) == 40


def test_attacks_stay_in_the_ball(data, net):
    unit = data.withColumn("features", F.transform("features", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / 4 + 0.5))))
    s = S.FlowSchema("t", tuple("abcde"), bounded=(S.Bounded("a", 0.2, 0.8),), discrete=("b",))
    scales = {n: (0.0, 1.0) for n in "abcde"}
    for schema in (None, s):
        adv = AT.adversarial_table(unit, net, "m", schema, scales, (0.1,), (0.1,), 4)
        assert adv.count() == 240
        worst = adv.select(F.max(F.array_max(F.zip_with("features", "original", lambda a, b: F.abs(a - b))))).first()[0]
        assert worst <= 0.1 + 1e-9


def test_faithfulness_drops_for_the_true_features(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    scorer = M.LinearScorer(((0.0, 3.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)), (0.0, 0.0))
    y = (x[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))],
                               "row_id bigint, y int, features array<double>")
    r = {row["k"]: row for row in Q.faithfulness(df, [1.0, 0.1, 0.05, 0.0], scorer, 2, (1,)).collect()}
    assert r[0]["f1"] == pytest.approx(1.0) and r[1]["f1_drop"] > 0.4 and r[1]["auc_drop"] == pytest.approx(0.5)


def test_importance_share_cases(spark):
    share = lambda a, t, rel: spark.createDataFrame([(a,)], "a array<double>").select(
        Q.importance_share(F.col("a"), t, rel)).first()[0]
    assert share([0.5, 0.001, -0.3, 0.005], 0.01, True) == 0.5
    assert share([0.001, 0.002], 0.01, False) == 0.0
    assert share([0.5, 0.005, -0.3], 0.01, False) == pytest.approx(2 / 3)


def test_constant_rows_have_no_stability(spark):
    df = spark.createDataFrame([(1, r, [2.0, 2.0]) for r in range(3)] + [(2, r, [1.0, 3.0]) for r in range(3)],
                               "row_id bigint, run int, attrs array<double>")
    r = {x["row_id"]: x for x in Q.stability(df, 1).collect()}
    assert r[1]["degenerate"] and r[1]["jaccard_mean"] is None and r[2]["jaccard_mean"] == 1.0


def test_missing_stored_metric_raises(spark):
    df = spark.createDataFrame([("k", 1, None)], "explainer_key string, row_id bigint, r_squared double")
    with pytest.raises(Exception, match="no r_squared"):
        Q.stored_metric(df, "fidelity").collect()


def test_unpack_pack_round_trip(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "row_id bigint, v array<double>")
    assert C.pack(C.unpack(df, "v", ["a.b", "c"]), ["a.b", "c"], "v").first()["v"] == [1.0, 2.0]
