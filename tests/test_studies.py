"""The composed audits on small tables."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowaudit.functions.vectors import _distance
from flowaudit.operators import attacks as AT, explainers as X, models as M, robustness as R, schemas as S
from flowaudit.plans import studies

SCORER = M.LinearScorer(tuple((w,) for w in (4.0, -3.0, 0.5, 0.0)), (0.1,), "sigmoid")


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(80, 4))
    y = (SCORER.predict(x)[:, 1] > 0.5).astype(int)
    return spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))],
                                 "row_id bigint, y int, features array<double>").cache()


def test_quality(samples):
    ig = X.integrated_gradients(samples, SCORER).select("row_id", "attrs")
    runs = {"LR_IG": ig.withColumn("run", F.explode(F.array(F.lit(0), F.lit(1))))}
    row = studies.quality_audit(samples, {"LR_IG": ig}, SCORER, 2, runs, k_values=(1, 2)).first()
    assert row["stability_jaccard_mean"] == 1.0
    assert row["f1_drop_k2"] > 0.2 and 0 < row["complexity_normalized"] < 1


def test_agreement(samples):
    names = ["duration", "src_bytes", "count", "land"]
    base = X.integrated_gradients(samples, SCORER)
    label = F.when(F.col("row_id") % 2 == 0, "neptune").otherwise("normal")
    one = base.select(F.lit("LR_IG").alias("explainer_key"), "row_id", label.alias("label"), "attrs")
    two = base.select(F.lit("LR_PA-IG"), "row_id", label, F.transform("attrs", lambda v, i: v * (i + 1)))
    out = studies.agreement_audit(one.union(two), "nsl-kdd", names, top_k=(2,))
    pair = out["pairs"].first()
    assert pair["pair_type"] == "cross-mode" and pair["n"] == 80 and 0 < pair["spearman_mean"] <= 1
    assert {r["label"] for r in out["by_class"].filter("not overall").collect()} == {"neptune"}
    assert {r["n_resolved"] for r in out["alignment"].collect()} == {3}  # srv_count resolves to count by containment and counts twice
    assert out["summary"].first()["total_pairs"] == 1


def test_robustness(samples):
    rules = S.FlowSchema("t", tuple("abcd"), bounded=(S.Bounded("a", 0.1, 0.9),))
    explain = lambda d: X.integrated_gradients(d, SCORER, 10)
    out = studies.robustness_audit(samples, SCORER, explain, {"free": (None, None), "ruled": (rules, dict.fromkeys("abcd", (0.0, 1.0)))},
                                   (0.05, 0.2), (0.1,), 3)
    success = {(r["mode"], r["attack"], r["epsilon"]): r["success"] for r in out["success"].collect()}
    assert len(success) == 6 and success["free", "fgsm", 0.2] >= success["free", "fgsm", 0.05]
    assert success["ruled", "fgsm", 0.2] <= success["free", "fgsm", 0.2]
    assert out["lipschitz"].count() == out["similarity"].count() == out["equivalence"].count() == 6


def test_selection(samples):
    fits = {"LR": lambda d: M.fit(M.LogisticRegression(maxIter=20), d)}
    out = studies.selection_audit(samples, samples, samples, 4, 2, {"PA-SHAP": [4.0, 3.0, 0.5, 0.0]}, fits, n=2)
    rows = {r["selection_method"]: r for r in out["benchmark"].collect()}
    assert rows["Full"]["accuracy"] > 0.9 and rows["PA-SHAP"]["method_class"] == "Protocol-aware"
    chosen = {r["feature_idx"] for r in out["selection"].filter("selected and method = 'Spearman'").collect()}
    assert chosen == {0, 1}


def test_attacked_pairs_as_joined(spark):
    """Pairs that travel together are those of the join: ids may repeat (with other features) or be null, values may be missing."""
    scorer = M.LinearScorer(((1.5,), (-2.0,), (0.75,)), (0.25,), "sigmoid")
    rows = [(i, i % 2, [i / 40, (i * 7 % 40) / 40, 0.5]) for i in range(30)]
    rows += [(3, 1, [0.9, 0.1, 0.2]), (3, 0, [0.9, 0.1, 0.2]), (None, 1, [0.3, 0.3, 0.3]), (40, 1, [None, 0.3, 0.3])]
    f = spark.createDataFrame(rows, "row_id long, y int, features array<double>")
    explain = lambda d: X.integrated_gradients(d, scorer)

    def attack(d, *keep):
        return AT.adversarial_table(d, scorer, "free", fgsm_epsilons=(0.1, 0.2), pgd_epsilons=(0.1,), steps=3, keep=keep)

    def found(pairs):
        near = lambda v: None if v is None else tuple(None if x is None or x != x else round(x, 9) for x in v)
        return Counter((r.row_id, r.mode, r.attack, r.epsilon, r.pred_clean, r.pred_adv, *[near(r[c]) for c in ("x_clean", "x_adv", "attr_clean", "attr_adv")])
                       for r in pairs.collect())

    joined = found(R.paired_explanations(f.select("row_id", "features"), attack(f), explain))
    assert joined and found(R.attacked_pairs(f, lambda d: attack(d, "attr_clean"), explain)) == joined
    unique = f.filter("row_id < 30 and row_id <> 3")
    pairs = R.attacked_pairs(unique, lambda d: attack(d, "attr_clean"), explain)
    assert found(pairs) == found(R.paired_explanations(unique.select("row_id", "features"), attack(unique), explain))
    assert "SortMergeJoin" not in pairs._jdf.queryExecution().executedPlan().toString()  # no shuffle of explained rows


def test_audit_without_stored_pairs(spark):
    """Storing nothing changes no metric, and the distances keep a missing value missing."""
    scorer = M.LinearScorer(((1.5,), (-2.0,), (0.75,)), (0.25,), "sigmoid")
    f = spark.createDataFrame([(i, i % 2, [i / 40, (i * 7 % 40) / 40, 0.5]) for i in range(40)], "row_id long, y int, features array<double>")
    audits = [studies.robustness_audit(f, scorer, lambda d: X.integrated_gradients(d, scorer), None, (0.1,), (0.1,), 3, store=s) for s in (True, False)]
    for name in audits[0]:
        one, two = ({r.attack: r.asDict() for r in a[name].collect()} for a in audits)
        assert one.keys() == two.keys() == {"fgsm", "pgd"}
        for k in one:
            assert two[k] == {c: v if v is None or isinstance(v, str) else pytest.approx(v, abs=1e-9) for c, v in one[k].items()}
    got = _distance(pa.array([[1.0, 2.0], None, [1.0, None], [float("nan"), 1.0]]), pa.array([[1.0, 5.0], [1.0, 1.0], [1.0, 1.0], [1.0, 1.0]])).to_pylist()
    assert got[:3] == [3.0, None, None] and got[3] != got[3]
