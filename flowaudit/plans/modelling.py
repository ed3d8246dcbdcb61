"""Queries on neighbourhoods, reference points, models, explainers and attacks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from flowaudit.functions import arrays as A
from flowaudit.functions.tables import stored
from flowaudit.functions.vectors import matrix
from flowaudit.operators import attacks as AT, constraints as C, explainers as X, models as M, neighbors as N
from flowaudit.operators import quality as Q, robustness as R, schemas as SC
from flowaudit.plans.inputs import (
    FLOW_BIAS, FLOW_FEATURES, FLOW_WEIGHTS, PART_FEATURES, PART_SQL, SCALED_SQL, SCALES, WEIGHT_SQL, flow_scorer,
    parts, scaled_flows, softmax_scorer, vectors,
)
from flowaudit.plans.registry import big, query, rounded

PART_RULES = SC.FlowSchema(
    "parts", PART_FEATURES, protocol="proto", non_negative=("size", "price"), tcp_only=("grade",), discrete=("grade",),
    bounded=(SC.Bounded("size", 0, 60),))
PART_WEIGHTS = (0.0, 0.1, 0.5, -0.3)


def part_scorer() -> M.LinearScorer:
    return M.LinearScorer(tuple((w,) for w in PART_WEIGHTS), (0.0,), "identity")


def part_vectors(spark, folder):
    p = parts(spark, folder)
    return p.select("row_id", "kind", "y", F.array(*PART_FEATURES).alias("features"))


# --- neighbourhoods and reference points --------------------------------------------------------


@query("neighbourhood", """
SELECT count(*) * 5 AS n, count(*) AS originals, 0 AS violations, 0 AS foreign_protocols, 0 AS foreign_grades FROM part""")
def neighbourhood(spark, folder):
    """Five copies of every part: no rule is broken and drawn values come from the training values."""
    p = parts(spark, folder).select("row_id", *PART_FEATURES)
    near = N.neighbourhood(p, PART_RULES, 5, 2.0, N.value_pools(p, PART_RULES))
    fixed = C.enforce(p, PART_RULES)
    same = near.filter("sample = 0").join(fixed, ["row_id", *PART_FEATURES]).agg(F.count("*").alias("originals"))
    broken = [F.when(b, 1).otherwise(0) for b in C.rule_predicates(PART_RULES).values()]
    counts = near.agg(
        F.count("*").alias("n"), big(F.sum(sum(broken, F.lit(0)))).alias("violations"),
        F.count(F.when(~F.col("proto").isin(1.0, 6.0, 17.0), 1)).alias("foreign_protocols"),
        F.count(F.when(~F.col("grade").isin(0.0, 1.0, 2.0, 3.0, 4.0), 1)).alias("foreign_grades"))
    return counts.join(same)


@query("neighbourhood_fixed_discrete", """
SELECT count(*) * 4 AS n, 0 AS changed_protocols, true AS spread FROM part""")
def neighbourhood_fixed_discrete(spark, folder):
    """Without training values the discrete columns stay and the noise has the asked-for spread."""
    p = parts(spark, folder).select("row_id", *PART_FEATURES)
    near = N.neighbourhood(p, PART_RULES, 4, {"size": 1.0, "price": 0.5}, repair=False)
    j = near.join(p.select("row_id", F.col("proto").alias("_p"), F.col("price").alias("_q")), "row_id")
    std = F.stddev(F.when(F.col("sample") > 0, F.col("price") - F.col("_q")))
    return j.agg(F.count("*").alias("n"), F.count(F.when(F.col("proto") != F.col("_p"), 1)).alias("changed_protocols"),
                 (F.abs(std - 0.5) < 0.05).alias("spread"))


NEAR_SQL = """
WITH e AS (SELECT vec_id, label % 2 AS p, label % 3 AS y, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT q.vec_id AS row_id, c.vec_id AS other, c.v,
             row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, c.v), c.vec_id) AS pos
      FROM e q JOIN e c ON q.p = c.p AND c.y = 0)
"""


@query("nearest_benign", NEAR_SQL + """
SELECT row_id, round(v[1], 6) AS b0, round(v[64], 6) AS b63, false AS fallback FROM d WHERE pos = 1""")
def nearest_benign(spark, folder):
    """The nearest benign vector of the same protocol for every vector."""
    v = vectors(spark, folder)
    r = N.reference_points(v, v, 0)
    return rounded(r.select("row_id", F.get("baseline", F.lit(0)).alias("b0"), F.get("baseline", F.lit(63)).alias("b63"),
                            "fallback"))


@query("nearest_benign_fallback", """
WITH e AS (SELECT vec_id, label % 2 AS p, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT q.vec_id AS row_id, q.p, c.v, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, c.v), c.vec_id) AS pos
      FROM e q JOIN e c ON c.label = 4)
SELECT row_id, round(v[1], 6) AS b0, p = 1 AS fallback FROM d WHERE pos = 1""")
def nearest_benign_fallback(spark, folder):
    """Benign rows exist for one protocol only; the others fall back to it and say so."""
    v = vectors(spark, folder)
    r = N.reference_points(v, v.withColumn("y", F.col("label")), 4)
    return rounded(r.select("row_id", F.get("baseline", F.lit(0)).alias("b0"), "fallback"))


@query("median_benign", NEAR_SQL + """
, m AS (SELECT row_id, i, median(v[i]) AS m FROM d, range(1, 65) t(i) WHERE pos <= 5 GROUP BY 1, 2)
SELECT row_id, round(max(m) FILTER (WHERE i = 1), 6) AS b0, round(sum(m), 6) AS total FROM m GROUP BY 1""")
def median_benign(spark, folder):
    """The per-feature median of the five nearest benign vectors."""
    v = vectors(spark, folder)
    r = N.reference_points(v, v, 0, 5)
    return rounded(r.select("row_id", F.get("baseline", F.lit(0)).alias("b0"), A.total(F.col("baseline")).alias("total")))


LOGIT_SQL = f"""
WITH cells AS (SELECT vec_id AS row_id, label % 3 AS y, i - 1 AS f, CAST(embedding[i] AS DOUBLE) AS v
               FROM embeddings, range(1, 65) t(i)),
logit AS (SELECT row_id, y, c, sum(v * {WEIGHT_SQL.format(f='f', c='c')}) AS z FROM cells, range(0, 3) t(c) GROUP BY 1, 2, 3)
"""


@query("class_baselines", LOGIT_SQL + """
SELECT c AS class_id, arg_min(row_id, abs(z)) AS row_id FROM logit GROUP BY 1""")
def class_baselines(spark, folder):
    """Per class the vector whose logit is nearest to zero."""
    scorer = M.LinearScorer(softmax_scorer().weights, softmax_scorer().bias, "identity")
    v = vectors(spark, folder).withColumn("logits", scorer.proba(F.col("features")))
    b = N.class_baselines(v, 3)
    return b.select(big("class_id").alias("class_id"), "row_id")


# --- models ---------------------------------------------------------------------------------------


WIDTH = 64
#: Background rows of the SHAP queries, as many as the reference's studies take.
BACKGROUND = 100


def _labelled(spark, folder):
    return vectors(spark, folder).select("row_id", "y", "features")


def _agree(model, df):
    """Largest difference between the JVM route and the exported scorer."""
    both = M.score(model, df).withColumn("_e", M.export(model).proba(F.col("features")))
    gap = F.array_max(F.zip_with("proba", "_e", lambda a, b: F.abs(a - b)))
    return both.agg(F.count("*").alias("n"), (F.max(gap) < 1e-9).alias("routes_agree"))


SAME_SQL = "SELECT count(*) AS n, true AS routes_agree FROM embeddings"


@query("random_forest", SAME_SQL)
def random_forest(spark, folder):
    d = _labelled(spark, folder)
    return _agree(M.random_forest(d), d)


@query("boosted_trees", """
SELECT count(*) AS n, 300 AS rounds, round(ln(3e0), 6) AS loss_at_start, true AS loss_falls, true AS loss_is_scored, true AS beats_majority FROM embeddings""")
def boosted_trees(spark, folder):
    """Before the first round all three classes are equally likely; the last loss is that of the exported trees."""
    d = _labelled(spark, folder)
    model = M.boosted_trees(d, 3)
    start, end = model.history[0], model.history[-1]
    scored = M.score(model, d)
    loss = F.avg(-F.log(F.get("proba", F.col("y").cast("int"))))
    largest = d.groupBy("y").count().agg(F.max("count").alias("largest"))
    out = scored.agg(F.count("*").alias("n"), loss.alias("loss"), F.count(F.when(F.col("pred") == F.col("y"), 1)).alias("hits")).crossJoin(F.broadcast(largest))
    return rounded(out.select(
        "n", F.lit(len(model.history) - 1).cast("bigint").alias("rounds"), F.lit(start).alias("loss_at_start"), F.lit(end < start).alias("loss_falls"),
        (F.abs(F.col("loss") - end) < 1e-9).alias("loss_is_scored"), (F.col("hits") > F.col("largest")).alias("beats_majority")))


@query("feed_forward", SAME_SQL)
def feed_forward(spark, folder):
    d = _labelled(spark, folder)
    return _agree(M.feed_forward(d, WIDTH, 3), d)


@query("single_feature_classifier", SAME_SQL)
def single_feature_classifier(spark, folder):
    d = _labelled(spark, folder)
    return _agree(M.single_feature_classifier(d, 2, 20), d.withColumn("features", F.array(F.get("features", F.lit(2)))))


@query("kernel_svm")
def kernel_svm(spark, folder):
    """Class counts predicted by the kernel machine."""
    d = _labelled(spark, folder)
    model, lift = M.kernel_svm(d, WIDTH)
    return M.score(model, d.withColumn("features", lift(F.col("features")))).groupBy("pred").agg(F.count("*").alias("n"))


@query("perturbation_detector")
def perturbation_detector(spark, folder):
    """Share of real and shuffled vectors the detector calls perturbed."""
    d = _labelled(spark, folder)
    names = [f"x{i}" for i in range(WIDTH)]
    real = C.unpack(d.select("row_id", "features"), "features", names)
    shuffled = C.pack(R.marginal_shuffle(real, real, names), names)
    model = M.perturbation_detector(d, shuffled)
    both = d.select("row_id", "features", F.lit(0).alias("perturbed")).unionByName(
        shuffled.select("row_id", "features", F.lit(1).alias("perturbed")))
    return M.score(model, both).groupBy("perturbed").agg(F.avg(F.get("proba", F.lit(1))).alias("mean_alpha"))


@query("linear_scores", f"""
WITH {SCALED_SQL},
p AS (SELECT y, 1 / (1 + exp(-({FLOW_BIAS}e0 + {' + '.join(f'({w}e0) * x{i}' for i, w in enumerate(FLOW_WEIGHTS))}))) AS p FROM scaled)
SELECT y, round(avg(p), 6) AS p1, round(avg(1 - p), 6) AS p0, count(*) FILTER (WHERE p > 0.5) AS pred1 FROM p GROUP BY 1""")
def linear_scores(spark, folder):
    f = scaled_flows(spark, folder).withColumn("p", flow_scorer().proba(F.col("features")))
    p = lambda i: F.get("p", F.lit(i))
    return rounded(f.groupBy("y").agg(F.avg(p(1)).alias("p1"), F.avg(p(0)).alias("p0"),
                                      F.count(F.when(A.argmax(F.col("p")) == 1, 1)).alias("pred1")))


@query("padded_probabilities", f"""
WITH {SCALED_SQL} SELECT y, round(avg(x1), 6) AS c0, 0e0 AS c1, round(avg(x0), 6) AS c2, 0e0 AS c3 FROM scaled GROUP BY 1""")
def padded_probabilities(spark, folder):
    """A model that knows classes 2 and 0 reports all four classes."""
    f = scaled_flows(spark, folder).withColumn("p", M.pad_probabilities(F.col("features"), [2, 0], 4))
    return rounded(f.groupBy("y").agg(*[F.avg(F.get("p", F.lit(i))).alias(f"c{i}") for i in range(4)]))


# --- explainers -----------------------------------------------------------------------------------


@query("linear_shap", f"""
WITH {PART_SQL}, m AS (SELECT avg(size) AS s, avg(price) AS p, avg(grade) AS g FROM parts)
SELECT row_id, 0e0 AS a_proto, round(0.1e0 * (size - s), 6) + 0.0 AS a_size, round(0.5e0 * (price - p), 6) + 0.0 AS a_price,
       round(-0.3e0 * (grade - g), 6) + 0.0 AS a_grade FROM parts, m""")
def linear_shap(spark, folder):
    p = part_vectors(spark, folder)
    x = X.linear_shap(p.select("row_id", "features"), part_scorer(), p)
    return rounded(x.select("row_id", *[F.get("attrs", F.lit(i)).alias(f"a_{n}") for i, n in enumerate(PART_FEATURES)]))


def _centroids(spark, folder):
    """One background row per part type (as many rows as types)."""
    p = parts(spark, folder).groupBy("kind").agg(*[F.avg(c).alias(c) for c in PART_FEATURES])
    return X.background_matrix(p.orderBy("kind").select(F.array(*PART_FEATURES).alias("features")))


@query("kernel_shap_linear", f"""
WITH {PART_SQL}, k AS (SELECT kind, avg(size) AS s, avg(price) AS p, avg(grade) AS g FROM parts GROUP BY 1),
m AS (SELECT avg(s) AS s, avg(p) AS p, avg(g) AS g FROM k)
SELECT row_id, 0e0 AS a_proto, round(0.1e0 * (size - s), 6) + 0.0 AS a_size, round(0.5e0 * (price - p), 6) + 0.0 AS a_price,
       round(-0.3e0 * (grade - g), 6) + 0.0 AS a_grade, round(0.1e0 * s + 0.5e0 * p - 0.3e0 * g, 6) AS expected_value FROM parts, m""")
def kernel_shap_linear(spark, folder):
    """Coalition estimates equal the closed form for a linear score."""
    x = X.kernel_shap(part_vectors(spark, folder).select("row_id", "features"), part_scorer(), _centroids(spark, folder))
    return rounded(x.select("row_id", *[F.get("attrs", F.lit(i)).alias(f"a_{n}") for i, n in enumerate(PART_FEATURES)],
                            "expected_value"))


@query("kernel_shap_repaired", "SELECT count(*) AS n, true AS additive FROM part")
def kernel_shap_repaired(spark, folder):
    """Coalitions repaired at the row's protocol: attributions still sum to the repaired output's change."""
    p = part_vectors(spark, folder).select("row_id", "features")
    bg = _centroids(spark, folder)
    x = X.kernel_shap(p, part_scorer(), bg, PART_RULES).select("row_id", "attrs", "expected_value")
    rows = C.pack(C.enforce(C.unpack(p, "features", list(PART_FEATURES)), PART_RULES), list(PART_FEATURES))
    f_x = F.get(part_scorer().proba(F.col("features")), F.lit(0))
    j = x.join(rows.select("row_id", f_x.alias("f_x")), "row_id")
    gap = F.abs(A.total(F.col("attrs")) + F.col("expected_value") - F.col("f_x"))
    return j.agg(F.count("*").alias("n"), (F.max(gap) < 1e-6).alias("additive"))


@query("protocol_lime", "SELECT count(*) AS n, 4 AS width, true AS fitted FROM part")
def protocol_lime(spark, folder):
    """Local surrogates of a linear score fit almost perfectly."""
    x = X.protocol_lime(parts(spark, folder).select("row_id", *PART_FEATURES), PART_RULES, part_scorer(), sigma=1.0)
    return x.agg(F.count("*").alias("n"), big(F.max(F.size("attrs"))).alias("width"),
                 (F.min("r_squared") > 0.9).alias("fitted"))


@query("quartile_lime", "SELECT count(*) AS n, 4 AS width, 0 AS beyond_kept FROM part")
def quartile_lime(spark, folder):
    p = parts(spark, folder)
    bins = X.quartile_bins(p, list(PART_FEATURES))
    x = X.quartile_lime(p, bins, flow_scorer(), kept=3)
    nonzero = F.size(F.filter("attrs", lambda v: v != 0))
    return x.agg(F.count("*").alias("n"), big(F.max(F.size("attrs"))).alias("width"),
                 F.count(F.when(nonzero > 3, 1)).alias("beyond_kept"))


@query("stable_sample_count")
def stable_sample_count(spark, folder):
    """Agreement of repeated explanations per sample count, and the chosen count."""
    p = parts(spark, folder)
    bins = X.quartile_bins(p, list(PART_FEATURES))
    explain = lambda counts, runs: X.quartile_lime_counts(p, bins, flow_scorer(), counts, runs, 3)
    return X.stable_sample_count(explain, top_k=2, at_once=True)


def _forest(spark, folder):
    d = _labelled(spark, folder)
    return d, M.export(M.random_forest(d)), X.background_matrix(X.background_rows(d, BACKGROUND))


@query("tree_shap", "SELECT count(*) AS n, true AS additive FROM embeddings")
def tree_shap(spark, folder):
    """Attributions plus the expected value give the predicted class's probability."""
    d, forest, bg = _forest(spark, folder)
    x = X.tree_shap(d, forest, bg)
    p = F.get(forest.proba(F.col("features")), F.col("predicted_class").cast("int"))
    gap = F.abs(A.total(F.col("attrs")) + F.col("expected_value") - p)
    return x.agg(F.count("*").alias("n"), (F.max(gap) < 1e-9).alias("additive"))


@query("tree_interactions", "SELECT count(*) * 64 AS n, true AS sums_to_shap, true AS symmetric FROM embeddings")
def tree_interactions(spark, folder):
    """Interaction rows sum to the Shapley values and the matrix is symmetric."""
    d, forest, bg = _forest(spark, folder)
    cells = X.tree_interactions(d, forest, bg)
    # every cell in one pass: to the sum of its row i and, from the first row, as the mirror image of cell (j, 0)
    own = F.struct("i", F.col("v").alias("s"), F.when(F.col("j") == 0, F.col("v")).alias("a"), F.lit(None).cast("double").alias("b"), F.lit(0).alias("first"))
    none = F.lit(None).cast("double")
    mirror = F.struct(F.col("j").alias("i"), none.alias("s"), none.alias("a"), F.col("v").alias("b"), F.lit(1).alias("first"))
    both = cells.select("row_id", F.explode(F.when(F.col("i") == 0, F.array(own, mirror)).otherwise(F.array(own))).alias("c")).select("row_id", "c.*")
    sums = both.groupBy("row_id", "i").agg(
        F.sum("s").alias("s"), F.max("a").alias("a"), F.min("b").alias("least"), F.max("b").alias("most"), F.sum("first").alias("times"))
    phi = X.tree_shap(d, forest, bg).select("row_id", F.posexplode("attrs").alias("i", "phi"))
    j = sums.join(phi, ["row_id", "i"])
    apart = F.greatest(F.abs(F.col("a") - F.col("least")), F.abs(F.col("a") - F.col("most")))
    return j.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n"), (F.max(F.abs(F.col("s") - F.col("phi"))) < 1e-9).alias("sums_to_shap"),
                 (F.max(apart) < 1e-9).alias("symmetric"))


def _net(spark, folder):
    d = _labelled(spark, folder)
    return d, M.export(M.feed_forward(d, WIDTH, 3))


@query("deep_shap", "SELECT count(*) AS n, true AS additive FROM embeddings")
def deep_shap(spark, folder):
    d, net = _net(spark, folder)
    bg = X.background_matrix(X.background_rows(d, BACKGROUND))
    x = X.deep_shap(d, net, bg)
    logits = _logits(x, net)
    gap = F.abs(A.total(F.col("attrs")) + F.col("expected_value") - F.get("z", F.col("predicted_class").cast("int")))
    return logits.agg(F.count("*").alias("n"), (F.max(gap) < 1e-9).alias("additive"))


def _logits(df, net):
    @F.pandas_udf("array<double>")
    def logits(batch: pd.Series) -> pd.Series:
        return pd.Series(list(net.predict_logits(matrix(batch))))

    return df.withColumn("z", logits("features"))


@query("integrated_gradients_logistic", f"""
WITH {SCALED_SQL},
s AS (SELECT y, x0, x1, x2, x3, {' + '.join(f'({w}e0) * x{i}' for i, w in enumerate(FLOW_WEIGHTS))} AS s FROM scaled),
g AS (SELECT *, CASE WHEN {FLOW_BIAS} + s > 0 THEN 1 ELSE -1 END
        * (1 / (1 + exp(-({FLOW_BIAS}e0 + s))) - 1 / (1 + exp(-{FLOW_BIAS}e0))) / s AS g FROM s WHERE abs(s) > 1e-9)
SELECT y, count(*) AS n, {', '.join(f'round(avg(g * ({w}e0) * x{i}), 6) AS a{i}' for i, w in enumerate(FLOW_WEIGHTS))}
FROM g GROUP BY 1""")
def integrated_gradients_logistic(spark, folder):
    """Path gradients of a logistic score against their closed form."""
    x = X.integrated_gradients(scaled_flows(spark, folder).select("y", "features"), flow_scorer(), 30)
    return rounded(x.groupBy("y").agg(F.count("*").alias("n"), *[
        F.avg(F.get("attrs", F.lit(i))).alias(f"a{i}") for i in range(4)]))


@query("integrated_gradients", "SELECT count(*) AS n, true AS complete FROM embeddings")
def integrated_gradients(spark, folder):
    d, net = _net(spark, folder)
    return _complete(X.integrated_gradients(d, net))


def _complete(x):
    return x.agg(F.count("*").alias("n"), (F.max(F.abs("convergence_delta")) < 1e-3).alias("complete"))


@query("sequential_gradients", "SELECT count(*) AS n, true AS complete FROM embeddings")
def sequential_gradients(spark, folder):
    """The two-phase path from each class's near-zero vector adds up as well."""
    d, net = _net(spark, folder)
    bases = X.class_baseline_matrix(N.class_baselines(_logits(d, net).withColumnRenamed("z", "logits"), 3), 3)
    schema = SC.FlowSchema("v", tuple(f"x{i}" for i in range(WIDTH)), discrete=("x1", "x5"))
    return _complete(X.sequential_gradients(d, net, schema, bases))


@query("deeplift", "SELECT count(*) AS n, true AS complete FROM embeddings")
def deeplift(spark, folder):
    d, net = _net(spark, folder)
    return _complete(X.deeplift(d, net, softmax=False))


@query("deeplift_class_baseline", "SELECT count(*) AS n, true AS complete FROM embeddings")
def deeplift_class_baseline(spark, folder):
    d, net = _net(spark, folder)
    bases = X.class_baseline_matrix(N.class_baselines(_logits(d, net).withColumnRenamed("z", "logits"), 3), 3)
    return _complete(X.deeplift(d, net, bases, softmax=False))


@query("predicted_class_values", """
SELECT vec_id AS row_id, round(CAST(embedding[label % 3 * 2 + 1] AS DOUBLE), 6) AS a0,
       round(CAST(embedding[label % 3 * 2 + 2] AS DOUBLE), 6) AS a1 FROM embeddings""")
def predicted_class_values(spark, folder):
    """The predicted class's vector out of per-class attributions."""
    v = vectors(spark, folder)
    per_class = F.array(*[F.slice("features", 2 * c + 1, 2) for c in range(3)])
    picked = v.select("row_id", X.class_values(per_class, F.col("y")).alias("a"))
    return rounded(picked.select("row_id", F.get("a", F.lit(0)).alias("a0"), F.get("a", F.lit(1)).alias("a1")))


@query("ablation_interactions", f"""
WITH {PART_SQL}, m AS (SELECT avg(size) AS s, avg(price) AS p, avg(grade) AS g FROM parts)
SELECT 1 AS i, 1 AS j, round(avg(abs(0.1e0 * (size - s))), 6) AS strength FROM parts, m
UNION ALL SELECT 2, 2, round(avg(abs(0.5e0 * (price - p))), 6) FROM parts, m
UNION ALL SELECT 3, 3, round(avg(abs(0.3e0 * (grade - g))), 6) FROM parts, m""")
def ablation_interactions(spark, folder):
    """For a linear score only the ablated feature's own attribution moves."""
    p = part_vectors(spark, folder).select("row_id", "features")
    explain = lambda rows: X.linear_shap(rows, part_scorer(), p)
    v = X.ablation_interactions(p, explain, 4)
    s = v.groupBy(big("i").alias("i"), big("j").alias("j")).agg(F.avg(F.abs("v")).alias("strength"))
    return rounded(s.filter("strength > 1e-12"))


@query("explanation_union", """
SELECT k AS explainer_key, count(*) AS n FROM embeddings, (SELECT unnest(['DNN_IG', 'DNN_DeepLIFT', 'RF_SHAP']) AS k) GROUP BY 1""")
def explanation_union(spark, folder):
    """Several explainers over the same rows as one explanation table."""
    d, net = _net(spark, folder)
    _, forest, bg = _forest(spark, folder)
    u = X.union_explanations({
        "DNN_IG": X.integrated_gradients(d, net), "DNN_DeepLIFT": X.deeplift(d, net), "RF_SHAP": X.tree_shap(d, forest, bg)})
    return u.groupBy("explainer_key").agg(F.count("*").alias("n"))


@query("completeness", "SELECT CASE WHEN count(*) > 0 THEN 1e0 END AS completeness_success_rate, 100 + count(*) AS "
       "completeness_total_tested, 100 + count(*) AS completeness_successes FROM embeddings")
def completeness(spark, folder):
    """Explaining zeros, extremes and corrupted rows never fails."""
    d, net = _net(spark, folder)
    bad = Q.corrupted_inputs(d, WIDTH)
    return Q.completeness(X.integrated_gradients(bad, net, 50).select("block", "attrs"))


@query("explainer_robustness", "SELECT count(*) AS n, true AS stable FROM part")
def explainer_robustness(spark, folder):
    """Attributions of a linear score hardly move under rule-abiding mutations of the row."""
    p = parts(spark, folder).select("row_id", *PART_FEATURES)
    mutants = N.neighbourhood(p, PART_RULES, 3, 0.05).filter("sample > 0")
    explain = lambda d: X.integrated_gradients(C.pack(d, list(PART_FEATURES)), flow_scorer())
    r = Q.semantic_robustness(explain(p), explain(mutants.withColumnRenamed("sample", "copy")))
    return r.agg(F.count("*").alias("n"), (F.avg("robustness") > 0.7).alias("stable"))


# --- attacks ----------------------------------------------------------------------------------------

_Z = f"({FLOW_BIAS}e0 + " + " + ".join(f"({w}e0) * {{p}}{i}" for i, w in enumerate(FLOW_WEIGHTS)) + ")"
FGSM_SQL = f"""
WITH {SCALED_SQL}, eps AS (SELECT CAST(unnest([0.01, 0.05, 0.1, 0.2, 0.3]) AS DOUBLE) AS epsilon),
adv AS (SELECT epsilon, y, x0, x1, x2, x3, {', '.join(
    f'greatest(0, least(1, x{i} + epsilon * (CASE WHEN y = 1 THEN -1 ELSE 1 END) * ({1 if w > 0 else -1}))) AS a{i}'
    for i, w in enumerate(FLOW_WEIGHTS))} FROM scaled, eps)
"""


@query("fgsm_success", FGSM_SQL + f"""
SELECT 'plain' AS mode, 'fgsm' AS attack, epsilon,
       round(avg(CASE WHEN (1 / (1 + exp(-{_Z.format(p='x')})) > 0.5e0) <> (1 / (1 + exp(-{_Z.format(p='a')})) > 0.5e0)
                      THEN 1.0 ELSE 0.0 END), 6) AS success,
       round(max(greatest({', '.join(f'abs(a{i} - x{i})' for i in range(4))})), 6) AS linf, count(*) AS n
FROM adv GROUP BY 3""")
def fgsm_success(spark, folder):
    """Share of flipped predictions per strength of the one-step attack."""
    scorer = flow_scorer()
    adv = AT.fgsm(scaled_flows(spark, folder), scorer)
    adv = adv.select(F.lit("plain").alias("mode"), "attack", "epsilon", "original", "features",
                     A.argmax(scorer.proba(F.col("original"))).alias("pred_clean"),
                     A.argmax(scorer.proba(F.col("features"))).alias("pred_adv"))
    return rounded(R.attack_success(adv))


ATTACK_RULES = SC.FlowSchema("scaled", FLOW_FEATURES, bounded=(SC.Bounded("price", 2000, 90000),), discrete=("quantity",))


@query("pgd_success")
def pgd_success(spark, folder):
    """The iterated attack, free and held to the rules."""
    scorer = flow_scorer()
    f = scaled_flows(spark, folder)
    both = AT.adversarial_table(f, scorer, "unconstrained", vectors=False).unionByName(
        AT.adversarial_table(f, scorer, "constrained", ATTACK_RULES, SCALES, vectors=False))
    return R.attack_success(both)


@query("pgd_inside_ball", """
SELECT 0.05e0 AS epsilon, count(*) AS n, 0 AS outside FROM lineitem UNION ALL SELECT 0.1e0, count(*), 0 FROM lineitem""")
def pgd_inside_ball(spark, folder):
    """Every attacked row stays in its ball and in [0, 1]."""
    adv = AT.pgd(scaled_flows(spark, folder), flow_scorer(), (0.05, 0.1))
    out = A.distance(F.col("features"), F.col("original"), "linf") > F.col("epsilon") + 1e-9
    out = out | (F.array_max("features") > 1) | (F.array_min("features") < 0)
    return adv.groupBy("epsilon").agg(F.count("*").alias("n"), F.count(F.when(out, 1)).alias("outside"))


@query("robustness_of_explainer")
def robustness_of_explainer(spark, folder):
    """Clean and attacked rows explained in one pass, then all three robustness metrics."""
    scorer = flow_scorer()
    f = scaled_flows(spark, folder)
    attack = lambda d: AT.fgsm(d, scorer).select(
        F.lit("unconstrained").alias("mode"), "attack", "epsilon", "row_id", "original", "features", "attr_clean",
        A.argmax(scorer.proba(F.col("original"))).alias("pred_clean"),
        A.argmax(scorer.proba(F.col("features"))).alias("pred_adv"))
    # attacked and explained once, without a shuffle; the three metrics read it about seven times
    pairs = stored(R.attacked_pairs(f, attack, lambda d: X.integrated_gradients(d, scorer)), "explained-pairs")
    by = ["mode", "attack", "epsilon"]
    lip = R.lipschitz(pairs, by).select(*by, "lipschitz_max", "lipschitz_mean", "lipschitz_median")
    sim = R.explanation_similarity(pairs, by).select(*by, "similarity_satisfaction_rate", "cosine_similarity_mean")
    eq = R.classification_equivalence(pairs, by).select(*by, "prediction_preserving_rate", "rank_correlation_mean")
    return lip.join(sim, by).join(eq, by)


@query("integrity_blend", f"""
WITH {SCALED_SQL},
p AS (SELECT y, x2 AS alpha, x3 AS d, 1 / (1 + exp(-{_Z.format(p='x')})) AS p1 FROM scaled),
q AS (SELECT y, alpha, p1, exp(-5 * d * d) AS e0, exp(-5 * (d - 1) * (d - 1)) AS e1 FROM p),
b AS (SELECT y, p1, p1 * (1 - alpha) + e1 / (e0 + e1) * alpha AS b1 FROM q)
SELECT y, round(avg(b1), 6) AS p1, round(avg(CASE WHEN (b1 > 0.5) = (p1 > 0.5) THEN 1.0 ELSE 0.0 END), 6) AS agreement,
       round(avg(CASE WHEN CAST(b1 > 0.5 AS INT) = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM b GROUP BY 1""")
def integrity_blend(spark, folder):
    """A scorer that answers from the decoy where the detector suspects a probe."""
    f = scaled_flows(spark, folder)
    p = flow_scorer().proba(F.col("features"))
    f = f.withColumn("p", p).withColumn("b", R.integrity_blend(
        F.col("p"), F.get("features", F.lit(2)), F.get("features", F.lit(3)), 2))
    rows = f.select("y", F.get("b", F.lit(1)).alias("p1"), A.argmax(F.col("b")).alias("pred_wrapper"),
                    A.argmax(F.col("p")).alias("pred_model"))
    a = R.wrapper_agreement(rows, ["y"])
    return rounded(a.join(rows.groupBy("y").agg(F.avg("p1").alias("p1")), "y"))
