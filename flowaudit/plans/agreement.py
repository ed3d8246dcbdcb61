"""Queries on attribution tables: quality, agreement, alignment, interactions, robustness."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from flowaudit.functions import arrays as A
from flowaudit.operators import alignment as AL, consensus as C, interactions as I, quality as Q, robustness as R
from flowaudit.operators import selection as S
from flowaudit.plans.inputs import EXPL_SQL, WEIGHT_SQL, explanations, softmax_scorer, vectors
from flowaudit.plans.registry import big, query, rounded, table

# --- agreement -----------------------------------------------------------------------------

RANKS_SQL = f"""
WITH {EXPL_SQL},
ranked AS (
  SELECT k, row_id, label, f, abs(v) AS a,
         rank() OVER (PARTITION BY k, row_id ORDER BY abs(v))
           + (count(*) OVER (PARTITION BY k, row_id, abs(v)) - 1) / CAST(2 AS DOUBLE) AS r,
         row_number() OVER (PARTITION BY k, row_id ORDER BY abs(v) DESC, f) AS pos
  FROM expl),
pairs AS (
  SELECT a.k AS explainer_a, b.k AS explainer_b, a.row_id, a.label, corr(a.r, b.r) AS rho,
         sum(CASE WHEN a.pos <= 5 AND b.pos <= 5 THEN 1 ELSE 0 END) / CAST(5 AS DOUBLE) AS top5,
         sum(CASE WHEN a.pos <= 10 AND b.pos <= 10 THEN 1 ELSE 0 END) / CAST(10 AS DOUBLE) AS top10
  FROM ranked a JOIN ranked b ON a.row_id = b.row_id AND a.f = b.f AND a.k < b.k
  GROUP BY 1, 2, 3, 4)
"""


@query("consensus_per_attack", RANKS_SQL + """
SELECT explainer_a, explainer_b, coalesce(CAST(label AS VARCHAR), 'all') AS attack, count(*) AS n,
       round(avg(rho), 6) AS spearman_mean, round(stddev_pop(rho), 6) AS spearman_std,
       round(avg(top5), 6) AS top5, round(avg(top10), 6) AS top10
FROM pairs GROUP BY GROUPING SETS ((explainer_a, explainer_b), (explainer_a, explainer_b, label))
HAVING grouping(label) = 1 OR count(*) >= 10""")
def consensus_per_attack(spark, folder):
    """Overall and per-class agreement of every explainer pair in one pass."""
    rows = C.row_agreement(explanations(spark, folder), kendall=False)
    a = C.agreement_by_class(rows)
    return rounded(a.select("explainer_a", "explainer_b", F.coalesce(F.col("label").cast("string"), F.lit("all")).alias(
        "attack"), "n", "spearman_mean", "spearman_std", "top5", "top10"))


@query("consensus_pairs", RANKS_SQL + """
SELECT explainer_a, explainer_b, count(*) AS n, round(avg(rho), 6) AS spearman_mean,
       round(stddev_pop(rho), 6) AS spearman_std, round(avg(top5), 6) AS top5, round(avg(top10), 6) AS top10,
       CASE WHEN explainer_a LIKE '%PA-%' AND explainer_b LIKE '%PA-%' THEN 'within-pa'
            WHEN explainer_a LIKE '%PA-%' OR explainer_b LIKE '%PA-%' THEN 'cross-mode'
            ELSE 'within-normal' END AS pair_type
FROM pairs GROUP BY 1, 2""")
def consensus_pairs(spark, folder):
    return rounded(C.pair_agreement(C.row_agreement(explanations(spark, folder), kendall=False)))


KENDALL_SQL = f"""
WITH {EXPL_SQL},
signs AS (
  SELECT x.k, x.row_id, x.f AS f, y.f AS g, sign(abs(x.v) - abs(y.v)) AS s
  FROM expl x JOIN expl y ON x.k = y.k AND x.row_id = y.row_id AND x.f < y.f),
taus AS (
  SELECT a.k AS explainer_a, b.k AS explainer_b, a.row_id,
         sum(a.s * b.s) / sqrt(CAST(sum(abs(a.s)) AS DOUBLE) * CAST(sum(abs(b.s)) AS DOUBLE)) AS tau
  FROM signs a JOIN signs b ON a.row_id = b.row_id AND a.f = b.f AND a.g = b.g AND a.k < b.k
  GROUP BY 1, 2, 3)
"""


@query("consensus_kendall", KENDALL_SQL + """
SELECT explainer_a, explainer_b, count(*) AS n, round(avg(tau), 6) AS kendall_mean,
       round(stddev_pop(tau), 6) AS kendall_std FROM taus GROUP BY 1, 2""")
def consensus_kendall(spark, folder):
    p = C.pair_agreement(C.row_agreement(explanations(spark, folder), top_k=()))
    return rounded(p.select("explainer_a", "explainer_b", "n", "kendall_mean", "kendall_std"))


IMPORTANCE_SQL = f"""
WITH {EXPL_SQL},
imp AS (SELECT k, f, avg(abs(v)) AS importance FROM expl GROUP BY 1, 2)
"""
WILCOXON_SQL = IMPORTANCE_SQL + """,
d AS (SELECT a.k AS explainer_a, b.k AS explainer_b, a.importance - b.importance AS d
      FROM imp a JOIN imp b ON a.f = b.f AND a.k < b.k),
r AS (SELECT *, rank() OVER (PARTITION BY explainer_a, explainer_b ORDER BY abs(d))
        + (count(*) OVER (PARTITION BY explainer_a, explainer_b, abs(d)) - 1) / CAST(2 AS DOUBLE) AS rk
      FROM d WHERE d <> 0)
"""


@query("wilcoxon_statistic", WILCOXON_SQL + """
SELECT explainer_a, explainer_b,
       round(least(coalesce(sum(rk) FILTER (WHERE d > 0), 0.0), coalesce(sum(rk) FILTER (WHERE d < 0), 0.0)), 6)
         AS wilcoxon_statistic
FROM r GROUP BY 1, 2""")
def wilcoxon_statistic(spark, folder):
    w = C.wilcoxon(C.mean_importance(explanations(spark, folder)))
    return rounded(w.select("explainer_a", "explainer_b", "wilcoxon_statistic"))


NORMAL_SQL = """
q AS (SELECT explainer_a, explainer_b, least(w, n * (n + 1) / 2.0 - w) AS w, n, abs((least(w, n * (n + 1) / 2.0 - w) - n * (n + 1) / 4.0)
        / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0)) AS z
      FROM (SELECT explainer_a, explainer_b, coalesce(sum(rk) FILTER (WHERE d > 0), 0.0) AS w, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY 1, 2)
      JOIN (SELECT explainer_a, explainer_b, sum(t * t * t - t) AS ties
            FROM (SELECT explainer_a, explainer_b, abs(d), CAST(count(*) AS DOUBLE) AS t FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2)
      USING (explainer_a, explainer_b)),
p AS (SELECT explainer_a, explainer_b, w, 1 - 2 / sqrt(2 * pi()) * max(z) / 6000 * sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
        * exp(-(z * i / 2000) * (z * i / 2000) / 2)) AS p
      FROM q, range(0, 2001) t(i) GROUP BY 1, 2, 3)
"""


@query("wilcoxon_test", WILCOXON_SQL + "," + NORMAL_SQL + """
SELECT explainer_a, explainer_b, round(w, 6) AS wilcoxon_statistic, round(p, 6) + 0.0 AS wilcoxon_p_value, p < 0.05 AS wilcoxon_reject_h0 FROM p""")
def wilcoxon_test(spark, folder):
    """Statistic, p-value (64 features: the normal law, integrated by Simpson's rule in the twin) and rejection per explainer pair."""
    return rounded(C.wilcoxon(C.mean_importance(explanations(spark, folder))))


def _full_pairs(spark, folder):
    e = explanations(spark, folder)
    return C.pair_agreement(C.row_agreement(e)).join(
        F.broadcast(C.wilcoxon(C.mean_importance(e))), ["explainer_a", "explainer_b"])


@query("consensus_summary", KENDALL_SQL + """,
ranked AS (
  SELECT k, row_id, f, rank() OVER (PARTITION BY k, row_id ORDER BY abs(v))
    + (count(*) OVER (PARTITION BY k, row_id, abs(v)) - 1) / CAST(2 AS DOUBLE) AS r FROM expl),
rhos AS (SELECT a.k AS explainer_a, b.k AS explainer_b, a.row_id, corr(a.r, b.r) AS rho
         FROM ranked a JOIN ranked b ON a.row_id = b.row_id AND a.f = b.f AND a.k < b.k GROUP BY 1, 2, 3),
t AS (SELECT explainer_a, explainer_b, avg(tau) AS m FROM taus GROUP BY 1, 2),
s AS (SELECT explainer_a, explainer_b, avg(rho) AS m FROM rhos GROUP BY 1, 2)
SELECT CASE WHEN s.explainer_a LIKE '%PA-%' OR s.explainer_b LIKE '%PA-%' THEN 'cross-mode'
            ELSE 'within-normal' END AS pair_type,
       round(avg(s.m), 6) AS consensus_mean_spearman, round(avg(t.m), 6) AS consensus_mean_kendall,
       count(*) AS total_pairs
FROM s JOIN t USING (explainer_a, explainer_b) GROUP BY 1""")
def consensus_summary(spark, folder):
    s = C.agreement_summary(_full_pairs(spark, folder), ["pair_type"])
    return rounded(s.drop("n_significant_divergences"))


@query("consensus_matrix", RANKS_SQL + """,
m AS (SELECT explainer_a AS a, explainer_b AS b, avg(rho) AS v FROM pairs GROUP BY 1, 2)
SELECT a, b, round(v, 6) AS value FROM m UNION ALL SELECT b, a, round(v, 6) FROM m
UNION ALL SELECT DISTINCT k, k, 1.0 FROM expl""")
def consensus_matrix(spark, folder):
    p = C.pair_agreement(C.row_agreement(explanations(spark, folder), kendall=False))
    return rounded(C.symmetric_matrix(p, "spearman_mean"))


@query("consensus_shorter_width", f"""
WITH {EXPL_SQL},
cut AS (SELECT * FROM expl WHERE k <> 'DNN_IG' AND f < 40),
ranked AS (
  SELECT k, row_id, f, rank() OVER (PARTITION BY k, row_id ORDER BY abs(v))
    + (count(*) OVER (PARTITION BY k, row_id, abs(v)) - 1) / CAST(2 AS DOUBLE) AS r FROM cut),
rhos AS (SELECT a.row_id, corr(a.r, b.r) AS rho FROM ranked a JOIN ranked b
         ON a.row_id = b.row_id AND a.f = b.f AND a.k < b.k GROUP BY 1)
SELECT count(*) AS n, round(avg(rho), 6) AS spearman_mean FROM rhos""")
def consensus_shorter_width(spark, folder):
    """Explainers over different feature sets are compared on the shared features."""
    e = explanations(spark, folder).filter(F.col("explainer_key") != "DNN_IG")
    e = e.withColumn("attrs", F.when(F.col("explainer_key") == "RF_SHAP", F.slice("attrs", 1, 40)).otherwise(
        F.col("attrs")))
    p = C.pair_agreement(C.row_agreement(e, kendall=False))
    return rounded(p.select("n", "spearman_mean"))


# --- quality -------------------------------------------------------------------------------


@query("top_features", f"""
WITH {EXPL_SQL},
r AS (SELECT k, f, row_number() OVER (PARTITION BY k, row_id ORDER BY abs(v) DESC, f) AS rank FROM expl)
SELECT k AS explainer_key, rank, f AS feature_idx, count(*) AS n FROM r WHERE rank <= 5 GROUP BY 1, 2, 3""")
def top_features(spark, folder):
    t = Q.top_features(explanations(spark, folder), 5)
    return t.groupBy("explainer_key", big("rank").alias("rank"), big("feature_idx").alias("feature_idx")).agg(
        F.count("*").alias("n"))


@query("top_features_signed", f"""
WITH {EXPL_SQL},
r AS (SELECT k, f, row_number() OVER (PARTITION BY k, row_id ORDER BY v DESC, f) AS rank FROM expl)
SELECT k AS explainer_key, f AS feature_idx, count(*) AS n FROM r WHERE rank <= 3 GROUP BY 1, 2""")
def top_features_signed(spark, folder):
    t = Q.top_features(explanations(spark, folder), 3, absolute=False)
    return t.groupBy("explainer_key", big("feature_idx").alias("feature_idx")).agg(F.count("*").alias("n"))


@query("attribution_map", f"""
WITH {EXPL_SQL}
SELECT k AS explainer_key, row_id, round(v, 6) AS f7 FROM expl WHERE f = 7""")
def attribution_map(spark, folder):
    m = Q.as_map(explanations(spark, folder), [f"f{i}" for i in range(64)])
    return rounded(m.select("explainer_key", "row_id", F.col("attributions")["f7"].alias("f7")))


@query("importance_share", f"""
WITH {EXPL_SQL},
m AS (SELECT k, row_id, abs(v) AS a, max(abs(v)) OVER (PARTITION BY k, row_id) AS top FROM expl),
s AS (SELECT k, row_id, avg(CASE WHEN a > top * 0.2e0 THEN 1.0 ELSE 0.0 END) AS rel,
             avg(CASE WHEN a > 0.1e0 THEN 1.0 ELSE 0.0 END) AS absolute FROM m GROUP BY 1, 2)
SELECT k AS explainer_key, round(avg(rel), 6) AS relative_share, round(avg(absolute), 6) AS absolute_share
FROM s GROUP BY 1""")
def importance_share(spark, folder):
    e = explanations(spark, folder)
    return rounded(e.groupBy("explainer_key").agg(
        F.avg(Q.importance_share(F.col("attrs"), 0.2)).alias("relative_share"),
        F.avg(Q.importance_share(F.col("attrs"), 0.1, False)).alias("absolute_share")))


SPARSITY_SQL = f"""
WITH {EXPL_SQL},
m AS (SELECT k, abs(v) / max(abs(v)) OVER (PARTITION BY k, row_id) AS s FROM expl),
taus AS (SELECT i / CAST(10 AS DOUBLE) AS tau FROM range(0, 11) t(i)),
curve AS (SELECT k AS explainer_key, tau, avg(CASE WHEN s < tau THEN 1.0 ELSE 0.0 END) AS sparsity
          FROM m, taus GROUP BY 1, 2)
"""


@query("sparsity_curve", SPARSITY_SQL + "SELECT explainer_key, tau, round(sparsity, 6) AS sparsity FROM curve")
def sparsity_curve(spark, folder):
    return rounded(Q.sparsity_curve(explanations(spark, folder)))


COMPLEXITY_SQL = """
p AS (SELECT k, row_id, abs(v) / sum(abs(v)) OVER (PARTITION BY k, row_id) AS p FROM expl),
h AS (SELECT k, row_id, -sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) AS h FROM p GROUP BY 1, 2),
cx AS (SELECT k AS explainer_key, avg(h) AS complexity_mean_entropy, stddev_pop(h) AS complexity_std_entropy,
              avg(h) / 6 AS complexity_normalized FROM h GROUP BY 1)
"""


@query("complexity", f"""
WITH {EXPL_SQL}, {COMPLEXITY_SQL}
SELECT explainer_key, round(complexity_mean_entropy, 6) AS complexity_mean_entropy,
       round(complexity_std_entropy, 6) AS complexity_std_entropy,
       round(complexity_normalized, 6) AS complexity_normalized FROM cx""")
def complexity(spark, folder):
    return rounded(Q.complexity(explanations(spark, folder)))


@query("all_metrics", SPARSITY_SQL + f""", {COMPLEXITY_SQL}
SELECT explainer_key, round(max(sparsity) FILTER (WHERE abs(tau - 0.1) < 1e-9), 6) AS sparsity_mean,
       round(max(sparsity) FILTER (WHERE abs(tau - 0.5) < 1e-9), 6) AS "sparsity_tau_0.5",
       round(max(complexity_mean_entropy), 6) AS complexity_mean_entropy,
       round(max(complexity_normalized), 6) AS complexity_normalized
FROM curve JOIN cx USING (explainer_key) GROUP BY 1""")
def all_metrics(spark, folder):
    """One wide row per explainer from the single metrics."""
    e = explanations(spark, folder)
    wide = Q.wide_metrics([Q.sparsity_wide(Q.sparsity_curve(e)), Q.complexity(e)])
    return rounded(wide.select("explainer_key", "sparsity_mean", "`sparsity_tau_0.5`", "complexity_mean_entropy",
                               "complexity_normalized"))


@query("stability", f"""
WITH {EXPL_SQL},
r AS (SELECT k, row_id, f, row_number() OVER (PARTITION BY k, row_id ORDER BY abs(v) DESC, f) AS pos FROM expl),
o AS (SELECT a.row_id, a.k AS ka, b.k AS kb, count(*) FILTER (WHERE a.pos <= 10 AND b.pos <= 10) AS c
      FROM r a JOIN r b ON a.row_id = b.row_id AND a.f = b.f AND a.k < b.k GROUP BY 1, 2, 3)
SELECT row_id, round(avg(c / CAST(20 - c AS DOUBLE)), 6) AS jaccard_mean,
       round(min(c / CAST(20 - c AS DOUBLE)), 6) AS jaccard_min FROM o GROUP BY 1""")
def stability(spark, folder):
    """The three explainers taken as repeated runs of one."""
    runs = explanations(spark, folder).withColumnRenamed("explainer_key", "run")
    return rounded(Q.stability(runs, 10).drop("degenerate"))


@query("semantic_robustness", f"""
WITH {EXPL_SQL},
r AS (SELECT k, row_id, f, rank() OVER (PARTITION BY k, row_id ORDER BY v)
        + (count(*) OVER (PARTITION BY k, row_id, v) - 1) / CAST(2 AS DOUBLE) AS r FROM expl),
c AS (SELECT a.row_id, b.k, corr(a.r, b.r) AS rho FROM r a JOIN r b
      ON a.row_id = b.row_id AND a.f = b.f AND a.k = 'RF_SHAP' AND b.k <> 'RF_SHAP' GROUP BY 1, 2)
SELECT row_id, round(avg(rho), 6) AS robustness FROM c GROUP BY 1""")
def semantic_robustness(spark, folder):
    e = explanations(spark, folder)
    base = e.filter("explainer_key = 'RF_SHAP'").select("row_id", "attrs")
    other = e.filter("explainer_key <> 'RF_SHAP'").select("row_id", F.col("explainer_key").alias("copy"), "attrs")
    return rounded(Q.semantic_robustness(base, other))


@query("local_accuracy", f"""
WITH {EXPL_SQL},
s AS (SELECT k, row_id, sum(v) AS total FROM expl GROUP BY 1, 2),
w AS (SELECT a.k, a.row_id, abs(a.total - b.total) AS err, abs(b.total) AS want
      FROM s a JOIN s b ON a.row_id = b.row_id AND b.k = 'RF_SHAP')
SELECT k AS explainer_key, bool_and(err <= 1e-2 + 1e-5 * want) AS completeness_axiom_valid,
       round(avg(err), 6) AS completeness_axiom_mae,
       round(avg(CASE WHEN err <= 1e-2 + 1e-5 * want THEN 1.0 ELSE 0.0 END), 6) AS completeness_axiom_pass_rate
FROM w GROUP BY 1""")
def local_accuracy(spark, folder):
    e = explanations(spark, folder)
    model = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"), A.total(A.as_doubles(F.col("embedding"))).alias("f_x"),
        F.lit(0.0).alias("f_0"))
    return rounded(Q.local_accuracy(e.join(model, "row_id"), ["explainer_key"]))


@query("efficiency", """
SELECT event_type AS explainer_key, round(sum(value) * 1000.0 / count(*), 4) AS time_per_sample_ms,
       round(sum(value), 4) AS total_time_s, round(count(*) / sum(value), 4) AS samples_per_second
FROM events GROUP BY 1""")
def efficiency(spark, folder):
    timing = table(spark, folder, "events").groupBy(F.col("event_type").alias("explainer_key")).agg(
        F.count("*").alias("n"), F.sum("value").alias("total_s"))
    return rounded(Q.efficiency(timing), 4)


@query("stored_metric", """
SELECT vec_id AS row_id, round(CAST(embedding[1] AS DOUBLE), 6) AS fidelity FROM embeddings""")
def stored_metric(spark, folder):
    e = table(spark, folder, "embeddings").select(
        F.lit("PA-LIME").alias("explainer_key"), F.col("vec_id").alias("row_id"),
        F.get("embedding", F.lit(0)).cast("double").alias("r_squared"))
    return rounded(Q.stored_metric(e, "fidelity").drop("explainer_key"))


ORDER = "row_number() OVER (ORDER BY importance DESC, f)"
FAITHFUL_SQL = f"""
WITH {EXPL_SQL},
imp AS (SELECT f, avg(abs(v)) AS importance, {ORDER.replace('importance', 'avg(abs(v))')} AS pos
        FROM expl WHERE k = 'RF_SHAP' GROUP BY f),
means AS (SELECT f, avg(v) AS m FROM expl WHERE k = 'RF_SHAP' GROUP BY f),
x AS (SELECT row_id, label % 3 AS y, f, v FROM expl WHERE k = 'RF_SHAP')
"""
FAITH_SCORES = FAITHFUL_SQL + f""",
ks AS (SELECT unnest([0, 5, 10, 15]) AS k),
ab AS (SELECT ks.k, x.row_id, x.y, x.f, CASE WHEN imp.pos <= ks.k THEN means.m ELSE x.v END AS v
       FROM ks, x JOIN imp USING (f) JOIN means USING (f)),
logit AS (SELECT k, row_id, y, c, sum(v * {WEIGHT_SQL.format(f='f', c='c')}) AS z
          FROM ab, range(0, 3) t(c) GROUP BY 1, 2, 3, 4),
mx AS (SELECT *, max(z) OVER (PARTITION BY k, row_id) AS zm FROM logit),
prob AS (SELECT k, row_id, y, c, exp(z - zm) / sum(exp(z - zm)) OVER (PARTITION BY k, row_id) AS p FROM mx),
pred AS (SELECT k, row_id, y, arg_max(c, p) AS pred FROM prob GROUP BY 1, 2, 3),
cls AS (SELECT k, c, count(*) FILTER (WHERE y = c) AS support, count(*) FILTER (WHERE pred = c) AS predicted,
               count(*) FILTER (WHERE y = c AND pred = c) AS tp FROM pred, range(0, 3) t(c) GROUP BY 1, 2),
f1 AS (SELECT k, sum(2.0 * tp / (support + predicted) * support) / sum(support) AS f1 FROM cls GROUP BY 1),
rk AS (SELECT k, c, y, rank() OVER (PARTITION BY k, c ORDER BY p)
         + (count(*) OVER (PARTITION BY k, c, p) - 1) / CAST(2 AS DOUBLE) AS r FROM prob),
au AS (SELECT k, c, count(*) FILTER (WHERE y = c) AS np, count(*) FILTER (WHERE y <> c) AS nn,
              sum(r) FILTER (WHERE y = c) AS s FROM rk GROUP BY 1, 2),
auc AS (SELECT k, sum((s - np * (np + 1) / 2.0) / (CAST(np AS DOUBLE) * nn) * np) / sum(np) AS auc FROM au GROUP BY 1)
"""


def _importance(spark, folder) -> list[float]:
    e = explanations(spark, folder).filter("explainer_key = 'RF_SHAP'")
    rows = C.mean_importance(e).orderBy("feature_idx").collect()  # one number per feature
    return [r["importance"] for r in rows]


@query("faithfulness", FAITH_SCORES + """
SELECT f1.k AS k, round(f1.f1, 6) AS f1, round(auc.auc, 6) AS auc,
       round((SELECT f1 FROM f1 WHERE k = 0) - f1.f1, 6) AS f1_drop,
       round((SELECT auc FROM auc WHERE k = 0) - auc.auc, 6) AS auc_drop
FROM f1 JOIN auc USING (k)""")
def faithfulness(spark, folder):
    return rounded(Q.faithfulness(vectors(spark, folder), _importance(spark, folder), softmax_scorer(), 3))


@query("faithfulness_correlation", FAITHFUL_SQL + f""",
z AS (SELECT row_id, y, c, sum(v * {WEIGHT_SQL.format(f='f', c='c')}) AS z FROM x, range(0, 3) t(c) GROUP BY 1, 2, 3),
ab AS (SELECT z.row_id, z.y, z.c, x.f AS j, z.z + (means.m - x.v) * {WEIGHT_SQL.format(f='x.f', c='z.c')} AS z
       FROM z JOIN x ON z.row_id = x.row_id JOIN means ON means.f = x.f),
pb AS (SELECT row_id, sum(exp(z)) FILTER (WHERE c = y) / sum(exp(z)) AS p FROM z GROUP BY 1),
pa AS (SELECT row_id, j, sum(exp(z)) FILTER (WHERE c = y) / sum(exp(z)) AS p FROM ab GROUP BY 1, 2),
drops AS (SELECT j, avg(pb.p - pa.p) AS d FROM pa JOIN pb USING (row_id) GROUP BY 1)
SELECT round(corr(imp.importance, drops.d), 6) AS faithfulness_correlation
FROM imp JOIN drops ON imp.f = drops.j""")
def faithfulness_correlation(spark, folder):
    e = explanations(spark, folder).filter("explainer_key = 'RF_SHAP'")
    imp = C.mean_importance(e).select("feature_idx", "importance")
    drops = Q.probability_drops(vectors(spark, folder), 64, softmax_scorer())
    return rounded(Q.faithfulness_correlation(imp, drops).select("faithfulness_correlation"))


@query("global_importance", IMPORTANCE_SQL + """
SELECT k AS explainer_key, f AS feature_idx, round(importance, 6) AS importance FROM imp""")
def global_importance(spark, folder):
    m = C.mean_importance(explanations(spark, folder))
    return rounded(m.select("explainer_key", big("feature_idx").alias("feature_idx"), "importance"))


# --- alignment -----------------------------------------------------------------------------


def _expert(spark, folder):
    """Five expected features per class, derived from the classes in the table."""
    labels = table(spark, folder, "embeddings").select("label").distinct()
    return labels.select(
        F.concat(F.lit("attack "), F.col("label")).alias("attack"), F.col("label").alias("attack_pos"),
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.concat(
            F.lit("F"), (F.col("label") * 3 + j * 7) % 64))).alias("pos", "feature"))


ALIGN_SQL = f"""
WITH {EXPL_SQL},
imp AS (SELECT k, label, f, avg(abs(v)) AS importance, count(*) AS n FROM expl GROUP BY 1, 2, 3 HAVING count(*) >= 5),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k, label ORDER BY importance DESC, f) AS rank,
                  sum(importance) OVER (PARTITION BY k, label) AS total FROM imp),
expert AS (SELECT DISTINCT label, (label * 3 + j * 7) % 64 AS f FROM embeddings, range(0, 5) t(j)),
scores AS (
  SELECT 'Attack ' || label || ' flood' AS label, k AS explainer_key,
         sum(1.0 / rank) / (1 + 1/2e0 + 1/3e0 + 1/4e0 + 1/5e0) AS rra, sum(importance) / max(total) AS rma,
         count(*) AS n_resolved
  FROM ranked JOIN expert USING (label, f) GROUP BY 1, 2)
"""


def _alignment(spark, folder):
    e = explanations(spark, folder).withColumn(
        "label", F.concat(F.lit("Attack "), F.col("label"), F.lit(" flood")))
    names = spark.range(64).select(F.concat(F.lit("f"), "id").alias("feature_name"), F.col("id").cast("int").alias(
        "feature_idx"))
    expert = _expert(spark, folder)
    resolved = AL.resolve_features(expert, names)
    attacks = expert.select("attack", "attack_pos").distinct()
    labels = e.select("label").distinct()
    return AL.alignment_scores(AL.class_importance(e), resolved, AL.resolve_attacks(labels, attacks))


@query("alignment_scores", ALIGN_SQL + """
SELECT label, explainer_key, round(rra, 6) AS rra, round(rma, 6) AS rma, n_resolved FROM scores""")
def alignment_scores(spark, folder):
    return rounded(_alignment(spark, folder).select("label", "explainer_key", "rra", "rma", "n_resolved"))


@query("alignment_summary", ALIGN_SQL + """
SELECT explainer_key, round(avg(rra), 6) AS mean_rra, round(avg(rma), 6) AS mean_rma FROM scores GROUP BY 1""")
def alignment_summary(spark, folder):
    return rounded(AL.alignment_summary(_alignment(spark, folder), ["explainer_key"]))


@query("resolve_features", """
WITH names AS (SELECT p_name AS name, row_number() OVER (ORDER BY p_name) - 1 AS idx
               FROM (SELECT DISTINCT p_name FROM part)),
wanted AS (SELECT DISTINCT p_type AS attack, upper(split_part(p_name, ' ', 2)) AS feature FROM part
           UNION SELECT DISTINCT p_type, p_name FROM part
           UNION SELECT DISTINCT p_type, upper(p_name) FROM part),
m AS (SELECT attack, feature, idx, CASE WHEN feature = name THEN 1 WHEN lower(feature) = lower(name) THEN 2
        WHEN contains(lower(name), lower(feature)) OR contains(lower(feature), lower(name)) THEN 3 END AS level
      FROM wanted, names)
SELECT attack, feature, arg_min(idx, level * 100000 + CASE WHEN level = 2 THEN -idx ELSE idx END) AS feature_idx
FROM m WHERE level IS NOT NULL GROUP BY 1, 2""")
def resolve_features(spark, folder):
    """Expert names found exactly, case-blind or by containment among the part names."""
    part = table(spark, folder, "part")
    # one row per distinct name, so numbering them is a small window
    features = part.select(F.col("p_name").alias("feature_name")).distinct().withColumn(
        "feature_idx", F.row_number().over(W.orderBy("feature_name")) - 1)
    forms = F.array(F.upper(F.element_at(F.split("p_name", " "), 2)), F.col("p_name"), F.upper("p_name"))
    wanted = part.select(F.col("p_type").alias("attack"), F.explode(forms).alias("feature")).distinct()
    r = AL.resolve_features(wanted, features)
    return r.select("attack", "feature", big("feature_idx").alias("feature_idx"))


@query("resolve_attacks", """
WITH attacks AS (SELECT DISTINCT p_brand AS attack, CAST(substr(p_brand, 7) AS BIGINT) AS pos FROM part),
labels AS (SELECT DISTINCT CASE p_partkey % 2 WHEN 0 THEN p_brand ELSE upper(p_brand) || ' x' END AS label FROM part),
m AS (SELECT label, attack, pos, CASE WHEN label = attack THEN 1
        WHEN contains(lower(label), lower(attack)) OR contains(lower(attack), lower(label)) THEN 3 END AS level
      FROM labels, attacks)
SELECT label, arg_min(attack, level * 1000 + pos) AS attack FROM m WHERE level IS NOT NULL GROUP BY 1""")
def resolve_attacks(spark, folder):
    part = table(spark, folder, "part")
    attacks = part.select(F.col("p_brand").alias("attack"),
                          F.substring("p_brand", 7, 10).cast("int").alias("attack_pos")).distinct()
    label = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.concat(F.upper("p_brand"), F.lit(" x")))
    return AL.resolve_attacks(part.select(label.alias("label")).distinct(), attacks)


@query("expert_coverage", """
WITH t AS (SELECT split_part(p_name, ' ', 2) AS word, count(*) AS parts FROM part GROUP BY 1)
SELECT word, parts, 61 AS attacks FROM t""")
def expert_coverage(spark, folder):
    """The shipped expert table next to the table's own names: attacks known per name."""
    known = AL.expert_table(spark).select("dataset", "attack").distinct().agg(F.count("*").alias("attacks"))
    words = table(spark, folder, "part").groupBy(F.element_at(F.split("p_name", " "), 2).alias("word")).agg(
        F.count("*").alias("parts"))
    return words.join(F.broadcast(known))


# --- interactions ----------------------------------------------------------------------------

INTER_SQL = """
WITH v AS (SELECT vec_id AS row_id, i - 1 AS i, j - 1 AS j,
             CAST(embedding[i] AS DOUBLE) * CAST(embedding[j] AS DOUBLE) * (1 + (i * j) % 3) AS v
           FROM embeddings, range(1, 65) a(i), range(1, 65) b(j)),
m AS (SELECT i, j, avg(abs(v)) AS strength FROM v GROUP BY 1, 2),
main AS (SELECT i - 1 AS f, avg(abs(CAST(embedding[65 - i] AS DOUBLE))) AS importance
         FROM embeddings, range(1, 65) a(i) GROUP BY 1)
"""


def _interactions(spark, folder):
    e = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"), A.as_doubles(F.col("embedding")).alias("a"))
    cells = e.select("row_id", "a", F.posexplode("a").alias("i", "x")).select(
        "row_id", "i", "x", F.posexplode("a").alias("j", "y"))
    return cells.select("row_id", "i", "j", (F.col("x") * F.col("y") * (
        1 + (F.col("i") + 1) * (F.col("j") + 1) % 3)).alias("v"))


def _main(spark, folder):
    e = table(spark, folder, "embeddings").select(
        F.reverse(A.as_doubles(F.col("embedding"))).alias("attrs"), F.lit("LIME").alias("explainer_key"))
    return C.mean_importance(e).select("feature_idx", "importance")


@query("interaction_matrix", INTER_SQL + "SELECT i, j, round(strength, 6) AS strength FROM m")
def interaction_matrix(spark, folder):
    return rounded(I.mean_matrix(_interactions(spark, folder)).select(big("i").alias("i"), big("j").alias("j"), "strength"))


@query("top_interactions", INTER_SQL + """
SELECT i, j, round(strength, 6) AS strength FROM m WHERE i < j ORDER BY m.strength DESC, i, j LIMIT 20""")
def top_interactions(spark, folder):
    t = I.top_pairs(I.mean_matrix(_interactions(spark, folder)), 20)
    return rounded(t.select(big("i").alias("i"), big("j").alias("j"), "strength"))


@query("interaction_vs_main", INTER_SQL + """,
d AS (SELECT f, rank() OVER (ORDER BY strength) AS rd, rank() OVER (ORDER BY importance) AS rm
      FROM m JOIN main ON m.i = main.f AND m.i = m.j)
SELECT round((SELECT corr(rd, rm) FROM d), 6) AS main_effect_correlation,
       round(sum(strength) FILTER (WHERE i <> j) / (sum(strength) FILTER (WHERE i = j) + 1e-12), 6)
         AS interaction_to_main_ratio,
       round(sum(strength) FILTER (WHERE i <> j), 6) AS total_interaction_strength FROM m""")
def interaction_vs_main(spark, folder):
    c = I.main_effect_comparison(I.mean_matrix(_interactions(spark, folder)), _main(spark, folder))
    return rounded(c.drop("main_effect_correlation_p"))


@query("rank_displacement", INTER_SQL + """,
s AS (SELECT i AS f, sum(strength) AS s FROM m WHERE i <> j GROUP BY 1),
r AS (SELECT f, row_number() OVER (ORDER BY importance DESC, f) - 1 AS lime_rank,
             row_number() OVER (ORDER BY s DESC, f) - 1 AS interaction_rank FROM s JOIN main USING (f))
SELECT f AS feature_idx, lime_rank, interaction_rank, lime_rank - interaction_rank AS rank_gain
FROM r WHERE lime_rank > interaction_rank ORDER BY rank_gain DESC, f LIMIT 10""")
def rank_displacement(spark, folder):
    r = I.rank_displacement(I.mean_matrix(_interactions(spark, folder)), _main(spark, folder))
    return r.select(*[big(c).alias(c) for c in r.columns])


@query("strongest_submatrix", INTER_SQL + """,
top AS (SELECT i AS f FROM m GROUP BY 1 ORDER BY sum(strength) DESC, i LIMIT 5)
SELECT i, j, round(strength, 6) AS strength FROM m
WHERE i IN (SELECT f FROM top) AND j IN (SELECT f FROM top)""")
def strongest_submatrix(spark, folder):
    s = I.strongest_submatrix(I.mean_matrix(_interactions(spark, folder)), 5)
    return rounded(s.select(big("i").alias("i"), big("j").alias("j"), "strength"))


@query("dependence_points", INTER_SQL + """,
top AS (SELECT i, j FROM m WHERE i < j ORDER BY strength DESC, i, j LIMIT 2)
SELECT vec_id AS row_id, top.i AS i, top.j AS j, round(CAST(embedding[top.i + 1] AS DOUBLE), 6) AS x_i,
       round(CAST(embedding[64 - top.i] AS DOUBLE), 6) AS attr_i,
       round(CAST(embedding[top.j + 1] AS DOUBLE), 6) AS x_j
FROM embeddings, top""")
def dependence_points(spark, folder):
    pairs = I.top_pairs(I.mean_matrix(_interactions(spark, folder)), 2)
    v = A.as_doubles(F.col("embedding"))
    samples = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"), v.alias("features"), F.reverse(v).alias("attrs"))
    d = I.dependence_points(samples, pairs)
    return rounded(d.withColumns({"i": big("i"), "j": big("j")}))


# --- robustness of explanations ----------------------------------------------------------------

PAIR_SQL = f"""
WITH {EXPL_SQL},
w AS (SELECT row_id, label, f, max(v) FILTER (WHERE k = 'RF_SHAP') AS xc, max(v) FILTER (WHERE k = 'DNN_IG') AS xa,
             max(v) FILTER (WHERE k = 'RF_SHAP') AS ac, max(v) FILTER (WHERE k = 'RF_PA-SHAP') AS aa
      FROM expl GROUP BY 1, 2, 3)
"""


def _attack_pairs(spark, folder):
    """Clean and attacked vectors with their explanations, from the three variants of a row."""
    e = explanations(spark, folder)
    at = lambda k: F.max_by("attrs", (F.col("explainer_key") == k).cast("int"))
    return e.groupBy("row_id", "label").agg(
        at("RF_SHAP").alias("x_clean"), at("DNN_IG").alias("x_adv"), at("RF_SHAP").alias("attr_clean"),
        at("RF_PA-SHAP").alias("attr_adv")).withColumns(
        {"pred_clean": F.col("label") % 2, "pred_adv": (F.col("row_id") % 2).cast("int")})


@query("lipschitz", PAIR_SQL + """,
d AS (SELECT row_id, label, sqrt(sum((xc - xa) * (xc - xa))) AS dx, sqrt(sum((ac - aa) * (ac - aa))) AS de
      FROM w GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN dx > 1e-10 THEN de / dx END AS r FROM d)
SELECT label, round(max(r), 6) AS lipschitz_max, round(avg(r), 6) AS lipschitz_mean,
       round(stddev_pop(r), 6) AS lipschitz_std, round(median(r), 6) AS lipschitz_median,
       round(quantile_cont(r, 0.95), 6) AS lipschitz_p95, round(quantile_cont(r, 0.99), 6) AS lipschitz_p99,
       round(avg(dx), 6) AS input_dist_mean, round(avg(de), 6) AS expl_dist_mean,
       count(r) AS num_valid, count(*) AS num_total FROM r GROUP BY 1""")
def lipschitz(spark, folder):
    return rounded(R.lipschitz(_attack_pairs(spark, folder), ["label"]))


@query("lipschitz_linf", PAIR_SQL + """,
d AS (SELECT row_id, max(abs(xc - xa)) AS dx, max(abs(ac - aa)) AS de FROM w GROUP BY 1)
SELECT round(max(de / dx), 6) AS lipschitz_max, round(avg(de / dx), 6) AS lipschitz_mean,
       round(median(de / dx), 6) AS lipschitz_median, count(*) AS num_valid FROM d WHERE dx > 1e-10""")
def lipschitz_linf(spark, folder):
    r = R.lipschitz(_attack_pairs(spark, folder), [], "linf")
    return rounded(r.select("lipschitz_max", "lipschitz_mean", "lipschitz_median", "num_valid"))


SIMILAR_SQL = PAIR_SQL + """,
n AS (SELECT row_id, label, sqrt(sum(ac * ac)) AS nc, sqrt(sum(aa * aa)) AS na FROM w GROUP BY 1, 2),
u AS (SELECT row_id, sqrt(sum((ac / nc - aa / na) * (ac / nc - aa / na))) AS ud, sum(ac / nc * (aa / na)) AS cs,
             sqrt(sum((ac - aa) * (ac - aa))) AS d, max(nc) AS nc FROM w JOIN n USING (row_id) GROUP BY 1),
rk AS (SELECT row_id, f,
         rank() OVER (PARTITION BY row_id ORDER BY ac)
           + (count(*) OVER (PARTITION BY row_id, ac) - 1) / CAST(2 AS DOUBLE) AS rc,
         rank() OVER (PARTITION BY row_id ORDER BY aa)
           + (count(*) OVER (PARTITION BY row_id, aa) - 1) / CAST(2 AS DOUBLE) AS ra,
         row_number() OVER (PARTITION BY row_id ORDER BY abs(ac) DESC, f) AS pc,
         row_number() OVER (PARTITION BY row_id ORDER BY abs(aa) DESC, f) AS pa FROM w),
o AS (SELECT row_id, corr(rc, ra) AS rho,
             count(*) FILTER (WHERE pc <= 5 AND pa <= 5) / CAST(10 - count(*) FILTER (WHERE pc <= 5 AND pa <= 5) AS DOUBLE)
               AS jac FROM rk GROUP BY 1),
s AS (SELECT u.*, o.rho, o.jac, n.label FROM u JOIN o USING (row_id) JOIN n USING (row_id))
"""


@query("explanation_similarity", SIMILAR_SQL + """
SELECT label, round(avg(CASE WHEN ud <= 0.2 THEN 1.0 ELSE 0.0 END), 6) AS similarity_satisfaction_rate,
       round(avg(ud), 6) AS distance_mean, round(stddev_pop(ud), 6) AS distance_std, round(max(ud), 6) AS distance_max,
       round(avg(cs), 6) AS cosine_similarity_mean, round(stddev_pop(cs), 6) AS cosine_similarity_std,
       round(avg(jac), 6) AS top_k_jaccard_mean, round(stddev_pop(jac), 6) AS top_k_jaccard_std,
       round(avg(rho), 6) AS rank_correlation_mean, round(stddev_pop(rho), 6) AS rank_correlation_std
FROM s GROUP BY 1""")
def explanation_similarity(spark, folder):
    return rounded(R.explanation_similarity(_attack_pairs(spark, folder), ["label"], 0.2))


@query("classification_equivalence", SIMILAR_SQL + """,
q AS (SELECT *, label % 2 = row_id % 2 AS same FROM s)
SELECT label, count(*) FILTER (WHERE same) AS num_prediction_preserving,
       count(*) FILTER (WHERE NOT same) AS num_prediction_changing,
       round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6) AS prediction_preserving_rate,
       round(avg(d) FILTER (WHERE same), 6) AS expl_distance_mean,
       round(stddev_pop(d) FILTER (WHERE same), 6) AS expl_distance_std,
       round(max(d) FILTER (WHERE same), 6) AS expl_distance_max,
       round(avg(d / nc) FILTER (WHERE same), 6) AS relative_distance_mean,
       round(avg(jac) FILTER (WHERE same), 6) AS top_k_jaccard_mean,
       round(stddev_pop(jac) FILTER (WHERE same), 6) AS top_k_jaccard_std,
       round(avg(rho) FILTER (WHERE same), 6) AS rank_correlation_mean,
       round(stddev_pop(rho) FILTER (WHERE same), 6) AS rank_correlation_std
FROM q GROUP BY 1""")
def classification_equivalence(spark, folder):
    return rounded(R.classification_equivalence(_attack_pairs(spark, folder), ["label"]))


@query("decoy_audit", f"""
WITH {EXPL_SQL},
r AS (SELECT k, f, row_number() OVER (PARTITION BY k, row_id ORDER BY abs(v) DESC, f) - 1 AS pos FROM expl),
d AS (SELECT k, CASE WHEN pos < 10 THEN pos ELSE 64 END AS pos FROM r WHERE f = 63)
SELECT k AS explainer_key, round(avg(CASE WHEN pos = 0 THEN 1.0 ELSE 0.0 END), 6) AS dummy_top1_rate,
       round(avg(CASE WHEN pos < 3 THEN 1.0 ELSE 0.0 END), 6) AS dummy_top3_rate,
       round(avg(pos), 6) AS dummy_mean_rank, count(*) AS num_samples, round(median(pos), 6) AS dummy_median_rank
FROM d GROUP BY 1""")
def decoy_audit(spark, folder):
    """Where the last feature ranks among the ten each explainer keeps."""
    return rounded(R.decoy_audit(explanations(spark, folder), 63, ["explainer_key"], kept=10, features=64))


@query("method_classes", """
WITH m AS (SELECT CASE event_type WHEN 'view' THEN 'Full' WHEN 'signup' THEN 'PCA' WHEN 'click' THEN 'PA-LIME'
             ELSE 'SHAP' END AS method FROM events)
SELECT CASE WHEN method = 'Full' THEN 'Baseline' WHEN method = 'PCA' THEN 'Statistical'
            WHEN method LIKE 'PA-%' THEN 'Protocol-aware' ELSE 'XAI' END AS method_class, count(*) AS n FROM m GROUP BY 1""")
def method_classes(spark, folder):
    t = F.col("event_type")
    method = F.when(t == "view", "Full").when(t == "signup", "PCA").when(t == "click", "PA-LIME").otherwise("SHAP")
    return table(spark, folder, "events").groupBy(S.method_class(method).alias("method_class")).agg(F.count("*").alias("n"))


