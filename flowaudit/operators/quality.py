"""Quality of explanations: metrics over tables of attributions and predictions."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowaudit.functions import arrays as A, hashing as H
from flowaudit.functions.stats import correlation_p
from flowaudit.functions.tables import checkpointed
from flowaudit.functions.vectors import spearman_signed
from flowaudit.operators import evaluation as E

KEY = "explainer_key"
THRESHOLDS = tuple(round(0.1 * i, 1) for i in range(11))


def top_features(expl: DataFrame, k: int, absolute: bool = True) -> DataFrame:
    """``(explainer_key, row_id, rank, feature_idx, attribution)`` of the k largest."""
    attrs = A.as_doubles(F.col("attrs"))
    order = A.absolute(attrs) if absolute else attrs
    idx = expl.select(KEY, "row_id", attrs.alias("_a"), F.posexplode(A.top_k(order, k)).alias("_p", "feature_idx"))
    return idx.select(KEY, "row_id", (F.col("_p") + 1).alias("rank"), "feature_idx",
                      F.get("_a", F.col("feature_idx")).alias("attribution"))


def as_map(expl: DataFrame, names: list[str]) -> DataFrame:
    """Attributions as a ``feature -> value`` map."""
    keys = F.array(*[F.lit(n) for n in names])
    return expl.select(KEY, "row_id", F.map_from_arrays(keys, A.as_doubles(F.col("attrs"))).alias("attributions"))


def importance_share(attrs: Column, threshold: float = 0.01, relative: bool = True) -> Column:
    """Share of features whose |value| is above the cutoff (relative to the row maximum)."""
    a = A.absolute(A.as_doubles(attrs))

    def share(x: Column) -> Column:
        top = F.array_max(x)
        cutoff = top * threshold if relative else F.lit(threshold)
        above = A.let(cutoff, lambda c: F.size(F.filter(x, lambda v: v > c)).cast("double") / F.size(x))
        return F.when(top == 0, 0.0).otherwise(above) if relative else above

    return A.let(a, share)


def sparsity_curve(expl: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Share of features below each threshold after scaling every row by its maximum."""
    a = A.absolute(A.as_doubles(F.col("attrs")))
    scaled = A.let(a, lambda x: A.let(
        F.when(F.array_max(x) == 0, 1.0).otherwise(F.array_max(x)), lambda m: F.transform(x, lambda v: v / m)))
    rows = expl.select(KEY, scaled.alias("_s"))
    below = lambda t: F.size(F.filter("_s", lambda v: v < F.lit(float(t))))
    counts = rows.select(KEY, F.size("_s").alias("_d"), *[below(t).alias(f"_c{i}") for i, t in enumerate(thresholds)])
    sums = counts.groupBy(KEY).agg(F.sum("_d").alias("_d"),
                                   *[F.sum(f"_c{i}").alias(f"_c{i}") for i in range(len(thresholds))])
    cells = F.array(*[F.struct(F.lit(float(t)).alias("tau"), (F.col(f"_c{i}") / F.col("_d")).alias("sparsity"))
                      for i, t in enumerate(thresholds)])
    return sums.select(KEY, F.explode(cells).alias("_x")).select(KEY, "_x.tau", "_x.sparsity")


def entropy(attrs: Column) -> Column:
    """Shannon entropy in bits of |attrs| as a distribution (0 for an all-zero row)."""
    a = A.absolute(A.as_doubles(attrs))
    term = lambda s: lambda v: F.when(v > 0, -(v / s) * F.log2(v / s)).otherwise(0.0)
    return A.let(a, lambda x: A.let(A.total(x), lambda s: A.total(F.transform(x, term(s)))))


def complexity(expl: DataFrame) -> DataFrame:
    rows = expl.select(KEY, entropy(F.col("attrs")).alias("h"), F.size("attrs").alias("_d"))
    ceiling = F.log2(F.max("_d"))
    return rows.groupBy(KEY).agg(
        F.avg("h").alias("complexity_mean_entropy"),
        F.stddev_pop("h").alias("complexity_std_entropy"),
        F.when(ceiling > 0, F.avg("h") / ceiling).otherwise(0.0).alias("complexity_normalized"),
    )


def stability(runs: DataFrame, top_k: int = 10, by: list[str] | None = None) -> DataFrame:
    """Mean and minimum pairwise Jaccard of top-k sets over repeated runs of a row.

    ``runs(*by, row_id, run, attrs)``.  Rows constant in all runs are flagged and
    get no score.  A row's runs (a fixed handful) meet in one aggregate.
    """
    keys = [*(by or []), "row_id"]
    a = A.as_doubles(F.col("attrs"))
    rows = runs.select(*keys, F.struct(
        F.col("run"),
        A.top_k(A.absolute(a), top_k).alias("top"),
        F.forall(a, lambda v: v == F.get(a, F.lit(0))).alias("flat"),
    ).alias("_r"))
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("_r")).alias("_r"))
    tops = F.col("_r.top")
    later = lambda i: F.slice(tops, i + 2, F.greatest(F.size(tops) - i - 1, F.lit(0)))
    scores = F.flatten(F.transform(tops, lambda t, i: F.transform(later(i), lambda u: A.jaccard(t, u, 1.0))))
    g = g.select(*keys, scores.alias("_s"), F.forall("_r.flat", lambda f: f).alias("degenerate"))
    has = F.size("_s") > 0
    score = lambda c: F.when(~F.col("degenerate"), F.when(has, c).otherwise(1.0))
    return g.select(*keys, score(A.mean(F.col("_s"))).alias("jaccard_mean"),
                    score(F.array_min("_s")).alias("jaccard_min"), "degenerate")


def stability_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(
        F.avg("jaccard_mean").alias("stability_jaccard_mean"),
        F.stddev_pop("jaccard_mean").alias("stability_jaccard_std"),
        F.sum(F.col("degenerate").cast("bigint")).alias("n_degenerate"),
    )


def column_means(df: DataFrame, vector: str = "features") -> DataFrame:
    """One row holding the mean of every vector element."""
    mean = Summarizer.mean(array_to_vector(F.col(vector)))
    return df.agg(vector_to_array(mean).alias("means"))


def with_ablations(df: DataFrame, means: DataFrame, sets: dict[int, list[int]], name: str,
                   vector: str = "features") -> DataFrame:
    """One copy of every row per ablation; the listed features take their column mean.

    Copies are made inside the row (no join on the data); ``means`` is one row.
    """
    plan = F.array(*[
        F.struct(F.lit(k).alias("k"), F.array(*[F.lit(i) for i in idx]).cast("array<int>").alias("idx"))
        for k, idx in sets.items()
    ])
    rows = df.join(F.broadcast(means)).withColumn("_a", F.explode(plan))
    swapped = F.transform(F.col(vector), lambda v, i: F.when(
        F.array_contains(F.col("_a.idx"), i), F.get("means", i)).otherwise(v))
    return rows.withColumn(vector, swapped).withColumn(name, F.col("_a.k")).drop("_a", "means")


def faithfulness(samples: DataFrame, importance: list[float], scorer, classes: int,
                 k_values: tuple[int, ...] = (5, 10, 15)) -> DataFrame:
    """Drop of weighted F1 and AUC when the k most important features take their mean.

    ``samples(row_id, y, features)``; ``importance`` is the mean |attribution| per
    feature.  All ablated copies are scored in one pass with a ``k`` column
    (``k = 0`` is the untouched baseline).
    """
    width = len(importance)
    order = sorted(range(width), key=lambda i: (-importance[i], i))
    sets = {0: [], **{k: order[: min(k, width)] for k in k_values}}
    rows = with_ablations(samples.select("y", "features"), column_means(samples), sets, "k")
    scored = rows.select("k", "y", scorer.proba(F.col("features")).alias("proba"))
    # scores feed several aggregates: store them once instead of scoring again for each
    scored = checkpointed(scored.withColumn("pred", A.argmax(F.col("proba"))))
    scores = E.class_scores(E.confusion(scored, classes, ["k"]), ["k"])
    f1 = E.f1_summary(scores, ["k"]).select("k", F.col("f1_weighted").alias("f1"))
    auc = E.weighted_auc(E.class_auc(scored, ["k"]), classes, ["k"])
    m = f1.join(auc, "k")
    # one row per k: the window below is over a handful of rows
    base = lambda c: F.max(F.when(F.col("k") == 0, F.col(c))).over(W.partitionBy(F.lit(0)))
    return m.select("k", "f1", "auc", (base("f1") - F.col("f1")).alias("f1_drop"),
                    (base("auc") - F.col("auc")).alias("auc_drop"))


def probability_drops(samples: DataFrame, width: int, scorer) -> DataFrame:
    """Mean drop of the true class's probability per single-feature ablation."""
    true = F.get(scorer.proba(F.col("features")), F.col("y").cast("int"))
    base = samples.select("y", "features").withColumn("_base", true)
    rows = with_ablations(base, column_means(samples), {j: [j] for j in range(width)}, "feature_idx")
    return rows.groupBy("feature_idx").agg(F.avg(F.col("_base") - true).alias("drop"))


def faithfulness_correlation(importance: DataFrame, drops: DataFrame) -> DataFrame:
    """Pearson r (and p) between mean |attribution| and probability drop over features."""

    @F.pandas_udf("double")
    def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([correlation_p(a, int(b)) for a, b in zip(r, n)], dtype="float64")

    c = importance.join(drops, "feature_idx").agg(
        F.corr("importance", "drop").alias("faithfulness_correlation"), F.count("*").alias("_n")
    )
    return c.select("faithfulness_correlation",
                    p_value("faithfulness_correlation", "_n").alias("faithfulness_p_value"))


def corrupted_inputs(samples: DataFrame, width: int, block: int = 50, seed: int = 42) -> DataFrame:
    """Edge-case rows: ``block`` zero rows, ``block`` uniform(-100, 100) rows, and every sample with 30 % of cells uniform(-10, 10)."""
    spark = samples.sparkSession
    zeros = spark.range(block).select(F.lit("zero").alias("block"), F.col("id").alias("row_id"),
                                      F.array_repeat(F.lit(0.0), width).alias("features"))
    cell = lambda rid, i, lo, hi, t: F.lit(lo) + F.lit(hi - lo) * H.uniform(seed, rid, F.lit(i), F.lit(t))
    rid = F.col("id")
    extreme = spark.range(block).select(
        F.lit("extreme"), rid, F.array(*[cell(rid, i, -100.0, 100.0, "x") for i in range(width)]))
    rid = F.col("row_id")
    noisy = samples.select(F.lit("noisy"), rid, F.array(*[
        F.when(H.uniform(seed, rid, F.lit(i), F.lit("m")) < 0.3, cell(rid, i, -10.0, 10.0, "v"))
        .otherwise(F.get("features", F.lit(i))) for i in range(width)]))
    return zeros.union(extreme).union(noisy)


def completeness(explained: DataFrame) -> DataFrame:
    """Success over corrupted blocks; a block with any NaN or missing vector fails whole.

    ``explained(block, attrs)``.
    """
    bad = F.coalesce(F.exists("attrs", lambda v: v.isNull() | F.isnan(v)), F.lit(True))
    blocks = explained.groupBy("block").agg(F.count("*").alias("n"), F.max(bad).alias("bad"))
    ok = F.sum(F.when(~F.col("bad"), F.col("n")).otherwise(0))
    return blocks.agg((ok / F.sum("n")).alias("completeness_success_rate"),
                      F.sum("n").alias("completeness_total_tested"), ok.alias("completeness_successes"))


def local_accuracy(rows: DataFrame, by: list[str] | None = None, atol: float = 1e-2, rtol: float = 1e-5) -> DataFrame:
    """Does the attribution sum match f(x) - f(0)?  ``rows(attrs, f_x, f_0)``."""
    total = A.total(A.as_doubles(F.col("attrs")))
    want = F.col("f_x") - F.col("f_0")
    r = rows.select(*(by or []), F.abs(total - want).alias("err"), want.alias("want"))
    ok = F.col("err") <= atol + rtol * F.abs("want")
    return r.groupBy(*(by or [])).agg(
        F.bool_and(ok).alias("completeness_axiom_valid"),
        F.avg("err").alias("completeness_axiom_mae"),
        F.avg(ok.cast("double")).alias("completeness_axiom_pass_rate"),
    )


def efficiency(timing: DataFrame) -> DataFrame:
    """``timing(explainer_key, n, total_s)`` -> ms per sample, total, samples per second."""
    return timing.select(
        KEY, (F.col("total_s") * 1000.0 / F.col("n")).alias("time_per_sample_ms"),
        F.col("total_s").alias("total_time_s"),
        F.when(F.col("total_s") > 0, F.col("n") / F.col("total_s")).otherwise(0.0).alias("samples_per_second"),
    )


ACCESSORS = {
    "fidelity": "r_squared",
    "path_convergence": "convergence_delta",
    "deeplift_convergence": "convergence_delta",
    "expected_value": "expected_value",
}


def stored_metric(expl: DataFrame, metric: str) -> DataFrame:
    """A value the explainer stored with the row; rows without it raise when read."""
    c = F.col(ACCESSORS[metric])
    value = F.when(c.isNull(), F.raise_error(F.lit(f"explanation has no {ACCESSORS[metric]}"))).otherwise(c)
    return expl.select(KEY, "row_id", value.alias(metric))


def semantic_robustness(base: DataFrame, mutants: DataFrame) -> DataFrame:
    """Mean Spearman between a row's attributions and those of its mutants (0 when none is defined).

    ``base(row_id, attrs)``, ``mutants(row_id, copy, attrs)``; undefined
    coefficients are skipped.
    """
    pairs = mutants.select("row_id", F.col("attrs").alias("_m")).join(base.select("row_id", "attrs"), "row_id")
    flat = lambda c: A.variance(A.as_doubles(F.col(c))) == 0
    rho = F.when(~(flat("attrs") | flat("_m")), spearman_signed(F.col("attrs"), F.col("_m"), 0.0))
    return pairs.select("row_id", rho.alias("rho")).groupBy("row_id").agg(
        F.coalesce(F.avg("rho"), F.lit(0.0)).alias("robustness"))


def wide_metrics(parts: list[DataFrame]) -> DataFrame:
    """Join per-explainer metric tables into one row per explainer."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, KEY, "full")
    return out


def sparsity_wide(curve: DataFrame) -> DataFrame:
    """Threshold rows as columns ``sparsity_tau_0.0`` ... plus ``sparsity_mean`` (threshold 0.1)."""
    at = lambda t: F.max(F.when(F.abs(F.col("tau") - t) < 1e-9, F.col("sparsity")))
    return curve.groupBy(KEY).agg(*[at(t).alias(f"sparsity_tau_{t:.1f}") for t in THRESHOLDS],
                                  at(0.1).alias("sparsity_mean"))
