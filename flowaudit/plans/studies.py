"""The four audits as compositions of operators; every result is a lazy DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from flowaudit.functions import arrays as A
from flowaudit.functions.tables import checkpointed, local_rows, stored
from flowaudit.operators import alignment as AL, attacks as AT, consensus as C, models as M, quality as Q
from flowaudit.operators import robustness as R, selection as S


def quality_audit(samples: DataFrame, explanations: dict[str, DataFrame], scorer, classes: int, runs: dict | None = None,
                  timing: DataFrame | None = None, k_values: tuple[int, ...] = (5, 10, 15)) -> DataFrame:
    """One wide row of quality metrics per explainer.

    ``samples(row_id, y, features)``; ``explanations[key](row_id, attrs)``; ``runs[key](row_id,
    run, attrs)`` holds repeated explanations for stability; ``timing(explainer_key, n, total_s)``.
    """
    table = None
    for key, df in explanations.items():
        part = df.select(F.lit(key).alias("explainer_key"), "row_id", "attrs")
        table = part if table is None else table.unionByName(part)
    parts = [Q.sparsity_wide(Q.sparsity_curve(table)), Q.complexity(table)]
    faithful = None
    for key in explanations:
        imp = C.mean_importance(table.filter(F.col("explainer_key") == key)).select("feature_idx", "importance")
        values = [r["importance"] for r in imp.orderBy("feature_idx").collect()]  # one number per feature
        drops = Q.faithfulness(samples, values, scorer, classes, k_values)
        wide = drops.agg(*[
            F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_k{k}") for k in k_values for c in ("f1_drop", "auc_drop")])
        corr = Q.faithfulness_correlation(imp, Q.probability_drops(samples, len(values), scorer))
        row = wide.join(corr).select(F.lit(key).alias("explainer_key"), "*")
        faithful = row if faithful is None else faithful.unionByName(row)
    parts.append(faithful)
    if runs:
        stable = None
        for key, df in runs.items():
            s = Q.stability_summary(Q.stability(df)).select(F.lit(key).alias("explainer_key"), "*")
            stable = s if stable is None else stable.unionByName(s)
        parts.append(stable)
    if timing is not None:
        parts.append(Q.efficiency(timing))
    return Q.wide_metrics(parts)


def agreement_audit(explanations: DataFrame, dataset: str, feature_names: list[str], alpha: float = 0.05,
                    top_k: tuple[int, ...] = C.TOP_K, expert: DataFrame | None = None) -> dict[str, DataFrame]:
    """Agreement of every explainer pair, per class, and alignment with the experts.

    ``explanations(explainer_key, row_id, label, attrs)``.  Returns ``pairs``, ``by_class``,
    ``summary``, ``by_type``, ``alignment`` and ``alignment_summary``.
    """
    spark = explanations.sparkSession
    rows = checkpointed(C.row_agreement(explanations, top_k))  # read by the overall and the per-class summary
    tests = C.wilcoxon(C.mean_importance(explanations), alpha)
    pairs = C.pair_agreement(rows).join(F.broadcast(tests), ["explainer_a", "explainer_b"])
    expert = AL.expert_table(spark).filter(F.col("dataset") == dataset) if expert is None else expert
    names = local_rows(spark, [(n, i) for i, n in enumerate(feature_names)], "feature_name string, feature_idx int")
    attacks = expert.select("attack", "attack_pos").distinct()
    labels = explanations.select("label").distinct()
    scores = AL.alignment_scores(AL.class_importance(explanations), AL.resolve_features(expert, names),
                                 AL.resolve_attacks(labels, attacks))
    return {
        "pairs": pairs,
        "by_class": C.agreement_by_class(rows),
        "summary": C.agreement_summary(pairs),
        "by_type": C.agreement_summary(pairs, ["pair_type"]),
        "alignment": scores,
        "alignment_summary": AL.alignment_summary(scores),
    }


def robustness_audit(samples: DataFrame, scorer, explain, modes: dict[str, tuple] | None = None,
                     fgsm_epsilons=AT.FGSM_EPSILONS, pgd_epsilons=AT.PGD_EPSILONS, steps: int = 20, store: bool = True) -> dict[str, DataFrame]:
    """Attack the rows, explain clean and attacked rows, and compare.

    ``samples(row_id, y, features)`` scaled to [0, 1]; ``modes[name] = (schema, scales)``, with
    ``(None, None)`` for an unconstrained attack. Each metric reads attacked and explained rows that are stored once; without ``store``
    nothing is kept and each makes them again, for explainers that cost less than the disk of all pairs.
    """
    modes = modes or {"unconstrained": (None, None)}

    def attacked(rows: DataFrame, **how) -> DataFrame:
        parts = [AT.adversarial_table(rows, scorer, mode, *rules, fgsm_epsilons, pgd_epsilons, steps, **how) for mode, rules in modes.items()]
        return reduce(DataFrame.unionByName, parts)

    if store:
        # columns of files take a fraction of what checkpointed rows take
        adv = stored(attacked(samples), "attacked")
        pairs = stored(R.paired_explanations(samples.select("row_id", A.as_doubles(F.col("features")).alias("features")), adv, explain), "explained-pairs")
    else:
        adv = attacked(samples, vectors=False)
        pairs = R.attacked_pairs(samples, lambda rows: attacked(rows, keep=("attr_clean",)), explain)
    by = ["mode", "attack", "epsilon"]
    return {
        "success": R.attack_success(adv),
        "lipschitz": R.lipschitz(pairs, by),
        "similarity": R.explanation_similarity(pairs, by),
        "equivalence": R.classification_equivalence(pairs, by),
    }


def selection_audit(train: DataFrame, val: DataFrame, test: DataFrame, width: int, classes: int,
                    importances: dict[str, list[float]] | None = None, fits: dict | None = None,
                    n: int | None = None) -> dict[str, DataFrame]:
    """Statistical and attribution-based feature sets, and all models on all sets.

    ``train/val/test(row_id, y, features)``; ``importances[method]`` are mean |attribution|
    vectors to prune by; ``fits[model](train)`` trains a Spark ML model.
    """
    table = S.statistical_selection(train, width, n)
    sets = {"Full": list(range(width))}
    for r in table.filter("selected").collect():  # a few indices per method
        sets.setdefault(r["method"], []).append(r["feature_idx"])
    for method, importance in (importances or {}).items():
        sets[method], _ = S.iterative_pruning(train, val, importance, classes)
    fits = fits or {"RF": lambda d: M.random_forest(d)}
    bench = S.benchmark(train, test, classes, {m: sorted(i) for m, i in sets.items()}, fits)
    return {"selection": table, "benchmark": bench.withColumn("method_class", S.method_class(F.col("selection_method")))}
