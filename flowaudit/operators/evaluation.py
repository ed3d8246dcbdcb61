"""Classifier evaluation from tables of labels, predictions and probabilities."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F

from flowaudit.functions.tables import value_ranks


def confusion(df: DataFrame, classes: int, by: list[str] | None = None, y="y", pred="pred") -> DataFrame:
    """Counts for every (y, pred) pair of class ids, zeros included: ``(*by, y, pred, n)``."""
    by = by or []
    counts = df.groupBy(*by, F.col(y).cast("int").alias("y"), F.col(pred).cast("int").alias("pred")).agg(
        F.count("*").alias("n")
    )
    ids = F.sequence(F.lit(0), F.lit(classes - 1))
    groups = counts.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = groups.select(*by, F.explode(ids).alias("y")).select(*by, "y", F.explode(ids).alias("pred"))
    return grid.join(counts, [*by, "y", "pred"], "left").select(
        *by, "y", "pred", F.coalesce("n", F.lit(0)).alias("n")
    )


def class_scores(cm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per class: support, tp, fp, fn, tn, f1 and fpr (0 where undefined)."""
    by = by or []
    role = lambda c, s, p: F.struct(F.col(c).alias("class_id"), F.lit(s).alias("s"), F.lit(p).alias("p"))
    sides = cm.select(*by, "n", (F.col("y") == F.col("pred")).cast("int").alias("hit"),
                      F.explode(F.array(role("y", 1, 0), role("pred", 0, 1))).alias("r"))
    c = sides.groupBy(*by, "r.class_id").agg(
        F.sum(F.col("n") * F.col("r.s")).alias("support"),
        F.sum(F.col("n") * F.col("r.p")).alias("predicted"),
        F.sum(F.col("n") * F.col("hit") * F.col("r.s")).alias("tp"),
    )
    totals = cm.groupBy(*by).agg(F.sum("n").alias("total")) if by else cm.agg(F.sum("n").alias("total"))
    c = c.join(F.broadcast(totals), by) if by else c.crossJoin(F.broadcast(totals))
    c = c.withColumns({
        "fp": F.col("predicted") - F.col("tp"),
        "fn": F.col("support") - F.col("tp"),
        "tn": F.col("total") - F.col("support") - F.col("predicted") + F.col("tp"),
    })
    f1_den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    neg = F.col("fp") + F.col("tn")
    return c.withColumns({
        "f1": F.when(f1_den > 0, 2.0 * F.col("tp") / f1_den).otherwise(0.0),
        "fpr": F.when(neg > 0, F.col("fp") / neg).otherwise(0.0),
    })


def false_positive_rates(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro FPR over all class ids and overall FP / (FP + TN)."""
    neg = F.sum("fp") + F.sum("tn")
    return scores.groupBy(*(by or [])).agg(
        F.avg("fpr").alias("fpr_macro"),
        F.when(neg > 0, F.sum("fp") / neg).otherwise(0.0).alias("far_overall"),
    )


def f1_summary(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, support-weighted F1 and macro F1 over classes seen in y or pred."""
    seen = F.col("support") + F.col("predicted") > 0
    n = F.sum("support")
    return scores.groupBy(*(by or [])).agg(
        (F.sum("tp") / n).alias("accuracy"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_weighted"),
        F.avg(F.when(seen, F.col("f1"))).alias("f1_macro"),
    )


def class_auc(df: DataFrame, by: list[str] | None = None, y="y", proba="proba") -> DataFrame:
    """One-vs-rest AUC per class with tied scores averaged: ``(*by, class_id, n_pos, auc)``.

    Scores are collapsed to distinct values first, so ranking needs neither a
    global sort nor a join back to the rows.  AUC is null when a class lacks
    positives or negatives.
    """
    by = by or []
    long = df.select(*by, F.col(y).cast("int").alias("_y"), F.posexplode(proba).alias("class_id", "score"))
    hit = F.when(F.col("_y") == F.col("class_id"), 1).otherwise(0)
    v = value_ranks(long, [*by, "class_id"], "score", {"pos": hit, "neg": 1 - hit})
    u = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return v.groupBy(*by, "class_id").agg(F.sum("pos").alias("n_pos"), F.when(pairs > 0, u / pairs).alias("auc"))


def weighted_auc(per_class: DataFrame, classes: int, by: list[str] | None = None) -> DataFrame:
    """AUC of class 1 for two classes, else the positive-weighted mean over usable classes."""
    usable = F.when(F.col("class_id") == 1, F.col("auc")) if classes == 2 else F.col("auc")
    weight = F.when(usable.isNotNull(), F.col("n_pos"))
    return per_class.groupBy(*(by or [])).agg(
        (F.sum(usable * weight) / F.nullif(F.sum(weight), F.lit(0))).alias("auc")
    )


def evaluate(df: DataFrame, classes: int, by: list[str] | None = None) -> DataFrame:
    """Accuracy, F1s, AUC, FPR and FAR of ``(y, pred, proba)`` rows, one row per group."""
    by = by or []
    scores = class_scores(confusion(df, classes, by), by)
    parts = [f1_summary(scores, by), false_positive_rates(scores, by), weighted_auc(class_auc(df, by), classes, by)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, by) if by else out.crossJoin(p)
    return out


def latency(model_transform, df: DataFrame, runs: int = 5, warmup_rows: int = 100) -> dict[str, float]:
    """Wall-clock scoring time in ms per row (mean and population std over runs)."""
    n = df.count()
    model_transform(df.limit(warmup_rows)).write.format("noop").mode("overwrite").save()
    per_row = []
    for _ in range(runs):
        start = time.perf_counter()
        model_transform(df).write.format("noop").mode("overwrite").save()
        per_row.append((time.perf_counter() - start) * 1000.0 / max(n, 1))
    m = sum(per_row) / len(per_row)
    std = (sum((v - m) ** 2 for v in per_row) / len(per_row)) ** 0.5
    return {"inference_ms_per_sample_mean": m, "inference_ms_per_sample_std": std, "total_inference_time_s": m * n / 1000.0}


def reduction_summary(metrics: DataFrame, original_features: int, full: str = "Full") -> DataFrame:
    """Change of every reduced feature set against the full set of the same model.

    ``metrics(model, selection_method, n_features, accuracy, f1_weighted,
    fpr_macro, train_time_s, inference_ms_per_sample_mean)``.
    """
    base = metrics.filter(F.col("selection_method") == full).alias("f")
    red = metrics.filter(F.col("selection_method") != full).alias("r")
    d = lambda c: F.col(f"r.{c}") - F.col(f"f.{c}")
    faster = lambda c: F.when(F.col(f"r.{c}") > 0, F.col(f"f.{c}") / F.col(f"r.{c}")).otherwise(
        F.lit(float("inf"))
    )
    return red.join(F.broadcast(base), F.col("r.model") == F.col("f.model")).select(
        "r.model", "r.selection_method",
        ((1 - F.col("r.n_features") / F.lit(float(original_features))) * 100).alias("feature_reduction_pct"),
        d("accuracy").alias("accuracy_change"),
        d("f1_weighted").alias("f1_weighted_change"),
        d("fpr_macro").alias("fpr_change"),
        faster("train_time_s").alias("train_time_speedup"),
        faster("inference_ms_per_sample_mean").alias("inference_latency_speedup"),
    )


def dataset_pivot(metrics: DataFrame, row: str, column: str, value: str, datasets: list[str] | None = None) -> DataFrame:
    """Rows = ``row``, one column per dataset, mean of ``value``."""
    g = metrics.groupBy(row)
    return (g.pivot(column, datasets) if datasets else g.pivot(column)).agg(F.avg(value))
