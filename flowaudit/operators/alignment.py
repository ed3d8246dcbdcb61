"""How well explainers rank the features that experts expect per attack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from flowaudit.functions import arrays as A
from flowaudit.functions.tables import local_rows, small_side
from flowaudit.operators.consensus import FLAT, is_benign
from flowaudit.operators.fixed_values import EXPERT_TABLES


def expert_rows() -> list[tuple]:
    rows = []
    for dataset, attacks in EXPERT_TABLES.items():
        for order, (attack, features) in enumerate(attacks.items()):
            rows += [(dataset, attack, order, feature, pos) for pos, feature in enumerate(features)]
    return rows


def expert_table(spark: SparkSession) -> DataFrame:
    """``(dataset, attack, attack_pos, feature, pos)`` with both positions 0-based."""
    return local_rows(
        spark, expert_rows(), "dataset string, attack string, attack_pos int, feature string, pos int"
    )


def _match_level(wanted: Column, have: Column, case_level: bool) -> Column:
    """1 exact, 2 same letters (if asked for), 3 one contains the other; null = no match."""
    lw, lh = F.lower(wanted), F.lower(have)
    m = F.when(wanted == have, 1)
    if case_level:
        m = m.when(lw == lh, 2)
    return m.when(F.contains(lh, lw) | F.contains(lw, lh), 3)


def resolve_features(expert: DataFrame, features: DataFrame) -> DataFrame:
    """Adds ``feature_idx`` to expert rows: exact, then case-blind, then first containment.

    ``features(feature_name, feature_idx)`` is the (short) feature list; unmatched
    expert rows are dropped.  A case-blind match takes the last such name, a
    containment match the first.
    """
    level = _match_level(F.col("feature"), F.col("feature_name"), True)
    hits = expert.join(small_side(features), level.isNotNull()).withColumn("_level", level)
    tie = F.when(F.col("_level") == 2, -F.col("feature_idx")).otherwise(F.col("feature_idx"))
    keys = expert.columns
    w = W.partitionBy(*keys).orderBy("_level", tie)
    return hits.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*keys, "feature_idx", "feature_name")


def resolve_attacks(labels: DataFrame, attacks: DataFrame) -> DataFrame:
    """``(label) -> (label, attack)``: exact, else the first attack containing or contained."""
    level = _match_level(F.col("label"), F.col("attack"), False)
    hits = labels.join(small_side(attacks), level.isNotNull()).withColumn("_level", level)
    w = W.partitionBy("label").orderBy("_level", "attack_pos")
    return hits.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("label", "attack")


def class_importance(expl: DataFrame, min_rows: int = 5, benign=None) -> DataFrame:
    """Mean |attribution| per (explainer, label, feature) for attack classes of enough rows."""
    keep = expl.filter(~is_benign(F.col("label"), *([benign] if benign else [])))
    long = keep.select("explainer_key", "label", F.posexplode(A.absolute(A.as_doubles(F.col("attrs")))).alias(
        "feature_idx", "_v"))
    return (
        long.groupBy("explainer_key", "label", "feature_idx")
        .agg(F.avg("_v").alias("importance"), F.count("*").alias("n"))
        .filter(F.col("n") >= min_rows)
    )


def alignment_scores(importance: DataFrame, resolved: DataFrame, attack_of: DataFrame) -> DataFrame:
    """RRA and RMA per (label, explainer).

    RRA: sum of 1/rank of the expert features over the best possible sum; RMA:
    their share of the total importance.  A feature resolved twice counts twice.
    """
    keys = ["explainer_key", "label"]
    w = W.partitionBy(*keys).orderBy(F.desc("importance"), "feature_idx")
    ranked = importance.withColumn("rank", F.row_number().over(w))
    ranked = ranked.withColumn("total", F.sum("importance").over(W.partitionBy(*keys)))
    wanted = attack_of.join(F.broadcast(resolved), "attack").groupBy("label", "attack", "feature_idx").agg(
        F.count("*").alias("times")
    )
    hit = ranked.join(small_side(wanted), ["label", "feature_idx"])
    k = F.sum("times")
    best = F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda s, r: s + F.lit(1.0) / r)
    share = F.when(F.max("total") < FLAT, 0.0).otherwise(F.sum(F.col("importance") * F.col("times")) / F.max("total"))
    return hit.groupBy("label", "attack", "explainer_key").agg(
        (F.sum(F.col("times") / F.col("rank")) / best).alias("rra"),
        share.alias("rma"),
        k.cast("bigint").alias("n_resolved"),
        F.sort_array(F.collect_set("feature_idx")).alias("resolved"),
    )


def alignment_summary(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scores.groupBy(*(by or [])).agg(F.avg("rra").alias("mean_rra"), F.avg("rma").alias("mean_rma"))
