"""Summaries of per-row feature interaction values ``(row_id, i, j, v)``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from flowaudit.functions.stats import correlation_p

FLAT = 1e-12


def mean_matrix(values: DataFrame) -> DataFrame:
    """Mean |v| per (i, j)."""
    return values.groupBy("i", "j").agg(F.avg(F.abs("v")).alias("strength"))


def top_pairs(matrix: DataFrame, n: int = 20) -> DataFrame:
    """The n strongest pairs above the diagonal."""
    return matrix.filter("i < j").orderBy(F.desc("strength"), "i", "j").limit(n)


def _tied_rank(c: str):
    return F.rank().over(W.orderBy(c)) + (F.count("*").over(W.partitionBy(c)) - 1) / 2.0


def main_effect_comparison(matrix: DataFrame, main: DataFrame) -> DataFrame:
    """Spearman of the diagonal with the main effects, and off-diagonal over diagonal mass.

    ``main(feature_idx, importance)``.  Both inputs have one row per feature (pair),
    so the feature-wide windows are small whatever the number of samples.
    """
    diag = matrix.filter("i = j").select(F.col("i").alias("feature_idx"), F.col("strength").alias("d"))
    both = diag.join(main.withColumnRenamed("importance", "m"), "feature_idx")
    ranks = both.withColumns({"_rd": _tied_rank("d"), "_rm": _tied_rank("m")})
    usable = (F.stddev_pop("d") > FLAT) & (F.stddev_pop("m") > FLAT)
    corr = ranks.agg(
        F.when(usable, F.corr("_rd", "_rm")).otherwise(0.0).alias("main_effect_correlation"),
        F.count("*").alias("_n"),
        usable.alias("_usable"),
    )

    @F.pandas_udf("double")
    def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([correlation_p(a, int(b)) for a, b in zip(r, n)], dtype="float64")

    corr = corr.select(
        "main_effect_correlation",
        F.when(F.col("_usable"), p_value("main_effect_correlation", "_n")).otherwise(1.0).alias(
            "main_effect_correlation_p"),
    )
    off = F.coalesce(F.sum(F.when(F.col("i") != F.col("j"), F.col("strength"))), F.lit(0.0))
    on = F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), F.col("strength"))), F.lit(0.0))
    sums = matrix.agg((off / (on + FLAT)).alias("interaction_to_main_ratio"), off.alias("total_interaction_strength"))
    return corr.join(F.broadcast(sums))


def row_strength(matrix: DataFrame, include_diagonal: bool = False) -> DataFrame:
    m = matrix if include_diagonal else matrix.filter("i != j")
    return m.groupBy(F.col("i").alias("feature_idx")).agg(F.sum(F.abs("strength")).alias("strength"))


def rank_displacement(matrix: DataFrame, main: DataFrame, n: int = 10) -> DataFrame:
    """Features ranked higher by interaction than by main effect (0-based ranks)."""
    both = row_strength(matrix).join(main, "feature_idx")
    place = lambda c: F.row_number().over(W.orderBy(F.desc(c), "feature_idx")) - 1
    r = both.withColumns({"lime_rank": place("importance"), "interaction_rank": place("strength")})
    gain = F.col("lime_rank") - F.col("interaction_rank")
    return (
        r.filter(gain > 0).select("feature_idx", "lime_rank", "interaction_rank", gain.alias("rank_gain"))
        .orderBy(F.desc("rank_gain"), "feature_idx").limit(n)
    )


def strongest_submatrix(matrix: DataFrame, n: int) -> DataFrame:
    """Cells among the n features of largest row strength (diagonal included)."""
    top = row_strength(matrix, True).orderBy(F.desc("strength"), "feature_idx").limit(n).select("feature_idx")
    top = F.broadcast(top)
    return matrix.join(top.withColumnRenamed("feature_idx", "i"), "i", "left_semi").join(
        top.withColumnRenamed("feature_idx", "j"), "j", "left_semi").select("i", "j", "strength")


def dependence_points(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(row_id, i, j, x_i, attr_i, x_j)`` for the given (few) pairs of features.

    ``samples(row_id, features, attrs)``.
    """
    p = F.broadcast(pairs.select("i", "j"))
    return samples.join(p).select(
        "row_id", "i", "j",
        F.get("features", F.col("i")).alias("x_i"),
        F.get("attrs", F.col("i")).alias("attr_i"),
        F.get("features", F.col("j")).alias("x_j"),
    )
