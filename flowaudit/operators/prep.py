"""Flow-table preparation: cleaning, protocol and label rules, split, scaling, oversampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from flowaudit.functions import arrays as A, hashing as H
from flowaudit.functions.tables import (
    exact_quantiles, hash_levels, local_rows, long_form, small_side, smallest_per_group,
)
from flowaudit.operators.constraints import clamp, col
from flowaudit.operators.fixed_values import KDD_CATEGORIES, LABEL_COLUMNS, METADATA_COLUMNS, PROTOCOL_NUMBERS
from flowaudit.operators.neighbors import nearest_rows


def find_label(df: DataFrame) -> str:
    for c in LABEL_COLUMNS:
        if c in df.columns:
            return c
    raise ValueError(f"no label column among {df.columns}")


def drop_metadata(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in METADATA_COLUMNS if c in df.columns])


def clean_label(c: Column) -> Column:
    return F.trim(c.cast("string"))


def numeric(c: Column) -> Column:
    """Text to double, anything unreadable to null."""
    return c.try_cast("double")


def finite(c: Column) -> Column:
    """NaN and infinities to null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def medians(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Exact median per column: ``(*by, feature, median)``."""
    q = exact_quantiles(long_form(df, columns, by), [*(by or []), "feature"], "value", [0.5])
    return q.select(*(by or []), "feature", F.col("quantile").alias("median"))


def impute_medians(df: DataFrame, columns: list[str], by: list[str] | None = None,
                   fit_on: DataFrame | None = None) -> DataFrame:
    """Fill nulls with the column's median (of the row's group with ``by``).

    Medians are a small table (features, or files x features) joined by broadcast;
    ``fit_on`` takes them from other rows, such as the training split.
    """
    m = medians(df if fit_on is None else fit_on, columns, by)
    aggs = [F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"_med{i}") for i, c in enumerate(columns)]
    wide = small_side(m.groupBy(*by).agg(*aggs) if by else m.agg(*aggs))
    out = df.join(wide, by, "left") if by else df.join(wide)
    filled = {c: F.coalesce(col(c), F.col(f"_med{i}")) for i, c in enumerate(columns)}
    return out.withColumns(filled).drop(*[f"_med{i}" for i in range(len(columns))])


def clean(df: DataFrame, label: str, features: list[str], by: list[str] | None = None, dedup: bool = True,
          header_rows: bool = False) -> DataFrame:
    """Numeric coercion, non-finite to null, median imputation, incomplete rows and duplicates out.

    Rows whose label repeats the header name are dropped unless ``header_rows``.
    """
    df = df.withColumns({f: finite(numeric(col(f))) for f in features}).withColumn(label, clean_label(col(label)))
    if not header_rows:
        df = df.filter(F.lower(col(label)) != "label")
    df = impute_medians(df, features, by).na.drop(subset=[f"`{c}`" for c in [*features, label]])
    return df.dropDuplicates() if dedup else df


def with_row_id(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Stable id from the row's content (after dedup rows are distinct, so ids are too, up to hash chance)."""
    return df.withColumn("row_id", F.xxhash64(*[col(c) for c in (columns or df.columns)]))


def protocol_from_flags(flags: list[str], window: str, port: str) -> Column:
    """TCP if any flag counter is set or the window field is present (>= 0); else ICMP on port 0; else UDP."""
    tcp = reduce(lambda a, b: a | b, [col(f) > 0 for f in flags], col(window) >= 0)
    return F.when(tcp, PROTOCOL_NUMBERS["tcp"]).when(col(port) == 0, PROTOCOL_NUMBERS["icmp"]).otherwise(
        PROTOCOL_NUMBERS["udp"])


def protocol_from_window(flags: list[str], window: str, columns: list[str]) -> Column:
    """TCP if an existing flag counter is set or the window is > 0; else ICMP when it is 0; else UDP."""
    tcp = reduce(lambda a, b: a | b, [col(f) > 0 for f in flags if f in columns], col(window) > 0)
    return F.when(tcp, PROTOCOL_NUMBERS["tcp"]).when(col(window) == 0, PROTOCOL_NUMBERS["icmp"]).otherwise(
        PROTOCOL_NUMBERS["udp"])


def category_table(spark: SparkSession, categories: dict[str, str] | None = None) -> DataFrame:
    return local_rows(spark, list((categories or KDD_CATEGORIES).items()), "attack string, category string")


def map_categories(df: DataFrame, label: str, categories: DataFrame, default: str = "Normal") -> DataFrame:
    """Attack name -> category by trimmed lower-case name; unknown names become ``default``."""
    df = df.withColumn("_attack", F.lower(F.trim(col(label).cast("string"))))
    out = df.join(F.broadcast(categories.withColumnRenamed("attack", "_attack")), "_attack", "left")
    return out.withColumn("category", F.coalesce("category", F.lit(default))).drop("_attack")


def one_hot_categories(parts: list[DataFrame], columns: list[str], max_values: int = 10_000) -> dict[str, list[str]]:
    """Sorted categories per column over all parts, found in one pass; refuses unbounded columns."""
    both = reduce(DataFrame.unionByName, [p.select(*[col(c) for c in columns]) for p in parts])
    cells = F.array(*[F.struct(F.lit(c).alias("c"), col(c).cast("string").alias("v")) for c in columns])
    found = both.select(F.explode(cells).alias("_x")).select("_x.c", "_x.v").distinct()
    many = [r["c"] for r in found.groupBy("c").count().filter(F.col("count") > max_values).collect()]
    if many:
        raise ValueError(f"more than {max_values} categories in {many}; index such columns instead")
    found = found.collect()  # at most columns x max_values rows
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in found:
        if r["v"] is not None:
            out[r["c"]].append(r["v"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """0/1 columns ``<column>_<value>`` in sorted order; unseen values are all zero."""
    made = {f"{c}_{v}": F.when(col(c).cast("string") == v, 1.0).otherwise(0.0)
            for c, values in categories.items() for v in values}
    return df.withColumns(made).drop(*categories)


def label_ids(parts: list[DataFrame], label: str) -> DataFrame:
    """``(label, label_id)``: ids follow the sorted class names of all parts."""
    names = reduce(DataFrame.union, [p.select(col(label).cast("string").alias("label")) for p in parts]).distinct()
    return small_side(names.select("label", (F.row_number().over(W.orderBy("label")) - 1).alias("label_id")))


def encode_labels(df: DataFrame, label: str, ids: DataFrame) -> DataFrame:
    return df.join(ids.withColumnRenamed("label", "_l"), col(label).cast("string") == F.col("_l"), "left").drop("_l")


def contiguous_ids(train: DataFrame, y: str = "y") -> DataFrame:
    """``(y, model_id)`` for classes seen in training, in id order."""
    return small_side(train.select(y).distinct().select(
        y, (F.dense_rank().over(W.orderBy(y)) - 1).alias("model_id")))


def remap_labels(df: DataFrame, ids: DataFrame, y: str = "y") -> DataFrame:
    """Adds ``model_id``; classes not seen in training get -1."""
    return df.join(ids, y, "left").withColumn("model_id", F.coalesce("model_id", F.lit(-1)))


def stratified_split(df: DataFrame, y: str, test: float = 0.2, val: float = 0.1, key: str = "row_id",
                     seed: int = 42, buckets: int = 1024) -> DataFrame:
    """Adds ``split``: per class round(test n) test rows, then round(val rest) validation rows.

    Counts are exact and a row's place depends only on its key.  Each class is cut
    into hash buckets, so no class is ranked in one task.
    """
    n = F.count("*")
    n_test = F.rint(n * test)
    quotas = small_side(df.groupBy(y).agg(
        n_test.cast("bigint").alias("_test"),
        (n_test + F.rint((n - n_test) * val)).cast("bigint").alias("_val")))
    cut = hash_levels(df, [y], quotas, ["_test", "_val"], seed, key, buckets)
    split = F.when(F.col("level") == 0, "test").when(F.col("level") == 1, "val").otherwise("train")
    return cut.withColumn("split", split).drop("level")


def fit_scales(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Minimum and maximum of every feature (one row to the driver)."""
    aggs = [f(col(c)).cast("double").alias(f"{t}{i}") for i, c in enumerate(features)
            for t, f in (("lo", F.min), ("hi", F.max))]
    row = train.agg(*aggs).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(features)}


def scale(df: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - min) / (max - min), range 1 for constant features; values are not clipped."""
    return df.withColumns({
        c: (col(c) - F.lit(lo)) / F.lit(hi - lo if hi > lo else 1.0) for c, (lo, hi) in scales.items()})


def unscale(df: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: col(c) * F.lit(hi - lo) + F.lit(lo) for c, (lo, hi) in scales.items()})


def rescale_clipped(df: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    """Scale with a safe range and clip to [0, 1]."""
    return df.withColumns({
        c: clamp((col(c) - F.lit(lo)) / F.lit(hi - lo if hi - lo >= 1e-12 else 1.0), 0.0, 1.0)
        for c, (lo, hi) in scales.items()})


def oversample(df: DataFrame, y: str = "y", k: int = 5, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Lift every class below the median class count to that count with synthetic rows.

    ``df(row_id, y, features)``.  Classes with one row are left alone.  Synthetic rows
    lie between a row and one of its k nearest rows of the same class; which rows
    get one more than the others follows from their hash, so class counts are
    exact.  Adds ``synthetic`` (row ids of synthetic rows are hashes of parent and copy).
    """
    counts = df.groupBy(y).agg(F.count("*").alias("_n"))
    target = exact_quantiles(counts, [], "_n", [0.5]).select(F.floor("quantile").alias("_target"))
    need = counts.join(F.broadcast(target)).withColumn("_need", F.col("_target") - F.col("_n"))
    need = small_side(need.filter("_need > 0 AND _n > 1").select(
        y, "_n", F.floor(F.col("_need") / F.col("_n")).alias("_each"), (F.col("_need") % F.col("_n")).alias("n_take"),
        F.least(F.lit(k), F.col("_n") - 1).alias("_k")))
    need = need.withColumnRenamed("_n", "_rows")
    few = df.select(key, y, A.as_doubles(F.col("features")).alias("features")).join(need.drop("n_take"), y)
    marked = smallest_per_group(few, [y], need.select(y, "n_take"), seed, key)
    copies = F.col("_each") + F.col("taken").cast("bigint")
    seeds = marked.withColumn("_copies", copies).filter("_copies > 0")
    q = seeds.select(F.col(key).alias("query_id"), F.col("features").alias("vector"), y, F.lit(True).alias("self"))
    c = few.select(F.col(key).alias("candidate_id"), F.col("features").alias("vector"), y)
    near = nearest_rows(q, c, k, [y]).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "vector"))), lambda s: s["vector"]).alias("_near"))
    rows = seeds.join(near.withColumnRenamed("query_id", key), key)
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    ids = [F.col(key), F.col("_copy")]
    other = F.get("_near", H.pick(F.least(F.size("_near"), F.col("_k").cast("int")), seed, *ids, F.lit("near")).cast("int"))
    u = H.uniform(seed, *ids, F.lit("step"))
    made = rows.withColumns({"_o": other, "_u": u}).select(
        H.hash64(seed, *ids, F.lit("synthetic")).alias(key), y,
        F.zip_with("features", "_o", lambda a, b: a + F.col("_u") * (b - a)).alias("features"),
        F.lit(True).alias("synthetic"))
    real = df.select(key, y, A.as_doubles(F.col("features")).alias("features"), F.lit(False).alias("synthetic"))
    return real.unionByName(made)


def keep_features(df: DataFrame, keys: list[str], selected: list[str]) -> DataFrame:
    return df.select(*keys, *[col(c) for c in selected])


def prepare(df: DataFrame, label: str | None = None, test: float = 0.2, val: float = 0.1, seed: int = 42):
    """Raw flow table -> ``(split table, scales, label ids)``.

    The table has ``row_id, y, split`` and scaled features; scales come from the
    training rows only.
    """
    label = label or find_label(df)
    df = drop_metadata(df)
    features = [c for c in df.columns if c != label]
    cleaned = with_row_id(clean(df, label, features))
    ids = label_ids([cleaned], label)
    encoded = encode_labels(cleaned, label, ids).withColumnRenamed("label_id", "y").drop(label)
    split = stratified_split(encoded, "y", test, val, seed=seed)
    scales = fit_scales(split.filter("split = 'train'"), features)
    return scale(split, scales), scales, ids
