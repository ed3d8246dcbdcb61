"""Explainers as batch jobs over rows ``(row_id, features array<double>, ...)``.

Spark partitions the rows; model parameters and the bounded background sample
travel with the task.  Neighbourhoods and coalitions are drawn, repaired, scored and summed
inside the Arrow batch of their row; only pool neighbourhoods, and packet neighbourhoods made as rows, are tables of copies.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowaudit.functions import arrays as A, hashing as H, kernels as K, samples as S
from flowaudit.functions.tables import exact_quantiles, local_rows, long_form
from flowaudit.operators.constraints import pack
from flowaudit.operators.models import Scorer, TreeScorer
from flowaudit.operators.neighbors import neighbourhood, spread_by_key
from flowaudit.operators.rule_program import RuleProgram
from flowaudit.operators.schemas import FlowSchema

MAX_BACKGROUND = 1000
MATRIX_CELLS = 1 << 23


# --- samples ------------------------------------------------------------------------


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """n rows without replacement, the same for every partitioning and explainer."""
    return df.orderBy(H.hash64(seed, F.col(key)), key).limit(n)


def background_rows(train: DataFrame, n: int, seed: int = 42, benign: int | None = None) -> DataFrame:
    """Background sample of at most n rows; with ``benign`` only rows of that class."""
    if benign is not None:
        train = train.filter(F.col("y") == benign)
    rows = sample_rows(train, n, seed)
    if benign is not None and not rows.limit(1).count():
        raise ValueError("no benign row for the background")
    return rows


def background_matrix(rows: DataFrame) -> np.ndarray:
    """The (bounded) background sample as a matrix."""
    got = rows.select("features").limit(MAX_BACKGROUND + 1).collect()
    if len(got) > MAX_BACKGROUND:
        raise ValueError(f"background exceeds {MAX_BACKGROUND} rows; sample it first")
    return np.array([r[0] for r in got], dtype=float)


# --- batched kernels ------------------------------------------------------------------


def batch_explain(df: DataFrame, kernel, extra: list[str], key: str, at_once: int | None = None) -> DataFrame:
    """Run ``kernel(x, columns) -> (attrs, {extra: values})`` on every Arrow batch of rows, cut where it has more than ``at_once``.

    Adds ``explainer_key``, ``attrs`` and the extra double columns; input columns stay.
    """
    fields = [T.StructField("explainer_key", T.StringType()), *df.schema.fields,
              T.StructField("attrs", T.ArrayType(T.DoubleType())),
              *[T.StructField(n, T.DoubleType()) for n in extra]]
    schema = T.StructType(fields)
    names = df.columns

    def run(batches):
        for batch in (b.slice(s, at_once or b.num_rows) for b in batches for s in range(0, b.num_rows, at_once or b.num_rows)):
            n = batch.num_rows
            x = batch["features"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            attrs, more = kernel(x, batch)
            flat = pa.array(np.ascontiguousarray(attrs, dtype=float).ravel())
            offsets = pa.array(np.arange(0, attrs.size + 1, attrs.shape[1], dtype=np.int32))
            cols = [pa.array([key] * n), *[batch[c] for c in names], pa.ListArray.from_arrays(offsets, flat),
                    *[pa.array(np.asarray(more[e], dtype=float)) for e in extra]]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.mapInArrow(run, schema)


def _targets(scorer: Scorer, x, batch):
    """The class to explain: column ``target`` if given, else the predicted class."""
    if "target" in batch.schema.names:
        return batch["target"].to_numpy(zero_copy_only=False).astype(int)
    return scorer.predict(x).argmax(axis=1)


def _base(x, batch, bases):
    """Start points: column ``baseline``, or per-class rows, or zeros."""
    if bases is not None:
        return lambda target: bases[target]
    if "baseline" in batch.schema.names:
        m = batch["baseline"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(x.shape)
        return lambda target: m
    return lambda target: np.zeros_like(x)


def integrated_gradients(df: DataFrame, scorer, steps: int = 50, softmax: bool = True, key: str = "DNN_IG") -> DataFrame:
    """Path-averaged gradients times input difference, from ``baseline`` or zero."""

    def kernel(x, batch):
        t = _targets(scorer, x, batch)
        attrs, delta = K.integrated_gradients(scorer, x, _base(x, batch, None)(t), t, steps, softmax)
        return attrs, {"predicted_class": t, "convergence_delta": delta}

    return batch_explain(df, kernel, ["predicted_class", "convergence_delta"], key)


def class_baseline_matrix(baselines: DataFrame, classes: int) -> np.ndarray:
    """Rows of :func:`neighbors.class_baselines` (one per class) as a matrix."""
    rows = {r["class_id"]: r["baseline"] for r in baselines.limit(classes).collect()}
    return np.array([rows[c] for c in range(classes)], dtype=float)


def sequential_gradients(df: DataFrame, scorer, schema: FlowSchema, bases: np.ndarray, steps: int = 50,
                         softmax: bool = True, key: str = "DNN_PA-IG") -> DataFrame:
    """Two-phase path that never visits half-set discrete features."""
    discrete = [i for i, f in enumerate(schema.features) if f in set(schema.discrete)]

    def kernel(x, batch):
        t = _targets(scorer, x, batch)
        attrs, delta = K.sequential_gradients(scorer, x, bases[t], t, discrete, steps, softmax)
        return attrs, {"predicted_class": t, "convergence_delta": delta}

    return batch_explain(df, kernel, ["predicted_class", "convergence_delta"], key)


def deeplift(df: DataFrame, scorer, bases: np.ndarray | None = None, softmax: bool = True,
             key: str = "DNN_DeepLIFT") -> DataFrame:
    """Rescale-rule contributions from zero or from a per-class reference row."""

    def kernel(x, batch):
        t = _targets(scorer, x, batch)
        base = _base(x, batch, bases)(t)
        attrs = K.rescale_multipliers(scorer, x, base, t, softmax)
        f = scorer.predict if softmax else scorer.predict_logits
        rows = np.arange(len(x))
        delta = attrs.sum(1) - (f(x)[rows, t] - f(base)[rows, t])
        return attrs, {"predicted_class": t, "convergence_delta": delta}

    return batch_explain(df, kernel, ["predicted_class", "convergence_delta"], key)


def deep_shap(df: DataFrame, scorer, background: np.ndarray, softmax: bool = False, key: str = "DNN_SHAP") -> DataFrame:
    """Rescale contributions averaged over the background rows."""

    def kernel(x, batch):
        t = _targets(scorer, x, batch)
        attrs, expected = K.deep_shap(scorer, x, background, t, softmax)
        return attrs, {"predicted_class": t, "expected_value": expected}

    return batch_explain(df, kernel, ["predicted_class", "expected_value"], key)


def _leaf_table(scorer: TreeScorer, background: np.ndarray):
    """The forest's leaf table, made once per worker task and kept for its batches."""
    made: list[K.LeafTable] = []

    def table() -> K.LeafTable:
        if not made:
            made.append(K.LeafTable(scorer.trees, scorer.weights, np.asarray(background, float)))
        return made[0]

    return table


def tree_shap(df: DataFrame, scorer: TreeScorer, background: np.ndarray, key: str = "RF_SHAP") -> DataFrame:
    """Interventional Shapley values of the predicted class (boosted: of the log-odds, or of the class margin)."""
    table, mean = _leaf_table(scorer, background), scorer.predict_raw(np.asarray(background, float)).mean(0)

    def kernel(x, batch):
        t = _targets(scorer, x, batch)
        if scorer.link == "boosted":
            sign = np.where(t == 1, 1.0, -1.0)
            return table().shapley(x, np.zeros_like(t)) * sign[:, None], {"predicted_class": t, "expected_value": mean[0] * sign}
        return table().shapley(x, t), {"predicted_class": t, "expected_value": mean[t]}

    return batch_explain(df, kernel, ["predicted_class", "expected_value"], key)


def tree_interactions(df: DataFrame, scorer: TreeScorer, background: np.ndarray) -> DataFrame:
    """Interaction values of the predicted class as ``(row_id, i, j, v)`` rows."""
    width, table = background.shape[1], _leaf_table(scorer, background)

    def kernel(x, batch):
        t = _targets(scorer, x, batch)
        pick = np.zeros_like(t) if scorer.link == "boosted" else t
        return table().interactions(x, pick).reshape(len(x), -1), {}

    # a few rows at a time: each holds width^2 cells
    flat = batch_explain(df.select("row_id", "features"), kernel, [], "interactions", max(1, MATRIX_CELLS // (width * width)))
    cells = flat.select("row_id", F.posexplode("attrs").alias("_p", "v"))
    return cells.select("row_id", F.floor(F.col("_p") / width).cast("int").alias("i"),
                        (F.col("_p") % width).cast("int").alias("j"), "v")


def linear_shap(df: DataFrame, scorer, background: DataFrame, key: str = "LR_SHAP") -> DataFrame:
    """Closed form for a linear score: weight times distance from the background mean (class 0 output)."""
    width = len(scorer.weights)
    means = background.agg(*[F.avg(F.get("features", F.lit(i))).alias(f"_m{i}") for i in range(width)])
    phi = F.array(*[F.lit(float(w[0])) * (F.get("features", F.lit(i)) - F.col(f"_m{i}"))
                    for i, w in enumerate(scorer.weights)])
    return df.join(F.broadcast(means)).select(F.lit(key).alias("explainer_key"), *df.columns, phi.alias("attrs"))


def class_values(per_class: Column, pred: Column) -> Column:
    """The predicted class's vector out of ``array<array<double>>`` per-class attributions."""
    return F.element_at(per_class, pred.cast("int") + 1)


# --- neighbourhood-based explainers -----------------------------------------------------

_RIDGE = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("attrs", T.ArrayType(T.DoubleType())),
    T.StructField("predicted_class", T.DoubleType()), T.StructField("r_squared", T.DoubleType()),
    T.StructField("intercept", T.DoubleType()), T.StructField("local_prediction", T.DoubleType()),
    T.StructField("num_samples", T.LongType()),
])


def _column_matrix(table: pa.Table, name: str, order: np.ndarray) -> np.ndarray:
    flat = table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)[order]


def _solved(table: pa.Table, group: list[str], schema: T.StructType, values: list) -> pa.Table:
    """One output row: the group keys of the input and the fitted values."""
    keys = [table[g][0].as_py() for g in group]
    types = to_arrow_schema(schema)
    return pa.table([pa.array([v], f.type) for v, f in zip([*keys, *values], types)], names=schema.names)


def _fitted(x: np.ndarray, p: np.ndarray, kernel_width: float | None, halve: bool, alpha: float, standardise: bool,
            class_to_explain: int | None) -> list:
    """Weighted ridge on the copies of one group, its first being the explained one: the values of ``_RIDGE`` after the key."""
    if standardise:
        std = x.std(axis=0)
        x = (x - x.mean(axis=0)) / np.where(std > 0, std, 1.0)
    cls = int(p[0].argmax()) if class_to_explain is None else class_to_explain
    d2 = ((x - x[0]) ** 2).sum(axis=1)
    width = 0.75 * np.sqrt(x.shape[1]) if kernel_width is None else kernel_width
    coef, icpt, r2 = K.weighted_ridge(x, p[:, cls], np.exp(-d2 / ((2.0 if halve else 1.0) * width**2)), alpha)
    return [coef, float(cls), r2, icpt, float(x[0] @ coef + icpt), len(x)]


def _surrogate(scored: DataFrame, kernel_width: float | None, halve: bool, alpha: float, standardise: bool,
               group: list[str], class_to_explain: int | None = None) -> DataFrame:
    """Weighted ridge per group of ``(*group, sample, features, proba)`` rows (group size = sample count)."""
    schema = T.StructType([*[scored.schema[g] for g in group], *_RIDGE.fields[1:]])

    def solve(table: pa.Table) -> pa.Table:
        order = np.argsort(table["sample"].to_numpy())
        x, p = _column_matrix(table, "features", order), _column_matrix(table, "proba", order)
        return _solved(table, group, schema, _fitted(x, p, kernel_width, halve, alpha, standardise, class_to_explain))

    return scored.groupBy(*group).applyInArrow(solve, schema)


#: Cells (copies x features) of a batch part that a task holds at once.
COPY_CELLS = 1 << 18


def _row_parts(rows: int, cells_per_row: int):
    """Slices of a batch's rows of about COPY_CELLS cells."""
    step = max(1, COPY_CELLS // max(1, cells_per_row))
    return [slice(a, min(rows, a + step)) for a in range(0, rows, step)]


def protocol_lime(rows: DataFrame, schema: FlowSchema, scorer, samples: int = 5000, sigma=0.1, pools=None,
                  kernel_width: float | None = None, alpha: float = 1.0, seed: int = 42,
                  class_to_explain: int | None = None, key: str = "PA-LIME") -> DataFrame:
    """Local ridge surrogate on a rule-abiding neighbourhood of every row.

    ``rows(row_id, <feature columns>)``.  The copies of a row are drawn, repaired, scored and
    summed inside the row's Arrow batch, so no copy is a row of a table and nothing is
    grouped.  With ``pools`` the protocol and the discrete features come from training values, which are
    tables: then the copies are rows, dealt by ``row_id``.
    """
    names = list(schema.features)
    cols = [F.col(f"`{n}`") for n in names]
    if pools:
        near = pack(neighbourhood(rows.select("row_id", *cols), schema, samples, sigma, pools, seed), names)
        scored = near.select("row_id", "sample", "features", scorer.proba(F.col("features")).alias("proba"))
        out = _surrogate(scored, kernel_width, True, alpha, False, ["row_id"], class_to_explain)
        return out.select(F.lit(key).alias("explainer_key"), "*")
    program, width = RuleProgram(schema), len(names)
    moving = [names.index(n) for n in schema.continuous]
    spread = np.array([float(sigma[n] if isinstance(sigma, dict) else sigma) for n in schema.continuous])
    reach = 0.75 * np.sqrt(width) if kernel_width is None else kernel_width

    def kernel(x, batch):
        ids, made = batch["row_id"].to_numpy(), []
        for part in _row_parts(len(x), samples * width):
            own = x[part]
            near = np.repeat(own[:, None, :], samples, axis=1)
            near[:, 1:, moving] += spread * S.normals(seed, ids[part], np.arange(1, samples), len(moving), 0)
            near = program(near.reshape(-1, width))
            p = scorer.predict(near).reshape(len(own), samples, -1)
            near = near.reshape(len(own), samples, width)
            cls = p[:, 0].argmax(axis=1) if class_to_explain is None else np.full(len(own), class_to_explain)
            y = p[np.arange(len(own)), :, cls]
            centred = near - near[:, :1]  # from the row itself, so that sums of squares lose no digits
            w = np.exp(-(centred**2).sum(axis=2) / (2.0 * reach**2))
            coef, icpt, r2 = S.ridge(S.moments(centred, y, w), alpha)
            made.append((coef, cls, r2, icpt - (near[:, 0] * coef).sum(1), icpt))
        coef, cls, r2, icpt, local = (np.concatenate(c) for c in zip(*made))
        return coef, {"predicted_class": cls, "r_squared": r2, "intercept": icpt, "local_prediction": local}

    packed = spread_by_key(rows.select("row_id", A.as_doubles(F.array(*cols)).alias("features")), "row_id")
    out = batch_explain(packed, kernel, ["predicted_class", "r_squared", "intercept", "local_prediction"], key)
    return out.select("explainer_key", "row_id", "attrs", "predicted_class", "r_squared", "intercept", "local_prediction",
                      F.lit(samples).cast("bigint").alias("num_samples"))


def packet_lime(near, features: Column | tuple[str, ...], scorer, group: list[str], kernel_width: float | None = None,
                alpha: float = 1.0, class_to_explain: int | None = None, key: str = "PA-LIME-PCAP") -> DataFrame:
    """Surrogate on accepted packets or flows: standard-scaled features, weights exp(-d^2 / width^2).

    ``near(*group, sample, ...)`` as made by the packet or flow neighbourhoods;
    ``features`` is an array column over it.  With ``features`` as names of header fields, ``near`` is the packet neighbourhood
    still to be made (all its arguments but ``fold`` bound): its copies are then made, scored and fitted inside the task.
    """
    if not isinstance(features, Column):
        columns = T.StructType(_RIDGE.fields[1:])
        predict = getattr(scorer, "predict_in_order", scorer.predict)

        def fit(made):
            fits = []
            for cells in zip(*[made[f] for f in features]):
                x = np.array(cells, dtype=float).T  # a feature's values lie together
                fits.append(_fitted(x, predict(x), kernel_width, False, alpha, True, class_to_explain))
            return [np.array(v) for v in zip(*fits)]

        return near(fold=(tuple(features), fit, columns)).select(F.lit(key).alias("explainer_key"), "*")
    rows = near.select(*group, "sample", features.alias("features"))
    scored = rows.withColumn("proba", scorer.proba(F.col("features")))
    out = _surrogate(scored, kernel_width, False, alpha, True, group, class_to_explain)
    return out.select(F.lit(key).alias("explainer_key"), "*")


def quartile_bins(train: DataFrame, names: list[str]) -> dict[str, dict]:
    """Per feature: quartile cuts and, per bin, frequency, mean, std, min and max of the training values."""
    cells = long_form(train, names)
    cuts: dict[str, list] = {n: [] for n in names}
    for r in exact_quantiles(cells, ["feature"], "value", [0.25, 0.5, 0.75]).collect():
        cuts[r["feature"]].append(r["quantile"])
    cuts = {n: sorted(set(v)) for n, v in cuts.items()}
    table = local_rows(train.sparkSession, list(cuts.items()), "feature string, _cuts array<double>")
    binned = cells.join(F.broadcast(table), "feature").withColumn(
        "bin", F.size(F.filter("_cuts", lambda c: c < F.col("value"))))
    v = F.col("value")
    stats = binned.groupBy("feature", "bin").agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"))
    empty = {"n": 0, "mean": None, "std": None, "min": None, "max": None}
    out = {n: {"cuts": cuts[n], "bins": [dict(empty) for _ in range(len(cuts[n]) + 1)]} for n in names}
    for r in stats.collect():  # four rows per feature
        out[r["feature"]]["bins"][r["bin"]] = {k: r[k] for k in empty}
    return out


def quartile_lime(rows: DataFrame, bins: dict[str, dict], scorer, samples: int = 5000, kept: int = 10,
                  seed: int = 42, key: str = "LIME", run: int = 0) -> DataFrame:
    """Plain local surrogate on quartile bins: same-bin indicators, the ``kept`` strongest features.

    ``rows(row_id, <feature columns>)``.  A sample draws each feature's bin by
    training frequency and a clipped normal value inside it; sample 0 is the row.
    """
    out = quartile_lime_counts(rows, bins, scorer, (samples,), (run,), kept, seed)
    return out.select(F.lit(key).alias("explainer_key"), "row_id", "attrs", "predicted_class", "r_squared", "intercept",
                      "local_prediction", "num_samples")


def quartile_lime_counts(rows: DataFrame, bins: dict[str, dict], scorer, counts=(200, 500, 1000, 2000, 5000), runs=(0,),
                         kept: int = 10, seed: int = 42) -> DataFrame:
    """Quartile surrogates for several sample counts and repeated draws in one pass: (num_samples, run, row_id, attrs, ...).

    A smaller count is a prefix of a larger one's samples, so weighted sums are kept at every count and only the
    largest count is drawn and scored, inside the row's Arrow batch.
    """
    names, counts = list(bins), sorted(counts)
    width, largest = len(names), counts[-1]
    edges = [np.array(bins[n]["cuts"], float) for n in names]
    total = [np.cumsum([b["n"] for b in bins[n]["bins"]]) for n in names]
    shares = [t / t[-1] for t in total]
    stat = lambda n, k: np.array([0.0 if b[k] is None else float(b[k]) for b in bins[n]["bins"]])
    stats = [tuple(stat(n, k) for k in ("mean", "std", "min", "max")) for n in names]
    out = T.StructType([
        T.StructField("num_samples", T.LongType()), T.StructField("run", T.IntegerType()), T.StructField("row_id", T.LongType()),
        T.StructField("attrs", T.ArrayType(T.DoubleType())),
        *[T.StructField(n, T.DoubleType()) for n in ("predicted_class", "r_squared", "intercept", "local_prediction")]])

    def drawn(ids, own, run):
        """Samples 0 to ``largest`` - 1 of some rows: values, and whether they lie in the row's own bins."""
        who = np.arange(1, largest)
        u = S.uniforms(seed, ids, who, width, 0, run)
        noise = S.normals(seed, ids, who, width, 1, run)
        values = np.empty((len(own), largest, width))
        same = np.ones(values.shape)
        values[:, 0] = own
        for j in range(width):
            drawn_bin = np.minimum(np.searchsorted(shares[j], u[:, :, j], side="right"), len(shares[j]) - 1)
            mean, std, low, high = (v[drawn_bin] for v in stats[j])
            values[:, 1:, j] = np.clip(mean + std * noise[:, :, j], low, high)
            same[:, 1:, j] = drawn_bin == np.searchsorted(edges[j], own[:, j], side="left")[:, None]
        return values, same

    def explained(ids, own):
        for run in runs:
            values, z = drawn(ids, own, run)
            p = scorer.predict(values.reshape(-1, width)).reshape(len(own), largest, -1)
            cls = p[:, 0].argmax(axis=1)
            y = p[np.arange(len(own)), :, cls]
            w = np.sqrt(np.exp(-((1.0 - z) ** 2).sum(axis=2) / (0.75**2 * width)))
            sums = None
            for a, b in zip([0, *counts], counts):
                part = S.moments(z[:, a:b], y[:, a:b], w[:, a:b])
                sums = part if sums is None else tuple(x + v for x, v in zip(sums, part))
                coef, _, _ = S.ridge(sums, 0.01)
                top = np.sort(np.argsort(-np.abs(coef), axis=1, kind="stable")[:, :kept], axis=1)
                coef, icpt, r2 = S.ridge(S.chosen(sums, top), 1.0)
                attrs = np.zeros((len(own), width))
                np.put_along_axis(attrs, top, coef, axis=1)
                yield b, run, attrs, cls, r2, icpt, icpt + coef.sum(1)

    def run_batches(batches):
        for batch in batches:
            x = batch["features"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            ids = batch["row_id"].to_numpy()
            for part in _row_parts(len(x), largest * width):
                for count, run, attrs, *numbers in explained(ids[part], x[part]):
                    n = len(attrs)
                    offsets = pa.array(np.arange(0, attrs.size + 1, width, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, count)), pa.array(np.full(n, run, np.int32)), pa.array(ids[part]),
                        pa.ListArray.from_arrays(offsets, pa.array(attrs.ravel())), *[pa.array(v.astype(float)) for v in numbers]], names=out.names)

    packed = rows.select(F.col("row_id").cast("bigint").alias("row_id"), A.as_doubles(F.array(*[F.col(f"`{n}`") for n in names])).alias("features"))
    return spread_by_key(packed, "row_id").mapInArrow(run_batches, out)


def stable_sample_count(explain, candidates=(200, 500, 1000, 2000, 5000), repeats: int = 5, threshold: float = 0.85,
                        top_k: int = 10, at_once: bool = False) -> DataFrame:
    """Smallest sample count whose repeated explanations agree: ``(num_samples, stability, chosen)`` rows.

    ``explain(count, run)`` returns ``(row_id, attrs)``; with ``at_once``, ``explain(candidates, runs)`` returns
    ``(num_samples, run, row_id, attrs)`` of all of them, as :func:`quartile_lime_counts` does in one pass.
    Agreement is the mean pairwise Jaccard of top-k sets.
    """
    from flowaudit.operators.quality import stability

    if at_once:
        runs = explain(tuple(sorted(candidates)), tuple(range(repeats)))
    else:
        parts = [explain(c, r).select(F.lit(c).alias("num_samples"), F.lit(r).alias("run"), "row_id", "attrs")
                 for c in sorted(candidates) for r in range(repeats)]
        runs = reduce(DataFrame.union, parts)
    per_row = stability(runs, top_k, ["num_samples"])
    score = F.coalesce(F.col("jaccard_mean"), F.lit(1.0))
    s = per_row.groupBy("num_samples").agg(F.avg(score).alias("stability"))
    best = s.agg(F.coalesce(F.min(F.when(F.col("stability") >= threshold, F.col("num_samples"))),
                            F.max("num_samples")).alias("_best"))
    return s.join(F.broadcast(best)).select("num_samples", "stability",
                                            (F.col("num_samples") == F.col("_best")).alias("chosen"))


def kernel_shap(rows: DataFrame, scorer, background: np.ndarray, schema: FlowSchema | None = None,
                samples: int = 2048, seed: int = 42, key: str = "PA-KernelSHAP") -> DataFrame:
    """Shapley estimates from feature coalitions over a background, repaired before scoring.

    ``rows(row_id, features)``.  One coalition table serves all rows, so the least-squares solution is a constant
    matrix: each row needs only the mean score per coalition.  Coalitions are mixed with the background, repaired at the
    row's protocol, scored and averaged inside the row's Arrow batch; no mixed copy is a row of a table.
    """
    width = background.shape[1]
    masks, p_matrix, q = K.coalition_design(width, samples, seed)
    ends = np.vstack([np.zeros((1, width), dtype=int), np.ones((1, width), dtype=int), masks]).astype(bool)
    program = None if schema is None else RuleProgram(schema)
    proto = program.protocol if program is not None else None
    # coalitions of one row that are mixed at once
    step = max(1, COPY_CELLS // background.size)

    def kernel(x, batch):
        attrs, cls, base = np.empty(x.shape), np.empty(len(x), int), np.empty(len(x))
        for i, row in enumerate(x):
            means = []
            for s in range(0, len(ends), step):
                mixed = np.where(ends[s : s + step, None, :], row, background).reshape(-1, width)
                if program is not None:
                    mixed = program(mixed, None if proto is None else np.full(len(mixed), row[proto]))
                p = scorer.predict(mixed)
                means.append(p.reshape(-1, len(background), p.shape[1]).mean(axis=1))
            y = np.vstack(means)
            k = cls[i] = int(y[1].argmax())
            f0, fx = y[0, k], y[1, k]
            attrs[i], base[i] = p_matrix @ (y[2:, k] - f0) + q * (fx - f0), f0
        return attrs, {"predicted_class": cls, "expected_value": base}

    packed = spread_by_key(rows.select("row_id", A.as_doubles(F.col("features")).alias("features")), "row_id")
    return batch_explain(packed, kernel, ["predicted_class", "expected_value"], key).select(
        "explainer_key", "row_id", "attrs", "predicted_class", "expected_value")


def ablation_interactions(rows: DataFrame, explain, top_n: int = 20) -> DataFrame:
    """Approximate interactions: how all attributions move when feature j takes its mean.

    ``rows(row_id, features)``; ``explain`` maps rows (other columns kept) to rows with
    ``attrs``.  Ablated copies of the ``top_n`` most important features are explained in
    one pass for the class predicted on the untouched row; cell (i, j) is base minus
    ablated attribution of i.
    """
    from flowaudit.operators.quality import column_means, with_ablations

    base = explain(rows.select("row_id", "features"))
    long = base.select(F.posexplode("attrs").alias("i", "v"))
    strongest = long.groupBy("i").agg(F.avg(F.abs("v")).alias("m")).orderBy(F.desc("m"), "i").limit(top_n)
    top = [r["i"] for r in strongest.collect()]
    fixed = rows.select("row_id", "features")
    if "predicted_class" in base.columns:
        fixed = fixed.join(base.select("row_id", F.col("predicted_class").cast("int").alias("target")), "row_id")
    copies = with_ablations(fixed, column_means(rows), {j: [j] for j in top}, "j")
    moved = explain(copies).select("row_id", "j", F.col("attrs").alias("_m"))
    pair = base.select("row_id", F.col("attrs").alias("_b")).join(moved, "row_id")
    return pair.select("row_id", "j", F.posexplode(A.difference(F.col("_b"), F.col("_m"))).alias("i", "v")).select(
        "row_id", "i", "j", "v")


def union_explanations(parts: dict[str, DataFrame]) -> DataFrame:
    """All explainers over one sample as one table; optional columns become null."""
    columns = ["row_id", "attrs", "predicted_class", "r_squared", "intercept", "local_prediction",
               "convergence_delta", "expected_value", "num_samples"]
    out = None
    for key, df in parts.items():
        have = set(df.columns)
        part = df.select(F.lit(key).alias("explainer_key"), *[
            F.col(c) if c in have else F.lit(None).cast("bigint" if c == "num_samples" else "double").alias(c)
            for c in columns])
        out = part if out is None else out.unionByName(part)
    return out


def explain_all(jobs: dict, write) -> DataFrame | list[tuple[str, str]]:
    """Run every explainer job; a failing one is reported and skipped.

    ``jobs[key]() -> DataFrame`` and ``write(key, df)`` materialises it.  Returns the
    list of ``(key, error)`` that failed.
    """
    failed = []
    for key, job in jobs.items():
        try:
            write(key, job())
        except Exception as e:  # noqa: BLE001 - any explainer error must not stop the others
            failed.append((key, f"{type(e).__name__}: {e}"))
    return failed
