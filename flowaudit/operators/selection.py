"""Feature selection: statistical scores, attribution importance and pruning."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowaudit.functions.tables import checkpointed, exact_quantiles, local_rows, small_side, stored, value_ranks
from flowaudit.operators import evaluation as E, models as M

STATISTICAL = ("Chi-Squared", "PCA", "Spearman", "InfoGain")


def target_size(width: int) -> int:
    """How many features to keep: a fifth, at least five."""
    return max(5, int(0.2 * width))


def method_class(method: Column) -> Column:
    return (
        F.when(method == "Full", "Baseline").when(method.isin(*STATISTICAL), "Statistical")
        .when(method.startswith("PA-"), "Protocol-aware").otherwise("XAI")
    )


def cells(df: DataFrame, keep: list[str]) -> DataFrame:
    """``(*keep, feature_idx, value)`` rows of the ``features`` vector."""
    return df.select(*keep, F.posexplode("features").alias("feature_idx", "value"))


def chi_squared(df: DataFrame, y: str = "y") -> DataFrame:
    """Class sums against class share of the feature total: ``(feature_idx, score)``.

    Negative values count as 0 and a constant-zero feature scores 0.
    """
    sums = cells(df, [y]).groupBy(y, "feature_idx").agg(
        F.sum(F.greatest(F.col("value"), F.lit(0.0))).alias("observed"), F.count("*").alias("n"))
    totals = small_side(sums.groupBy("feature_idx").agg(F.sum("observed").alias("total"), F.sum("n").alias("rows")))
    j = sums.join(totals, "feature_idx").withColumn("expected", F.col("total") * F.col("n") / F.col("rows"))
    term = F.when(F.col("expected") > 0, F.pow(F.col("observed") - F.col("expected"), 2) / F.col("expected"))
    return j.groupBy("feature_idx").agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("score"))


def pca_loadings(df: DataFrame, width: int, variance: float = 0.95) -> DataFrame:
    """Largest |loading| of each feature over the components that reach ``variance``."""
    model = PCA(k=width, inputCol="_vec", outputCol="_pc").fit(M.with_vector(df).select("_vec"))
    seen, kept = 0.0, 0
    for v in model.explainedVariance:
        seen, kept = seen + float(v), kept + 1
        if seen >= variance:
            break
    loadings = abs(model.pc.toArray()[:, :kept]).max(axis=1)
    return local_rows(df.sparkSession, [(i, float(v)) for i, v in enumerate(loadings)], "feature_idx int, score double")


def _label_ranks(df: DataFrame, y: str) -> DataFrame:
    """Tie-averaged rank of each class id (as many rows as classes)."""
    return small_side(value_ranks(df.select(F.col(y).cast("double").alias("_y")), [], "_y").select(
        F.col("_y"), F.col("avg_rank").alias("_ry"), F.col("cnt").alias("_ny")))


def spearman_with_class(df: DataFrame, y: str = "y") -> DataFrame:
    """|Spearman| of every feature with the class id, from value counts (no join back to rows)."""
    long = cells(df, [y])
    ranks = value_ranks(long, ["feature_idx"], "value").select(
        "feature_idx", "value", "cnt", F.col("avg_rank").alias("_rx"))
    cross = long.groupBy("feature_idx", "value", F.col(y).cast("double").alias("_y")).agg(F.count("*").alias("_n"))
    # only distinct (value, class) rows meet here, so a dominating value is one row per class
    j = cross.join(ranks, ["feature_idx", "value"]).join(F.broadcast(_label_ranks(df, y)), "_y")
    n = F.sum("_n").cast("double")
    m = (n + 1) / 2
    s = j.groupBy("feature_idx").agg(
        (F.sum(F.col("_n") * F.col("_rx") * F.col("_ry")) - n * m * m).alias("xy"),
        (F.sum(F.col("_n") * F.col("_rx") * F.col("_rx")) - n * m * m).alias("xx"),
        (F.sum(F.col("_n") * F.col("_ry") * F.col("_ry")) - n * m * m).alias("yy"))
    ok = (F.col("xx") > 0) & (F.col("yy") > 0)
    return s.select("feature_idx", F.when(ok, F.abs(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))).otherwise(
        0.0).alias("score"))


def rank_vectors(df: DataFrame, key: str = "row_id", hot_share: int = 1000) -> DataFrame:
    """``(key, ranks)``: tie-averaged rank of every cell within its feature.

    Values holding more than 1/``hot_share`` of the rows (at most ``hot_share`` per
    feature) get their rank by broadcast; the others by an equi join on (feature,
    value), where no key is hot.
    """
    long = cells(df, [key])
    ranks = value_ranks(long, ["feature_idx"], "value").select(
        "feature_idx", "value", "cnt", F.col("avg_rank").alias("_r"))
    n = df.count()
    hot = F.broadcast(ranks.filter(F.col("cnt") * hot_share > n).select("feature_idx", "value", F.col("_r").alias("_hot")))
    tagged = long.join(hot, ["feature_idx", "value"], "left")
    easy = tagged.filter("_hot is not null").select(key, "feature_idx", F.col("_hot").alias("_r"))
    rest = tagged.filter("_hot is null").select(key, "feature_idx", "value")
    cold = rest.join(ranks.filter(F.col("cnt") * hot_share <= n), ["feature_idx", "value"]).select(key, "feature_idx", "_r")
    g = easy.unionByName(cold).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("feature_idx", "_r"))).alias("_x"))
    return g.select(key, F.col("_x._r").alias("ranks"))


def rank_correlations(df: DataFrame, width: int, key: str = "row_id") -> dict[tuple[int, int], float]:
    """Spearman between all features from one rank table and one aggregate (features squared values)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation

    v = rank_vectors(df, key).select(array_to_vector("ranks").alias("v"))
    m = Correlation.corr(v, "v", "pearson").first()[0].toArray()
    return {(i, j): float(m[i, j]) for i in range(width) for j in range(width)}


def spearman_selection(df: DataFrame, width: int, n: int, redundancy: float = 0.8, y: str = "y",
                       key: str = "row_id") -> DataFrame:
    """Best-correlated features first, skipping those too close to a chosen one, then filling up.

    Choosing walks over ``width`` numbers; both correlation steps are Spark jobs.
    """
    score = {r["feature_idx"]: r["score"] for r in spearman_with_class(df, y).collect()}
    corr = rank_correlations(df, width, key)
    order = sorted(range(width), key=lambda i: (-score.get(i, 0.0), i))
    chosen: list[int] = []
    for i in order:
        if len(chosen) < n and not any(abs(corr[i, j]) > redundancy for j in chosen):
            chosen.append(i)
    chosen += [i for i in order if i not in chosen][: n - len(chosen)]
    return local_rows(df.sparkSession, [(i, float(score.get(i, 0.0)), i in chosen) for i in range(width)],
                       "feature_idx int, score double, selected boolean")


def information_gain(df: DataFrame, bins: int = 10, y: str = "y") -> DataFrame:
    """Mutual information (nats) of quantile-binned features with the class, over all rows."""
    long = cells(df, [y])
    q = exact_quantiles(long, ["feature_idx"], "value", [i / bins for i in range(1, bins)])
    cuts = F.broadcast(q.groupBy("feature_idx").agg(F.array_sort(F.collect_set("quantile")).alias("_cuts")))
    binned = long.join(cuts, "feature_idx").withColumn(
        "bin", F.size(F.filter("_cuts", lambda c: c < F.col("value"))))
    joint = binned.groupBy("feature_idx", "bin", y).agg(F.count("*").alias("nxy"))
    # the contingency table has features x bins x classes rows, so its windows are small
    share = lambda *k: F.sum("nxy").over(W.partitionBy("feature_idx", *k)).cast("double")
    j = joint.withColumns({"n": share(), "nx": share("bin"), "ny": share(y)})
    p = F.col("nxy") / F.col("n")
    gain = F.sum(p * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny"))))
    return j.groupBy("feature_idx").agg(F.greatest(gain, F.lit(0.0)).alias("score"))


def _digamma(c: np.ndarray) -> np.ndarray:
    """psi(x) for x >= 1: shifted by 6, then the asymptotic series."""
    x = np.asarray(c, float)
    y = x + 6
    out = np.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * y**4)
    for i in range(6):
        out = out - 1 / (x + i)
    return out


def _sorted_part(batches) -> tuple[np.ndarray, list[np.ndarray], list]:
    """A sorted partition's (starts of features, [feature, class code, value, n], classes)."""
    table = pa.Table.from_batches(batches)
    classes = table["y"].combine_chunks().dictionary_encode()
    columns = [table["feature_idx"].to_numpy(), classes.indices.to_numpy(), table["value"].to_numpy(), table["n"].to_numpy()]
    starts = np.flatnonzero(np.diff(columns[0], prepend=columns[0][0] - 1))
    return np.append(starts, len(columns[0])), columns, [repr(c) for c in classes.dictionary.to_pylist()]


def _by_feature(batches):
    """(feature, class codes, values, counts, classes) of every feature in a partition."""
    batches = [b for b in batches if b.num_rows]
    if batches:
        starts, (f, y, v, n), classes = _sorted_part(batches)
        for a, b in zip(starts, starts[1:]):
            yield int(f[a]), y[a:b], v[a:b], n[a:b], classes


def _radius(v: np.ndarray, n: np.ndarray, before: int, rows: int, k: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance to the k-th neighbour of ``rows`` distinct sorted values from place ``before`` on, and the value it belongs to."""
    gaps, found = np.empty(rows), np.empty(rows)
    steps = np.arange(-reach, reach + 1)
    for s in range(0, rows, 1 << 16):
        own = np.arange(before + s, before + min(rows, s + (1 << 16)))
        at = own[:, None] + steps
        there = (at >= 0) & (at < len(v))
        at = np.clip(at, 0, len(v) - 1)
        gap = np.where(there, np.abs(v[at] - v[own, None]), np.inf)
        held = np.where(there, n[at] - (steps == 0), 0)
        near = np.argsort(gap, axis=1, kind="stable")  # of two values equally near the smaller one comes first
        enough = (np.take_along_axis(held, near, 1).cumsum(axis=1) >= k).argmax(axis=1)
        last = near[np.arange(len(own)), enough]
        gaps[s : s + len(own)], found[s : s + len(own)] = gap[np.arange(len(own)), last], v[at[np.arange(len(own)), last]]
    return gaps, found


def information_gain_neighbours(df: DataFrame, neighbours: int = 3, y: str = "y", chunk_rows: int = 2_000_000) -> DataFrame:
    """Nearest-neighbour estimate of the same quantity (continuous feature, discrete class), over all rows.

    As published for mixed variables: the distance to the k-th neighbour of the same class, then the rows
    of any class nearer than that. Rows are collapsed to (feature, value, class) counts and dealt once in sorted ranges of (feature, value)
    of at most about ``chunk_rows``; everything else happens inside the ranges. A first pass returns every range's outermost
    values of each class, a second one finds all radii and counts the rows within them. Only the first and last k values of a class in a range
    can have a radius that reaches beyond it, so what is asked of other ranges in a third pass is bounded by ranges x classes x k.
    Null or NaN values, null classes and classes of one row are left out.
    """
    k, spark = neighbours, df.sparkSession
    long = cells(df.filter(F.col(y).isNotNull()).withColumnRenamed(y, "y"), ["y"]).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = stored(long.groupBy("feature_idx", "y", F.col("value").cast("double").alias("value")).agg(F.count("*").alias("n")), "neighbour-counts")
    parts = max(-(-counts.count() // chunk_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = checkpointed(counts.repartitionByRange(parts, "feature_idx", "value").sortWithinPartitions("feature_idx", "value"))

    def outermost(batches):
        part = TaskContext.get().partitionId()
        for f, codes, v, n, classes in _by_feature(batches):
            for c in np.unique(codes):
                mine = codes == c
                mv, mn = v[mine], n[mine]
                yield pa.RecordBatch.from_pylist([{
                    "part": part, "f": f, "c": classes[c], "rows": int(mn.sum()), "low": float(v[0]), "high": float(v[-1]),
                    "v": [*mv[:k], *mv[-k:]], "n": [*mn[:k], *mn[-k:]], "first": min(k, len(mv))}], schema=to_arrow_schema(ends))

    ends = T._parse_datatype_string("part int, f int, c string, rows bigint, low double, high double, v array<double>, n array<bigint>, first int")
    seen = sorted(ranges.mapInArrow(outermost, ends).collect(), key=lambda r: (r["f"], r["c"], r["part"]))
    sizes: dict[tuple, int] = {}
    for r in seen:
        sizes[r["f"], r["c"]] = sizes.get((r["f"], r["c"]), 0) + r["rows"]
    seen = [r for r in seen if sizes[r["f"], r["c"]] > 1]
    spans: dict[int, dict[int, list]] = {}  # of a feature: range -> [first value, last value, rows]
    for r in seen:
        spans.setdefault(r["f"], {}).setdefault(r["part"], [r["low"], r["high"], 0])[2] += r["rows"]
    below = {(f, p): n for f, held in spans.items() for p, n in zip(sorted(held), np.cumsum([0, *(held[p][2] for p in sorted(held))]).tolist())}
    around: dict[tuple, tuple] = {}  # of a range, feature and class: the k values before it and behind it
    for i, r in enumerate(seen):
        before, behind = ([], []), ([], [])
        for step, side in ((-1, before), (1, behind)):
            j = i + step
            while 0 <= j < len(seen) and (seen[j]["f"], seen[j]["c"]) == (r["f"], r["c"]) and len(side[0]) < k:
                o = seen[j]
                half = slice(o["first"], None) if step < 0 else slice(0, o["first"])
                pairs = list(zip(o["v"][half], o["n"][half]))[::step][: k - len(side[0])]
                for list_, got in zip(side, zip(*pairs)):
                    list_.extend(got)
                j += step
        around[r["part"], r["f"], r["c"]] = tuple(x[::-1] for x in before), behind

    def within(batches):
        part = TaskContext.get().partitionId()
        for f, codes, v, n, classes in _by_feature(batches):
            kept = np.isin(codes, [i for i, c in enumerate(classes) if sizes.get((f, c), 0) > 1])
            if not kept.any():
                continue
            codes, v, n = codes[kept], v[kept], n[kept]
            running = np.concatenate([[0], n.cumsum()]) + below[f, part]
            earlier = [spans[f][p][1] for p in spans[f] if p < part]
            later = [spans[f][p][0] for p in spans[f] if p > part]
            floor, ceiling = max(earlier, default=-np.inf), min(later, default=np.inf)
            for c in np.unique(codes):
                mine, size = codes == c, sizes[f, classes[c]]
                (lv, ln), (rv, rn) = around[part, f, classes[c]]
                mv, mn, most = v[mine], n[mine], min(k, size - 1)
                gap, u = _radius(np.concatenate([lv, mv, rv]), np.concatenate([ln, mn, rn]).astype(np.int64), len(lv), len(mv), most, k)
                low, high = np.where(u < mv, u, mv - gap), np.where(u > mv, u, mv + gap)
                # rows below the upper end less those up to the lower end; a radius of 0 counts the value's own rows
                upto = np.where(gap > 0, running[np.searchsorted(v, high, "left")], running[np.searchsorted(v, high, "right")])
                under = np.where(gap > 0, running[np.searchsorted(v, low, "right")], running[np.searchsorted(v, low, "left")])
                open_low, open_high = (gap > 0) & (low < floor), (gap > 0) & (high > ceiling)
                done = ~(open_low | open_high)
                m = np.maximum(upto - under, 1)
                fixed = float(_digamma(most) - _digamma(size))
                total = float((mn[done] * (fixed - _digamma(m[done]))).sum())
                answers = [{"f": f, "n": int(mn[done].sum()), "total": total, "fixed": fixed, "low": None, "high": None, "under": 0, "upto": 0}]
                for i in np.flatnonzero(~done).tolist():
                    answers.append({"f": f, "n": int(mn[i]), "total": None, "fixed": fixed, "low": float(low[i]) if open_low[i] else None,
                                    "high": float(high[i]) if open_high[i] else None, "under": int(under[i]), "upto": int(upto[i])})
                yield pa.RecordBatch.from_pylist(answers, schema=to_arrow_schema(answer))

    answer = T._parse_datatype_string("f int, n bigint, total double, fixed double, low double, high double, under bigint, upto bigint")
    answers = ranges.mapInArrow(within, answer).collect()
    asked: dict[int, set] = {}
    for r in answers:
        asked.setdefault(r["f"], set()).update(x for x in (r["low"], r["high"]) if x is not None)
    asked = {f: np.array(sorted(x)) for f, x in asked.items() if x}

    def counted(batches):
        """Rows below each asked value, and up to it, from the range it lies in."""
        part = TaskContext.get().partitionId()
        for f, codes, v, n, classes in _by_feature(batches):
            kept = np.isin(codes, [i for i, c in enumerate(classes) if sizes.get((f, c), 0) > 1])
            if f in asked and kept.any():
                v, running = v[kept], np.concatenate([[0], n[kept].cumsum()]) + below[f, part]
                x = asked[f]
                x = x[(x >= spans[f][part][0]) & (x < min((spans[f][p][0] for p in spans[f] if p > part), default=np.inf))]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(x), f, np.int32)), pa.array(x), pa.array(running[np.searchsorted(v, x, "left")]),
                    pa.array(running[np.searchsorted(v, x, "right")])], names=["f", "x", "below", "upto"])

    held = {}
    if asked:
        for r in ranges.mapInArrow(counted, "f int, x double, below bigint, upto bigint").collect():
            held[r["f"], r["x"]] = r["below"], r["upto"]
    totals: dict[int, list] = {}
    for r in answers:
        score = r["total"]
        if score is None:
            upto = r["upto"] if r["high"] is None else held.get((r["f"], r["high"]), (0, 0))[0]
            under = r["under"] if r["low"] is None else held.get((r["f"], r["low"]), (0, 0))[1]
            score = r["n"] * (r["fixed"] - float(_digamma(max(upto - under, 1))))
        sums = totals.setdefault(r["f"], [0, []])
        sums[0] += r["n"]
        sums[1].append(score)
    scores = [(f, max(0.0, float(_digamma(n)) + math.fsum(parts) / n)) for f, (n, parts) in sorted(totals.items())]
    return local_rows(spark, scores, "feature_idx int, score double")


def select_top(scores: DataFrame, n: int, method: str) -> DataFrame:
    """Mark the n best scores (features are few, so this is a small sort)."""
    best = F.broadcast(scores.orderBy(F.desc("score"), "feature_idx").limit(n).select(
        "feature_idx", F.lit(True).alias("_s")))
    return scores.join(best, "feature_idx", "left").select(
        F.lit(method).alias("method"), "feature_idx", "score", F.coalesce("_s", F.lit(False)).alias("selected"))


def statistical_selection(df: DataFrame, width: int, n: int | None = None) -> DataFrame:
    """All statistical methods: ``(method, feature_idx, score, selected)``."""
    n = target_size(width) if n is None else n
    spear = spearman_selection(df, width, n).select(F.lit("Spearman").alias("method"), "feature_idx", "score", "selected")
    return (
        select_top(chi_squared(df), n, "Chi-Squared")
        .unionByName(select_top(pca_loadings(df, width), n, "PCA"))
        .unionByName(spear)
        .unionByName(select_top(information_gain(df), n, "InfoGain"))
    )


def pruning_sizes(width: int, ratio: float = 0.1, minimum: int = 5) -> list[int]:
    """Feature counts visited when a tenth (at least one) is dropped per step."""
    sizes = [width]
    while sizes[-1] > minimum:
        n = sizes[-1]
        sizes.append(max(minimum, n - max(1, int(n * ratio))))
    return sizes


def iterative_pruning(train: DataFrame, val: DataFrame, importance: list[float], classes: int, ratio: float = 0.1,
                      tolerance: float = 0.01, minimum: int = 5, trees: int = 50, depth: int = 10,
                      seed: int = 42) -> tuple[list[int], list[dict]]:
    """Drop the least important features while the validation F1 stays within ``tolerance``.

    The loop is over model fits (at most a few dozen), each a Spark job; returns the
    kept feature indices and the history.
    """
    width = len(importance)
    order = sorted(range(width), key=lambda i: (-importance[i], i))

    def f1_of(kept: list[int]) -> float:
        cut = lambda d: d.select("y", F.array(*[F.get("features", F.lit(i)) for i in kept]).alias("features"))
        model = M.random_forest(cut(train), trees, depth, seed)
        scored = M.score(model, cut(val))
        scores = E.class_scores(E.confusion(scored, classes))
        return E.f1_summary(scores).first()["f1_weighted"]

    base = f1_of(order)
    best, history = order, [{"n_features": width, "f1": base, "f1_drop": 0.0}]
    for size in pruning_sizes(width, ratio, minimum)[1:]:
        f1 = f1_of(order[:size])
        history.append({"n_features": size, "f1": f1, "f1_drop": base - f1})
        if base - f1 > tolerance:
            break
        best = order[:size]
    return sorted(best), history


def benchmark(train: DataFrame, test: DataFrame, classes: int, feature_sets: dict[str, list[int]], fits: dict) -> DataFrame:
    """Every model on every feature set: evaluation, training time and latency rows.

    ``fits[name](train) -> Spark ML model``; ``feature_sets`` maps a selection method to
    feature indices (``Full`` keeps all).
    """
    import time

    rows = []
    for method, idx in feature_sets.items():
        cut = lambda d: d.select("y", F.array(*[F.get("features", F.lit(i)) for i in idx]).alias("features"))  # noqa: E731,B023
        tr, te = cut(train), cut(test)
        for name, fit in fits.items():
            start = time.perf_counter()
            model = fit(tr)
            took = time.perf_counter() - start
            m = E.evaluate(M.score(model, te), classes).first().asDict()
            lat = E.latency(lambda d, m=model: M.score(m, d), te, runs=1)
            rows.append((name, method, len(idx), m["accuracy"], m["f1_weighted"], m["f1_macro"], m["auc"],
                         m["fpr_macro"], m["far_overall"], took, lat["inference_ms_per_sample_mean"],
                         lat["inference_ms_per_sample_std"]))
    return local_rows(
        train.sparkSession, rows,
        "model string, selection_method string, n_features int, accuracy double, f1_weighted double, f1_macro double, "
        "auc_roc double, fpr_macro double, far_overall double, train_time_s double, "
        "inference_ms_per_sample_mean double, inference_ms_per_sample_std double")
