"""NumPy kernels over a batch of equally long vectors, and their Arrow UDFs.

Ranking and Kendall's tau loop over feature pairs; as interpreted array lambdas
they cost about 50 times more than these batched kernels.  Spark still decides
which rows meet; a kernel only sees one Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F

FLAT = 1e-12


def matrix(column) -> np.ndarray:
    """Stack a batch of equally long vectors into a (rows, width) matrix."""
    return np.vstack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def average_ranks(m: np.ndarray) -> np.ndarray:
    """1-based row ranks, ties averaged."""
    n = m.shape[1]
    order = np.argsort(m, axis=1, kind="stable")
    s = np.take_along_axis(m, order, axis=1)
    starts = np.ones_like(s, dtype=bool)
    starts[:, 1:] = s[:, 1:] != s[:, :-1]
    ends = np.ones_like(starts)
    ends[:, :-1] = starts[:, 1:]
    pos = np.arange(n)
    first = np.maximum.accumulate(np.where(starts, pos, 0), axis=1)
    last = np.minimum.accumulate(np.where(ends, pos, n)[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(m.shape)
    np.put_along_axis(out, order, (first + last) / 2.0 + 1.0, axis=1)
    return out


def top_mask(m: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k largest values per row (smaller index wins ties)."""
    idx = np.argsort(-m, axis=1, kind="stable")[:, :k]
    mask = np.zeros(m.shape, dtype=bool)
    np.put_along_axis(mask, idx, True, axis=1)
    return mask


def spearman(ra: np.ndarray, rb: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Pearson correlation of average ranks per row; 0 where not usable."""
    c = (ra.shape[1] + 1) / 2.0
    a, b = ra - c, rb - c
    spread = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    ok = usable & (spread > 0)
    return np.where(ok, (a * b).sum(1) / np.where(ok, spread, 1.0), 0.0)


def kendall(ra: np.ndarray, rb: np.ndarray, usable: np.ndarray, chunk: int = 1 << 22) -> np.ndarray:
    """Kendall tau-b per row from the signs of all feature pairs; 0 where not usable."""
    rows, n = ra.shape
    i, j = np.triu_indices(n, 1)
    out = np.zeros(rows)
    step = max(1, chunk // max(1, len(i)))
    for s in range(0, rows, step):
        sa = np.sign(ra[s : s + step, i] - ra[s : s + step, j])
        sb = np.sign(rb[s : s + step, i] - rb[s : s + step, j])
        untied = np.sqrt(np.count_nonzero(sa, 1).astype(float) * np.count_nonzero(sb, 1))
        ok = usable[s : s + step] & (untied > 0)
        out[s : s + step] = np.where(ok, (sa * sb).sum(1) / np.where(ok, untied, 1.0), 0.0)
    return out


def agreement(vectors: list[np.ndarray], top_k: tuple[int, ...], with_tau: bool) -> dict[tuple[int, int], dict]:
    """All explainer pairs of a batch of rows; vectors[i] is (rows, width_i).

    Every vector is ranked once per width it is compared on.
    """
    cache: dict[tuple[int, int], tuple] = {}

    def prepared(i: int, width: int):
        if (i, width) not in cache:
            m = np.abs(vectors[i][:, :width])
            masks = [top_mask(m, min(k, width)) for k in top_k]
            cache[i, width] = (average_ranks(m), m.std(axis=1) >= FLAT, masks)
        return cache[i, width]

    out = {}
    for i in range(len(vectors)):
        for j in range(i + 1, len(vectors)):
            width = min(vectors[i].shape[1], vectors[j].shape[1])
            ra, ua, ma = prepared(i, width)
            rb, ub, mb = prepared(j, width)
            ok = ua & ub
            row = {"rho": spearman(ra, rb, ok)}
            if with_tau:
                row["tau"] = kendall(ra, rb, ok)
            for k, a, b in zip(top_k, ma, mb):
                row[f"top{k}"] = (a & b).sum(1) / min(k, width)
            out[i, j] = row
    return out


def both_distances(x: Column, y: Column, u: Column, v: Column) -> Column:
    """Euclidean distances ``dx`` of x from y and ``de`` of u from v; null where an array or one of its values is missing."""

    @F.arrow_udf("struct<dx double, de double>")
    def measured(x: pa.Array, y: pa.Array, u: pa.Array, v: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([_distance(x, y), _distance(u, v)], ["dx", "de"])

    return measured(x, y, u, v)


def _distance(x: pa.Array, y: pa.Array) -> pa.Array:
    sizes = [np.diff(a.offsets.to_numpy()) for a in (x, y)]
    known = np.ones(len(x), bool)
    for a in (x, y):
        known &= a.is_valid().to_numpy(zero_copy_only=False)
    if not known.all() or not (sizes[0] == sizes[1]).all():
        # missing vectors, or vectors of different lengths, whose further places are missing
        known &= sizes[0] == sizes[1]
        out = np.full(len(x), np.nan)
        if known.any():
            part = _distance(x.filter(pa.array(known)), y.filter(pa.array(known)))
            out[known] = part.to_numpy(zero_copy_only=False)
            known[known] = part.is_valid().to_numpy(zero_copy_only=False)
        return pa.array(out, mask=~known)
    flat = [a.flatten() for a in (x, y)]
    a, b = (f.to_numpy(zero_copy_only=False).astype(float, copy=False) for f in flat)
    total, gaps = np.zeros(len(x)), np.zeros(len(x), bool)
    if len(a):
        square = (a - b) ** 2
        row = np.repeat(np.arange(len(x)), sizes[0])
        total = np.bincount(row, square, len(x))  # in the order of the places
        for f in flat:
            if f.null_count:
                gaps |= np.bincount(row, f.is_null().to_numpy(zero_copy_only=False), len(x)) > 0
    return pa.array(np.sqrt(total), mask=gaps)


def spearman_signed(a: Column, b: Column, guard: float = 1e-10) -> Column:
    """Spearman of signed vectors; 0 when either is (nearly) constant."""

    @F.pandas_udf("double")
    def rho(x: pd.Series, y: pd.Series) -> pd.Series:
        mx, my = matrix(x), matrix(y)
        usable = (mx.std(axis=1) > guard) & (my.std(axis=1) > guard)
        return pd.Series(spearman(average_ranks(mx), average_ranks(my), usable))

    return rho(a, b)
