"""Row-local math over ``array<double>`` columns (one sample per row, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, even when the body loops over it.

    A lambda re-evaluates outer expressions per element; binding them to a lambda
    variable of a one-element array avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def absolute(a: Column) -> Column:
    return F.transform(a, lambda v: F.abs(v))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def variance(a: Column) -> Column:
    """Population variance, centred first so that near-constant rows stay near zero."""
    return let(mean(a), lambda m: total(F.transform(a, lambda v: (v - m) * (v - m)))) / F.size(a)


def l2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def distance(a: Column, b: Column, norm: str = "l2") -> Column:
    """``l2`` or ``linf`` distance between two vectors."""
    if norm == "l2":
        return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    if norm == "linf":
        return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    raise ValueError(f"unknown norm {norm!r}")


def top_k(a: Column, k) -> Column:
    """0-based indices of the k largest values; ties go to the smaller index."""
    pairs = F.transform(a, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: s["i"])


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """|A and B| / |A or B| of two index sets."""
    inter = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(F.array_union(a, b)).cast("double")
    return F.when(union > 0, inter / union).otherwise(F.lit(empty))


def overlap(a: Column, b: Column, k) -> Column:
    """|A and B| / k."""
    return F.size(F.array_intersect(a, b)).cast("double") / k


def argmax(a: Column) -> Column:
    """0-based position of the first maximum."""
    return let(a, lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("int"))


def softmax(a: Column) -> Column:
    shifted = lambda x: let(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp(v - m)))
    normalised = lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s))
    return let(a, lambda x: let(shifted(x), normalised))


def as_doubles(a: Column) -> Column:
    return F.transform(a, lambda v: v.cast("double"))


def median_of(values: Column) -> Column:
    """Median of a small array, interpolated between the middle two."""
    at = lambda s, f: F.get(s, f((F.size(s) - 1) / 2).cast("int"))
    return let(F.array_sort(values), lambda s: (at(s, F.floor) + at(s, F.ceil)) / 2.0)
