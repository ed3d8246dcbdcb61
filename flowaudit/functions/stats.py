"""Small scalar statistics used on already aggregated rows (no SciPy needed)."""

from __future__ import annotations

import math


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def wilcoxon_p(diffs: list[float]) -> float:
    """Two-sided signed-rank p-value: exact for n <= 50 without ties, else normal."""
    d = [x for x in diffs if x != 0.0]
    n = len(d)
    if n == 0:
        return 1.0
    order = sorted(range(n), key=lambda i: abs(d[i]))
    ranks, ties, i = [0.0] * n, 0.0, 0
    while i < n:
        j = i
        while j < n and abs(d[order[j]]) == abs(d[order[i]]):
            j += 1
        for m in range(i, j):
            ranks[order[m]] = (i + j + 1) / 2.0
        ties += (j - i) ** 3 - (j - i)
        i = j
    w_pos = sum(r for r, x in zip(ranks, d) if x > 0)
    w = min(w_pos, n * (n + 1) / 2.0 - w_pos)
    if ties == 0 and n == len(diffs) and n <= 50:
        counts = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(counts) - 1, r - 1, -1):
                counts[s] += counts[s - r]
        return min(1.0, 2.0 * sum(counts[: int(w) + 1]) / 2.0**n)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0)
    return normal_two_sided((w - n * (n + 1) / 4.0) / sd) if sd > 0 else 1.0


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            h *= step
        if abs(step - 1.0) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a Pearson/Spearman coefficient (t-distribution, n-2 df)."""
    if r is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1.0:
        return 0.0
    df = n - 2
    return incomplete_beta(df / 2.0, 0.5, df / (df + r * r * df / (1.0 - r * r)))
