"""Seeded draws that depend only on keys, never on partitioning.

``rand(seed)`` restarts per partition, so a retried task or another partition
count would change the draw.  Hashing the row's own keys gives the same value
wherever and however often the row is computed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _key(k) -> Column:
    return k if isinstance(k, Column) else F.lit(k)


def hash64(seed: int, *keys) -> Column:
    """64-bit hash of the seed and the keys (strings are taken as literals)."""
    return F.xxhash64(F.lit(seed).cast("bigint"), *[_key(k) for k in keys])


def uniform(seed: int, *keys) -> Column:
    """Uniform draw in [0, 1) from the upper 53 hash bits."""
    return F.shiftrightunsigned(hash64(seed, *keys), 11).cast("double") * F.lit(2.0**-53)


def normal(seed: int, *keys) -> Column:
    """Standard normal draw (Box-Muller over two independent hashes)."""
    u1 = F.lit(1.0) - uniform(seed, *keys, F.lit("r"))
    u2 = uniform(seed, *keys, F.lit("a"))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def pick(n, seed: int, *keys) -> Column:
    """Uniform integer in [0, n) as bigint."""
    n = _key(n)
    return F.least(F.floor(uniform(seed, *keys) * n), n.cast("bigint") - 1)
