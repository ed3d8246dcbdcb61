"""The draws of ``hashing`` for many copies of a row inside its task: same keys, same numbers.

A hash of several columns is a chain (XXH64), so the row's own keys are hashed once as a column and the chain goes on here
over attempts and field names.
"""

from __future__ import annotations

import numpy as np

P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(h: np.ndarray, bits: int, spare: np.ndarray) -> None:
    np.right_shift(h, np.uint64(64 - bits), out=spare)
    h <<= np.uint64(bits)
    h |= spare


def _ended(h: np.ndarray, spare: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, P2), (29, P3), (32, None)):
        np.right_shift(h, np.uint64(shift), out=spare)
        h ^= spare
        if factor is not None:
            h *= factor
    return h


def _step(h: np.ndarray, add, bits: int, factor, plus, spare: np.ndarray) -> None:
    h ^= add
    _turned(h, bits, spare)
    h *= factor
    if plus is not None:
        h += plus


def then_int(h: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes ``h`` (n) carried on over 32-bit integers (m): (n, m)."""
    with np.errstate(over="ignore"):
        out = np.repeat((h + (P5 + np.uint64(4)))[:, None], len(values), axis=1)
        spare = np.empty_like(out)
        _step(out, (values.astype(np.uint64) & np.uint64(0xFFFFFFFF)) * P1, 23, P2, P3, spare)
        return _ended(out, spare)


def then_text(h: np.ndarray, text: str) -> np.ndarray:
    """Hashes carried on over a short text (less than 32 bytes)."""
    data, at = text.encode(), 0
    if len(data) >= 32:
        raise ValueError("texts of 32 bytes and more are hashed in lanes")
    with np.errstate(over="ignore"):
        out, spare = h + (P5 + np.uint64(len(data))), np.empty_like(h)
        while at + 8 <= len(data):
            word = np.full(1, int.from_bytes(data[at : at + 8], "little"), np.uint64) * P2
            _turned(word, 31, np.empty_like(word))
            _step(out, word * P1, 27, P1, P4, spare)
            at += 8
        if at + 4 <= len(data):
            _step(out, np.full(1, int.from_bytes(data[at : at + 4], "little"), np.uint64) * P1, 23, P2, P3, spare)
            at += 4
        for byte in data[at:]:
            _step(out, np.full(1, byte, np.uint64) * P5, 11, P1, None, spare)
        return _ended(out, spare)


def _uniform(h: np.ndarray) -> np.ndarray:
    h >>= np.uint64(11)
    out = h.view(np.int64).astype(float)  # 53 bits, so the sign is free
    out *= 2.0**-53
    return out


def normals(h: np.ndarray, field: str) -> np.ndarray:
    """``hashing.normal`` of the keys in ``h`` and the field."""
    own = then_text(h, field)
    u, v = _uniform(then_text(own, "r")), _uniform(then_text(own, "a"))
    np.subtract(1.0, u, out=u)
    np.log(u, out=u)
    u *= -2.0
    np.sqrt(u, out=u)
    v *= 2.0 * np.pi
    np.cos(v, out=v)
    u *= v
    return u


def picks(h: np.ndarray, field: str, n: int) -> np.ndarray:
    """``hashing.pick`` of n values (n a power of two: the upper bits) for the keys in ``h`` and the field."""
    if n < 2 or n & (n - 1):
        raise ValueError("n must be a power of two")
    out = then_text(h, field)
    out >>= np.uint64(65 - n.bit_length())
    return out.view(np.int64)
