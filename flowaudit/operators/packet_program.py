"""Perturbed, repaired and checked copies of packets as one NumPy program, for work that keeps a packet's copies inside its task.

``packets`` has the same noise, rules and checks as columns; both give the same copies. A missing value is NaN here.
"""

from __future__ import annotations

import numpy as np

from flowaudit.functions import key_draws as D
from flowaudit.operators.fixed_values import (
    ACK, FIN, ICMP_CODES, ICMP_HEADER, IP_FLAGS, IP_HEADER, RST, SYN, TCP_HEADER, UDP_HEADER, URG,
)

MAX_16, MAX_32 = 2**16 - 1, 2**32 - 1
TCP, UDP, ICMP, OTHER = "tcp", "udp", "icmp", "other"
#: Columns of a packet that the program reads besides ``protocol`` and the hash of its keys.
READS = ("ip_ttl", "ip_tos", "ip_total_length", "tcp_window_size", "tcp_flags", "tcp_seq", "tcp_ack", "tcp_urgent_ptr",
         "icmp_type", "icmp_code", "payload_size")
#: Those that the columns cut to whole numbers.
WHOLE = ("ip_total_length", "tcp_flags", "payload_size")
#: Noise of a field in units of sigma, and the range it is put back to.
NOISE = {"ip_ttl": (1, 1, 255), "ip_tos": (1, 0, 255), "tcp_window_size": (100, 0, 65535), "tcp_seq": (1000, 0, MAX_32),
         "tcp_ack": (1000, 0, MAX_32), "tcp_urgent_ptr": (1, 0, 65535)}


def _snapped(values: np.ndarray, allowed) -> np.ndarray:
    steps = np.array(sorted(allowed))
    return steps[np.searchsorted(steps[:-1] + steps[1:], 2 * values, side="left")]


_IP_FLAGS = _snapped(np.arange(8), IP_FLAGS).astype(float)
_ICMP_TYPES = _snapped(np.arange(256), ICMP_CODES)
_LARGEST = np.full(256, np.nan)
for _type, _codes in ICMP_CODES.items():
    _LARGEST[_type] = max(_codes)


def repaired_flags(flags: np.ndarray, original: np.ndarray) -> np.ndarray:
    """As ``packets.repair_tcp_flags``, for whole numbers without nulls."""
    has = lambda f, bits: (f & bits) != 0
    open_ = (flags | ACK) & ~SYN
    open_ = np.where(has(open_, FIN) & has(open_, RST), open_ & ~RST, open_)
    out = np.select(
        [has(original, SYN) & ~has(original, ACK), has(original, SYN), has(original, RST), has(original, FIN)],
        [(flags | SYN) & ~(FIN | RST | ACK), (flags | SYN | ACK) & ~(FIN | RST), (flags | RST) & (RST | ACK),
         (flags | FIN | ACK) & ~(RST | SYN)], open_)
    out = np.where(has(out, SYN), out & ~(FIN | RST), out)
    return np.where(out == 0, original, out)


def _noisy(packets: dict, h: np.ndarray, field: str, sigma: float) -> np.ndarray:
    scale, low, high = NOISE[field]
    x = D.normals(h, field)
    x *= sigma * scale
    x += packets[field][:, None]
    np.rint(x, out=x)
    np.maximum(x, low, out=x)
    return np.minimum(x, high, out=x)


def copies(packets: dict[str, np.ndarray], kind: str, attempts: np.ndarray, sigma: float) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Copies of packets of one protocol: header fields (packets, attempts) and which copies are valid.

    ``packets`` holds the columns ``READS`` as doubles and ``hash``, the hash of seed and keys. Fields of other protocols
    are null after the repair, so they are not drawn.
    """
    h = D.then_int(packets["hash"], attempts)
    shape, payload = h.shape, packets["payload_size"]
    each = lambda v: np.broadcast_to(v[:, None], shape)
    out = {f: _noisy(packets, h, f, sigma) for f in ("ip_ttl", "ip_tos")}
    out["ip_flags"] = _IP_FLAGS[D.picks(h, "ip_flags", 8)]
    header = {TCP: TCP_HEADER, UDP: UDP_HEADER, ICMP: ICMP_HEADER}.get(kind)
    out["ip_total_length"] = each(packets["ip_total_length"] if header is None else IP_HEADER + header + payload)
    if kind == TCP:
        for f in ("tcp_window_size", "tcp_seq", "tcp_ack", "tcp_urgent_ptr"):
            out[f] = _noisy(packets, h, f, sigma)
        known = ~np.isnan(packets["tcp_flags"])
        first = np.where(known, packets["tcp_flags"], 0).astype(np.int64)[:, None]
        # the repaired flags of all 64 draws of a packet, looked up
        table = repaired_flags(first ^ np.arange(64), first)
        drawn = D.picks(h, "tcp_flags", 64)
        urgent = np.take_along_axis((table & URG) != 0, drawn, axis=1) | ~known[:, None]
        out["tcp_flags"] = np.take_along_axis(np.where(known[:, None], table, np.nan), drawn, axis=1)
        out["tcp_urgent_ptr"] = np.where(urgent, out["tcp_urgent_ptr"], 0.0)
    elif kind == UDP:
        out["udp_length"] = each(UDP_HEADER + payload)
    elif kind == ICMP:
        types = _ICMP_TYPES[D.picks(h, "icmp_type", 256)]
        most = np.where(np.isnan(packets["icmp_type"])[:, None], np.nan, _LARGEST[types])
        code = np.where(np.isnan(packets["icmp_code"])[:, None], np.nan, D.picks(h, "icmp_code", 256))
        out["icmp_type"] = np.where(np.isnan(most), np.nan, types)
        out["icmp_code"] = np.fmin(code, most)
        out["icmp_code"][np.isnan(code)] = np.nan
    return out, _valid(out, kind, shape)


def _valid(out: dict[str, np.ndarray], kind: str, shape) -> np.ndarray:
    """As ``packets.packet_is_valid``; comparisons with NaN are false, as those with null count as false there."""
    there = lambda *names: np.logical_or.reduce([~np.isnan(out[n]) for n in names if n in out] or [np.zeros(shape, bool)])
    bad = (out["ip_ttl"] <= 0) | (out["ip_total_length"] < IP_HEADER) | (out["ip_total_length"] > MAX_16)
    if kind == TCP:
        known = there("tcp_flags")
        flags = np.where(known, out["tcp_flags"], 0).astype(np.int64)
        in_32 = lambda n: (out[n] >= 0) & (out[n] <= MAX_32)
        urgent = out["tcp_urgent_ptr"]
        bad |= there("udp_length", "icmp_type") | (known & (
            (((flags & SYN) != 0) & ((flags & (FIN | RST)) != 0))
            | (((flags & URG) == 0) & (np.isnan(urgent) | (urgent != 0)))
            | ~(in_32("tcp_seq") & in_32("tcp_ack"))))
    elif kind == UDP:
        bad |= there("tcp_flags", "tcp_seq", "tcp_window_size") | (out["udp_length"] < UDP_HEADER)
    elif kind == ICMP:
        code, types = out["icmp_code"], out["icmp_type"]
        most = _LARGEST[np.where(np.isnan(types), 1, types).astype(int)]  # 1 is no known type
        bad |= there("tcp_flags", "udp_length") | ~((code >= 0) & (code <= most))
    return ~bad
