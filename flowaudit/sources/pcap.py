"""Classic capture files as packet rows."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

PACKET_SCHEMA = (
    "file string, pkt_no bigint, src string, dst string, sport int, dport int, protocol string, ip_ttl int, "
    "ip_tos int, ip_total_length int, ip_flags int, tcp_window_size int, tcp_flags int, tcp_seq bigint, "
    "tcp_ack bigint, tcp_urgent_ptr int, udp_length int, icmp_type int, icmp_code int, ts double, payload_size int"
)
_NAMES = [c.split()[0] for c in PACKET_SCHEMA.split(", ")]

# --- fixed values: file magics (byte order, ticks per second), link types and protocol numbers ---
MAGICS = {0xA1B2C3D4: 1e6, 0xA1B23C4D: 1e9}
ETHERNET, RAW_IP = 1, (12, 101, 228)
TCP, UDP, ICMP = 6, 17, 1


def _frame(frame: bytes, link: int) -> bytes | None:
    """The IPv4 packet inside a captured frame."""
    if link == ETHERNET:
        kind, at = int.from_bytes(frame[12:14], "big"), 14
        while kind in (0x8100, 0x88A8):
            kind, at = int.from_bytes(frame[at + 2 : at + 4], "big"), at + 4
        return frame[at:] if kind == 0x0800 else None
    if link in RAW_IP:
        return frame if frame and frame[0] >> 4 == 4 else None
    return None


def decode_packet(file: str, number: int, ts: float, frame: bytes, link: int) -> tuple | None:
    """One packet row, or None unless it is IPv4 with TCP, UDP or ICMP.

    Payload sizes assume 20-byte IP and TCP headers, so options count as payload.
    """
    ip = _frame(frame, link)
    if ip is None or len(ip) < 20:
        return None
    head, tos, length, _, frag, ttl, proto, _, src, dst = struct.unpack("!BBHHHBBH4s4s", ip[:20])
    body = ip[(head & 15) * 4 :]
    dotted = lambda a: ".".join(map(str, a))
    row = dict.fromkeys(_NAMES)
    row.update(file=file, pkt_no=number, src=dotted(src), dst=dotted(dst), sport=0, dport=0, ip_ttl=ttl, ip_tos=tos,
               ip_total_length=length, ip_flags=frag >> 13, ts=ts)
    if proto == TCP and len(body) >= 20:
        sport, dport, seq, ack, off, window, _, urgent = struct.unpack("!HHIIHHHH", body[:20])
        row.update(protocol="tcp", sport=sport, dport=dport, tcp_seq=seq, tcp_ack=ack, tcp_flags=off & 0x1FF,
                   tcp_window_size=window, tcp_urgent_ptr=urgent, payload_size=max(0, length - 40))
    elif proto == UDP and len(body) >= 8:
        sport, dport, size, _ = struct.unpack("!HHHH", body[:8])
        row.update(protocol="udp", sport=sport, dport=dport, udp_length=size, payload_size=max(0, size - 8))
    elif proto == ICMP and len(body) >= 4:
        row.update(protocol="icmp", icmp_type=body[0], icmp_code=body[1], payload_size=max(0, length - 28))
    else:
        return None
    return tuple(row[n] for n in _NAMES)


def decode_capture(file: str, content: bytes):
    """Packet rows of one capture; the number counts every captured frame."""
    if len(content) < 24:
        return
    for order in ("<", ">"):
        magic = struct.unpack(order + "I", content[:4])[0]
        if magic in MAGICS:
            break
    else:
        raise ValueError(f"{file}: not a classic capture file")
    link, at, number = struct.unpack(order + "I", content[20:24])[0], 24, 0
    while at + 16 <= len(content):
        sec, part, kept, _ = struct.unpack(order + "IIII", content[at : at + 16])
        row = decode_packet(file, number, sec + part / MAGICS[magic], content[at + 16 : at + 16 + kept], link)
        if row is not None:
            yield row
        at, number = at + 16 + kept, number + 1


def capture_packets(files: DataFrame, batch_rows: int = 20_000) -> DataFrame:
    """Packets of captures given as ``(path, content)`` rows, one capture at a time inside a task."""

    def decode(frames):
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = []
                for row in decode_capture(name, bytes(content)):
                    rows.append(row)
                    if len(rows) == batch_rows:
                        yield pd.DataFrame(rows, columns=_NAMES, dtype=object)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=_NAMES, dtype=object)

    return files.select("path", "content").mapInPandas(decode, PACKET_SCHEMA)


def read_captures(spark: SparkSession, path: str, batch_rows: int = 20_000) -> DataFrame:
    """Packets of every capture under ``path``; files are decoded in parallel, one file per task at a time."""
    return capture_packets(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), batch_rows)
