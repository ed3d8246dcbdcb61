"""Queries on packets and flows (the events table seen as traffic)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from flowaudit.operators import explainers as X, models as M, packets as P, quality as Q
from flowaudit.plans.inputs import PACKET_SQL, packets
from flowaudit.plans.registry import big, query, rounded, table

def _snap(x: str, allowed: str) -> str:
    return f"list_sort([{{'d': abs(v - ({x})), 'v': v}} FOR v IN {allowed}])[1].v"


def _clamp(x: str, lo, hi) -> str:
    return f"greatest({lo}, least({hi}, {x}))"


# flag repair in SQL: SYN 2, ACK 16, FIN 1, RST 4, URG 32; a packet is its own original here
FIXED_SQL = f"""
{PACKET_SQL},
fl AS (SELECT *, CASE
    WHEN protocol <> 'tcp' THEN NULL
    WHEN tcp_flags & 2 <> 0 AND tcp_flags & 16 = 0 THEN (tcp_flags | 2) & ~21
    WHEN tcp_flags & 2 <> 0 THEN (tcp_flags | 18) & ~5
    WHEN tcp_flags & 4 <> 0 THEN (tcp_flags | 4) & 20
    WHEN tcp_flags & 1 <> 0 THEN (tcp_flags | 17) & ~6
    ELSE (tcp_flags | 16) & ~2 END AS f1 FROM pk),
fx AS (SELECT flow, pkt_no, protocol, ts, payload_size,
    {_clamp('ip_ttl', 1, 255)} AS ip_ttl, {_clamp('ip_tos', 0, 255)} AS ip_tos,
    {_snap('ip_flags', '[0, 2, 4]')} AS ip_flags,
    CASE protocol WHEN 'tcp' THEN 40 + payload_size ELSE 28 + payload_size END AS ip_total_length,
    CASE WHEN protocol = 'tcp' THEN {_clamp('tcp_window_size', 0, 65535)} END AS tcp_window_size,
    f1 AS tcp_flags,
    CASE WHEN protocol = 'tcp' THEN {_clamp('tcp_seq', 0, 4294967295)} END AS tcp_seq,
    CASE WHEN protocol = 'tcp' THEN {_clamp('tcp_ack', 0, 4294967295)} END AS tcp_ack,
    CASE WHEN protocol = 'tcp' THEN CASE WHEN f1 & 32 = 0 THEN 0 ELSE {_clamp('tcp_urgent_ptr', 0, 65535)} END END AS tcp_urgent_ptr,
    CASE WHEN protocol = 'udp' THEN 8 + payload_size END AS udp_length,
    CASE WHEN protocol = 'icmp' THEN {_snap(_clamp('icmp_type', 0, 255), '[0, 3, 5, 8, 11, 12]')} END AS icmp_type,
    icmp_code AS raw_code FROM fl),
fixed AS (SELECT *, CASE WHEN protocol = 'icmp' THEN CASE icmp_type
    WHEN 0 THEN 0 WHEN 8 THEN 0 WHEN 3 THEN {_clamp('raw_code', 0, 15)} WHEN 5 THEN {_clamp('raw_code', 0, 3)}
    WHEN 11 THEN {_clamp('raw_code', 0, 1)} ELSE {_clamp('raw_code', 0, 2)} END END AS icmp_code FROM fx)
"""
_FIELDS = ("ip_ttl", "ip_tos", "ip_flags", "ip_total_length", "tcp_window_size", "tcp_flags", "tcp_seq", "tcp_ack",
           "tcp_urgent_ptr", "udp_length", "icmp_type", "icmp_code")


@query("packet_repair", f"""
WITH {FIXED_SQL} SELECT pkt_no, protocol, {', '.join(f'CAST(coalesce({c}, -1) AS BIGINT) AS {c}' for c in _FIELDS)} FROM fixed""")
def packet_repair(spark, folder):
    r = P.repair_packets(packets(spark, folder))
    return r.select("pkt_no", "protocol", *[F.coalesce(big(c), F.lit(-1)).alias(c) for c in _FIELDS])


@query("tcp_flag_states", f"""
WITH {FIXED_SQL} SELECT tcp_flags, count(*) AS n FROM fixed WHERE protocol = 'tcp' GROUP BY 1""")
def tcp_flag_states(spark, folder):
    r = P.repair_packets(packets(spark, folder)).filter("protocol = 'tcp'")
    return r.groupBy(big("tcp_flags").alias("tcp_flags")).agg(F.count("*").alias("n"))


VALID_SQL = """
CASE WHEN ip_ttl <= 0 OR ip_total_length < 20 THEN false
     WHEN protocol = 'tcp' THEN udp_length IS NULL AND icmp_type IS NULL
       AND NOT (tcp_flags & 2 <> 0 AND tcp_flags & 5 <> 0) AND NOT (tcp_flags & 32 = 0 AND tcp_urgent_ptr <> 0)
       AND tcp_seq BETWEEN 0 AND 4294967295 AND tcp_ack BETWEEN 0 AND 4294967295
     WHEN protocol = 'udp' THEN tcp_flags IS NULL AND tcp_seq IS NULL AND tcp_window_size IS NULL
       AND coalesce(udp_length >= 8, true)
     ELSE tcp_flags IS NULL AND udp_length IS NULL AND (
       (icmp_type IN (0, 8) AND icmp_code = 0) OR (icmp_type = 3 AND icmp_code BETWEEN 0 AND 15)
       OR (icmp_type = 5 AND icmp_code BETWEEN 0 AND 3) OR (icmp_type = 11 AND icmp_code BETWEEN 0 AND 1)
       OR (icmp_type = 12 AND icmp_code BETWEEN 0 AND 2)) END
"""


@query("packet_validity", f"""
WITH {FIXED_SQL} SELECT protocol, coalesce({VALID_SQL}, false) AS valid, count(*) AS n FROM pk GROUP BY 1, 2""")
def packet_validity(spark, folder):
    """Raw packets: which would pass the validity check as they are."""
    p = packets(spark, folder).withColumn("valid", P.packet_is_valid())
    return p.groupBy("protocol", "valid").agg(F.count("*").alias("n"))


@query("flow_validity", f"""
WITH {FIXED_SQL} SELECT flow, count(*) AS n_packets, true AS valid FROM fixed GROUP BY 1""")
def flow_validity(spark, folder):
    """Repaired flows in time order are valid."""
    r = P.repair_flows(packets(spark, folder), ["flow"])
    # sequence numbers may run past 32 bits; the start is low enough here
    return P.flow_validity(r, ["flow"], order=["pos"])


@query("flow_validity_raw", """
WITH x AS (SELECT user_id AS flow, event_id, CAST(floor(value) AS BIGINT) AS t FROM events),
y AS (SELECT flow, t >= lag(t) OVER (PARTITION BY flow ORDER BY event_id) AS up FROM x)
SELECT flow, count(*) AS n_packets, bool_and(coalesce(up, true)) AS valid FROM y GROUP BY 1""")
def flow_validity_raw(spark, folder):
    """Packets in capture order whose times run backwards make the flow invalid."""
    p = P.repair_packets(packets(spark, folder)).withColumn("ts", F.col("payload_size").cast("double"))
    return P.flow_validity(p, ["flow"])


@query("flow_repair", f"""
WITH {FIXED_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY ts, pkt_no) AS pos FROM fixed),
s AS (SELECT pkt_no, pos, CASE WHEN protocol = 'tcp' THEN first(tcp_seq) OVER (PARTITION BY flow ORDER BY pos)
        + coalesce(sum(greatest(payload_size, 1)) OVER (PARTITION BY flow ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS tcp_seq FROM o)
SELECT pkt_no, pos, CAST(coalesce(tcp_seq, -1) AS BIGINT) AS tcp_seq FROM s""")
def flow_repair(spark, folder):
    """Time order and continuous TCP sequence numbers per flow."""
    r = P.repair_flows(packets(spark, folder), ["flow"])
    return r.select("pkt_no", big("pos").alias("pos"), F.coalesce(big("tcp_seq"), F.lit(-1)).alias("tcp_seq"))


def _addressed(spark, folder):
    """Packets with addresses; odd packets travel the other way."""
    e = table(spark, folder, "events")
    a, b = F.concat(F.lit("10.0.0."), F.col("user_id") % 40), F.concat(F.lit("10.1.0."), F.col("user_id") % 7)
    odd = F.col("event_id") % 2 == 1
    return e.select(
        F.lit("capture").alias("file"), F.col("event_id").alias("pkt_no"), F.when(odd, b).otherwise(a).alias("src"),
        F.when(odd, a).otherwise(b).alias("dst"), F.when(odd, 80).otherwise(5000).alias("sport"),
        F.when(odd, 5000).otherwise(80).alias("dport"), F.lit("tcp").alias("protocol"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("ts"))


@query("assign_flows", """
WITH p AS (SELECT event_id, ts, '10.0.0.' || user_id % 40 AS a, '10.1.0.' || user_id % 7 AS b FROM events),
f AS (SELECT a, b, count(*) AS n_packets, arg_min(event_id % 2, ts) AS dir FROM p GROUP BY 1, 2)
SELECT CASE WHEN dir = 1 THEN b ELSE a END AS flow_src, CASE WHEN dir = 1 THEN 80 ELSE 5000 END AS flow_sport,
       CASE WHEN dir = 1 THEN a ELSE b END AS flow_dst, n_packets FROM f""")
def assign_flows(spark, folder):
    """Both directions of a conversation form one flow, named after its first packet."""
    f = P.assign_flows(_addressed(spark, folder))
    return f.groupBy("flow_id", "flow_src", "flow_sport", "flow_dst").agg(F.count("*").alias("n_packets")).drop("flow_id")


@query("perturbed_packets", "SELECT count(*) AS n, 0 AS moved_lengths, 0 AS wrong_bits FROM events")
def perturbed_packets(spark, folder):
    """Noise touches headers only: lengths stay and at most six flag bits flip."""
    raw = packets(spark, folder)
    p = P.perturb_packets(raw.withColumns({"_l": F.col("ip_total_length"), "_f": F.col("tcp_flags")}), 5.0, ["pkt_no"])
    bits = F.col("tcp_flags").bitwiseXOR(F.col("_f").cast("bigint"))
    return p.agg(F.count("*").alias("n"), F.count(F.when(F.col("_l") != F.col("ip_total_length"), 1)).alias("moved_lengths"),
                 F.count(F.when((bits < 0) | (bits > 63), 1)).alias("wrong_bits"))


@query("perturbed_flows", "SELECT count(*) * 2 AS n, count(DISTINCT user_id) * 2 AS flows, 0 AS invalid FROM events")
def perturbed_flows(spark, folder):
    """Two perturbed copies of every flow, all valid after repair."""
    c = P.perturb_flows(packets(spark, folder), 2, 5.0, ["flow"], ["flow", "pkt_no"])
    v = P.flow_validity(c, ["flow", "copy_id"], order=["pos"])
    return v.agg(big(F.sum("n_packets")).alias("n"), F.count("*").alias("flows"),
                 F.count(F.when(~F.col("valid"), 1)).alias("invalid"))


@query("packet_neighbourhood", "SELECT user_id AS flow, 20 AS n, true AS all_valid FROM events GROUP BY 1")
def packet_neighbourhood(spark, folder):
    """Twenty valid perturbed packets per flow, in attempt order."""
    n = P.packet_neighbourhood(packets(spark, folder), 20, 5.0, ["flow", "pkt_no"], group=["flow"])
    return n.groupBy("flow").agg(F.count("*").alias("n"), F.bool_and(P.packet_is_valid()).alias("all_valid"))


@query("flow_neighbourhood", "SELECT user_id AS flow, count(*) * 2 AS n, 2 AS samples FROM events GROUP BY 1")
def flow_neighbourhood(spark, folder):
    """Two accepted versions of every flow."""
    n = P.flow_neighbourhood(packets(spark, folder), 2, 5.0, ["flow"], ["flow", "pkt_no"], max_retries=2)
    return n.groupBy("flow").agg(F.count("*").alias("n"), F.count_distinct("sample").alias("samples"))


PACKET_SCORER = M.LinearScorer(((0.02,), (0.01,), (0.001,)), (0.0,), "identity")


PACKET_FEATURES = ("ip_ttl", "ip_tos", "ip_total_length")

#: Perturbed packets a surrogate is fitted to, as many as row surrogates take by default.
PACKET_SAMPLES = 5000


def _packet_lime(spark, folder, seed):
    near = partial(P.packet_neighbourhood, packets(spark, folder), PACKET_SAMPLES, 5.0, ["flow", "pkt_no"], group=["flow"], seed=seed)
    return X.packet_lime(near, PACKET_FEATURES, PACKET_SCORER, ["flow"])


@query("packet_lime", "SELECT count(DISTINCT user_id) AS n, 3 AS width, true AS fitted FROM events")
def packet_lime(spark, folder):
    """Surrogates on perturbed packets of every flow."""
    x = _packet_lime(spark, folder, 42)
    return x.agg(F.count("*").alias("n"), big(F.max(F.size("attrs"))).alias("width"), (F.avg("r_squared") > 0.5).alias("fitted"))


@query("packet_lime_robustness", "SELECT count(DISTINCT user_id) AS n, true AS positive FROM events")
def packet_lime_robustness(spark, folder):
    """Rank agreement of surrogates over repeated packet neighbourhoods."""
    base = _packet_lime(spark, folder, 42).select(F.col("flow").alias("row_id"), "attrs")
    again = None
    for seed in (43, 44):
        part = _packet_lime(spark, folder, seed).select(F.col("flow").alias("row_id"), F.lit(seed).alias("copy"), "attrs")
        again = part if again is None else again.union(part)
    return Q.semantic_robustness(base, again).agg(F.count("*").alias("n"), (F.avg("robustness") > 0).alias("positive"))


@query("first_packet_features", """
WITH f AS (SELECT user_id AS flow, arg_min(event_id, ts) AS i FROM events GROUP BY 1)
SELECT flow, CAST(i * 7 % 400 - 50 AS DOUBLE) AS ttl, CAST(i % 5000 AS DOUBLE) AS length FROM f""")
def first_packet_features(spark, folder):
    """Row explainers on traffic see the features of the first packet."""
    f = P.first_packet_features(packets(spark, folder), ["flow"], [F.col("ip_ttl"), F.col("ip_total_length")])
    return rounded(f.select("flow", F.get("features", F.lit(0)).alias("ttl"), F.get("features", F.lit(1)).alias("length")))
