"""Copies of packets that stay in their task: the same draws, packets and surrogates as tables of copies."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from flowaudit.functions import hashing as H, key_draws as D
from flowaudit.operators import explainers as X, models as M, packet_program as PP, packets as P
from flowaudit.plans import traffic
from flowaudit.plans.registry import QUERIES

import __spark_entry__  # noqa: F401 - registers the queries

FIELDS = ("protocol string, ip_ttl bigint, ip_tos bigint, ip_total_length bigint, ip_flags bigint, tcp_window_size bigint, "
          "tcp_flags bigint, tcp_seq bigint, tcp_ack bigint, tcp_urgent_ptr bigint, udp_length bigint, icmp_type bigint, "
          "icmp_code bigint, payload_size bigint, flow bigint, pkt_no bigint")
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
TCP = dict(protocol="tcp", ip_ttl=250, ip_tos=3, ip_total_length=60, ip_flags=2, tcp_window_size=65000, tcp_flags=0x10, tcp_seq=1000,
           tcp_ack=2**32 - 500, tcp_urgent_ptr=4, payload_size=20)
UDP = dict(protocol="udp", ip_ttl=4, ip_tos=250, ip_total_length=60, udp_length=9, payload_size=31, tcp_flags=3)
ICMP = dict(protocol="icmp", ip_ttl=60, ip_tos=9, ip_total_length=60, icmp_type=8, icmp_code=3, payload_size=8)


def frame(spark, flows):
    rows = [{**p, "flow": f, "pkt_no": 100 * i + (f or 0)} for f, packets in flows for i, p in enumerate(packets)]
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], FIELDS)


def odd_flows(spark):
    """All protocols and states, nulls, lengths out of range, and groups whose first packets give no valid copy."""
    lost = {**TCP, "tcp_seq": None}
    return frame(spark, [
        *[(i, [{**TCP, "tcp_flags": f}]) for i, f in enumerate((0, 1, 2, 3, 4, 5, 0x12, 0x11, 0x20, 0x3F, 0xC2, None))],
        (20, [UDP, TCP]), (21, [ICMP]), (22, [lost, TCP]), (23, [{**UDP, "payload_size": 70000}, ICMP, TCP]),
        (24, [{**ICMP, "icmp_type": None}, {**ICMP, "icmp_code": None}, lost, UDP]), (25, [{**UDP, "payload_size": None}]),
        (26, [{**TCP, "protocol": "gre"}]), (27, [{**TCP, "protocol": None, "ip_ttl": None}]), (28, [{**TCP, "tcp_urgent_ptr": None}]),
        (29, [{**ICMP, "icmp_type": 5, "ip_tos": None}]), (None, [ICMP, UDP])])


ARRAYS = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in P.HEADER])
kept = lambda made: [made[c] for c in P.HEADER]  # noqa: E731 - sent to the tasks by value


def test_draws_are_those_of_the_columns(spark):
    names = ("ip_ttl", "ip_flags", "tcp_window_size", "tcp_urgent_ptr", "tcp_seq", "a", "four", "eight_88", "thirteen_byte")
    rows = spark.range(-3, 60).withColumn("attempt", (F.col("id") * 7919 % 5000).cast("int"))
    k = [F.col("id"), F.lit("file"), F.col("attempt")]
    got = rows.select("attempt", H.hash64(7, *k[:2]).alias("h"), *[H.normal(7, *k, F.lit(c)).alias("n_" + c) for c in names],
                      *[H.pick(n, 7, *k, F.lit(c)).alias(f"p{n}_{c}") for n in (8, 64, 256) for c in names]).toPandas()
    h = np.array([D.then_int(np.array([a], np.int64).view(np.uint64), np.array([b]))[0, 0] for a, b in zip(got["h"], got["attempt"])])
    for c in names:
        np.testing.assert_allclose(D.normals(h, c), got["n_" + c], rtol=1e-12, atol=1e-12)
        for n in (8, 64, 256):
            assert (D.picks(h, c, n) == got[f"p{n}_{c}"]).all()
    with pytest.raises(ValueError):
        D.picks(h, "a", 10)


def test_flags_and_snapping_of_the_program(spark):
    pairs = [(f, o) for f in range(64) for o in range(256)]
    df = spark.createDataFrame(pairs, "f bigint, o bigint").select("f", "o", P.repair_tcp_flags(F.col("f"), F.col("o")).alias("r")).toPandas()
    assert (PP.repaired_flags(df["f"].to_numpy(), df["o"].to_numpy()) == df["r"]).all()


@pytest.mark.parametrize("n", [1, 40])
def test_copies_in_the_task_equal_the_table_of_copies(spark, n):
    p = odd_flows(spark)
    make = partial(P.packet_neighbourhood, p, n, 5.0, ["flow", "pkt_no"], group=["flow"], seed=11)
    table = make().select("flow", "sample", *P.HEADER).toPandas().sort_values(["flow", "sample"])
    want = {f if f == f else None: g[list(P.HEADER)].to_numpy(dtype=float) for f, g in table.groupby("flow", dropna=False)}
    rows = make(fold=(P.HEADER, kept, ARRAYS)).collect()
    assert len(rows) == len(want) == p.select("flow").distinct().count()
    for r in rows:
        got = np.array([r[c] for c in P.HEADER]).T
        np.testing.assert_array_equal(got, want[r["flow"]], err_msg=str(r["flow"]))


def test_many_copies_are_cut_in_parts_without_changing_them(spark, monkeypatch):
    p = odd_flows(spark)
    make = lambda: {r["flow"]: r["ip_ttl"] for r in P.packet_neighbourhood(
        p.filter("flow <> 27"), 30, 5.0, ["flow", "pkt_no"], group=["flow"], fold=(P.HEADER, kept, ARRAYS)).collect()}
    whole = make()
    monkeypatch.setattr(P, "COPIES_AT_ONCE", 1)
    assert make() == whole


def test_a_group_without_enough_valid_copies_fails(spark):
    p = frame(spark, [(1, [TCP]), (2, [{**TCP, "tcp_seq": None}] * 3)])
    with pytest.raises(Exception, match="fewer than 5 valid samples after 20 attempts"):
        P.packet_neighbourhood(p, 5, 5.0, ["flow", "pkt_no"], 4, group=["flow"], fold=(P.HEADER, kept, ARRAYS)).collect()
    with pytest.raises(ValueError, match="payload_size"):
        P.packet_neighbourhood(p, 5, 5.0, ["flow", "pkt_no"], group=["flow"], fold=(("ip_ttl", "payload_size"), kept, ARRAYS))
    late = frame(spark, [(2, [{**TCP, "tcp_seq": None}] * 3 + [TCP])])
    with pytest.raises(Exception, match="fewer than 5 valid samples after 15 attempts"):
        P.packet_neighbourhood(late, 5, 5.0, ["flow", "pkt_no"], 3, group=["flow"], fold=(P.HEADER, kept, ARRAYS)).collect()


def test_surrogates_in_the_task_equal_those_of_the_table(spark):
    p = odd_flows(spark)
    make = partial(P.packet_neighbourhood, p, 60, 5.0, ["flow", "pkt_no"], group=["flow"])
    vector = F.array(*[F.col(c).cast("double") for c in traffic.PACKET_FEATURES])
    two = M.LinearScorer(((0.02, 0.0), (0.01, 0.03), (0.001, 0.0)), (0.0, -1.0))
    for scorer, more in ((traffic.PACKET_SCORER, {}), (two, {}), (two, {"class_to_explain": 1, "kernel_width": 2.0, "alpha": 0.5})):
        a = X.packet_lime(make(), vector, scorer, ["flow"], **more)
        b = X.packet_lime(make, traffic.PACKET_FEATURES, scorer, ["flow"], **more)
        assert a.schema.simpleString() == b.schema.simpleString()
        key = lambda r: (r["flow"] is not None, r["flow"] or 0)
        for x, y in zip(sorted(a.collect(), key=key), sorted(b.collect(), key=key), strict=True):
            assert x["flow"] == y["flow"] and x["num_samples"] == y["num_samples"] == 60 and x["explainer_key"] == y["explainer_key"]
            flat = lambda r: [*r["attrs"], r["predicted_class"], r["r_squared"], r["intercept"], r["local_prediction"]]
            np.testing.assert_allclose(flat(x), flat(y), rtol=1e-8, atol=1e-10, err_msg=str(x["flow"]))


def events(spark, folder, flows):
    spark.range(flows * 4).selectExpr(
        "id AS event_id", f"CAST(id % {flows} AS BIGINT) AS user_id", "timestamp_seconds(id) AS ts", "CAST(id * 37 % 900 AS DOUBLE) AS value"
    ).write.parquet(f"{folder}/events.parquet")


def test_queries_make_every_copy_once_and_group_none(spark, tmp_path, monkeypatch):
    events(spark, tmp_path, 23)

    def counted(*_):
        raise AssertionError("the copies are made once more, to be counted")

    monkeypatch.setattr(P, "_enough", counted)
    monkeypatch.setattr(traffic, "PACKET_SAMPLES", 300)
    spread = []
    made = X.packet_lime
    monkeypatch.setattr(X, "packet_lime", lambda *a, **k: spread.append(made(*a, **k)) or spread[-1])
    assert QUERIES["packet_lime"](spark, str(tmp_path)).collect() == [(23, 3, True)]
    assert QUERIES["packet_lime_robustness"](spark, str(tmp_path)).collect() == [(23, True)]
    # one for packet_lime, three for the robustness; groups stay spread over the cluster although their rows are few
    assert len(spread) == 4
    assert all(d.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) for d in spread)
