"""Packet and flow rules, captures, sources, store and streams."""

import struct

import pytest
from pyspark.sql import functions as F

from flowaudit import streaming
from flowaudit.operators import packets as P, prep, schemas as S
from flowaudit.sources import flows as SRC, pcap, store

FIELDS = ("protocol string, ip_ttl bigint, ip_tos bigint, ip_total_length bigint, ip_flags bigint, tcp_window_size bigint, "
          "tcp_flags bigint, tcp_seq bigint, tcp_ack bigint, tcp_urgent_ptr bigint, udp_length bigint, icmp_type bigint, "
          "icmp_code bigint, ts double, payload_size bigint")
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
TCP = dict(protocol="tcp", ip_ttl=64, ip_tos=0, ip_total_length=60, ip_flags=2, tcp_window_size=65535, tcp_flags=0x10,
           tcp_seq=1000, tcp_ack=500, tcp_urgent_ptr=0, ts=1000.0, payload_size=20)


def frame(spark, rows, extra=""):
    names = NAMES + [e.split()[0] for e in extra.split(", ") if e]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], FIELDS + (", " + extra if extra else ""))


def repaired(spark, packet, original=None):
    o = {k: F.lit(v) for k, v in (original or {}).items()}
    return P.repair_packets(frame(spark, [packet]), o).first()


def test_packet_repair_cases(spark):
    assert repaired(spark, {**TCP, "protocol": "udp"}, {"protocol": "tcp"})["protocol"] == "tcp"
    assert 1 <= repaired(spark, {**TCP, "ip_ttl": 300})["ip_ttl"] <= 255
    assert repaired(spark, {**TCP, "ip_ttl": -5})["ip_ttl"] == 1
    flags = repaired(spark, {**TCP, "tcp_flags": 0x07}, {"tcp_flags": 0x02})["tcp_flags"]
    assert flags & 2 and not flags & 5
    assert repaired(spark, {**TCP, "tcp_urgent_ptr": 100})["tcp_urgent_ptr"] == 0
    assert repaired(spark, {**TCP, "ip_total_length": 9999})["ip_total_length"] == 60
    udp = repaired(spark, {**TCP, "protocol": "udp"})
    assert udp["tcp_flags"] is None and udp["tcp_seq"] is None and udp["udp_length"] == 28
    icmp = repaired(spark, {**TCP, "protocol": "icmp", "icmp_type": 200, "icmp_code": 9})
    assert icmp["icmp_type"] == 12 and icmp["icmp_code"] == 2 and icmp["tcp_flags"] is None


@pytest.mark.parametrize("value,want", [(1, 0), (3, 2), (2, 2), (7, 4)])
def test_flags_snap_to_the_smaller_neighbour(spark, value, want):
    assert repaired(spark, {**TCP, "ip_flags": value})["ip_flags"] == want


def _flags(flags, original):
    """The state rules spelled out on plain integers."""
    FIN, SYN, RST, ACK = 1, 2, 4, 16
    if original & SYN and not original & ACK:
        flags = (flags | SYN) & ~(FIN | RST | ACK)
    elif original & SYN:
        flags = (flags | SYN | ACK) & ~(FIN | RST)
    elif original & RST:
        flags = (flags | RST) & (RST | ACK)
    elif original & FIN:
        flags = (flags | FIN | ACK) & ~(RST | SYN)
    else:
        flags = (flags | ACK) & ~SYN
        if flags & FIN and flags & RST:
            flags &= ~RST
    if flags & SYN:
        flags &= ~(FIN | RST)
    return flags or original


def test_flag_repair_for_all_states(spark):
    pairs = [(f, o) for f in range(64) for o in range(64)]
    df = spark.createDataFrame(pairs, "f bigint, o bigint").withColumn("r", P.repair_tcp_flags(F.col("f"), F.col("o")))
    assert all(r["r"] == _flags(r["f"], r["o"]) for r in df.collect())


def test_validity(spark):
    bad = [{**TCP, "ip_ttl": 0}, {**TCP, "tcp_flags": 3}, {**TCP, "tcp_urgent_ptr": 5}, {**TCP, "udp_length": 9},
           {**TCP, "tcp_seq": 2**32}, {**TCP, "ip_total_length": 10}]
    rows = frame(spark, [TCP, *bad]).withColumn("ok", P.packet_is_valid())
    assert [r["ok"] for r in rows.collect()] == [True] + [False] * 6


def flow_rows(spark, times, payloads):
    rows = [{**TCP, "ts": t, "payload_size": p, "flow": 1, "pkt_no": i, "flow_protocol": "tcp"}
            for i, (t, p) in enumerate(zip(times, payloads))]
    return frame(spark, rows, "flow bigint, pkt_no bigint, flow_protocol string")


def test_flow_order_and_sequences(spark):
    r = P.repair_flows(flow_rows(spark, (3.0, 1.0, 2.0), (1, 100, 50)), ["flow"]).orderBy("pos").collect()
    assert [x["ts"] for x in r] == [1.0, 2.0, 3.0]
    assert [x["tcp_seq"] for x in r] == [1000, 1100, 1150]
    assert P.flow_validity(flow_rows(spark, (3.0, 1.0), (1, 1)), ["flow"]).first()["valid"] is False


def test_huge_flows_are_chunked_without_changing_the_result(spark):
    """One flow holds most packets; cutting it into chunks gives the same order, sums and verdicts."""
    rows = [{**TCP, "ts": float(i * 7919 % 101), "payload_size": i % 5, "flow": 0 if i % 4 else i, "pkt_no": i,
             "flow_protocol": "tcp"} for i in range(400)]
    p = frame(spark, rows, "flow bigint, pkt_no bigint, flow_protocol string")
    pick = lambda d: sorted(map(tuple, d.select("flow", "pkt_no", "pos", "tcp_seq").collect()))
    assert pick(P.repair_flows(p, ["flow"], chunk_rows=20)) == pick(P.repair_flows(p, ["flow"]))
    for order in (["pkt_no"], ["ts", "pkt_no"]):
        verdicts = [sorted(map(tuple, P.flow_validity(p, ["flow"], order=order, chunk_rows=c).collect()))
                    for c in (20, 10_000)]
        assert verdicts[0] == verdicts[1]


def test_neighbourhoods_fill_or_fail(spark):
    p = flow_rows(spark, (1.0, 2.0), (10, 20))
    n = P.packet_neighbourhood(p, 15, 5.0, ["pkt_no"], group=["flow"])
    assert sorted(r["sample"] for r in n.collect()) == list(range(15))
    f = P.flow_neighbourhood(p, 3, 5.0, ["flow"], ["pkt_no"])
    assert f.count() == 6 and f.select("sample").distinct().count() == 3
    over = p.withColumn("tcp_seq", F.lit(2**32 - 1)).withColumn("payload_size", F.lit(2**31).cast("bigint"))
    with pytest.raises(Exception, match="valid flows"):
        P.flow_neighbourhood(over, 2, 0.0, ["flow"], ["pkt_no"], 2).collect()


def test_flows_near_the_last_sequence_number_go_on_at_zero(spark):
    p = flow_rows(spark, (1.0, 2.0, 3.0), (10, 20, 30)).withColumn("tcp_seq", F.lit(2**32 - 1))
    f = P.flow_neighbourhood(p, 2, 0.0, ["flow"], ["pkt_no"], 2).orderBy("sample", "pos").collect()
    assert [r["tcp_seq"] for r in f] == [2**32 - 1, 9, 29] * 2


def ethernet(ip):
    return b"\0" * 12 + b"\x08\x00" + ip


def ipv4(proto, body, ttl=64):
    return struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 1, 0x4000, ttl, proto, 0, bytes([10, 0, 0, 1]),
                       bytes([10, 0, 0, 2])) + body


def capture(frames, order="<"):
    out = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 100 + i, 500000, len(f), len(f)) + f
    return out


def test_captures(spark, tmp_path):
    tcp = struct.pack("!HHIIHHHH", 1234, 80, 7, 9, (5 << 12) | 0x12, 512, 0, 0) + b"hello"
    udp = struct.pack("!HHHH", 53, 5353, 12, 0) + b"data"
    icmp = bytes([8, 0, 0, 0]) + b"\0" * 4
    frames = [ethernet(ipv4(6, tcp)), b"\0" * 12 + b"\x08\x06" + b"arp", ethernet(ipv4(17, udp)), ethernet(ipv4(1, icmp)),
              ethernet(ipv4(47, b"gre"))]
    for name, order in (("a.pcap", "<"), ("b.pcap", ">")):
        (tmp_path / name).write_bytes(capture(frames, order))
    p = pcap.read_captures(spark, str(tmp_path)).orderBy("file", "pkt_no").collect()
    assert [r["pkt_no"] for r in p] == [0, 2, 3] * 2
    t, u, c = p[:3]
    assert (t["protocol"], t["tcp_flags"], t["tcp_seq"], t["payload_size"], t["ip_flags"]) == ("tcp", 0x12, 7, 5, 2)
    assert (u["protocol"], u["udp_length"], u["payload_size"]) == ("udp", 12, 4)
    assert (c["protocol"], c["icmp_type"], c["payload_size"], c["ts"]) == ("icmp", 8, 0, 103.5)
    (tmp_path / "bad.pcap").write_bytes(b"x" * 40)
    with pytest.raises(Exception, match="capture"):
        pcap.read_captures(spark, str(tmp_path / "bad.pcap")).collect()


def test_flow_direction_follows_the_first_packet(spark):
    rows = [("f", 0, "a", "b", 1, 2, "tcp", 5.0), ("f", 1, "b", "a", 2, 1, "tcp", 4.0), ("f", 2, "a", "b", 1, 2, "udp", 1.0)]
    df = spark.createDataFrame(rows, "file string, pkt_no bigint, src string, dst string, sport int, dport int, protocol string, ts double")
    got = P.assign_flows(df).select("flow_id", "flow_src", "protocol").distinct().collect()
    assert len(got) == 2
    assert {r["protocol"]: r["flow_src"] for r in got} == {"tcp": "b", "udp": "a"}


def test_csv_sources(spark, tmp_path):
    kdd = tmp_path / "kdd.txt"
    kdd.write_text("\n".join(",".join(["0", "tcp", "http", "SF"] + ["1"] * 37 + ["neptune", "21"]) for _ in range(3)))
    df = SRC.read_kdd(spark, str(kdd))
    assert df.columns[-1] == "label" and len(df.columns) == 42 and df.first()["service"] == "http"
    d = tmp_path / "dir"
    d.mkdir()
    (d / "b.csv").write_text(" x , Label\n1,A\n,A\nLabel,Label\n9,A\n")
    (d / "a.csv").write_text("Label, x\nB,5\nB,bad\nB,Infinity\n")
    big = SRC.read_large_flows(spark, str(d)).collect()
    assert sorted((r["Label"], r["x"]) for r in big) == [("A", 1.0), ("A", 5.0), ("A", 9.0), ("B", 5.0), ("B", 5.0), ("B", 5.0)]
    with pytest.raises(ValueError):
        SRC.attach_labels(spark.read.schema("x int").csv(str(kdd)), spark.read.schema("Label string").csv(str(d / "a.csv")))


def test_positions_across_blocks(spark, tmp_path):
    n = 3000
    (tmp_path / "data.csv").write_text("\n".join(str(i) for i in range(n)))
    (tmp_path / "labels.csv").write_text("\n".join(f"L{i}" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        data = spark.read.schema("x int").csv(str(tmp_path / "data.csv"))
        labels = spark.read.schema("Label string").csv(str(tmp_path / "labels.csv"))
        j = SRC.attach_labels(data, labels)
        assert data.rdd.getNumPartitions() > 3
        assert j.filter(F.concat(F.lit("L"), "x") != F.col("Label")).count() == 0 and j.count() == n
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_store_resumes_only_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("d", k, i, float(i)) for k in ("a", "b") for i in range(4)],
                                 "dataset string, explainer_key string, row_id bigint, v double")
    computed = []

    def compute(todo):
        computed.append(todo.count())
        return todo

    keys = ["explainer_key", "row_id"]
    assert store.resume(rows.filter("row_id < 3"), path, keys, compute, config={"s": 1}).count() == 6
    assert store.resume(rows, path, keys, compute, config={"s": 1}).count() == 8
    assert computed == [6, 2]
    assert store.read_table(spark, path, {"s": 2}).count() == 0
    assert store.config_hash({"b": 1, "a": 2}) == store.config_hash({"a": 2, "b": 1})
    assert len(store.config_hash({})) == 16
    s = spark.createDataFrame([("m", float("nan")), ("k", 1.0)], "method string, v double")
    store.write_summary(s, str(tmp_path / "json"), "json")
    assert spark.read.schema("method string, v double").json(str(tmp_path / "json")).filter("v is null").count() == 1


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    frame(spark, [{**TCP, "ip_ttl": 999}] * 3).write.parquet(src)
    out = streaming.packet_stream(spark.readStream.schema(FIELDS).parquet(src))
    q = out.writeStream.format("memory").queryName("packets").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["ip_ttl"] for r in spark.sql("select ip_ttl from packets where valid").collect()] == [255] * 3
    s = S.FlowSchema("t", ("a",), non_negative=("a",))
    spark.createDataFrame([(-1.0,)], "a double").write.parquet(src + "2")
    q = streaming.repair_stream(spark.readStream.schema("a double").parquet(src + "2"), s).writeStream.format(
        "memory").queryName("flows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select a from flows").first()[0] == 0.0


def test_prepare_end_to_end(spark):
    rows = [(str(i % 37), str(i * 7 % 101), "10.0.0.1", " A" if i % 3 else "B ") for i in range(400)]
    raw = spark.createDataFrame(rows, "x string, z string, `Src IP` string, Label string")
    table, scales, ids = prep.prepare(raw)
    n = table.count()
    assert n == raw.select("x", "z", F.trim("Label").alias("l")).distinct().count()
    assert [r["label"] for r in ids.orderBy("label_id").collect()] == ["A", "B"]
    train = table.filter("split = 'train'").agg(F.min("x"), F.max("x")).first()
    assert (train[0], train[1]) == (0.0, 1.0) and set(scales) == {"x", "z"}
    assert table.select("row_id").distinct().count() == n
