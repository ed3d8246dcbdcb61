"""Constraint rules: hand-computed cases, one per rule, and the shipped catalogues."""

import pytest

from flowaudit.operators import constraints as C, schemas as S


def one(spark, names, row, schema, protocol=None):
    df = spark.createDataFrame([tuple(float(v) for v in row)], ", ".join(f"`{n}` double" for n in names))
    from pyspark.sql import functions as F

    got = C.enforce(df, schema, None if protocol is None else F.lit(float(protocol))).first()
    return tuple(got[n] for n in names)


CASES = [
    (("mx", "mean", "mn"), (2, 1, 5), dict(ordered=(S.Ordered("mx", "mean", "mn"),)), (5, 2, 1)),
    (("mx", "mean", "mn"), (10, 3, 7), dict(ordered=(S.Ordered("mx", "mean", "mn"),)), (10, 7, 3)),
    (("mx", "std", "mn"), (10, 20, 5), dict(spread=(S.Spread("std", "mx", "mn"),)), (10, 5, 5)),
    (("mx", "std", "mn"), (100, 3, 90), dict(spread=(S.Spread("std", "mx", "mn"),)), (100, 3, 90)),
    (("p", "d", "r"), (100, 10, 999), dict(derived=(S.Derived("r", "ratio", ("p", "d")),)), (100, 10, 10)),
    (("p", "d", "r"), (50, 0, 999), dict(derived=(S.Derived("r", "ratio", ("p", "d")),)), (50, 0, 0)),
    (("f", "b", "d", "r"), (300, 200, 5, 999), dict(derived=(S.Derived("r", "sum_ratio", ("f", "b", "d")),)),
     (300, 200, 5, 100)),
    (("s", "v"), (4, 999), dict(derived=(S.Derived("v", "square", ("s",)),)), (4, 16)),
    (("t", "u"), (42, 999), dict(derived=(S.Derived("u", "equal", ("t",)),)), (42, 42)),
    (("a", "b"), (-3, 2), dict(non_negative=("a",)), (0, 2)),
    (("a", "b"), (0.5, 2.5), dict(discrete=("a", "b")), (0, 2)),
    (("a",), (70000,), dict(bounded=(S.Bounded("a", 0, 65535),)), (65535,)),
    (("a", "b"), (7, 1), dict(duplicates=(("a", "b"),)), (7, 7)),
    (("odd.name", "b/s"), (-1, 3), dict(non_negative=("odd.name",)), (0, 3)),
]


@pytest.mark.parametrize("names,row,rules,want", CASES)
def test_single_rule(spark, names, row, rules, want):
    assert one(spark, names, row, S.FlowSchema("t", names, **rules)) == pytest.approx(want)


def test_protocol_gates(spark):
    names = ("proto", "syn", "udp", "icmp", "conn")
    s = S.FlowSchema("t", names, protocol="proto", tcp_only=("syn",), udp_only=("udp",), icmp_only=("icmp",),
                     connection_only=("conn",))
    assert one(spark, names, (6, 1, 1, 1, 1), s) == (6, 1, 0, 0, 1)
    assert one(spark, names, (17, 1, 1, 1, 1), s) == (17, 0, 1, 0, 1)
    assert one(spark, names, (1, 1, 1, 1, 1), s) == (1, 0, 0, 1, 0)
    assert one(spark, names, (6, 1, 1, 1, 1), s, protocol=17) == (17, 0, 1, 0, 1)


def test_chained_rules_see_earlier_results(spark):
    names = ("a", "b", "c")
    s = S.FlowSchema("t", names, derived=(S.Derived("b", "square", ("a",)), S.Derived("c", "equal", ("b",))))
    assert one(spark, names, (3, 0, 0), s) == (3, 9, 9)


def test_string_coded_protocol_needs_codes():
    with pytest.raises(ValueError):
        _ = S.get_schema("NSL-KDD").codes


COUNTS = {
    "CIC-IDS-2017": (79, 19, 3, 8, 9, 8), "CSE-CIC-IDS2018": (78, 19, 3, 8, 9, 8), "NSL-KDD": (41, 19, 21, 0, 0, 0),
    "UNSW-NB15-Native": (44, 24, 8, 0, 0, 0), "UNSW-NB15-CICFlowMeter": (77, 18, 2, 8, 9, 8),
}


@pytest.mark.parametrize("name", COUNTS)
def test_catalogue_sizes(name):
    s = S.get_schema(name)
    got = (len(s.features), len(s.discrete), len(s.bounded), len(s.ordered), len(s.derived), len(s.spread))
    assert got == COUNTS[name]
    assert len(set(s.features)) == len(s.features)
    for _, _, operands, _, _ in s.rules():
        assert set(operands) <= set(s.features)


def test_rule_summary_and_missing(spark):
    row = {r["dataset_name"]: r for r in S.rule_summary(spark).collect()}["nsl-kdd"]
    assert (row["num_features"], row["num_non_negative"], row["num_tcp_only"], row["num_discrete"],
            row["num_bounded_range"]) == (41, 32, 1, 19, 21)
    flow = spark.createDataFrame([(1.0,)], "duration double")
    lost = S.missing_rules(spark, S.get_schema("NSL-KDD"), flow)
    assert lost.filter("feature = 'duration'").count() == 0
    assert lost.filter("feature = 'urgent' and kind = 'tcp_only'").count() == 1
    with pytest.raises(KeyError):
        S.get_schema("nope")


def test_every_flow_meter_row_is_valid_after_repair(spark):
    s = S.get_schema("CIC-IDS-2017")
    rows = [tuple(float((i * 37 + j * 91) % 211 - 60) for j in range(len(s.features))) for i in range(40)]
    rows = [(r[0], [1.0, 6.0, 17.0][i % 3], *r[2:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in s.features))
    assert C.violations(df, s).agg({"violations": "sum"}).first()[0] > 0
    assert C.violations(C.enforce(df, s), s).filter("violations > 0").collect() == []


def test_encoding_looks_at_the_column(spark):
    df = spark.createDataFrame([(1.0,), (6.0,), (17.0,)], "p double")
    assert S.protocol_encoding(df, "p").first()[0] == "integer"
    assert S.protocol_encoding(df.filter("p = 1"), "p").first()[0] == "string"
