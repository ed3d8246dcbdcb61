"""Rule catalogues: which protocol rules apply to which columns of a flow table.

Catalogues of the flow-meter family are generated from one naming dialect per
dataset, because the rule families follow from the kind of column (a length or
gap statistic, a flag counter, a rate, a bulk or window column).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowaudit.functions.tables import local_rows
from flowaudit.operators.fixed_values import ARGUS_FEATURES, FLOW_METER_FEATURES, KDD_FEATURES, PROTOCOL_NUMBERS


@dataclass(frozen=True)
class Ordered:
    """maximum >= mean >= minimum."""

    maximum: str
    mean: str
    minimum: str


@dataclass(frozen=True)
class Spread:
    """0 <= std <= maximum - minimum."""

    std: str
    maximum: str
    minimum: str


@dataclass(frozen=True)
class Derived:
    """target = relation(operands), relation in equal | square | ratio | sum_ratio."""

    target: str
    relation: str
    operands: tuple[str, ...]
    scale: float = 1.0


@dataclass(frozen=True)
class Bounded:
    column: str
    lower: float
    upper: float


@dataclass(frozen=True)
class FlowSchema:
    name: str
    features: tuple[str, ...]
    protocol: str | None = None
    encoding: str = "integer"
    protocol_codes: dict[str, int] | None = None
    non_negative: tuple[str, ...] = ()
    tcp_only: tuple[str, ...] = ()
    udp_only: tuple[str, ...] = ()
    icmp_only: tuple[str, ...] = ()
    connection_only: tuple[str, ...] = ()
    discrete: tuple[str, ...] = ()
    ordered: tuple[Ordered, ...] = ()
    spread: tuple[Spread, ...] = ()
    derived: tuple[Derived, ...] = ()
    bounded: tuple[Bounded, ...] = ()
    duplicates: tuple[tuple[str, str], ...] = ()

    @property
    def codes(self) -> dict[str, int]:
        """Numeric protocol codes; string-coded tables must state their own."""
        if self.protocol_codes is not None:
            return self.protocol_codes
        if self.encoding == "string":
            raise ValueError(f"{self.name}: protocol is string-coded, pass protocol_codes")
        return PROTOCOL_NUMBERS

    @property
    def continuous(self) -> list[str]:
        skip = set(self.discrete) | {self.protocol}
        return [c for c in self.features if c not in skip]

    def rules(self) -> list[tuple]:
        """(kind, target, operands, lower, upper) for every rule, in enforcement order."""
        out: list[tuple] = []
        plain = lambda kind, names: out.extend((kind, n, [n], None, None) for n in names)
        plain("non_negative", self.non_negative)
        out += [("ordered", r.mean, [r.minimum, r.mean, r.maximum], None, None) for r in self.ordered]
        out += [("spread", r.std, [r.std, r.maximum, r.minimum], None, None) for r in self.spread]
        out += [(r.relation, r.target, [r.target, *r.operands], None, None) for r in self.derived]
        out += [("bounded", r.column, [r.column], float(r.lower), float(r.upper)) for r in self.bounded]
        plain("discrete", self.discrete)
        plain("tcp_only", self.tcp_only)
        plain("udp_only", self.udp_only)
        plain("icmp_only", self.icmp_only)
        plain("connection_only", self.connection_only)
        out += [("duplicate", b, [a, b], None, None) for a, b in self.duplicates]
        return out

    def restrict(self, columns: list[str]) -> "FlowSchema":
        """Keep the rules whose columns all exist; see :func:`missing_rules` for the rest."""
        have = set(columns)
        keep = lambda names: tuple(n for n in names if n in have)
        return FlowSchema(
            self.name, keep(self.features), self.protocol if self.protocol in have else None,
            self.encoding, self.protocol_codes, keep(self.non_negative), keep(self.tcp_only),
            keep(self.udp_only), keep(self.icmp_only), keep(self.connection_only), keep(self.discrete),
            tuple(r for r in self.ordered if {r.maximum, r.mean, r.minimum} <= have),
            tuple(r for r in self.spread if {r.std, r.maximum, r.minimum} <= have),
            tuple(r for r in self.derived if {r.target, *r.operands} <= have),
            tuple(r for r in self.bounded if r.column in have),
            tuple(p for p in self.duplicates if set(p) <= have),
        )


def _flow_meter(name: str) -> FlowSchema:
    """Rules of one flow-meter export, found from the kinds of its columns."""
    features = FLOW_METER_FEATURES[name]

    def of(test) -> list[str]:
        return [f for f in features if test(f)]

    def sibling(std: str, statistic: str) -> str:
        """The column of the same quantity with another statistic, which some exports write in front."""
        behind = std.replace("Std", statistic)
        return behind if behind in features else f"{statistic} {std.removesuffix(' Std')}"

    ports = of(lambda f: f.endswith(" Port"))
    direction_flags, flag_counts = of(lambda f: f.endswith(" Flags")), of(lambda f: " Flag C" in f)
    windows, subflows = of(lambda f: "win" in f.lower()), of(lambda f: f.startswith("Subflow"))
    data_packets = of(lambda f: "act" in f.lower() and "data" in f.lower())
    rates, variance = of(lambda f: f.endswith("/s")), of(lambda f: " Var" in f)
    deviations = of(lambda f: f.endswith(" Std"))
    totals = features.index("Flow Duration") + 1
    packets, sizes = features[totals : totals + 2], features[totals + 2 : totals + 4]
    copies = of(lambda f: f.endswith(".1"))
    overall = [f for f in deviations if f.startswith(variance[0].split(" Var")[0])]
    signed = {*ports, "Protocol", *windows}
    return FlowSchema(
        name=name,
        features=tuple(features),
        protocol="Protocol",
        non_negative=tuple(f for f in features if f not in signed),
        tcp_only=(*direction_flags, *flag_counts, *windows),
        discrete=(*ports, "Protocol", *packets, *direction_flags, *flag_counts, subflows[0], subflows[2], *data_packets),
        ordered=tuple(Ordered(sibling(s, "Max"), sibling(s, "Mean"), sibling(s, "Min")) for s in deviations),
        spread=tuple(Spread(s, sibling(s, "Max"), sibling(s, "Min")) for s in deviations),
        derived=(
            Derived(rates[0], "sum_ratio", (*sizes, "Flow Duration")),
            Derived(rates[1], "sum_ratio", (*packets, "Flow Duration")),
            *[Derived(rate, "ratio", (total, "Flow Duration")) for rate, total in zip(rates[2:], packets)],
            Derived(variance[0], "square", (overall[0],)),
            *[Derived(s, "equal", (t,)) for s, t in zip(subflows, (packets[0], sizes[0], packets[1], sizes[1]))],
        ),
        bounded=tuple(Bounded(f, 0, 65535) for f in (*ports, *windows)),
        duplicates=tuple((c.removesuffix(".1"), c) for c in copies),
    )


def _kdd() -> FlowSchema:
    coded = ("protocol_type", "service", "flag")
    binary = ("land", "logged_in", "root_shell", "su_attempted", "is_host_login", "is_guest_login")
    logins = ("num_failed_logins", "logged_in", "root_shell", "su_attempted", "num_shells", "num_access_files")
    counters = ("wrong_fragment", "urgent", "num_outbound_cmds", "count", "srv_count",
                "dst_host_count", "dst_host_srv_count")
    rates = [f for f in KDD_FEATURES if f.endswith("_rate")]
    discrete = {*coded, *binary, *logins, *counters}
    return FlowSchema(
        name="NSL-KDD",
        features=tuple(KDD_FEATURES),
        protocol="protocol_type",
        encoding="string",
        non_negative=tuple(f for f in KDD_FEATURES if f not in {*coded, *binary}),
        tcp_only=("urgent",),
        connection_only=logins,
        discrete=tuple(f for f in KDD_FEATURES if f in discrete),
        bounded=tuple(Bounded(f, 0, 1) for f in [*rates, *binary]),
    )


def _argus() -> FlowSchema:
    coded, binary = ("proto", "service", "state"), ("is_ftp_login", "is_sm_ips_ports")
    ranges = {"sttl": 255, "dttl": 255, "swin": 65535, "dwin": 65535, "Srcport": 65535, "Dstport": 65535,
              "is_ftp_login": 1, "is_sm_ips_ports": 1}
    whole = {*coded, *binary, "spkts", "dpkts", "sloss", "dloss", "swin", "dwin", "trans_depth",
             "Srcport", "Dstport"}
    return FlowSchema(
        name="UNSW-NB15-Native",
        features=tuple(ARGUS_FEATURES),
        protocol="proto",
        encoding="string",
        non_negative=tuple(f for f in ARGUS_FEATURES if f not in {*coded, *binary}),
        tcp_only=("swin", "stcpb", "dtcpb", "dwin", "tcprtt", "synack", "ackdat"),
        connection_only=("trans_depth", "response_body_len", "is_ftp_login", "ct_ftp_cmd", "ct_flw_http_mthd"),
        discrete=tuple(f for f in ARGUS_FEATURES if f in whole or f.startswith("ct_")),
        bounded=tuple(Bounded(f, 0, hi) for f, hi in ranges.items()),
    )


CATALOGUE: dict[str, FlowSchema] = {s.name: s for s in [*map(_flow_meter, FLOW_METER_FEATURES), _kdd(), _argus()]}

DATASET_SCHEMAS = {
    "nsl-kdd": "NSL-KDD",
    "cic-ids-2017": "CIC-IDS-2017",
    "unsw-nb15": "UNSW-NB15-CICFlowMeter",
    "cse-cic-ids2018": "CSE-CIC-IDS2018",
}


def get_schema(name: str) -> FlowSchema:
    if name not in CATALOGUE:
        raise KeyError(f"unknown schema {name!r}; available: {sorted(CATALOGUE)}")
    return CATALOGUE[name]


RULE_TYPE = "dataset string, kind string, feature string, operands array<string>, lo double, hi double"


def rule_table(spark: SparkSession, schemas: list[FlowSchema] | None = None) -> DataFrame:
    """All rules as rows ``(dataset, kind, feature, operands, lo, hi)``."""
    schemas = list(CATALOGUE.values()) if schemas is None else schemas
    return spark.createDataFrame([(s.name, *r) for s in schemas for r in s.rules()], RULE_TYPE)


def missing_rules(spark: SparkSession, schema: FlowSchema, flow: DataFrame) -> DataFrame:
    """Rules that cannot run on ``flow`` because an operand column is absent."""
    have = spark.createDataFrame([(c,) for c in flow.columns], "operand string")
    rules = rule_table(spark, [schema]).withColumn("operand", F.explode("operands"))
    lost = rules.join(F.broadcast(have), "operand", "left_anti")
    return lost.groupBy("dataset", "kind", "feature").agg(F.sort_array(F.collect_set("operand")).alias("missing"))


def rule_summary(spark: SparkSession, datasets: dict[str, str] | None = None) -> DataFrame:
    """One row per dataset with the size of each rule family."""
    rows = []
    for key, name in (datasets or DATASET_SCHEMAS).items():
        s = get_schema(name)
        rows.append((key, name, len(s.features), s.protocol, s.encoding, len(s.non_negative), len(s.tcp_only),
                     len(s.discrete), len(s.ordered), len(s.bounded), len(s.derived), len(s.spread)))
    return local_rows(
        spark, rows,
        "dataset_name string, schema_name string, num_features bigint, protocol_feature string, "
        "protocol_encoding string, num_non_negative bigint, num_tcp_only bigint, num_discrete bigint, "
        "num_hierarchical bigint, num_bounded_range bigint, num_cross_feature bigint, num_std_range bigint",
    )


def protocol_encoding(flow: DataFrame, protocol: str) -> DataFrame:
    """``string`` when the whole column holds only the codes 0, 1, 2; else ``integer``.

    Looks at the column, not at one row, so an ICMP row (1) does not read as string-coded.
    """
    p = F.col(protocol)
    small = F.min(F.when(p.isin(0, 1, 2), 1).otherwise(0)) == 1
    return flow.agg(F.when(small, "string").otherwise("integer").alias("encoding"))
