"""Protocol rules as native column expressions.

Every step is a projection, so the whole repair runs inside the stage that
reads the rows: no shuffle, no Python.  The protocol is a column, so rows of
different protocols are repaired together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowaudit.operators.schemas import FlowSchema

EPS = 1e-10


def col(name: str) -> Column:
    """Column by its literal name (dots and slashes are not path separators)."""
    return F.col("`" + name.replace("`", "``") + "`")


def unpack(df: DataFrame, vector: str, names: list[str]) -> DataFrame:
    """array column -> one column per feature (the array column is dropped)."""
    keep = [c for c in df.columns if c != vector]
    return df.select(*[col(c) for c in keep], *[F.get(col(vector), F.lit(i)).alias(n) for i, n in enumerate(names)])


def pack(df: DataFrame, names: list[str], vector: str = "features") -> DataFrame:
    """feature columns -> one array column (the feature columns are dropped)."""
    drop = set(names)
    return df.select(*[col(c) for c in df.columns if c not in drop], F.array(*[col(n) for n in names]).alias(vector))


def clamp(c: Column, lower, upper) -> Column:
    """Clip to [lower, upper]; null and NaN pass through."""
    lower = lower if isinstance(lower, Column) else F.lit(float(lower))
    upper = upper if isinstance(upper, Column) else F.lit(float(upper))
    return F.when(c < lower, lower).when((c > upper) & ~F.isnan(c), upper).otherwise(c)


def _layers(items: list[tuple[str, list[str], Column]]) -> list[dict[str, Column]]:
    """Group assignments into projections; a later rule sees an earlier rule's result."""
    layers: list[dict[str, Column]] = []
    written: set[str] = set()
    read: set[str] = set()
    for target, operands, expr in items:
        if not layers or written & {target, *operands} or target in read:
            layers.append({})
            written, read = set(), set()
        layers[-1][target] = expr
        written.add(target)
        read |= set(operands)
    return layers


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(F.abs(denominator) > EPS, numerator / denominator).otherwise(F.lit(0.0))


def _derived(rule) -> Column:
    ops = [col(o) for o in rule.operands]
    if rule.relation == "equal":
        return ops[0]
    if rule.relation == "square":
        return ops[0] * ops[0]
    if rule.relation == "ratio":
        value = _ratio(ops[0], ops[1])
    elif rule.relation == "sum_ratio":
        value = _ratio(ops[0] + ops[1], ops[2])
    else:
        raise ValueError(f"unknown relation {rule.relation!r}")
    return value if rule.scale == 1.0 else value * F.lit(rule.scale)


def _gate(names, keep: Column) -> dict[str, Column]:
    return {n: F.when(keep, col(n)).otherwise(F.lit(0.0)) for n in names}


def enforce(df: DataFrame, schema: FlowSchema, original_protocol: Column | None = None) -> DataFrame:
    """Repair rows so that they obey every rule of ``schema``.

    Order: protocol pin, non-negative, ordered triples, spread, derived values,
    ranges, rounding, protocol gates, duplicate columns.  Rounding follows the
    arithmetic, so a derived value may differ from its rounded operands.
    """
    if schema.protocol and original_protocol is not None:
        df = df.withColumn(schema.protocol, original_protocol)
    if schema.non_negative:
        df = df.withColumns({n: F.when(col(n) < 0, F.lit(0.0)).otherwise(col(n)) for n in schema.non_negative})
    sorted_names = [f"_sorted_{i}" for i in range(len(schema.ordered))]
    seen: set[str] = set()
    for i, r in enumerate(schema.ordered):
        overlap = seen & {r.maximum, r.mean, r.minimum}
        if overlap:
            raise ValueError(f"ordered rules share columns: {sorted(overlap)}")
        seen |= {r.maximum, r.mean, r.minimum}
    if schema.ordered:
        df = df.withColumns(
            {s: F.array_sort(F.array(col(r.minimum), col(r.mean), col(r.maximum)))
             for s, r in zip(sorted_names, schema.ordered)}
        )
        picked = {}
        for s, r in zip(sorted_names, schema.ordered):
            for i, n in enumerate((r.minimum, r.mean, r.maximum)):
                picked[n] = F.get(F.col(s), F.lit(i))
        df = df.withColumns(picked).drop(*sorted_names)
    spread = [
        (r.std, [r.maximum, r.minimum],
         F.greatest(F.lit(0.0), F.least(col(r.std), col(r.maximum) - col(r.minimum))))
        for r in schema.spread
    ]
    derived = [(r.target, list(r.operands), _derived(r)) for r in schema.derived]
    for layer in [*_layers(spread), *_layers(derived)]:
        df = df.withColumns(layer)
    if schema.bounded:
        df = df.withColumns({r.column: clamp(col(r.column), r.lower, r.upper) for r in schema.bounded})
    if schema.discrete:
        df = df.withColumns({n: F.rint(col(n)) for n in schema.discrete})
    if schema.protocol:
        proto, gates = F.rint(col(schema.protocol)), {}
        for names, key in ((schema.tcp_only, "tcp"), (schema.udp_only, "udp"), (schema.icmp_only, "icmp")):
            if names:
                gates = _gate(names, proto == F.lit(float(schema.codes[key])))
                df = df.withColumns(gates)
        if schema.connection_only:
            df = df.withColumns(_gate(schema.connection_only, proto != F.lit(float(schema.codes["icmp"]))))
    for layer in _layers([(b, [a], col(a)) for a, b in schema.duplicates]):
        df = df.withColumns(layer)
    return df


def rule_predicates(schema: FlowSchema, tolerance: float = 1e-6) -> dict[str, Column]:
    """``rule name -> broken?`` for every rule.

    Derived values of rounded operands may be off by what rounding did to the
    operands, so those rules are skipped when an operand is discrete.
    """
    out: dict[str, Column] = {}
    for n in schema.non_negative:
        out[f"non_negative:{n}"] = col(n) < 0
    for r in schema.ordered:
        out[f"ordered:{r.mean}"] = (col(r.minimum) > col(r.mean)) | (col(r.mean) > col(r.maximum))
    for r in schema.spread:
        limit = col(r.maximum) - col(r.minimum)
        out[f"spread:{r.std}"] = (col(r.std) < -tolerance) | (col(r.std) > limit + tolerance)
    for r in schema.derived:
        if not set(r.operands) & set(schema.discrete):
            want = _derived(r)
            out[f"{r.relation}:{r.target}"] = F.abs(col(r.target) - want) > tolerance * (1 + F.abs(want))
    for r in schema.bounded:
        out[f"bounded:{r.column}"] = (col(r.column) < r.lower) | (col(r.column) > r.upper)
    for n in schema.discrete:
        out[f"discrete:{n}"] = col(n) != F.rint(col(n))
    if schema.protocol:
        proto = F.rint(col(schema.protocol))
        for names, key in ((schema.tcp_only, "tcp"), (schema.udp_only, "udp"), (schema.icmp_only, "icmp")):
            for n in names:
                out[f"{key}_only:{n}"] = (proto != float(schema.codes[key])) & (col(n) != 0)
        for n in schema.connection_only:
            out[f"connection_only:{n}"] = (proto == float(schema.codes["icmp"])) & (col(n) != 0)
    for a, b in schema.duplicates:
        out[f"duplicate:{b}"] = col(a) != col(b)
    return out


def violations(df: DataFrame, schema: FlowSchema, by: list[str] | None = None) -> DataFrame:
    """Broken-row count per rule, one pass over the table: ``(*by, rule, violations)``."""
    rules = rule_predicates(schema)
    sums = [F.sum(F.when(p, 1).otherwise(0)).cast("bigint").alias(f"_v{i}") for i, p in enumerate(rules.values())]
    wide = df.groupBy(*by).agg(*sums) if by else df.agg(*sums)
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_v{i}").alias("violations"))
                      for i, n in enumerate(rules)])
    long = wide.select(*(by or []), F.explode(pairs).alias("_p"))
    return long.select(*(by or []), "_p.rule", F.coalesce("_p.violations", F.lit(0)).alias("violations"))


def project_feasible(
    df: DataFrame,
    schema: FlowSchema,
    scales: dict[str, tuple[float, float]],
    epsilon: Column,
    adversarial: str = "features",
    original: str = "original",
) -> DataFrame:
    """Pull scaled adversarial rows back onto the rules and into the epsilon ball.

    Unscale, repair with the original row's protocol, rescale, clip to [0, 1],
    clip the change to +-epsilon around the original, clip again.
    """
    names = list(schema.features)
    before = {n: F.get(F.col(original), F.lit(i)) for i, n in enumerate(names)}
    span = {n: (float(scales[n][0]), float(scales[n][1] - scales[n][0])) for n in names}
    df = unpack(df, adversarial, names)
    df = df.withColumns({n: col(n) * span[n][1] + span[n][0] for n in names})
    proto = None
    if schema.protocol:
        lo, width = span[schema.protocol]
        proto = F.rint(before[schema.protocol] * width + lo)
    df = enforce(df, schema, proto)
    safe = {n: (col(n) - span[n][0]) / (span[n][1] if span[n][1] >= 1e-12 else 1.0) for n in names}
    df = df.withColumns({n: clamp(safe[n], 0.0, 1.0) for n in names})
    move = {n: clamp(col(n) - before[n], -epsilon, epsilon) for n in names}
    df = df.withColumns({n: clamp(before[n] + move[n], 0.0, 1.0) for n in names})
    return pack(df, names, adversarial)
