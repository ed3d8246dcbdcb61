"""Composed audits, end-to-end preparation, captures, latency and rule counts as queries."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import functions as F

from flowaudit.functions.tables import stored
from flowaudit.operators import consensus as CO, constraints as C, evaluation as E, explainers as X, prep as P
from flowaudit.operators import quality as Q
from flowaudit.plans import agreement, modelling, preparation, studies  # noqa: F401 - agreement registers the twins used here
from flowaudit.plans.inputs import FLOW_FEATURES, FLOW_SQL, explanations, flow_scorer, flows, scaled_flows, softmax_scorer, vectors
from flowaudit.plans.registry import SQL, big, query, rounded, table
from flowaudit.sources import pcap

# --- composed audits ---------------------------------------------------------------------------


@query("agreement_audit", f"""
WITH cs AS ({SQL['consensus_summary']}), w AS ({SQL['wilcoxon_test']}),
d AS (SELECT CASE WHEN explainer_a LIKE '%PA-%' AND explainer_b LIKE '%PA-%' THEN 'within-pa'
                  WHEN explainer_a LIKE '%PA-%' OR explainer_b LIKE '%PA-%' THEN 'cross-mode' ELSE 'within-normal' END AS pair_type,
             count(*) FILTER (WHERE wilcoxon_reject_h0) AS n_significant_divergences FROM w GROUP BY 1)
SELECT cs.*, n_significant_divergences FROM cs JOIN d USING (pair_type)""")
def agreement_audit(spark, folder):
    """The whole agreement audit; its summary by pair type, with the number of rejected tests."""
    e = explanations(spark, folder)
    return rounded(studies.agreement_audit(e, "embeddings", [f"x{i}" for i in range(64)])["by_type"])


@query("consensus_p_values", f"""
WITH w AS ({SQL['wilcoxon_test']}), k AS (SELECT explainer_a AS a FROM w UNION SELECT explainer_b FROM w)
SELECT explainer_a AS a, explainer_b AS b, wilcoxon_p_value AS value FROM w UNION ALL SELECT explainer_b, explainer_a, wilcoxon_p_value FROM w
UNION ALL SELECT a, a, 1.0 FROM k""")
def consensus_p_values(spark, folder):
    """Symmetric matrix of the signed-rank p-values."""
    w = CO.wilcoxon(CO.mean_importance(explanations(spark, folder)))
    return rounded(CO.symmetric_matrix(w, "wilcoxon_p_value"))


T_SQL = """
t AS (SELECT r, n - 2 AS v, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t FROM c),
p AS (SELECT r, 1 - 2 * max(t) / 6000 * exp(lgamma((max(v) + 1) / 2.0) - lgamma(max(v) / 2.0)) / sqrt(max(v) * pi())
        * sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + (t * i / 2000) * (t * i / 2000) / v, -(v + 1) / 2.0)) AS p
      FROM t, range(0, 2001) u(i) GROUP BY 1)
"""


@query("faithfulness_test", f"""
WITH c AS ({SQL['faithfulness_correlation'].replace('round(corr(imp.importance, drops.d), 6) AS faithfulness_correlation',
                                                      'corr(imp.importance, drops.d) AS r, CAST(count(*) AS DOUBLE) AS n')}), {T_SQL}
SELECT round(r, 6) AS faithfulness_correlation, round(p, 6) + 0.0 AS faithfulness_p_value FROM p""")
def faithfulness_test(spark, folder):
    """The faithfulness correlation with its p-value (Student's law, integrated by Simpson's rule in the twin)."""
    imp = CO.mean_importance(explanations(spark, folder).filter("explainer_key = 'RF_SHAP'")).select("feature_idx", "importance")
    return rounded(Q.faithfulness_correlation(imp, Q.probability_drops(vectors(spark, folder), 64, softmax_scorer())))


@query("quality_audit", f"""
WITH a AS ({SQL['all_metrics']}), f AS ({SQL['faithfulness_test']})
SELECT a.*, f.* FROM a, f WHERE explainer_key = 'RF_SHAP'""")
def quality_audit(spark, folder):
    """One wide row of quality metrics: sparsity, complexity, faithfulness by ablation and its correlation with p."""
    e = explanations(spark, folder).filter("explainer_key = 'RF_SHAP'")
    wide = studies.quality_audit(vectors(spark, folder), {"RF_SHAP": e.select("row_id", "attrs")}, softmax_scorer(), 3)
    return rounded(wide.select("explainer_key", "sparsity_mean", "`sparsity_tau_0.5`", "complexity_mean_entropy", "complexity_normalized",
                               "faithfulness_correlation", "faithfulness_p_value"))


@query("robustness_audit", f"""
WITH s AS ({SQL['fgsm_success']}) SELECT 'unconstrained' AS mode, attack, epsilon, success, linf, n FROM s""")
def robustness_audit(spark, folder):
    """The whole robustness audit, free and held to the rules; its one-step attack has a closed form."""
    f = scaled_flows(spark, folder)
    modes = {"unconstrained": (None, None), "constrained": (modelling.ATTACK_RULES, modelling.SCALES)}
    audit = studies.robustness_audit(f, flow_scorer(), lambda d: X.integrated_gradients(d, flow_scorer()), modes, store=False)
    return rounded(audit["success"].filter("mode = 'unconstrained' and attack = 'fgsm'"))


# --- preparation, rules, latency ------------------------------------------------------------------


@query("prepare", f"""
WITH {FLOW_SQL}, d AS (SELECT DISTINCT proto, label, quantity, price, discount, tax FROM flows), ids AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS y FROM (SELECT DISTINCT label FROM d))
SELECT y, count(*) AS n, true AS scaled, true AS shares FROM d JOIN ids USING (label) GROUP BY 1""")
def prepare(spark, folder):
    """Raw flows to a deduplicated, labelled, split and scaled table; scales come from the training rows."""
    raw = flows(spark, folder).drop("row_id")
    out, scales, _ = P.prepare(raw, "label")
    out = stored(out, "prepared")
    cells = F.array(*[F.col(c) for c in ("proto", *FLOW_FEATURES)])
    train = F.col("split") == "train"
    whole = out.agg(F.min(F.when(train, F.array_min(cells))).alias("low"), F.max(F.when(train, F.array_max(cells))).alias("high")).first()
    fits = abs(whole["low"]) < 1e-12 and abs(whole["high"] - 1) < 1e-12
    share = lambda s: F.count(F.when(F.col("split") == s, 1))
    n = F.count("*")
    near = (F.abs(share("test") - n * 0.2) <= 1) & (F.abs(share("val") - (n - share("test")) * 0.1) <= 1)
    return out.groupBy(big("y").alias("y")).agg(n.alias("n"), F.lit(fits).alias("scaled"), near.alias("shares"))


@query("rule_summary", f"""
WITH v AS ({SQL['rule_violations']})
SELECT split_part(rule, ':', 1) AS kind, count(*) AS rules, count(*) FILTER (WHERE violations > 0) AS broken_rules, CAST(sum(violations) AS BIGINT) AS violations
FROM v GROUP BY 1""")
def rule_summary(spark, folder):
    """Per family: its rules that can be checked on the rows, those that are broken, and how often."""
    v = C.violations(preparation.rule_rows(spark, folder), preparation.RULES)
    return v.groupBy(F.split("rule", ":")[0].alias("kind")).agg(
        F.count("*").alias("rules"), F.count(F.when(F.col("violations") > 0, 1)).alias("broken_rules"), F.sum("violations").alias("violations"))


@query("latency", "SELECT count(*) AS n, true AS measured FROM lineitem")
def latency(spark, folder):
    """Scoring time per flow, over five runs after a warm-up."""
    f = scaled_flows(spark, folder)
    got = E.latency(lambda d: d.select(flow_scorer().proba(F.col("features")).alias("p")), f)
    fine = got["inference_ms_per_sample_mean"] > 0 and got["inference_ms_per_sample_std"] >= 0
    return f.agg(F.count("*").alias("n"), F.lit(fine).alias("measured"))


# --- captures ---------------------------------------------------------------------------------------

CAPTURE_ROWS = 1000


def _capture(rows: pa.Table) -> pa.Table:
    """A classic capture of one range of events: Ethernet frames with IPv4 and TCP or UDP, and now and then one of another kind."""
    out = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)]
    for r in rows.sort_by("event_id").to_pylist():
        i, user = r["event_id"], r["user_id"]
        size, port = i % 700, user % 60000
        if i % 11 == 0:
            frame = b"\0" * 12 + b"\x86\xdd" + b"\0" * 40  # not IPv4
        elif i % 2:
            head = struct.pack("!BBHHHBBH4s4s", 0x45, i % 256, 40 + size, 0, 0, 64, 6, 0, bytes((10, 0, 0, 1)), bytes((10, 0, user >> 8 & 255, user & 255)))
            frame = b"\0" * 12 + b"\x08\x00" + head + struct.pack("!HHIIHHHH", port, 443, i, 0, 0x5002, 1000, 0, 0) + b"x" * size
        else:
            head = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 28 + size, 0, 0, 64, 17, 0, bytes((10, 0, 0, 1)), bytes((10, 0, user >> 8 & 255, user & 255)))
            frame = b"\0" * 12 + b"\x08\x00" + head + struct.pack("!HHHH", port, 53, 8 + size, 0) + b"x" * size
        out.append(struct.pack("<IIII", i, 0, len(frame), len(frame)) + frame)
    return pa.table({"path": [f"capture-{rows['part'][0].as_py()}"], "content": pa.array([b"".join(out)], pa.binary())})


@query("read_captures", """
SELECT CASE WHEN event_id % 2 = 1 THEN 'tcp' ELSE 'udp' END AS protocol, count(*) AS n, CAST(sum(event_id % 700) AS BIGINT) AS payload,
       CAST(sum(user_id % 60000) AS BIGINT) AS ports, CAST(sum(event_id % 1000) AS BIGINT) AS numbers
FROM events WHERE event_id % 11 <> 0 GROUP BY 1""")
def read_captures(spark, folder):
    """Events written as capture bytes, a range of events each, and read back as packets."""
    e = table(spark, folder, "events").select("event_id", "user_id", F.floor(F.col("event_id") / CAPTURE_ROWS).cast("long").alias("part"))
    files = stored(e.groupBy("part").applyInArrow(_capture, "path string, content binary"), "captures")
    packets = pcap.capture_packets(files)
    return packets.groupBy("protocol").agg(
        F.count("*").alias("n"), big(F.sum("payload_size")).alias("payload"), big(F.sum("sport")).alias("ports"),
        big(F.sum(F.col("ts").cast("long") % CAPTURE_ROWS)).alias("numbers"))
