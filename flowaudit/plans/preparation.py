"""Queries on flow tables: sources, preparation, protocol rules, evaluation and selection."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F


from flowaudit.operators import constraints as C, evaluation as E, explainers as X, prep as P
from flowaudit.operators import robustness as R, schemas as SC, selection as S
from flowaudit.plans.inputs import FLOW_FEATURES, FLOW_SQL, SCALED_SQL, SCALES, explanations, flows, protocol, scaled_flows
from flowaudit.plans.registry import big, query, rounded, spread, table
from flowaudit.sources import flows as SRC, store


def scratch(spark) -> str:
    """A new folder all executors can reach (the checkpoint folder; a local one only in local mode)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        return tempfile.mkdtemp(prefix="flowaudit-")
    import uuid

    return f"{shared.rstrip('/')}/flowaudit-{uuid.uuid4().hex}"


# --- sources ---------------------------------------------------------------------------------


@query("read_kdd", """
SELECT CASE l_linenumber % 3 WHEN 0 THEN 'icmp' WHEN 1 THEN 'tcp' ELSE 'udp' END AS protocol_type,
       l_returnflag AS label, count(*) AS n, round(sum(l_quantity), 4) AS src_bytes
FROM lineitem GROUP BY 1, 2""")
def read_kdd(spark, folder):
    """Line items written as a headerless KDD file and read back by name."""
    li = table(spark, folder, "lineitem")
    m = F.col("l_linenumber") % 3
    values = {"protocol_type": F.when(m == 0, "icmp").when(m == 1, "tcp").otherwise("udp"), "service": F.lit("http"),
              "flag": F.col("l_linestatus"), "src_bytes": F.col("l_quantity"), "duration": F.col("l_tax")}
    out = scratch(spark) + "/kdd"
    li.select(*[values.get(c, F.lit(0.0)).alias(c) for c in SRC.KDD_FEATURES], F.col("l_returnflag").alias("label"),
              F.lit(21).alias("difficulty_level")).write.csv(out)
    df = SRC.read_kdd(spark, out)
    return rounded(df.groupBy("protocol_type", "label").agg(F.count("*").alias("n"), F.sum("src_bytes").alias(
        "src_bytes")), 4)


@query("read_directory", """
SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def read_directory(spark, folder):
    """Orders written as CSV files of two layouts with blanks in the headers, read back by column name."""
    o = table(spark, folder, "orders")
    out = scratch(spark) + "/orders"
    half = F.col("o_orderkey") % 2 == 0
    names = [F.col("o_orderkey").alias(" o_orderkey"), F.col("o_totalprice").alias(" o_totalprice "),
             F.col("o_orderpriority").alias(" Label")]
    o.filter(half).select(*names).write.option("ignoreLeadingWhiteSpace", False).csv(out, header=True)
    o.filter(~half).select(*reversed(names)).write.mode("append").csv(out, header=True)
    df = SRC.read_flow_directory(spark, out)
    return rounded(df.groupBy(F.col("Label").alias("priority")).agg(
        F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("double")).alias("total")), 2)


@query("attach_labels", """
SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def attach_labels(spark, folder):
    """A data file set and a label file set joined by row position."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    base = scratch(spark)
    ordered = o.repartitionByRange(6, "o_orderkey").sortWithinPartitions("o_orderkey")
    ordered.select("o_totalprice").write.csv(base + "/data", header=False)
    other = o.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey")
    other.select("o_orderstatus").write.csv(base + "/labels", header=False)
    data = spark.read.schema("price double").csv(base + "/data")
    labels = spark.read.schema("Label string").csv(base + "/labels")
    j = SRC.attach_labels(data, labels)
    return rounded(j.groupBy(F.col("Label").alias("status")).agg(F.count("*").alias("n"), F.sum("price").alias("total")), 2)


RAW_SQL = """
raw AS (
  SELECT event_type, event_id, ' ' || event_type || ' ' AS label,
         CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0 THEN NULL ELSE value END AS value,
         CAST(user_id AS DOUBLE) AS user
  FROM events)
"""


def _raw_events(spark, folder):
    """Text values with bad cells: words, infinities and blanks at fixed keys."""
    i = F.col("event_id")
    value = F.when(i % 17 == 0, "bad").when(i % 19 == 0, "Infinity").when(i % 23 == 0, F.lit(None)).otherwise(
        F.col("value").cast("string"))
    return table(spark, folder, "events").select(
        F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("Label"), value.alias("value"),
        F.col("user_id").cast("string").alias("user"), F.lit("10.0.0.1").alias("Src IP"), "event_type")


@query("read_large_flows", f"""
WITH {RAW_SQL},
m AS (SELECT event_type, median(value) AS med FROM raw GROUP BY 1)
SELECT event_type AS label, count(*) AS n, round(sum(coalesce(value, med)), 4) AS total
FROM raw JOIN m USING (event_type) GROUP BY 1""")
def read_large_flows(spark, folder):
    """One file per event type: medians are per file and duplicates stay."""
    out = scratch(spark) + "/large"
    (_raw_events(spark, folder).withColumn("kind", F.col("event_type")).drop("event_type")
     .repartition("kind").write.partitionBy("kind").csv(out, header=True))
    df = SRC.read_large_flows(spark, out)
    return rounded(df.groupBy(F.col("Label").alias("label")).agg(
        F.count("*").alias("n"), F.sum("value").alias("total")), 4)


@query("explanation_store", """
SELECT 'RF_SHAP' AS explainer_key, count(*) AS n, round(sum(CAST(embedding[1] AS DOUBLE)), 6) AS total FROM embeddings
UNION ALL SELECT 'RF_PA-SHAP', count(*), round(sum(CAST(embedding[1] AS DOUBLE) * 0.8e0), 6) FROM embeddings""")
def explanation_store(spark, folder):
    """Explanations written partitioned by explainer, the missing ones added on resume, read back by key."""
    path = scratch(spark) + "/explanations"
    e = explanations(spark, folder).withColumn("dataset", F.lit("demo")).filter("explainer_key <> 'DNN_IG'")
    config = {"samples": 2000, "seed": 42}
    store.write_table(e.filter("explainer_key = 'RF_SHAP'"), path, config=config)
    done = store.resume(e, path, ["explainer_key", "row_id"], lambda rows: rows, config=config)
    return rounded(done.groupBy("explainer_key").agg(F.count("*").alias("n"), F.sum(F.get("attrs", F.lit(0))).alias("total")))


@query("missing_pairs", """
WITH k AS (SELECT DISTINCT event_type AS k FROM events), p AS (
  SELECT a.k AS explainer_a, b.k AS explainer_b FROM k a JOIN k b ON a.k < b.k)
SELECT * FROM p WHERE explainer_a <> 'click'""")
def missing_pairs(spark, folder):
    """Pairs still to compute when those of one explainer are stored already."""
    k = table(spark, folder, "events").select("event_type").distinct()
    a, b = k.toDF("explainer_a"), k.toDF("explainer_b")
    pairs = a.join(b, F.col("explainer_a") < F.col("explainer_b"))
    return store.missing(pairs, pairs.filter("explainer_a = 'click'"), ["explainer_a", "explainer_b"])


@query("summary_sink", """
SELECT event_type AS method, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1""")
def summary_sink(spark, folder):
    """A result table written as CSV and JSON; the JSON copy is read back."""
    base = scratch(spark)
    s = rounded(table(spark, folder, "events").groupBy(F.col("event_type").alias("method")).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean_value")))
    store.write_summary(s, base + "/csv", "csv")
    store.write_summary(s, base + "/json", "json")
    return spark.read.schema("method string, n bigint, mean_value double").json(base + "/json")


# --- preparation --------------------------------------------------------------------------------


@query("clean_flows", f"""
WITH {RAW_SQL},
m AS (SELECT median(value) AS med FROM raw),
d AS (SELECT DISTINCT trim(label) AS label, coalesce(value, med) AS value, user FROM raw, m)
SELECT label, count(*) AS n, round(sum(value), 4) AS total, round(sum(user), 4) AS users FROM d GROUP BY 1""")
def clean_flows(spark, folder):
    """Label found and trimmed, metadata dropped, text coerced, gaps filled by medians, duplicates removed."""
    raw = P.drop_metadata(_raw_events(spark, folder).drop("event_type"))
    label = P.find_label(raw)
    c = P.clean(raw, label, ["value", "user"])
    return rounded(c.groupBy(F.col(label).alias("label")).agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.sum("user").alias("users")), 4)


@query("feature_medians", f"""
WITH {FLOW_SQL}
SELECT label, 'price' AS feature, round(median(price), 6) AS median FROM flows GROUP BY 1
UNION ALL SELECT label, 'quantity', round(median(quantity), 6) FROM flows GROUP BY 1
UNION ALL SELECT label, 'discount', round(median(discount), 6) FROM flows GROUP BY 1""")
def feature_medians(spark, folder):
    return rounded(P.medians(flows(spark, folder), ["price", "quantity", "discount"], ["label"]))


@query("protocol_from_flags", """
SELECT CASE WHEN l_linenumber - 5 > 0 OR l_quantity - 30 > 0 OR l_partkey % 7 - 3 >= 0 THEN 6
            WHEN l_suppkey % 4 = 0 THEN 1 ELSE 17 END AS protocol, count(*) AS n FROM lineitem GROUP BY 1""")
def protocol_from_flags(spark, folder):
    li = table(spark, folder, "lineitem").select(
        (F.col("l_linenumber") - 5).alias("SYN"), (F.col("l_quantity") - 30).alias("ACK"),
        (F.col("l_partkey") % 7 - 3).alias("window"), (F.col("l_suppkey") % 4).alias("port"))
    p = P.protocol_from_flags(["SYN", "ACK"], "window", "port")
    return li.groupBy(p.alias("protocol")).agg(F.count("*").alias("n"))


@query("protocol_from_window", """
SELECT CASE WHEN l_linenumber - 5 > 0 OR l_partkey % 7 - 3 > 0 THEN 6
            WHEN l_partkey % 7 - 3 = 0 THEN 1 ELSE 17 END AS protocol, count(*) AS n FROM lineitem GROUP BY 1""")
def protocol_from_window(spark, folder):
    li = table(spark, folder, "lineitem").select(
        (F.col("l_linenumber") - 5).alias("SYN"), (F.col("l_partkey") % 7 - 3).alias("window"))
    p = P.protocol_from_window(["SYN", "CWR"], "window", li.columns)
    return li.groupBy(p.alias("protocol")).agg(F.count("*").alias("n"))


@query("attack_categories", """
SELECT CASE event_type WHEN 'click' THEN 'DoS' WHEN 'view' THEN 'Probe' WHEN 'error' THEN 'U2R' ELSE 'Normal' END
         AS category, count(*) AS n FROM events GROUP BY 1""")
def attack_categories(spark, folder):
    t = F.col("event_type")
    attack = F.when(t == "click", "Neptune ").when(t == "view", " satan").when(t == "error", "ROOTKIT").otherwise("novel")
    df = table(spark, folder, "events").select(attack.alias("label"))
    return P.map_categories(df, "label", P.category_table(spark)).groupBy("category").agg(F.count("*").alias("n"))


@query("one_hot", """
SELECT o_orderstatus AS status, CAST(sum(CAST(o_orderpriority = '1-URGENT' AS INT)) AS BIGINT) AS urgent,
       CAST(sum(CAST(o_orderpriority = '5-LOW' AS INT)) AS BIGINT) AS low, count(*) AS n FROM orders GROUP BY 1""")
def one_hot(spark, folder):
    """Categories of both halves of the orders give one fixed column list."""
    o = table(spark, folder, "orders").withColumn("status", F.col("o_orderstatus"))
    train, test = o.filter("o_orderkey % 5 > 0"), o.filter("o_orderkey % 5 = 0")
    cats = P.one_hot_categories([train, test], ["o_orderpriority", "o_orderstatus"])
    hot = P.one_hot(train, cats).unionByName(P.one_hot(test, cats))
    s = lambda c: big(F.sum(F.col(f"`{c}`")))
    return hot.groupBy("status").agg(s("o_orderpriority_1-URGENT").alias("urgent"),
                                     s("o_orderpriority_5-LOW").alias("low"), F.count("*").alias("n"))


@query("label_ids", f"""
WITH {FLOW_SQL}, ids AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT label FROM flows))
SELECT label, label_id, count(*) AS n FROM flows JOIN ids USING (label) GROUP BY 1, 2""")
def label_ids(spark, folder):
    f = flows(spark, folder)
    e = P.encode_labels(f, "label", P.label_ids([f], "label"))
    return e.groupBy("label", big("label_id").alias("label_id")).agg(F.count("*").alias("n"))


@query("contiguous_labels", """
WITH seen AS (SELECT DISTINCT label FROM embeddings WHERE label % 3 > 0),
ids AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM seen)
SELECT label, coalesce(id, -1) AS model_id, count(*) AS n FROM embeddings LEFT JOIN ids USING (label) GROUP BY 1, 2""")
def contiguous_labels(spark, folder):
    """Classes missing from training get -1."""
    e = table(spark, folder, "embeddings").select("label")
    ids = P.contiguous_ids(e.filter("label % 3 > 0"), "label")
    return P.remap_labels(e, ids, "label").groupBy("label", big("model_id").alias("model_id")).agg(F.count("*").alias("n"))


@query("stratified_split", f"""
WITH {FLOW_SQL}, n AS (SELECT label, count(*) AS n FROM flows GROUP BY 1),
t AS (SELECT label, n, round_even(n * 0.2e0, 0) AS te FROM n),
v AS (SELECT *, round_even((n - te) * 0.1e0, 0) AS va FROM t)
SELECT label, 'test' AS split, CAST(te AS BIGINT) AS n FROM v
UNION ALL SELECT label, 'val', CAST(va AS BIGINT) FROM v
UNION ALL SELECT label, 'train', CAST(n - te - va AS BIGINT) FROM v""")
def stratified_split(spark, folder):
    s = P.stratified_split(flows(spark, folder), "label")
    return s.groupBy("label", "split").agg(F.count("*").alias("n"))


@query("min_max_scale", f"""
WITH {FLOW_SQL}, r AS (SELECT min(price) AS lo, max(price) AS hi, min(quantity) AS ql, max(quantity) AS qh
                       FROM flows WHERE label LIKE 'R%')
SELECT label, round(avg((price - lo) / (hi - lo)), 6) AS price, round(max((quantity - ql) / (qh - ql)), 6) AS quantity,
       0e0 AS constant FROM flows, r GROUP BY 1""")
def min_max_scale(spark, folder):
    """Ranges come from the training classes only; a constant column scales to 0."""
    f = flows(spark, folder).withColumn("constant", F.lit(7.0))
    scales = P.fit_scales(f.filter("label LIKE 'R%'"), ["price", "quantity", "constant"])
    s = P.scale(f, scales)
    return rounded(s.groupBy("label").agg(F.avg("price").alias("price"), F.max("quantity").alias("quantity"),
                                          F.max("constant").alias("constant")))


@query("rescale_clipped", f"""
WITH {FLOW_SQL}
SELECT label, round(avg(least(1.0, greatest(0.0, (price - 20000.0) / 50000.0))), 6) AS price,
       round(sum((quantity - 1) / 49e0 * 49 + 1), 4) AS quantity FROM flows GROUP BY 1""")
def rescale_clipped(spark, folder):
    """Scaling and its inverse, and scaling clipped to [0, 1]."""
    f = flows(spark, folder)
    f = P.unscale(P.scale(f, {"quantity": (1.0, 50.0)}), {"quantity": (1.0, 50.0)})
    f = P.rescale_clipped(f, {"price": (20000.0, 70000.0)})
    r = f.groupBy("label").agg(F.avg("price").alias("price"), F.round(F.sum("quantity"), 4).alias("quantity"))
    return rounded(r)


@query("oversample_counts", """
WITH n AS (SELECT label AS y, count(*) AS n FROM embeddings GROUP BY 1),
t AS (SELECT CAST(floor(median(n)) AS BIGINT) AS target FROM n)
SELECT y, false AS synthetic, n FROM n
UNION ALL SELECT y, true, target - n FROM n, t WHERE n < target AND n > 1""")
def oversample_counts(spark, folder):
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("y"),
                                                  F.col("embedding").alias("features"))
    return P.oversample(e).groupBy("y", "synthetic").agg(F.count("*").alias("n"))


@query("sample_and_background", """
SELECT least(count(*), 1000) AS sampled, least(count(*) FILTER (WHERE label = 0), 200) AS benign FROM embeddings""")
def sample_and_background(spark, folder):
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("y"), "embedding")
    a = X.sample_rows(e, 1000).agg(F.count("*").alias("sampled"))
    return a.join(X.background_rows(e, 200, benign=0).agg(F.count("*").alias("benign")))


@query("decoy_feature", """
SELECT count(*) AS n, count(*) AS in_range, true AS centred FROM orders""")
def decoy_feature(spark, folder):
    """The decoy is uniform: inside [0, 1) and with mean near one half."""
    d = table(spark, folder, "orders").withColumn("d", R.decoy_column(42, F.col("o_orderkey")))
    return d.agg(F.count("*").alias("n"), F.count(F.when((F.col("d") >= 0) & (F.col("d") < 1), 1)).alias("in_range"),
                 (F.abs(F.avg("d") - 0.5) < 0.02).alias("centred"))


@query("marginal_shuffle", """
SELECT count(*) AS n, true AS half_swapped, 0 AS foreign_values FROM orders""")
def marginal_shuffle(spark, folder):
    """About half of the cells change, and only to values of their own column."""
    o = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price"),
        F.col("o_orderkey").cast("double").alias("key"))
    s = R.marginal_shuffle(o, o, ["price", "key"])
    foreign = s.join(o.select(F.col("key").alias("_k"), F.col("price").alias("_p")),
                     F.col("key") == F.col("_k"), "left").filter("_k is null").agg(big(F.count("*")).alias("foreign_values"))
    moved = s.agg(F.count("*").alias("n"), (F.abs(F.avg((F.col("key") != F.col("row_id")).cast("double")) - 0.5) < 0.05)
                  .alias("half_swapped"))
    return moved.join(foreign)


@query("corrupted_inputs", """
SELECT 'zero' AS block, 50 AS n UNION ALL SELECT 'extreme', 50 UNION ALL SELECT 'noisy', count(*)
FROM orders""")
def corrupted_inputs(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), F.array(
        F.col("o_totalprice"), F.col("o_custkey").cast("double")).alias("features"))
    from flowaudit.operators.quality import corrupted_inputs as make

    return make(o, 2).groupBy("block").agg(F.count("*").alias("n"))


@query("keep_features", f"""
WITH {FLOW_SQL} SELECT label, round(sum(price), 2) AS price, round(sum(tax), 4) AS tax FROM flows GROUP BY 1""")
def keep_features(spark, folder):
    k = P.keep_features(flows(spark, folder), ["label"], ["price", "tax"])
    return k.groupBy("label").agg((F.round(F.sum("price"), 2) + 0.0).alias("price"),
                                  (F.round(F.sum("tax"), 4) + 0.0).alias("tax"))


# --- protocol rules -----------------------------------------------------------------------------

RULES = SC.FlowSchema(
    name="lineitem-flows",
    features=("proto", "port", "pkt_max", "pkt_mean", "pkt_min", "pkt_std", "pkt_var", "duration", "fwd", "bwd",
              "rate", "fwd_rate", "sub_fwd", "syn", "win", "len_udp", "type_icmp", "login", "header", "header2"),
    protocol="proto",
    non_negative=("pkt_max", "pkt_mean", "pkt_min", "pkt_std", "pkt_var", "duration", "fwd", "bwd", "rate", "header"),
    tcp_only=("syn", "win"), udp_only=("len_udp",), icmp_only=("type_icmp",), connection_only=("login",),
    discrete=("port", "fwd", "syn", "login"),
    ordered=(SC.Ordered("pkt_max", "pkt_mean", "pkt_min"),),
    spread=(SC.Spread("pkt_std", "pkt_max", "pkt_min"),),
    derived=(SC.Derived("rate", "sum_ratio", ("fwd", "bwd", "duration")), SC.Derived("fwd_rate", "ratio", ("fwd", "duration")),
             SC.Derived("pkt_var", "square", ("pkt_std",)), SC.Derived("sub_fwd", "equal", ("fwd",))),
    bounded=(SC.Bounded("port", 0, 65535), SC.Bounded("win", 0, 1000)),
    duplicates=(("header", "header2"),),
)

_CELLS = {
    "proto": "CASE l_linenumber % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 6e0 ELSE 17e0 END",
    "port": "l_quantity * 1500 - 2000.5e0",
    "pkt_max": "l_quantity - 10e0",
    "pkt_mean": "l_discount * 300e0 - 5e0",
    "pkt_min": "l_tax * 400e0 - 6e0",
    "pkt_std": "l_linenumber * 5e0 - 12e0",
    "pkt_var": "l_quantity * 1e0",
    "duration": "CASE WHEN l_quantity < 10 THEN 0e0 ELSE l_quantity - 12e0 END",
    "fwd": "l_partkey / 4e0 - 20e0",
    "bwd": "l_suppkey - 30e0",
    "rate": "-1e0",
    "fwd_rate": "99e0",
    "sub_fwd": "5e0",
    "syn": "l_linenumber / 2e0",
    "win": "l_extendedprice / 10e0 - 300e0",
    "len_udp": "l_quantity * 2e0",
    "type_icmp": "l_suppkey * 1e0",
    "login": "l_linenumber / 4e0",
    "header": "l_tax * 100e0 - 4e0",
    "header2": "3e0",
}
RULES_SQL = "raw AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _CELLS.items()) + " FROM lineitem)"
REPAIR_SQL = f"""
WITH {RULES_SQL},
a AS (SELECT * REPLACE ({', '.join(f'greatest({n}, 0) AS {n}' for n in RULES.non_negative)}) FROM raw),
b AS (SELECT *, list_sort([pkt_min, pkt_mean, pkt_max]) AS t FROM a),
c AS (SELECT * REPLACE (t[1] AS pkt_min, t[2] AS pkt_mean, t[3] AS pkt_max) FROM b),
d AS (SELECT * REPLACE (greatest(0, least(pkt_std, pkt_max - pkt_min)) AS pkt_std) FROM c),
e AS (SELECT * REPLACE (CASE WHEN abs(duration) > 1e-10 THEN (fwd + bwd) / duration ELSE 0 END AS rate,
        CASE WHEN abs(duration) > 1e-10 THEN fwd / duration ELSE 0 END AS fwd_rate,
        pkt_std * pkt_std AS pkt_var, fwd AS sub_fwd) FROM d),
f AS (SELECT * REPLACE (greatest(0, least(port, 65535)) AS port, greatest(0, least(win, 1000)) AS win) FROM e),
g AS (SELECT * REPLACE (round_even(port, 0) AS port, round_even(fwd, 0) AS fwd, round_even(syn, 0) AS syn,
        round_even(login, 0) AS login) FROM f),
h AS (SELECT * REPLACE (CASE WHEN proto = 6 THEN syn ELSE 0 END AS syn, CASE WHEN proto = 6 THEN win ELSE 0 END AS win,
        CASE WHEN proto = 17 THEN len_udp ELSE 0 END AS len_udp,
        CASE WHEN proto = 1 THEN type_icmp ELSE 0 END AS type_icmp,
        CASE WHEN proto <> 1 THEN login ELSE 0 END AS login, header AS header2) FROM g)
"""


def rule_rows(spark, folder):
    return table(spark, folder, "lineitem").select(*[F.expr(e).cast("double").alias(n) for n, e in _CELLS.items()])


def _only(**kept) -> SC.FlowSchema:
    """The rule set with only some families."""
    return SC.FlowSchema(name="part", features=RULES.features, protocol="proto", **kept)


def _sums(df, names):
    return rounded(df.groupBy(big("proto").alias("proto")).agg(*[F.sum(n).alias(n) for n in names]), 3)


def _sum_sql(cte, names):
    return f"SELECT CAST(proto AS BIGINT) AS proto, {', '.join(f'round(sum({n}), 3) AS {n}' for n in names)} FROM {cte} GROUP BY 1"


def _register_families():
    families = {
        "rule_non_negative": ({"non_negative": RULES.non_negative}, RULES.non_negative,
                              f"SELECT * REPLACE ({', '.join(f'greatest({n}, 0) AS {n}' for n in RULES.non_negative)}) FROM raw"),
        "rule_ordered": ({"ordered": RULES.ordered}, ("pkt_min", "pkt_mean", "pkt_max"),
                         "SELECT * REPLACE (list_sort([pkt_min, pkt_mean, pkt_max])[1] AS pkt_min, "
                         "list_sort([pkt_min, pkt_mean, pkt_max])[2] AS pkt_mean, "
                         "list_sort([pkt_min, pkt_mean, pkt_max])[3] AS pkt_max) FROM raw"),
        "rule_spread": ({"spread": RULES.spread}, ("pkt_std",),
                        "SELECT * REPLACE (greatest(0, least(pkt_std, pkt_max - pkt_min)) AS pkt_std) FROM raw"),
        "rule_equal": ({"derived": RULES.derived[3:]}, ("sub_fwd",), "SELECT * REPLACE (fwd AS sub_fwd) FROM raw"),
        "rule_square": ({"derived": RULES.derived[2:3]}, ("pkt_var",),
                        "SELECT * REPLACE (pkt_std * pkt_std AS pkt_var) FROM raw"),
        "rule_ratio": ({"derived": RULES.derived[1:2]}, ("fwd_rate",),
                       "SELECT * REPLACE (CASE WHEN abs(duration) > 1e-10 THEN fwd / duration ELSE 0 END AS fwd_rate) FROM raw"),
        "rule_sum_ratio": ({"derived": RULES.derived[:1]}, ("rate",),
                           "SELECT * REPLACE (CASE WHEN abs(duration) > 1e-10 THEN (fwd + bwd) / duration ELSE 0 END AS rate) FROM raw"),
        "rule_bounded": ({"bounded": RULES.bounded}, ("port", "win"),
                         "SELECT * REPLACE (greatest(0, least(port, 65535)) AS port, greatest(0, least(win, 1000)) AS win) FROM raw"),
        "rule_discrete": ({"discrete": RULES.discrete}, RULES.discrete,
                          "SELECT * REPLACE (" + ", ".join(f"round_even({n}, 0) AS {n}" for n in RULES.discrete) + ") FROM raw"),
        "rule_protocol_gates": ({"tcp_only": RULES.tcp_only, "udp_only": RULES.udp_only, "icmp_only": RULES.icmp_only},
                                ("syn", "win", "len_udp", "type_icmp"),
                                "SELECT * REPLACE (CASE WHEN proto = 6 THEN syn ELSE 0 END AS syn, CASE WHEN proto = 6 THEN win "
                                "ELSE 0 END AS win, CASE WHEN proto = 17 THEN len_udp ELSE 0 END AS len_udp, "
                                "CASE WHEN proto = 1 THEN type_icmp ELSE 0 END AS type_icmp) FROM raw"),
        "rule_connection_only": ({"connection_only": RULES.connection_only}, ("login",),
                                 "SELECT * REPLACE (CASE WHEN proto <> 1 THEN login ELSE 0 END AS login) FROM raw"),
        "rule_duplicates": ({"duplicates": RULES.duplicates}, ("header", "header2"),
                            "SELECT * REPLACE (header AS header2) FROM raw"),
    }
    for name, (kept, names, step) in families.items():
        def run(spark, folder, kept=kept, names=names):
            return _sums(C.enforce(rule_rows(spark, folder), _only(**kept)), names)

        query(name, f"WITH {RULES_SQL}, s AS ({step}) " + _sum_sql("s", names))(run)


_register_families()


@query("rule_repair", REPAIR_SQL + _sum_sql("h", RULES.features[1:]))
def rule_repair(spark, folder):
    """All rules in order, in one stage."""
    return _sums(C.enforce(rule_rows(spark, folder), RULES), RULES.features[1:])


@query("rule_pin_protocol", f"""
WITH {RULES_SQL} SELECT 17 AS proto, count(*) AS n, 0e0 AS syn FROM raw""")
def rule_pin_protocol(spark, folder):
    """Rows pinned to an original protocol (UDP) lose their TCP fields."""
    r = C.enforce(rule_rows(spark, folder), _only(tcp_only=("syn",)), F.lit(17.0))
    return r.groupBy(big("proto").alias("proto")).agg(F.count("*").alias("n"), F.sum("syn").alias("syn"))


@query("rule_violations", f"""
WITH {RULES_SQL},
v AS (SELECT {', '.join(f'sum(CAST({n} < 0 AS INT)) AS "non_negative:{n}"' for n in RULES.non_negative)},
  sum(CAST(pkt_min > pkt_mean OR pkt_mean > pkt_max AS INT)) AS "ordered:pkt_mean",
  sum(CAST(pkt_std < -1e-6 OR pkt_std > pkt_max - pkt_min + 1e-6 AS INT)) AS "spread:pkt_std",
  sum(CAST(abs(pkt_var - pkt_std * pkt_std) > 1e-6 * (1 + pkt_std * pkt_std) AS INT)) AS "square:pkt_var",
  sum(CAST(port < 0 OR port > 65535 AS INT)) AS "bounded:port", sum(CAST(win < 0 OR win > 1000 AS INT)) AS "bounded:win",
  {', '.join(f'sum(CAST({n} <> round_even({n}, 0) AS INT)) AS "discrete:{n}"' for n in RULES.discrete)},
  sum(CAST(proto <> 6 AND syn <> 0 AS INT)) AS "tcp_only:syn", sum(CAST(proto <> 6 AND win <> 0 AS INT)) AS "tcp_only:win",
  sum(CAST(proto <> 17 AND len_udp <> 0 AS INT)) AS "udp_only:len_udp",
  sum(CAST(proto <> 1 AND type_icmp <> 0 AS INT)) AS "icmp_only:type_icmp",
  sum(CAST(proto = 1 AND login <> 0 AS INT)) AS "connection_only:login",
  sum(CAST(header <> header2 AS INT)) AS "duplicate:header2" FROM raw)
SELECT rule, CAST(violations AS BIGINT) AS violations FROM (UNPIVOT v ON COLUMNS(*) INTO NAME rule VALUE violations)""")
def rule_violations(spark, folder):
    return C.violations(rule_rows(spark, folder), RULES)


@query("rule_violations_after_repair", f"""
WITH {RULES_SQL} SELECT 0 AS violations, count(*) AS n FROM raw""")
def rule_violations_after_repair(spark, folder):
    fixed = C.enforce(rule_rows(spark, folder), RULES)
    v = C.violations(fixed, RULES).agg(big(F.sum("violations")).alias("violations"))
    return v.join(fixed.agg(F.count("*").alias("n")))


@query("rule_coverage", """
SELECT 'lineitem-flows' AS dataset, 'non_negative' AS kind, 'no_such_column' AS feature, 'no_such_column' AS missing,
       count(*) AS n FROM lineitem""")
def rule_coverage(spark, folder):
    """Rules of a catalogue that a table cannot satisfy because columns are missing."""
    s = SC.FlowSchema("lineitem-flows", ("l_tax", "no_such_column"), non_negative=("l_tax", "no_such_column"))
    li = table(spark, folder, "lineitem")
    lost = SC.missing_rules(spark, s, li).withColumn("missing", F.array_join("missing", ","))
    return lost.join(li.agg(F.count("*").alias("n")))


@query("protocol_encoding", """
SELECT 'integer' AS numbered, 'string' AS coded FROM lineitem LIMIT 1""")
def protocol_encoding(spark, folder):
    """Protocol numbers versus small codes, judged on the whole column."""
    li = table(spark, folder, "lineitem").select(protocol().alias("p"), (F.col("l_linenumber") % 3).alias("code"))
    a = SC.protocol_encoding(li, "p").withColumnRenamed("encoding", "numbered")
    return a.join(SC.protocol_encoding(li, "code").withColumnRenamed("encoding", "coded"))


FEASIBLE = SC.FlowSchema(
    "scaled-flows", FLOW_FEATURES, non_negative=("quantity",), discrete=("quantity",),
    bounded=(SC.Bounded("price", 2000, 90000),), ordered=(SC.Ordered("quantity", "discount", "tax"),))


@query("project_feasible", f"""
WITH {SCALED_SQL},
adv AS (SELECT *, x0 + 0.3e0 AS a0, x1 - 0.2e0 AS a1, x2 * 40 AS a2, x3 * 20 AS a3 FROM scaled),
raw AS (SELECT *, a0 * 49 + 1 AS q, a1 * 104100 + 900 AS p, a2 * CAST(0.1 AS DOUBLE) AS d, a3 * CAST(0.08 AS DOUBLE) AS t FROM adv),
s AS (SELECT *, list_sort([t, d, greatest(q, 0)]) AS l FROM raw),
r AS (SELECT *, round_even(l[3], 0) AS q2, greatest(2000, least(p, 90000)) AS p2, l[2] AS d2, l[1] AS t2 FROM s),
b AS (SELECT y, x0, x1, x2, x3, (q2 - 1) / 49 AS b0, (p2 - 900) / 104100 AS b1, d2 / CAST(0.1 AS DOUBLE) AS b2,
             t2 / CAST(0.08 AS DOUBLE) AS b3 FROM r),
k AS (SELECT y, {', '.join(f'greatest(0, least(1, x{i} + greatest(-0.15e0, least(0.15e0, greatest(0, least(1, b{i})) - x{i})))) AS f{i}' for i in range(4))} FROM b)
SELECT y, round(avg(f0), 6) AS quantity, round(avg(f1), 6) AS price, round(avg(f2), 6) AS discount,
       round(avg(f3), 6) AS tax FROM k GROUP BY 1""")
def project_feasible(spark, folder):
    """Adversarial rows pulled back onto the rules and into the 0.15 ball."""
    f = scaled_flows(spark, folder)
    x = F.col("features")
    adv = f.select("y", x.alias("original"), F.array(
        F.get(x, F.lit(0)) + 0.3, F.get(x, F.lit(1)) - 0.2, F.get(x, F.lit(2)) * 40, F.get(x, F.lit(3)) * 20).alias("features"))
    p = C.project_feasible(adv, FEASIBLE, SCALES, F.lit(0.15))
    return rounded(p.groupBy("y").agg(*[F.avg(F.get("features", F.lit(i))).alias(n) for i, n in enumerate(FLOW_FEATURES)]))


# --- evaluation -----------------------------------------------------------------------------------

SCORED_SQL = """
scored AS (
  SELECT l_linestatus AS g, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
         CASE WHEN l_quantity < 15 THEN 0 WHEN l_quantity < 40 THEN 1 ELSE 2 END AS pred,
         [l_quantity / 50e0, (l_discount + 0.0) * 5e0, l_extendedprice / 105000e0] AS proba FROM lineitem)
"""
CLASS_SQL = f"""
WITH {SCORED_SQL}, ids AS (SELECT unnest([0, 1, 2, 3]) AS c),
n AS (SELECT g, count(*) AS n FROM scored GROUP BY 1),
cl AS (SELECT g, c, count(*) FILTER (WHERE y = c) AS support, count(*) FILTER (WHERE pred = c) AS predicted,
             count(*) FILTER (WHERE y = c AND pred = c) AS tp FROM scored, ids GROUP BY 1, 2),
m AS (SELECT cl.*, predicted - tp AS fp, support - tp AS fn, n - support - predicted + tp AS tn FROM cl JOIN n USING (g)),
k AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2e0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
             CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / (fp + tn) ELSE 0 END AS fpr FROM m)
"""


def scored_rows(spark, folder):
    li = spread(table(spark, folder, "lineitem"), "l_extendedprice")
    q = F.col("l_quantity")
    return li.select(
        F.col("l_linestatus").alias("g"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("y"),
        F.when(q < 15, 0).when(q < 40, 1).otherwise(2).alias("pred"),
        F.array(q / 50.0, (F.col("l_discount") + 0.0) * 5.0, F.col("l_extendedprice") / 105000.0).alias("proba"))


@query("confusion_matrix", f"""
WITH {SCORED_SQL}, ids AS (SELECT unnest([0, 1, 2, 3]) AS c), g AS (SELECT DISTINCT g FROM scored),
n AS (SELECT g, y, pred, count(*) AS n FROM scored GROUP BY 1, 2, 3)
SELECT g.g AS g, a.c AS y, b.c AS pred, coalesce(n, 0) AS n FROM g, ids a, ids b
LEFT JOIN n ON n.g = g.g AND n.y = a.c AND n.pred = b.c""")
def confusion_matrix(spark, folder):
    return E.confusion(scored_rows(spark, folder), 4, ["g"])


def _classes(spark, folder):
    return E.class_scores(E.confusion(scored_rows(spark, folder), 4, ["g"]), ["g"])


@query("class_f1", CLASS_SQL + "SELECT g, c AS class_id, support, tp, fp, fn, tn, round(f1, 6) AS f1 FROM k")
def class_f1(spark, folder):
    return rounded(_classes(spark, folder).select("g", "class_id", "support", "tp", "fp", "fn", "tn", "f1"))


@query("f1_summary", CLASS_SQL + """
SELECT g, round(sum(tp) / CAST(sum(support) AS DOUBLE), 6) AS accuracy,
       round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
       round(avg(f1) FILTER (WHERE support + predicted > 0), 6) AS f1_macro FROM k GROUP BY 1""")
def f1_summary(spark, folder):
    return rounded(E.f1_summary(_classes(spark, folder), ["g"]))


@query("false_positive_rates", CLASS_SQL + """
SELECT g, round(avg(fpr), 6) AS fpr_macro, round(sum(fp) / CAST(sum(fp) + sum(tn) AS DOUBLE), 6) AS far_overall
FROM k GROUP BY 1""")
def false_positive_rates(spark, folder):
    return rounded(E.false_positive_rates(_classes(spark, folder), ["g"]))


AUC_SQL = f"""
WITH {SCORED_SQL},
l AS (SELECT g, y, c, proba[c + 1] AS s FROM scored, range(0, 3) t(c)),
r AS (SELECT g, c, y, rank() OVER (PARTITION BY g, c ORDER BY s)
        + (count(*) OVER (PARTITION BY g, c, s) - 1) / CAST(2 AS DOUBLE) AS r FROM l),
a AS (SELECT g, c, count(*) FILTER (WHERE y = c) AS np, count(*) FILTER (WHERE y <> c) AS nn,
             sum(r) FILTER (WHERE y = c) AS s FROM r GROUP BY 1, 2),
auc AS (SELECT g, c, np, (s - np * (np + 1) / 2e0) / (CAST(np AS DOUBLE) * nn) AS auc FROM a)
"""


@query("class_auc", AUC_SQL + "SELECT g, c AS class_id, np AS n_pos, round(auc, 6) AS auc FROM auc")
def class_auc(spark, folder):
    a = E.class_auc(scored_rows(spark, folder), ["g"])
    return rounded(a.withColumn("class_id", big("class_id")))


@query("weighted_auc", AUC_SQL + "SELECT g, round(sum(auc * np) / sum(np), 6) AS auc FROM auc GROUP BY 1")
def weighted_auc(spark, folder):
    return rounded(E.weighted_auc(E.class_auc(scored_rows(spark, folder), ["g"]), 3, ["g"]))


METRICS_SQL = """
met AS (SELECT 'm' || user_id % 3 AS model, CASE event_type WHEN 'view' THEN 'Full' ELSE event_type END AS selection_method,
          CASE event_type WHEN 'view' THEN 40 ELSE 10 END AS n_features, avg(value) / 100 AS accuracy,
          max(value) / 500 AS f1_weighted, min(value) AS fpr_macro, sum(value) AS train_time_s,
          CASE WHEN event_type = 'error' THEN 0 ELSE avg(value) END AS inference_ms_per_sample_mean
        FROM events GROUP BY user_id % 3, event_type)
"""


def metric_rows(spark, folder):
    e = table(spark, folder, "events")
    full = F.col("event_type") == "view"
    return e.groupBy((F.col("user_id") % 3).alias("u"), "event_type").agg(
        (F.avg("value") / 100).alias("accuracy"), (F.max("value") / 500).alias("f1_weighted"),
        F.min("value").alias("fpr_macro"), F.sum("value").alias("train_time_s"), F.avg("value").alias("lat")).select(
        F.concat(F.lit("m"), "u").alias("model"), F.when(full, "Full").otherwise(F.col("event_type")).alias("selection_method"),
        F.when(full, 40).otherwise(10).alias("n_features"), "accuracy", "f1_weighted", "fpr_macro", "train_time_s",
        F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("lat")).alias("inference_ms_per_sample_mean"))


@query("reduction_summary", f"""
WITH {METRICS_SQL}
SELECT r.model, r.selection_method, round((1 - r.n_features / 40e0) * 100, 6) AS feature_reduction_pct,
       round(r.accuracy - f.accuracy, 6) AS accuracy_change, round(r.f1_weighted - f.f1_weighted, 6) AS f1_weighted_change,
       round(r.fpr_macro - f.fpr_macro, 6) AS fpr_change,
       round(CASE WHEN r.train_time_s > 0 THEN f.train_time_s / r.train_time_s ELSE CAST('inf' AS DOUBLE) END, 6) AS train_time_speedup,
       CASE WHEN r.inference_ms_per_sample_mean > 0
            THEN round(f.inference_ms_per_sample_mean / r.inference_ms_per_sample_mean, 6)
            ELSE CAST('inf' AS DOUBLE) END AS inference_latency_speedup
FROM met r JOIN met f ON r.model = f.model AND f.selection_method = 'Full' WHERE r.selection_method <> 'Full'""")
def reduction_summary(spark, folder):
    return rounded(E.reduction_summary(metric_rows(spark, folder), 40))


@query("dataset_pivot", """
SELECT event_type AS method, round(avg(value) FILTER (WHERE user_id % 2 = 0), 6) AS even,
       round(avg(value) FILTER (WHERE user_id % 2 = 1), 6) AS odd FROM events GROUP BY 1""")
def dataset_pivot(spark, folder):
    e = table(spark, folder, "events").select(
        F.col("event_type").alias("method"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("dataset"), "value")
    return rounded(E.dataset_pivot(e, "method", "dataset", "value", ["even", "odd"]))


# --- selection --------------------------------------------------------------------------------------


def class_rows(spark, folder):
    """Scaled flows with three classes from the return flag."""
    f = flows(spark, folder)
    flag = F.substring("label", 1, 1)
    x = [(F.col(c) - lo) / F.lit(hi - lo) for c, (lo, hi) in SCALES.items()]
    return f.select("row_id", F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("y"), F.array(*x).alias("features"))


CELLS_SQL = f"""
{FLOW_SQL},
cells AS (
  SELECT CASE label[1] WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, i AS f,
         CASE i WHEN 0 THEN (quantity - 1) / 49e0 WHEN 1 THEN (price - 900) / 104100e0
                WHEN 2 THEN discount / CAST(0.1 AS DOUBLE) ELSE tax / CAST(0.08 AS DOUBLE) END AS v
  FROM flows, range(0, 4) t(i))
"""


@query("chi_squared", f"""
WITH {CELLS_SQL},
o AS (SELECT f, y, sum(greatest(v, 0)) AS o, count(*) AS n FROM cells GROUP BY 1, 2),
t AS (SELECT f, sum(o) AS t, sum(n) AS n FROM o GROUP BY 1)
SELECT f AS feature_idx, round(sum((o.o - t.t * o.n / t.n) * (o.o - t.t * o.n / t.n) / (t.t * o.n / t.n)), 4) AS score
FROM o JOIN t USING (f) GROUP BY 1""")
def chi_squared(spark, folder):
    return rounded(S.chi_squared(class_rows(spark, folder)).withColumn("feature_idx", big("feature_idx")), 4)


@query("spearman_with_class", f"""
WITH {CELLS_SQL},
r AS (SELECT f, rank() OVER (PARTITION BY f ORDER BY v) + (count(*) OVER (PARTITION BY f, v) - 1) / 2e0 AS rx,
             rank() OVER (PARTITION BY f ORDER BY y) + (count(*) OVER (PARTITION BY f, y) - 1) / 2e0 AS ry FROM cells)
SELECT f AS feature_idx, round(abs(corr(rx, ry)), 6) AS score FROM r GROUP BY 1""")
def spearman_with_class(spark, folder):
    return rounded(S.spearman_with_class(class_rows(spark, folder)).withColumn("feature_idx", big("feature_idx")))


@query("rank_correlations", f"""
WITH {FLOW_SQL},
r AS (SELECT rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2e0 AS a,
             rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2e0 AS b,
             rank() OVER (ORDER BY discount) + (count(*) OVER (PARTITION BY discount) - 1) / 2e0 AS c FROM flows)
SELECT round(corr(a, b), 6) AS quantity_price, round(corr(a, c), 6) AS quantity_discount FROM r""")
def rank_correlations(spark, folder):
    """Pairwise rank correlation of features from one table of ranks."""
    v = S.rank_vectors(class_rows(spark, folder))
    r = lambda i: F.get("ranks", F.lit(i))
    return rounded(v.agg(F.corr(r(0), r(1)).alias("quantity_price"), F.corr(r(0), r(2)).alias("quantity_discount")))


@query("information_gain", f"""
WITH {CELLS_SQL},
q AS (SELECT f, list_sort(list_distinct(quantile_cont(v, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]))) AS cuts FROM cells GROUP BY 1),
b AS (SELECT f, y, len(list_filter(cuts, lambda c: c < v)) AS bin FROM cells JOIN q USING (f)),
j AS (SELECT f, bin, y, count(*) AS n FROM b GROUP BY 1, 2, 3),
x AS (SELECT *, sum(n) OVER (PARTITION BY f) AS t, sum(n) OVER (PARTITION BY f, bin) AS nx,
             sum(n) OVER (PARTITION BY f, y) AS ny FROM j)
SELECT f AS feature_idx, round(greatest(sum(n / CAST(t AS DOUBLE) * ln(n * CAST(t AS DOUBLE) / (CAST(nx AS DOUBLE) * ny))), 0), 5) AS score
FROM x GROUP BY 1""")
def information_gain(spark, folder):
    return rounded(S.information_gain(class_rows(spark, folder)).withColumn("feature_idx", big("feature_idx")), 5)


@query("information_gain_neighbours")
def information_gain_neighbours(spark, folder):
    """The published nearest-neighbour estimator, over all rows."""
    return S.information_gain_neighbours(class_rows(spark, folder))


@query("statistical_selection")
def statistical_selection(spark, folder):
    """Chi-squared, PCA, rank correlation and information gain side by side."""
    return S.statistical_selection(class_rows(spark, folder), 4, 2)


@query("pca_loadings")
def pca_loadings(spark, folder):
    return S.pca_loadings(class_rows(spark, folder), 4)


def _train_test(rows):
    split = P.stratified_split(rows.select("row_id", "y", "features"), "y", val=0.0)
    return split.filter("split = 'train'"), split.filter("split = 'test'")


@query("iterative_pruning")
def iterative_pruning(spark, folder):
    """Pruning history on the embedding vectors, by the mean size of a forest's attributions on the training rows."""
    from flowaudit.operators import explainers as X, models as M
    from flowaudit.plans.inputs import vectors
    from flowaudit.plans.modelling import BACKGROUND

    train, val = _train_test(vectors(spark, folder))
    shap = X.tree_shap(train, M.export(M.random_forest(train)), X.background_matrix(X.background_rows(train, BACKGROUND)))
    importance = list(shap.agg(*[F.avg(F.abs(F.get("attrs", F.lit(i)))) for i in range(64)]).first())
    kept, history = S.iterative_pruning(train, val, importance, 3)
    return spark.createDataFrame([(h["n_features"], float(h["f1"]), float(h["f1_drop"]), len(kept)) for h in history],
                                 "n_features int, f1 double, f1_drop double, kept int")


@query("model_benchmark")
def model_benchmark(spark, folder):
    """Two model families on all and on selected features."""
    from flowaudit.operators import models as M
    from flowaudit.plans.inputs import vectors

    train, test = _train_test(vectors(spark, folder))
    fits = {"RF": lambda d: M.random_forest(d), "LR": lambda d: M.fit(M.LogisticRegression(), d)}
    b = S.benchmark(train, test, 3, {"Full": list(range(64)), "Chi-Squared": [0, 3, 5]}, fits)
    return b.withColumn("method_class", S.method_class(F.col("selection_method")))


