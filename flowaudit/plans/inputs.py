"""The benchmark tables seen as flows, packets and attributions (Spark side and SQL side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowaudit.functions import arrays as A
from flowaudit.operators.models import LinearScorer
from flowaudit.plans.registry import spread, table

# --- attributions: three explainers over the embedding vectors ---------------------------



def _variants(a: Column) -> dict[str, Column]:
    return {
        "RF_SHAP": a,
        "RF_PA-SHAP": F.transform(a, lambda v, i: v * (1 + (((i + 1) % 7) - 3) / 10)),
        "DNN_IG": F.transform(F.reverse(a), lambda v, i: v * (1 + ((i + 1) % 3) / 5)),
    }


def explanations(spark: SparkSession, folder: str) -> DataFrame:
    """``(explainer_key, row_id, label, attrs)``; one scan, copies made inside the row."""
    e = spread(table(spark, folder, "embeddings"), "vec_id").select(
        F.col("vec_id").alias("row_id"), F.col("label"), A.as_doubles(F.col("embedding")).alias("_a"))
    parts = F.array(*[F.struct(F.lit(k).alias("explainer_key"), v.alias("attrs"))
                      for k, v in _variants(F.col("_a")).items()])
    return e.withColumn("_x", F.explode(parts)).select("_x.explainer_key", "row_id", "label", "_x.attrs")


# long form: (k, row_id, label, f, v); f counts from 0
EXPL_SQL = """
cells AS (
  SELECT vec_id AS row_id, label, i, CAST(embedding[i] AS DOUBLE) AS e,
         CAST(embedding[65 - i] AS DOUBLE) AS r
  FROM embeddings, range(1, 65) t(i)),
expl AS (
  SELECT 'RF_SHAP' AS k, row_id, label, i - 1 AS f, e AS v FROM cells
  UNION ALL SELECT 'RF_PA-SHAP', row_id, label, i - 1, e * (1 + ((i % 7) - 3) / CAST(10 AS DOUBLE)) FROM cells
  UNION ALL SELECT 'DNN_IG', row_id, label, i - 1, r * (1 + (i % 3) / CAST(5 AS DOUBLE)) FROM cells)
"""

# --- vectors with a class, for models ---------------------------------------------------


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``(row_id, features, label, y, protocol)`` from the embeddings."""
    return spread(table(spark, folder, "embeddings"), "vec_id").select(
        F.col("vec_id").alias("row_id"), A.as_doubles(F.col("embedding")).alias("features"),
        "label", (F.col("label") % 3).alias("y"), (F.col("label") % 2).cast("double").alias("protocol"))


def softmax_scorer(width: int = 64, classes: int = 3) -> LinearScorer:
    """Fixed weights w[i][c] = ((3 i + 5 c) mod 7 - 3) / 2 and zero bias."""
    return LinearScorer(
        tuple(tuple(((3 * i + 5 * c) % 7 - 3) / 2.0 for c in range(classes)) for i in range(width)),
        (0.0,) * classes)


WEIGHT_SQL = "(((3 * {f} + 5 * {c}) % 7 - 3) / CAST(2 AS DOUBLE))"

# --- flow rows from lineitem ---------------------------------------------------------------

PROTO_SQL = "CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 6 ELSE 17 END"


def protocol(c: str = "l_linenumber") -> Column:
    m = F.col(c) % 3
    return F.when(m == 0, 1).when(m == 1, 6).otherwise(17)


FLOW_FEATURES = ("quantity", "price", "discount", "tax")


def flows(spark: SparkSession, folder: str) -> DataFrame:
    """``(row_id, proto, label, quantity, price, discount, tax)``."""
    li = spread(table(spark, folder, "lineitem"), "l_extendedprice")
    key = F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                     "l_discount", "l_tax", "l_shipdate")
    return li.select(
        key.alias("row_id"), protocol().cast("double").alias("proto"),
        F.concat("l_returnflag", "l_linestatus").alias("label"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"), (F.col("l_discount") + 0.0).alias("discount"),
        (F.col("l_tax") + 0.0).alias("tax"))


FLOW_SQL = f"""
flows AS (
  SELECT CAST({PROTO_SQL} AS DOUBLE) AS proto, l_returnflag || l_linestatus AS label, l_quantity AS quantity,
         l_extendedprice AS price, l_discount + 0.0 AS discount, l_tax + 0.0 AS tax
  FROM lineitem)
"""

# fixed ranges that scale the four features to [0, 1]
SCALES = {"quantity": (1.0, 50.0), "price": (900.0, 105000.0), "discount": (0.0, 0.1), "tax": (0.0, 0.08)}
FLOW_WEIGHTS = (1.5, -2.0, 0.75, -0.5)
FLOW_BIAS = 0.25


def flow_scorer() -> LinearScorer:
    return LinearScorer(tuple((w,) for w in FLOW_WEIGHTS), (FLOW_BIAS,), "sigmoid")


def scaled_flows(spark: SparkSession, folder: str) -> DataFrame:
    """``(row_id, y, features)`` with the four features in [0, 1]; y = returned or not."""
    f = flows(spark, folder)
    x = [(F.col(c) - lo) / F.lit(hi - lo) for c, (lo, hi) in SCALES.items()]
    return f.select("row_id", F.col("label").startswith("R").cast("int").alias("y"), F.array(*x).alias("features"))


SCALED_SQL = f"""
{FLOW_SQL},
scaled AS (
  SELECT CASE WHEN label LIKE 'R%' THEN 1 ELSE 0 END AS y,
         (quantity - 1.0) / 49.0 AS x0, (price - 900.0) / 104100.0 AS x1,
         discount / CAST(0.1 AS DOUBLE) AS x2, tax / CAST(0.08 AS DOUBLE) AS x3
  FROM flows)
"""

# --- packets from events ------------------------------------------------------------------


def packets(spark: SparkSession, folder: str) -> DataFrame:
    """Packet rows with out-of-range and contradictory headers; one flow per user."""
    e = table(spark, folder, "events")
    i = F.col("event_id")
    kind = F.col("user_id") % 3
    proto = F.when(kind == 0, "tcp").when(kind == 1, "udp").otherwise("icmp")
    tcp = lambda c: F.when(proto == "tcp", c.cast("bigint"))
    return e.select(
        F.col("user_id").alias("flow"), i.alias("pkt_no"), proto.alias("protocol"), proto.alias("flow_protocol"),
        (i * 7 % 400 - 50).alias("ip_ttl"), (i * 11 % 300 - 20).alias("ip_tos"), (i % 5000).alias("ip_total_length"),
        (i % 8).alias("ip_flags"), (i * 13 % 90000 - 1000).alias("tcp_window_size"), tcp(i * 5 % 64).alias("tcp_flags"),
        tcp(i * 100003 - 5000000).alias("tcp_seq"), tcp(i * 90001).alias("tcp_ack"),
        tcp(i % 3 * 40000 - 10).alias("tcp_urgent_ptr"), F.when(i % 4 > 0, i % 900).alias("udp_length"),
        F.when(proto == "icmp", i % 300).alias("icmp_type"), F.when(proto == "icmp", i % 20).alias("icmp_code"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("ts"), F.floor("value").cast("bigint").alias("payload_size"))


PACKET_SQL = """
raw AS (
  SELECT user_id AS flow, event_id AS i, ts, value,
         CASE user_id % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' ELSE 'icmp' END AS protocol
  FROM events),
pk AS (
  SELECT flow, i AS pkt_no, protocol, i * 7 % 400 - 50 AS ip_ttl, i * 11 % 300 - 20 AS ip_tos,
         i % 5000 AS ip_total_length, i % 8 AS ip_flags, i * 13 % 90000 - 1000 AS tcp_window_size,
         CASE WHEN protocol = 'tcp' THEN i * 5 % 64 END AS tcp_flags,
         CASE WHEN protocol = 'tcp' THEN i * 100003 - 5000000 END AS tcp_seq,
         CASE WHEN protocol = 'tcp' THEN i * 90001 END AS tcp_ack,
         CASE WHEN protocol = 'tcp' THEN i % 3 * 40000 - 10 END AS tcp_urgent_ptr,
         CASE WHEN i % 4 > 0 THEN i % 900 END AS udp_length,
         CASE WHEN protocol = 'icmp' THEN i % 300 END AS icmp_type,
         CASE WHEN protocol = 'icmp' THEN i % 20 END AS icmp_code,
         epoch_us(ts) AS ts, CAST(floor(value) AS BIGINT) AS payload_size
  FROM raw)
"""

# --- part rows for neighbourhood explainers --------------------------------------------------

PART_FEATURES = ("proto", "size", "price", "grade")


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """``(row_id, proto, size, price, grade, kind, y)`` from part."""
    k = F.col("p_partkey")
    m = k % 3
    return table(spark, folder, "part").select(
        k.alias("row_id"), F.when(m == 0, 1.0).when(m == 1, 6.0).otherwise(17.0).alias("proto"),
        F.col("p_size").cast("double").alias("size"), (F.col("p_retailprice") / 100.0).alias("price"),
        (k % 5).cast("double").alias("grade"), F.col("p_type").alias("kind"), (k % 2).cast("int").alias("y"))


PART_SQL = """
parts AS (
  SELECT p_partkey AS row_id, CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 6.0 ELSE 17.0 END AS proto,
         CAST(p_size AS DOUBLE) AS size, p_retailprice / CAST(100 AS DOUBLE) AS price,
         CAST(p_partkey % 5 AS DOUBLE) AS grade, p_type AS kind, p_partkey % 2 AS y
  FROM part)
"""
