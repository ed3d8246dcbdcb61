"""Reference points, exact nearest rows, neighbourhoods and oversampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowaudit.operators import constraints as C, neighbors as N, prep as P, schemas as S

TRAIN = [(0, 6, 100, 500, 0), (1, 6, 110, 510, 0), (2, 17, 50, 200, 0), (3, 6, 999, 9999, 1), (4, 17, 800, 8000, 1),
         (5, 6, 200, 600, 0)]


def vectors(spark, rows):
    return spark.createDataFrame(
        [(r[0], [float(v) for v in r[1:4]], float(r[1]), int(r[4]) if len(r) > 4 else 0) for r in rows],
        "row_id bigint, features array<double>, protocol double, y int")


@pytest.fixture(scope="module")
def train(spark):
    return vectors(spark, TRAIN)


def point(spark, train, query, **kw):
    r = N.reference_points(vectors(spark, [(9, *query)]), train, **kw).first()
    return r["baseline"], r["fallback"]


def test_nearest_benign_row(spark, train):
    assert point(spark, train, (6, 115, 515)) == ([6.0, 110.0, 510.0], False)
    assert point(spark, train, (17, 800, 8000))[0][0] == 17.0
    assert point(spark, train, (6, 999, 9999), benign=1)[0][1] == 999.0
    assert point(spark, train, (1, 50, 100)) == ([17.0, 50.0, 200.0], True)


def test_median_of_three_is_repaired(spark, train):
    schema = S.FlowSchema("t", ("proto", "duration", "bytes"), protocol="proto", non_negative=("duration", "bytes"))
    assert point(spark, train, (6, 150, 550), k=3, schema=schema)[0][:2] == [6.0, 110.0]


def test_no_benign_row_is_an_error(spark, train):
    with pytest.raises(ValueError):
        N.reference_points(train, train, benign=7)


def test_nearest_rows_match_brute_force_on_a_hot_cluster(spark):
    """A third of the candidates are copies of one point; cells and query groups are split."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    x[::3] = x[0]
    c = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "candidate_id bigint, vector array<double>")
    q = c.withColumnRenamed("candidate_id", "query_id").withColumn("self", F.lit(True))
    got = N.nearest_rows(q, c, 4, pivots=8, chunk_rows=37).toPandas()
    assert len(got) == 2400
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :4]
    for i, g in got.groupby("query_id"):
        assert np.sort(g["distance"]) == pytest.approx(want[i])
        assert i not in set(g["candidate_id"])


SCHEMA = S.FlowSchema(
    "t", ("proto", "duration", "pkt_max", "pkt_mean", "pkt_min", "syn_flag"), protocol="proto",
    non_negative=("duration", "pkt_max", "pkt_mean", "pkt_min", "syn_flag"), tcp_only=("syn_flag",),
    discrete=("syn_flag",), ordered=(S.Ordered("pkt_max", "pkt_mean", "pkt_min"),))
COLUMNS = ", ".join(f"{c} double" for c in SCHEMA.features)
POOL = [(6.0, 100.0, 50.0, 30.0, 10.0, 1.0), (6.0, 110.0, 60.0, 40.0, 20.0, 2.0), (6.0, 120.0, 70.0, 50.0, 30.0, 3.0),
        (17.0, 80.0, 40.0, 20.0, 5.0, 0.0), (17.0, 90.0, 45.0, 25.0, 8.0, 0.0)]


def test_neighbourhood_draws_from_training_values(spark):
    rows = spark.createDataFrame([(1, *POOL[0])], "row_id bigint, " + COLUMNS)
    pools = N.value_pools(spark.createDataFrame(POOL, COLUMNS), SCHEMA)
    near = N.neighbourhood(rows, SCHEMA, 500, 20.0, pools)
    pdf = near.toPandas()
    assert len(pdf) == 500
    assert tuple(pdf[pdf["sample"] == 0].iloc[0][list(SCHEMA.features)]) == POOL[0]
    assert set(pdf["proto"]) == {6.0, 17.0}
    assert set(pdf[pdf["proto"] == 6.0]["syn_flag"]) == {1.0, 2.0, 3.0}
    assert set(pdf[pdf["proto"] == 17.0]["syn_flag"]) == {0.0}
    assert 0.5 < (pdf["proto"] == 6.0).mean() < 0.7
    share = pdf[pdf["proto"] == 6.0]["syn_flag"].value_counts(normalize=True)
    assert share.min() > 0.2
    assert C.violations(near, SCHEMA).filter("violations > 0").count() == 0


def test_discrete_stay_fixed_without_training_values(spark):
    rows = spark.createDataFrame([(1, *POOL[1])], "row_id bigint, " + COLUMNS)
    near = N.neighbourhood(rows, SCHEMA, 50, 5.0)
    assert {r["syn_flag"] for r in near.collect()} == {2.0}


def test_neighbourhood_is_partition_independent(spark):
    rows = spark.createDataFrame([(i, *POOL[i]) for i in range(5)], "row_id bigint, " + COLUMNS)
    pools = N.value_pools(spark.createDataFrame(POOL, COLUMNS), SCHEMA)
    runs = []
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        runs.append(sorted(map(tuple, N.neighbourhood(rows.repartition(parts), SCHEMA, 20, 3.0, pools).select(
            "row_id", "sample", *SCHEMA.features).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert runs[0] == runs[1]


def test_oversampling_fills_to_the_median_on_segments(spark):
    rng = np.random.default_rng(5)
    sizes = {0: 60, 1: 30, 2: 12, 3: 1, 4: 40}
    rows, n = [], 0
    for y, size in sizes.items():
        for _ in range(size):
            rows.append((n, y, [float(v) for v in rng.normal(size=3)]))
            n += 1
    df = spark.createDataFrame(rows, "row_id bigint, y int, features array<double>")
    out = P.oversample(df).toPandas()
    made = out[out["synthetic"]].groupby("y").size().to_dict()
    assert made == {2: 18}  # median count is 30; one-row class 3 is left alone
    real = np.array([r[2] for r in rows if r[1] == 2])
    for x in out[out["synthetic"]]["features"]:
        gaps = []
        for a in real:
            for b in real:
                seg = b - a
                t = 0 if not seg.any() else np.clip((x - a) @ seg / (seg @ seg), 0, 1)
                gaps.append(np.abs(a + t * seg - x).max())
        assert min(gaps) < 1e-9


@pytest.mark.parametrize("rows", [400, 4000])
def test_nearest_rows_visit_few_cells(spark, monkeypatch, rows):
    """Clustered rows of 24 features with keys and the row itself left out: exact, and the cells a query visits don't grow with the rows."""
    rng = np.random.default_rng(11)
    centres = rng.normal(scale=20.0, size=(40, 24))
    x = centres[rng.integers(40, size=rows)] + rng.normal(size=(rows, 24))
    key = rng.integers(2, size=rows)
    df = spark.createDataFrame([(k, v.tolist(), int(p)) for k, (v, p) in enumerate(zip(x, key))], "id long, vector array<double>, p int")
    visits, plain = {}, N.stored

    def counted(table, name):
        out = plain(table, name)
        visits[name] = out.count()
        return out

    monkeypatch.setattr(N, "stored", counted)
    q = df.where("id < 100").select(F.col("id").alias("query_id"), "vector", "p", F.lit(1).alias("self"))
    got = N.nearest_rows(q, df.select(F.col("id").alias("candidate_id"), "vector", "p"), 3, ["p"]).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.place, r.candidate_id))
        assert np.array_equal(r.vector, x[r.candidate_id])
    for i in range(100):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        d[key != key[i]] = np.inf
        want = sorted(range(rows), key=lambda j: (d[j], j))[:3]
        assert [c for _, c in sorted(found[i])] == want
    assert visits["nearest-visits"] / 100 < 6


def test_nearest_rows_with_too_few_candidates(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 5.0])], "query_id long, vector array<double>")
    c = spark.createDataFrame([(7, [1.0, 0.0]), (8, [4.0, 5.0])], "candidate_id long, vector array<double>")
    got = sorted(tuple(r)[:3] for r in N.nearest_rows(q, c, 5).select("query_id", "candidate_id", "place").collect())
    assert got == [(1, 7, 1), (1, 8, 2), (2, 7, 2), (2, 8, 1)]
    assert N.nearest_rows(q, c.limit(0), 5).count() == 0


@pytest.mark.parametrize("least", [4, 1024])
def test_draws_follow_exact_frequencies(spark, monkeypatch, least):
    """Draws at evenly spaced points give every value as often as it occurs among the rows of its protocol."""
    monkeypatch.setattr(N, "LEAST_SLICES", least)
    values = {6.0: {1.0: 60, 2.0: 25, 3.0: 10, 7.0: 5}, 17.0: {0.0: 1, 9.0: 199}, 1.0: {5.0: 1}}
    counts = spark.createDataFrame([(p, v, n) for p, of in values.items() for v, n in of.items()], "_proto double, value double, _n long")
    pool = N._pool(counts)
    assert pool.slices == max(least, 4) and pool.table.groupBy("_proto", "_slice").count().where("count > 1").count() == 0
    points = [(p, (i + 0.5) / 2000, -1.0) for p in (*values, 99.0) for i in range(2000)]
    df = spark.createDataFrame(points, "p double, u double, x double")
    got = {(r.p, r.x): r["count"] for r in N._draw(df, pool, "x", F.col("p"), F.col("u"), F.lit(True)).groupBy("p", "x").count().collect()}
    want = {(p, v): n * 2000 // sum(of.values()) for p, of in values.items() for v, n in of.items()}
    assert got == want | {(99.0, -1.0): 2000}


def test_visits_are_kept_once_a_query(spark, monkeypatch):
    import numpy as np

    kept = {}
    monkeypatch.setattr(N, "stored", lambda df, name, keep=N.stored: kept.setdefault(name, keep(df, name)))
    v = np.random.default_rng(3).normal(size=(120, 6))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id bigint, vector array<double>")
    got = N.nearest_rows(rows.withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "candidate_id"), 2, pivots=16).collect()
    far = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    assert np.allclose(sorted(r["distance"] for r in got), np.sort(np.sort(far, axis=1)[:, :2].ravel()))
    assert kept["nearest-visits"].count() <= 120  # one row each, not one for each of its cells
