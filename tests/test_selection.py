"""Feature scores against their definitions."""

import numpy as np
import pytest

from flowaudit.operators import selection as S


def brute_force(x, y, neighbours):
    """Every row against every other row."""
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    usable = [i for i in range(len(y)) if y.count(y[i]) > 1]
    k_of, n_of, m_of = [], [], []
    for i in usable:
        gaps = sorted(abs(x[j] - x[i]) for j in usable if j != i and y[j] == y[i])
        k = min(neighbours, len(gaps))
        radius = gaps[k - 1]
        k_of.append(k)
        n_of.append(len(gaps) + 1)
        m_of.append(sum(abs(x[j] - x[i]) < radius or x[j] == x[i] for j in usable))
    mean = lambda of: sum(map(psi, of)) / len(of)
    return max(0.0, psi(len(usable)) + mean(k_of) - mean(n_of) - mean(m_of))


@pytest.mark.parametrize("chunk_rows", [2_000_000, 40])
def test_information_gain_neighbours_uses_all_rows(spark, chunk_rows):
    rng = np.random.default_rng(5)
    y = [int(v) for v in rng.integers(0, 3, 150)] + [7]  # class 7 has one row
    columns = [
        [float(v) for v in np.array(y) * 4 + rng.integers(0, 6, 151)],  # whole numbers with ties
        [float(v) for v in rng.integers(0, 1024, 151) / 1024],  # exact in binary
        [0.0 if i % 3 else float(i) for i in range(151)],  # one value holds most rows
    ]
    rows = [(i, y[i], [c[i] for c in columns]) for i in range(151)] + [(200, None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "row_id int, y int, features array<double>")
    got = {r["feature_idx"]: r["score"] for r in S.information_gain_neighbours(df, 3, chunk_rows=chunk_rows).collect()}
    for f, x in enumerate(columns):
        assert got[f] == pytest.approx(brute_force(x, y, 3), abs=1e-4)


def test_information_gain_neighbours_sorts_distinct_values_once(spark, monkeypatch):
    """One sorted table of (feature, class, value, rows) is all that is kept; a rare class whose radii span many ranges is counted rightly."""
    kept, checkpointed = [], S.checkpointed

    def watched(df):
        out = checkpointed(df)
        kept.append((sorted(out.columns), out.count()))
        return out

    monkeypatch.setattr(S, "checkpointed", watched)
    x = [float(v) for v in np.random.default_rng(2).integers(0, 4096, 200) / 512]
    y = [1 if i % 40 == 0 else 0 for i in range(200)]  # five rows of class 1
    df = spark.createDataFrame([(i, y[i], [x[i]]) for i in range(200)], "row_id int, y int, features array<double>")
    got = S.information_gain_neighbours(df, 3, chunk_rows=20).collect()
    assert kept == [(["feature_idx", "n", "value", "y"], len({(a, b) for a, b in zip(x, y)}))]
    assert got[0]["score"] == pytest.approx(brute_force(x, y, 3), abs=1e-4)
