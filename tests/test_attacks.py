"""Attacks on whole vectors against brute force."""

import numpy as np
import pytest

from relaudit.operators import attacks
from relaudit.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def brute(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    ids, label, x = np.array([r.vec_id for r in rows]), np.array([r.label for r in rows]), np.array([r.embedding for r in rows], float)
    ref = x[(label >= 4) & (label < 8)]
    z = (x - ref.mean(0)) / ref.std(0)
    own = (ref - ref.mean(0)) / ref.std(0)
    z = z @ np.linalg.svd(own, full_matrices=False)[2][: min(10, len(ref) - 1)].T
    return ids[label < 8], z[label < 8], z[label >= 8], z[(label >= 4) & (label < 8)]


def kernel(q, rows):
    n, d = rows.shape
    cov = np.atleast_2d(np.cov(rows.T)) * n ** (-2 / (d + 4))
    e = -0.5 * np.einsum("abi,ij,abj->ab", q[:, None] - rows, np.linalg.inv(cov), q[:, None] - rows)
    top = e.max(1)
    return top + np.log(np.exp(e - top[:, None]).mean(1)) - 0.5 * np.linalg.slogdet(2 * np.pi * cov)[1]


def test_nearest_record_of_whole_vectors(spark, brute):
    ids, q, syn, _ = brute
    want = -np.sqrt(((q[:, None] - syn) ** 2).sum(2)).min(1)
    got = {r.query_id: r.score for r in registry.QUERIES["atk2_nearest_record_whole"](spark, SF).collect()}
    assert set(got) == set(ids.tolist()) and np.allclose([got[i] for i in ids], want, atol=1e-6)


def test_density_ratio_has_the_full_covariance(spark, brute):
    ids, q, syn, ref = brute
    got = {r.query_id: r.score for r in registry.QUERIES["atk4_density_ratio_whole"](spark, SF).collect()}
    assert np.allclose([got[i] for i in ids], kernel(q, syn) - kernel(q, ref), atol=1e-3)


def test_missing_components_take_the_median(spark):
    x = np.random.default_rng(2).standard_normal((40, 3))
    rows = [(i, [None if (i, j) in ((3, 0), (4, 0)) else float("nan") if (i, j) == (5, 1) else float(x[i, j]) for j in range(3)]) for i in range(40)]
    df = spark.createDataFrame([*rows, (40, None)], "i int, v array<double>")
    got = np.array([r.v for r in attacks.fit_representation(df, "v", 3)(df, "v").orderBy("i").collect()])
    full = np.array([[np.nan if a is None else a for a in v] for _, v in rows])
    full = np.where(np.isnan(full), np.nanmedian(full, axis=0), full)
    z = (full - full.mean(0)) / full.std(0)
    gap = lambda a: np.sqrt(((a[:, None] - a) ** 2).sum(2))
    assert got.shape == (40, 3) and np.allclose(gap(got), gap(z))


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(1).standard_normal((8, d)) * 10
    return centres[rng.integers(0, 8, n)] + 0.3 * rng.standard_normal((n, d))


def test_nearest_records_skip_far_cells_and_lose_nothing(spark, monkeypatch):
    q, s = clustered(300, 6, 2), clustered(400, 6, 3)
    q[:3] = 50.0  # far from every cell
    asks = spark.createDataFrame([*[(i, [float(x) for x in v]) for i, v in enumerate(q)], (900, None)], "query_id long, v array<double>")
    rows = spark.createDataFrame([*[(i, [float(x) for x in v]) for i, v in enumerate(s)], (900, None)], "syn_id long, s array<double>")
    want = -np.sqrt(((q[:, None] - s) ** 2).sum(2)).min(1)
    met, meet = [], attacks._meet

    def counted(asks, data, parts, block):
        sizes = {r.cell: r["count"] for r in data.groupBy("cell").count().collect()}
        met.append(sum(r["count"] * sizes[r.cell] for r in asks.groupBy("cell").count().collect()))
        return meet(asks, data, parts, block)

    monkeypatch.setattr(attacks, "_meet", counted)
    for cell, block in ((25, 4_096), (25, 10), (1_000, 64)):
        got = {r.query_id: r.score for r in attacks.nearest_record_scores(asks, rows, cell, block).collect()}
        assert set(got) == set(range(300)) and np.allclose([got[i] for i in range(300)], want, atol=1e-9)
    assert sum(met[:2]) < 0.5 * 300 * 400
    assert attacks.nearest_record_scores(asks, rows.limit(0)).count() == 0


def test_log_density_in_blocks_of_both(spark):
    q, s = clustered(90, 5, 4), clustered(130, 5, 5)
    asks = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id long, v array<double>")
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(s)], "syn_id long, s array<double>")
    e = -((q[:, None] - s) ** 2).sum(2) / (2 * 0.7**2)
    want = e.max(1) + np.log(np.exp(e - e.max(1)[:, None]).mean(1)) - 5 * np.log(0.7) - 2.5 * np.log(2 * np.pi)
    for block in (4_096, 17):
        got = {r.query_id: r.x for r in attacks.log_density(asks, rows, 5, 0.7, "x", block).collect()}
        assert np.allclose([got[i] for i in range(90)], want, atol=1e-8)


def test_pairs_in_blocks_of_both_with_copies(spark):
    q, s = clustered(70, 5, 6), clustered(120, 5, 7)
    s[40:80], q[0] = s[3], s[3]  # copies, whose order is that of their ids
    asks = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id long, v array<double>")
    rows = spark.createDataFrame([(500 - i, [float(x) for x in v]) for i, v in enumerate(s)], "syn_id long, s array<double>")
    d = np.sqrt(((q[:, None] - s) ** 2).sum(2))
    near = [sorted(zip(r, range(500, 380, -1), strict=True))[:7] for r in d]
    e = -d * d / (2 * 0.7**2)
    density = e.max(1) + np.log(np.exp(e - e.max(1)[:, None]).mean(1))
    for block in (4_096, 19):
        got = attacks.nearest_rows(asks, rows, 7, block)
        told = {}
        for r in got.collect():
            told.setdefault(r.query_id, []).append((r.d, r.syn_id))
        assert {i: [k for _, k in sorted(v)] for i, v in told.items()} == {i: [k for _, k in n] for i, n in enumerate(near)}
        out = {r.query_id: (r.pairs, r.nearest, r.distance, r.density) for r in attacks.pair_summary(asks, rows, 0.7, block).collect()}
        assert all(out[i] == pytest.approx((120, d[i].min(), d[i].mean(), density[i])) for i in range(70)) and out[0][1] == 0.0


def test_a_task_hands_on_few_rows_at_a_time():
    import pandas as pd

    assert [len(f) for f in attacks._slices([pd.DataFrame({"x": range(1_200)})])] == [512, 512, 176]
