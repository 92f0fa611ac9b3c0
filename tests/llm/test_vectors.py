"""Embedding near-dedup and nearest neighbours against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from relaudit.llm import ann, components, neardup

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed=1, groups=12, copies=12, d=16):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        base = rng.standard_normal(d)
        for k in range(copies):
            v = base if k < 3 else base + rng.standard_normal(d) * 0.12 * rng.integers(0, 3)
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], k % 3))
    n = len(rows)
    odd = [None, [0.0] * d, [float("nan")] * d, [float("inf")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [1.0, 2.0]]
    return rows + [(n + i, v, 0) for i, v in enumerate(odd)]


def brute_links(rows, cosine):
    good = {i: np.array(v, float) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {i: [] for i, _, _ in rows}
    for i, a in good.items():
        for j, b in good.items():
            if i < j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                links[i].append(j)
                links[j].append(i)
    comp = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i, js in links.items():
            low = min([comp[i], *(comp[j] for j in js)])
            for k in [i, *js]:
                if comp[k] > low:
                    comp[k], changed = low, True
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


def check(spark, **options):
    rows = vectors()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), **options).collect()}
    assert got == brute_links(rows, 0.9)


def test_near_duplicates_equal_brute_force(spark):
    check(spark)


def test_large_buckets_are_compared_in_parts(spark):
    check(spark, block=5)


def test_repeated_and_null_ids(spark):
    v = [1.0, 0.0, 0.1]
    rows = [(1, v, 0), (1, [-1.0, 0.0, 0.0], 0), (2, [1.0, 0.0, 0.0], 0), (None, v, 0), (None, None, 0), (3, v, 0), (4, [1.0, 0.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 5 and {k: got[k] for k in (1, 2, 3, 4)} == brute_without_null_ids(rows)


def brute_without_null_ids(rows):
    """A repeated id counts with its greatest vector; a null id is left out of what is compared here."""
    best = {}
    for i, v, _ in rows:
        if i is not None:
            best[i] = max(best.get(i, v), v)
    return {i: x[:2] for i, x in brute_links([(i, v, 0) for i, v in best.items()], 0.9).items()}


def test_no_vectors(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(200 + i, 201 + i) for i in range(25)] + [(5, 5), (None, 3)]
    comp = {}

    def root(x):
        while comp.setdefault(x, x) != x:
            x = comp[x]
        return x

    for a, b in edges[:-1]:
        x, y = root(a), root(b)
        comp[max(x, y)] = min(x, y)
    for part in (500_000, 20):
        got = {r.id: r.component_id for r in components.connected_components(spark.createDataFrame(edges, "u long, v long"), part).collect()}
        assert got == {x: root(x) for x in list(comp)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    rows = [(i, [float(a) for a in v], 0) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (3, [float(a) for a in x[3]], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), k=20, data_block=300, query_block=20).collect()
    full = x.astype(float) @ x.astype(float).T
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, 900, 20))
    hits = 0
    for q, near in found.items():
        near.sort()
        assert [n[0] for n in near] == list(range(1, 21)) and q not in [n[1] for n in near]
        assert all(abs(s - full[q, v]) < 1e-9 for _, v, s in near)
        order = sorted((v for v in range(900) if v != q), key=lambda v: (-full[q, v], v))[:20]
        hits += len(set(order) & {n[1] for n in near})
    assert hits >= 0.9 * 20 * len(found)
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id < 5")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 4


def skewed(n, d, longest, seed=11):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x * np.array([*longest, *np.exp(0.02 * rng.standard_normal(n - len(longest)))])[:, None]


def recall_in_a_block(x, asks, k=20):
    i, near, score, _ = ann.search_block(x[asks], asks, x, np.arange(len(x)), k)
    full = x[asks] @ x.T
    hits = 0
    for at, q in enumerate(asks):
        got = near[i == at]
        assert len(set(got)) == k and q not in got
        assert np.allclose(score[i == at], full[at, got])
        order = [v for v in np.lexsort((np.arange(len(x)), -full[at])) if v != q][:k]
        hits += len(set(order) & set(got))
    return hits / k / len(asks)


def test_recall_and_work_in_a_production_block():
    x = skewed(ann.DATA_BLOCK, 64, [])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asks = np.arange(0, ann.DATA_BLOCK, 400)
    assert recall_in_a_block(x, asks) >= 0.95
    counted = ann.search_block(x[asks], asks, x, np.arange(len(x)), 20)[3]
    assert counted < 0.6 * 64 * len(x) * len(asks)  # an exact scan reads 64 components of each
    close = np.repeat(x[: ann.DATA_BLOCK // 32], 32, axis=0) + 0.03 * x
    counted = ann.search_block(close[asks], asks, close, np.arange(len(x)), 20)[3]
    assert counted < 0.2 * 64 * len(x) * len(asks)  # near neighbours lie in narrow windows


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0, 0.0] if i % 3 else [0.0, 1.0, 0.0], 0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("x"), "v": F.lit(1), "ask": F.lit(2)})
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, df.where("vec_id in (1, 3)"), k=5).collect())
    assert got == [(1, 1, 2), (1, 2, 4), (1, 3, 5), (1, 4, 7), (1, 5, 8), (3, 1, 0), (3, 2, 6), (3, 3, 9), (3, 4, 12), (3, 5, 15)]


def test_few_long_vectors_lose_no_neighbours():
    asks = np.arange(0, 3000, 40)  # the long ones ask as well
    even = recall_in_a_block(skewed(3000, 64, []), asks)
    for longest in ([100.0], [1000.0], [1000.0, 1e-3, 30.0]):
        assert recall_in_a_block(skewed(3000, 64, longest), asks) >= max(even - 0.02, 0.9)


def test_spread_norms_and_queries_far_from_all_vectors():
    rng = np.random.default_rng(12)
    x = skewed(3000, 64, [])
    asks = np.arange(0, 3000, 40)
    assert recall_in_a_block(x * np.exp(2 * rng.standard_normal(3000))[:, None], asks) >= 0.9
    near_one = 0.01 * x + np.eye(64)[0]
    i, _, _, _ = ann.search_block(-50 * near_one[asks], -asks - 1, near_one, np.arange(3000), 20)
    assert (np.bincount(i, minlength=len(asks)) == 20).all()


def test_nearest_returns_twenty_beside_a_long_vector(spark):
    x = skewed(2000, 16, [1000.0])
    df = spark.createDataFrame([(i, [float(a) for a in v], 0) for i, v in enumerate(x)], SCHEMA)
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), data_block=1000).groupBy("query_id").count().collect()
    assert len(got) == 40 and all(r["count"] == 20 for r in got)
