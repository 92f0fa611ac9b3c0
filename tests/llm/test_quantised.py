"""Hard negatives and vector codes over whole-number components, against brute force."""

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from relaudit.llm import codes, hardneg
from relaudit.llm.quantised import products

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(seed=2, n=240, d=12, spread=0.25):
    """Clusters of unlike length, ties, copies, and vectors that take no part."""
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((6, d))
    x = (centers[rng.integers(0, 6, n)] + spread * rng.standard_normal((n, d))) * np.exp(rng.standard_normal(n) * 0.5)[:, None]
    x[50:60] = x[40:50]
    x[61] = 0
    rows = [(i, [float(a) for a in v.astype(np.float32)], int(rng.integers(0, 3))) for i, v in enumerate(x)]
    inf = float("inf")
    return rows + [(n, None, 1), (n + 1, [math.nan] * d, 1), (n + 2, [inf] + [0.0] * (d - 1), 1), (n + 3, [None] + [0.0] * (d - 1), 0), (n + 4, rows[0][1], None), (n + 10, [1.0, 2.0], 0), (n + 11, [], 0), (n + 12, [], 0)]


def whole(v):
    return v is not None and all(a is not None and math.isfinite(a) for a in v)


def brute_negatives(rows, anchor):
    good = [(i, [math.floor(256 * a) for a in v], k) for i, v, k in rows if whole(v) and k is not None]
    out = set()
    for a, q, own in good:
        if not anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(q, v, strict=True)) for i, v, _ in good if i != a and len(v) == len(q)}
        kind = {i: k for i, _, k in good}
        for p in sorted((i for i in score if kind[i] == own), key=lambda i: (-score[i], i))[:5]:
            fit = [i for i in score if kind[i] != own and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            for r, i in enumerate(sorted(fit, key=lambda i: (-score[i], i))[:3], 1):
                out.add((a, p, r, i, score[p], score[i]))
    return out


def test_hard_negatives_equal_brute_force(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS d", "'x' AS g", "2 AS score", "3 AS `a.b`").repartition(3)
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 100
    for options in ({}, {"block": 30, "chunk": 7, "seeds": 20}, {"seeds": 1}):
        got = {tuple(r) for r in hardneg.mine(df, F.col("vec_id") % 10 == 0, **options).collect()}
        assert got == want


def test_repeated_and_null_ids_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.6, 0.0], 2), (2, [0.7, 0.0], 2), (None, [0.8, 0.0], 2), (3, [-1.0, 0.0], 1)]
    got = [tuple(r) for r in hardneg.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()]
    assert got == [(0, 1, 1, 2, 256 * 230, 256 * 179)]
    assert hardneg.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0
    assert hardneg.mine(spark.createDataFrame(rows[:1], SCHEMA), F.col("vec_id") == 0).count() == 0


def test_coordinates_prune_and_lose_nothing():
    rng = np.random.default_rng(8)
    centers = rng.standard_normal((40, 32))
    x = np.repeat(centers, 50, axis=0) + 0.05 * rng.standard_normal((2000, 32))
    g = np.floor(4096 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int32)
    f = pd.DataFrame({"vec_id": np.arange(2000), "label": np.arange(2000) % 3, "g": list(g)})
    bucket = hardneg.Bucket(next(hardneg._bucket((32, 0, 0), f).itertuples()))
    q = g[::97]
    scores = products(q, g)
    least = np.sort(scores, axis=1)[:, -30].astype(float)
    some = 0
    for places, s, low in zip(bucket.candidates(q, least), scores, least, strict=True):
        need = set(np.flatnonzero(s >= low).tolist())
        assert places is None or need <= set(places.tolist())
        some += len(g) if places is None else len(places)
    assert some < 0.5 * len(g) * len(q)
    assert all(c is None for c in bucket.candidates(q, -least))  # a least score below 0 rules nothing out


def test_gnat_equals_all_distances_and_skips_some():
    rng = np.random.default_rng(9)
    for n, d in ((1, 3), (5, 1), (64, 4), (64, 1), (200, 2)):
        entries = rng.integers(-40, 40, (n, d))
        entries[n // 2 :] = entries[: n - n // 2]  # ties between copies, and between entries as far on either side
        queries = np.vstack([rng.integers(-60, 60, (300, d)), entries])
        tree = codes.Gnat(entries)
        at, near = tree.nearest(queries)
        far = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (near == far.min(axis=1)).all() and (at == far.argmin(axis=1)).all()
    spread = codes.Gnat(rng.integers(-10_000, 10_000, (64, 2)))
    spread.nearest(rng.integers(-10_000, 10_000, (2000, 2)))
    assert spread.compared < 0.7 * 64 * 2000
    same = codes.Gnat(np.zeros((30, 4), dtype=np.int64))
    assert same.nearest(np.ones((2, 4), dtype=np.int64))[0].tolist() == [0, 0]


def brute_codes(rows, parts, entries, rounds):
    good = [(i, [math.floor(256 * a) for a in v], k) for i, v, k in rows if whole(v)]
    size = len(min((r for r in good if r[1]), key=lambda r: (r[0], r[1]))[1])
    width = -(-size // parts)
    cut = [(i, [tuple((v + [0] * (width * parts - size))[p * width : (p + 1) * width]) for p in range(parts)] if len(v) == size else None, k) for i, v, k in good]
    fit = sorted((c for c in cut if c[1]), key=lambda c: (c[0], c[1]))
    books = [[c[1][p] for c in fit[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, x: min(range(len(books[p])), key=lambda e: (gap(x, books[p][e]), e))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            held = {}
            for _, x, _ in fit:
                held.setdefault(nearest(p, x[p]), []).append(x[p])
            for e, xs in held.items():
                new[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
        books = new
    out, by_label = [], {}
    for i, x, k in cut:
        if x:
            at = [nearest(p, x[p]) for p in range(parts)]
            error = sum(gap(x[p], books[p][e]) for p, e in enumerate(at))
            by_label[k] = by_label.get(k, 0) + error
            out.append((i, "".join(f"{e:02x}" for e in at), error, k))
        else:
            out.append((i, None, None, k))
    told = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted([(i, c, e, by_label.get(k), told) for i, c, e, k in out], key=str)


def test_codes_equal_brute_force(spark):
    rows = rows_of(n=90) + [(7, rows_of(n=90)[7][1], 2), (500, rows_of(n=90)[3][1], None), (501, rows_of(n=90)[4][1], None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS code", "1 AS error", "2 AS g", "3 AS `a.b`").repartition(3)
    for parts, entries in ((4, 16), (5, 300)):  # 12 components in 5 parts are filled up; more entries than vectors
        got = sorted([tuple(r) for r in codes.coded(df, parts=parts, entries=entries).collect()], key=str)
        want = brute_codes(rows, parts, entries, 2)
        if entries > 256:
            got = [(i, c and "".join(f"{int(c[k : k + 3], 16):02x}" for k in range(0, len(c), 3)), *rest) for i, c, *rest in got]
        assert sorted(got, key=str) == want


def test_no_vectors_to_code(spark):
    assert codes.coded(spark.createDataFrame([], SCHEMA)).count() == 0
    got = codes.coded(spark.createDataFrame([(1, [], 1), (2, None, 1)], SCHEMA)).collect()
    assert [(r.vec_id, r.code, r.error) for r in got] == [(1, None, None)]
