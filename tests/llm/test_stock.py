"""Cutting-stock packing: the linear program against plain ones, and exact round trips."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from relaudit.llm import packing, stock


def best_worth(sizes, worth, capacity):
    """The knapsack by plain recursion over fills."""
    out = [0.0] * (capacity + 1)
    for s in range(1, capacity + 1):
        out[s] = max([out[s - 1]] + [out[s - x] + w for x, w in zip(sizes, worth, strict=True) if x <= s])
    return out


def test_knapsack_and_its_patterns():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = rng.choice(np.arange(1, 60), size=rng.integers(1, 12), replace=False)
        worth = sizes * rng.uniform(-0.1, 1.2, len(sizes))
        best, last = stock.knapsack(sizes, worth, 128)
        assert np.allclose(best, best_worth(sizes.tolist(), worth.tolist(), 128))
        fills, first = np.array([128, 64, 1, 100]), np.array([-1, -1, -1, 0])
        for a, fill, i in zip(stock.patterns_of(sizes, last, fills, first), fills, first, strict=True):
            assert a @ sizes <= fill
            assert a @ worth == pytest.approx(best[fill] if i < 0 else worth[i] + best[fill - sizes[i]])


def test_program_meets_demand_near_its_bound():
    rng = np.random.default_rng(4)
    for m in (1, 2, 5, 40):
        sizes = np.sort(rng.choice(np.arange(20, 1500), size=m, replace=False))[::-1].copy()
        demand = rng.integers(1, 3_000, m)
        patterns, used, bound = stock.solve(sizes, demand.astype(float), 2048)
        cost = stock.targets(2048)[np.searchsorted(stock.targets(2048), patterns @ sizes)] + stock.PER_SEQUENCE
        assert np.allclose(used @ patterns, demand) and (patterns @ sizes <= 2048).all()
        assert bound <= cost @ used + 1e-6
        whole = stock.rounded(patterns, used, sizes, demand, 2048)
        assert (sum(a * n for a, n in whole) == demand).all() and all(a @ sizes <= 2048 for a, _ in whole)
    # two thirds and one third: the optimum is one of each, known by hand
    patterns, used, bound = stock.solve(np.array([1365, 683]), np.array([900.0, 900.0]), 2048)
    assert used.sum() == pytest.approx(900) and bound == pytest.approx(900 * (2048 + stock.PER_SEQUENCE), rel=0.01)


def test_plan_is_full_and_cuts_few():
    rng = random.Random(5)
    n = Counter((min(2048, int(rng.lognormvariate(6, 1)) + 1), rng.randrange(64)) for _ in range(20_000))
    rows = pd.DataFrame([(x, s, k) for (x, s), k in n.items()], columns=["length", "share", "n"])
    given, made = stock.plan(rows)
    tokens = int((rows["length"] * rows["n"]).sum())
    assert made.enough and given <= 4 and made.gap < 0.03 * tokens
    assert made.sequences <= 1.01 * tokens / 2048 + 12
    used = made.whole.groupby("length").size()
    assert set(used.index) <= set(rows["length"])


def check(rows, got, capacity=2048):
    whole = {}
    for doc, text, *_ in rows:
        whole[doc] = packing.token_ids([text or ""])[0] + np.array([1], "<u4").tobytes()
    sequences, covered = defaultdict(list), defaultdict(Counter)
    for r in got:
        ids = whole[r.doc_id]
        part = ids[4 * r.start : 4 * (r.start + r.length)]
        assert r.length > 0 and len(part) == 4 * r.length and zlib.crc32(part) == r.ids_crc32 and r.doc_tokens == len(ids) // 4
        covered[r.doc_id].update(range(r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    times = Counter(doc for doc, *_ in rows)
    assert {d: dict(c) for d, c in covered.items()} == {d: dict.fromkeys(range(len(whole[d]) // 4), k) for d, k in times.items()}
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at == capacity or at & (at - 1) == 0 and at <= capacity
    return sequences


def test_round_trip_without_padding(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["alpha", "Beta,", "gamma-ray", "delta."], k=rng.choice([0, 1, 30, 200, 400, 900, 6000]))) for _ in range(80)]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(100, None, 7), (101, "", 7), (5, texts[5], 7), (None, "x", 7), (None, "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").selectExpr("*", "'t' AS task", "1 AS share", "2 AS `a.b`").repartition(3)
    got = stock.pack(df).collect()
    sequences = check(rows, got)
    assert len(sequences) <= sum(r.length for r in got) / 2048 * 1.1 + 12


def test_documents_too_large_to_share_a_sequence_are_cut(spark):
    rows = [(i, " ".join(["word"] * (1100 + i % 7))) for i in range(60)]
    got = stock.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    sequences = check(rows, got)
    assert len(sequences) <= sum(r.length for r in got) / 2048 + 12


def test_one_document_and_none(spark):
    check([(1, "a b c")], stock.pack(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).collect())
    long = [(1, "a " * 5000)]
    assert len(check(long, stock.pack(spark.createDataFrame(long, "doc_id long, text string")).collect())) >= 3
    assert stock.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
