"""Learners and samplers against plain Python."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from relaudit.operators import attacks, learn, losses, metrics, prep, quantiles, splits
from relaudit.sources import tables

TEXTS = [
    (1, "red meadow quiet the river", 1), (2, "grey noise noise static", 0), (3, "red river bend", 1), (4, "static grey wall the", 0),
    (5, "meadow red red bend", 1), (6, "noise wall", 0), (7, None, 1), (8, "", 0),
]


def test_naive_bayes_equals_plain_counts(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, y int")
    model = learn.bag_of_words(docs, "y", vocabulary=6, min_docs=2)
    got = {r.doc_id: r.p for r in learn.bayes_scores(docs, model, "y").collect()}
    counts = {y: Counter(w for _, t, k in TEXTS if k == y for w in (t or "").split() if w != "the") for y in (0, 1)}
    held = Counter(w for _, t, _ in TEXTS for w in set((t or "").split()) if w != "the")
    total = counts[0] + counts[1]
    vocabulary = sorted((w for w in total if held[w] >= 2), key=lambda w: (-total[w], w))[:6]
    log_p = {(y, w): math.log((counts[y][w] + 1) / sum(counts[y][v] + 1 for v in vocabulary)) for y in (0, 1) for w in vocabulary}
    for i, text, _ in TEXTS:
        score = {y: math.log(0.5) + sum(log_p[y, w] for w in (text or "").split() if w in vocabulary) for y in (0, 1)}
        assert abs(got[i] - 1 / (1 + math.exp(score[0] - score[1]))) < 1e-9
    assert learn.bayes_scores(docs.limit(0), model, "y").count() == 0


def test_bags_follow_their_class(spark):
    model = spark.createDataFrame([(0, "a", 0.75), (0, "b", 0.25), (1, "b", 0.5), (1, "c", 0.5)], "y int, token string, probability double")
    lengths = spark.createDataFrame([(0, 10, 3), (0, 30, 1), (1, 20, 5)], "y int, length int, rows long")
    rows = learn.sample_bags(model, lengths, "y", 400, 5, 0.1).collect()
    size, n, shown = Counter(), Counter(), {}
    for r in rows:
        size[r.y, r.bag] += r.n
        n[r.y, r.token] += r.n
        shown[r.y, r.bag] = r.shown
    assert {k[0]: v for k, v in size.items() if k[0] == 1} == {1: 20} and {v for k, v in size.items() if k[0] == 0} == {10, 30}
    assert abs(sum(v == 30 for k, v in size.items() if k[0] == 0) / 400 - 0.25) < 0.07
    assert abs(n[0, "a"] / (n[0, "a"] + n[0, "b"]) - 0.75) < 0.03 and (0, "c") not in n and (1, "a") not in n
    assert 0.05 < sum(v != k[0] for k, v in shown.items()) / len(shown) < 0.15
    assert sorted(map(tuple, rows)) == sorted(map(tuple, learn.sample_bags(model, lengths, "y", 400, 5, 0.1).collect()))


def test_private_model_is_a_distribution_and_noise_fades(spark):
    rows = spark.createDataFrame([(i % 2, "x" if i % 3 else "z") for i in range(600)], "y int, f string")
    domain, classes = spark.createDataFrame([("f", "x"), ("f", "z")], "feature string, level string"), spark.createDataFrame([(0,), (1,)], "y int")
    plain = {(r.y, r.level): r.probability for r in learn.conditional_model(rows, "y", ["f"], 0.5).collect()}
    for epsilon, off in ((0.5, 0.5), (1e6, 1e-3)):
        got = {(r.y, r.level): r.probability for r in learn.private_model(rows, "y", domain, classes, epsilon, 3).collect()}
        assert all(abs(sum(p for (y, _), p in got.items() if y == k) - 1) < 1e-9 for k in (0, 1))
        assert max(abs(got[k] - plain[k]) for k in plain) < off


def test_inputs_that_differ_in_a_row_noise_the_same_cells(spark):
    rows = [(i % 2, "x") for i in range(100)]
    domain, classes = spark.createDataFrame([("f", x) for x in "xzw"], "feature string, level string"), spark.createDataFrame([(0,), (1,), (2,)], "y int")
    cells = []
    for more in ([], [(1, "z")], [(2, "w")], [(7, "x"), (0, "unknown")]):
        df = spark.createDataFrame(rows + more, "y int, f string")
        kept, rejects = learn.registered_rows(df, "y", domain)
        cells.append({(r.y, r.feature, r.level) for r in learn.private_model(df, "y", domain, classes, 1.0, 3).collect()})
        assert {r.y for r in learn.private_classes(df, "y", classes, 1, 1.0, 3).collect()} == {0, 1, 2}
        assert [tuple(r) for r in rejects.select("y", "feature", "level", "n").collect()] == ([(0, "f", "unknown", 1)] if len(more) == 2 else [])
    assert all(c == {(y, "f", x) for y in (0, 1, 2) for x in "xzw"} for c in cells)


def test_poisson_releases_resample(spark):
    df = spark.range(4_000).select("id", (F.col("id") % 7).cast("double").alias("x"), splits.poisson_weights(9, 5, "id").alias("w"))
    rows = df.collect()
    w = np.array([r.w for r in rows])
    assert w.shape == (4_000, 9) and abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    assert abs(np.corrcoef(w.T) - np.eye(9)).max() < 0.06
    got = {r.release: (r.n, r.total) for r in splits.poisson_sums(df, 9, "w", [], total=lambda _: F.col("x")).collect()}
    x = np.array([r.x for r in rows])
    assert got == {r: (w[:, r].sum(), pytest.approx((w[:, r] * x).sum())) for r in range(9)}


def test_weighted_auc_equals_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 2)), float(rng.integers(0, 12))) for i in range(90)]
    df = spark.createDataFrame(rows, "query_id long, member int, score double")
    weighted = df.select(F.col("member").alias("y"), F.col("score").alias("p"), splits.poisson_weights(6, 4, "member", "query_id").alias("w"))
    told = weighted.collect()
    got = {r.release: r.auc for r in metrics.weighted_auc(weighted, 6).collect()}
    for r in range(6):
        pos, neg = [(t.p, t.w[r]) for t in told if t.y], [(t.p, t.w[r]) for t in told if not t.y]
        won = sum(a * b * ((p > q) + 0.5 * (p == q)) for p, a in pos for q, b in neg)
        assert got[r] == pytest.approx(won / sum(a for _, a in pos) / sum(b for _, b in neg))
    row = attacks.bootstrap_interval(df, 6, 4).first()
    assert row.mean_auc == pytest.approx(np.mean(list(got.values()))) and row.lo == pytest.approx(np.quantile(list(got.values()), 0.025))


def test_preprocessor_ignores_unseen_levels_and_fills_gaps(spark):
    train = spark.createDataFrame([(1, 2.0, "a"), (2, 4.0, "a"), (3, None, "b")], "id int, x double, c string")
    put = learn.preprocessor(train, ["x"], ["c"])
    got = {r.id: (round(r.x, 6), r.c_a, r.c_b) for r in put(spark.createDataFrame([(9, None, "new"), (8, 3.0, None)], "id int, x double, c string")).collect()}
    assert got == {9: (0.0, 0.0, 0.0), 8: (0.0, 1.0, 0.0)}


def test_calibration_line_of_separated_and_single_classes_is_null(spark):
    rows = [("one", 1, 0.2), ("one", 1, 0.6), ("flat", 0, 0.5), ("flat", 1, 0.5)] + [("line", int(i % 10 < k), k / 10) for k in range(1, 10) for i in range(10)]
    got = {r.g: (r.slope, r.intercept) for r in metrics.calibration_line(spark.createDataFrame(rows, "g string, y int, p double"), ["g"]).collect()}
    assert got["one"] == got["flat"] == (None, None)
    assert abs(got["line"][0] - 1) < 1e-6 and abs(got["line"][1]) < 1e-6


def test_names_and_frozen_results(spark, tmp_path):
    assert prep.unique_names(["a b", "a-b", "?", "", "x_1"]) == ["a_b", "a_b_2", "column", "column_2", "x_1"]
    rows = spark.range(3)
    tables.write_new(rows, f"{tmp_path}/t")
    assert tables.refuses(rows.limit(1), f"{tmp_path}/t") and spark.read.parquet(f"{tmp_path}/t").count() == 3
    with pytest.raises(ValueError):
        tables.union_runs({"a": rows, "b": rows}, "id")


def test_generator_jobs_tell_good_mechanisms_from_bad(spark):
    from relaudit.plans import registry

    sf = "/root/testdata/sf0.01"
    got = {r.mechanism: r for r in registry.QUERIES["job6_text_mechanisms"](spark, sf).collect()}
    assert set(got) == {"bags::m0", "bags::m1"} and all(r.releases == 5 and 0 <= r.direct_lcb <= 1 for r in got.values())
    assert got["bags::m0"].q50 >= got["bags::m1"].q50 and got["bags::m0"].role == "high"
    got = {r.mechanism: r for r in registry.QUERIES["job5_private_generator"](spark, sf).collect()}
    assert set(got) == {"private::e0.01", "private::e10.0"}
    assert got["private::e10.0"].named_recognized >= got["private::e0.01"].named_recognized
    assert got["private::e10.0"].named_recognized > 0
    for r in got.values():
        assert r.reliability_lcb == max(r.named_lcb, r.direct_lcb, r.smooth_lcb) and 0 <= r.direct_favorable <= r.releases == 10


def test_releases_are_fitted_as_each_alone(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((300, 3))
    y = (rng.uniform(size=300) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0, 0.3])))).astype(int)
    w, shown = rng.poisson(1.0, (300, 4)), np.where(rng.uniform(size=(300, 4)) < 0.2, 1 - y[:, None], y[:, None])
    w[:, 3] = 0  # a release that holds nothing
    rows = [(*map(float, a), int(b), c.tolist(), e.tolist()) for a, b, c, e in zip(x, y, w, shown, strict=True)] + [(None, 1.0, 1.0, 1, [9] * 4, [1] * 4)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int, w array<int>, s array<int>").repartition(3)
    got = {r.release: r.b for r in learn.logistic_models(df, ["a", "b", "c"], "y", 4, "w", "s", rounds=30).collect()}
    design = np.hstack([np.ones((300, 1)), x])
    for r in range(4):
        p = 1 / (1 + np.exp(-design @ got[r]))
        gradient = design.T @ (w[:, r] * (shown[:, r] - p)) - np.array([0, *got[r][1:]])
        assert np.abs(gradient).max() < 1e-8  # the optimum of the same penalised likelihood
    assert got[3] == [0.0] * 4
    plain = learn.logistic_models(df, ["a", "b", "c"], "y", ridge=0.0, rounds=30).first().b
    p = 1 / (1 + np.exp(-design @ plain))
    assert np.abs(design.T @ (y - p)).max() < 1e-6
    scored = learn.score_logistic(df.dropna(), learn.logistic_models(df, ["a", "b", "c"], "y", ridge=0.0, rounds=30), ["a", "b", "c"], "p").collect()
    assert len(scored) == 300 and max(abs(r.p - 1 / (1 + np.exp(-(np.array([1, r.a, r.b, r.c]) @ plain)))) for r in scored) < 1e-12
    with pytest.raises(ValueError):
        learn.logistic_models(df, ["a", "b", "c"], "y", 10_000)


def test_quantiles_of_large_tables_are_exact(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal(6_000)
    ties = rng.integers(0, 4, 6_000).astype(float)
    heavy = np.where(rng.uniform(size=6_000) < 0.6, 7.0, x)
    rows = [(float(a), float(b), float(c), None) for a, b, c in zip(x, ties, heavy, strict=True)] + [(None, float("nan"), 7.0, None)]
    df = spark.createDataFrame(rows, "x double, t double, h double, n double").repartition(5)
    p = [0.0, 0.01, 0.25, 0.5, 0.9937, 1.0]
    for small in (10, 300, 20_000):
        got = quantiles.exact_quantiles(df, {c: F.col(c) for c in "xthn"}, p, small)
        assert got["x"] == pytest.approx(np.quantile(x, p).tolist(), abs=1e-12)
        assert got["t"] == np.quantile(ties, p).tolist()
        assert got["h"] == pytest.approx(np.quantile([*heavy, 7.0], p).tolist(), abs=1e-12)
        assert got["n"] == [None] * 6
    assert quantiles.exact_quantiles(df.limit(0), {"x": F.col("x")}, [0.5]) == {"x": [None]}


def test_pilot_limits_stay_within_the_domain(spark):
    risks = spark.createDataFrame([("a", 0.1), ("a", 0.2001), ("b", 0.3)], "requirement string, risk double")
    got = {r.requirement: (r.cutoff, r.tolerance) for r in losses.pilot_limits(risks, 0.02, 0.05).collect()}
    assert got == {"a": (0.221, 0.271), "b": (0.32, 0.37)}
    for guard, slack in ((0.8, 0.1), (-0.4, 0.1)):
        with pytest.raises(ValueError, match="b"):
            losses.pilot_limits(risks, guard, slack)


def test_classes_are_ranked_and_indexed_in_order(spark):
    from relaudit.operators import splits

    rows = spark.createDataFrame([(i, ["a", "b", None][i % 3]) for i in range(100)], "id int, label string")
    got = splits.class_rank(rows, "label", 3, "id").collect()
    for k, size in (("a", 34), ("b", 33), (None, 33)):
        of = [r for r in got if r.label == k]
        assert sorted(r["_rank"] for r in of) == list(range(1, size + 1)) and {r["_n"] for r in of} == {size}
    assert splits.class_rank(rows.limit(0), "label", 3, "id").count() == 0


def test_sampled_releases_follow_the_model(spark):
    model = spark.createDataFrame([(0, "f", "a", 0.8), (0, "f", "b", 0.2), (1, "f", "a", 0.1), (1, "f", "b", 0.9)], "y int, feature string, level string, probability double")
    classes = spark.createDataFrame([(0, 30.0), (1, 70.0)], "y int, count double")
    rows = learn.sample_releases(model, classes, "y", ["f"], releases=3, m=4_000, seed=8).collect()
    assert Counter(r.release for r in rows) == {0: 4_000, 1: 4_000, 2: 4_000}
    for release in range(3):
        own = [r for r in rows if r.release == release]
        ones = [r for r in own if r.y == 1]
        assert abs(len(ones) / 4_000 - 0.7) < 0.03
        assert abs(sum(r.f == "b" for r in ones) / len(ones) - 0.9) < 0.03
        assert abs(sum(r.f == "b" for r in own if r.y == 0) / (4_000 - len(ones)) - 0.2) < 0.04
    again = learn.sample_releases(model, classes, "y", ["f"], releases=3, m=4_000, seed=8).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_fit_select_takes_the_cheapest(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (600, 2))
    y = (np.abs(x[:, 0]) < 0.5).astype(int)  # trees can tell, a line cannot
    df = spark.createDataFrame([(i, float(a), None if i % 50 == 0 else float(b), int(k)) for i, (a, b, k) in enumerate(zip(x[:, 0], x[:, 1], y, strict=True))], "i long, a double, b double, y int")
    got = {r.model: r for r in learn.fit_select(df, ["a", "b"], "y", ["i"]).collect()}
    assert set(got) == {"boosted_trees", "forest", "logistic"}
    assert [m for m, r in got.items() if r.selected] == [min(got, key=lambda m: (got[m].cost, m))]
    assert got["logistic"].cost > 0.05 > min(got["boosted_trees"].cost, got["forest"].cost)
    assert all(0 <= r.threshold <= 1 and r.cost >= 0 for r in got.values())


def test_classes_are_told_by_broadcast_and_hashes_are_taken_once(spark):
    rows = spark.range(600).select("id", (F.col("id") % 2).alias("label"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables too large to be broadcast by themselves
    try:
        plan = splits.class_rank(rows, "label", 3, "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "SortMergeJoin" not in plan  # it would put each class in one task
    got = rows.limit(40).select("id", splits.keyed_uniforms(6, 9, "id").alias("u"), splits.poisson_weights(6, 9, "id").alias("w")).collect()
    for r in got:
        want = [int(hashlib.md5(f"{r.id}#{k // 4}#9".encode()).hexdigest()[k % 4 * 8 :][:8], 16) / 2**32 for k in range(6)]
        assert r.u == want and r.w == [sum(u >= c for c in splits.POISSON) for u in want]


def test_subgroup_metrics_come_from_counts(spark, monkeypatch):
    """What is kept of the rows is a count for each group, class and score; null scores stay out of means."""
    kept = []
    stage = metrics.staged
    monkeypatch.setattr(metrics, "staged", lambda df, what: kept.append(stage(df, what)) or kept[-1])
    s = spark.range(20_000).selectExpr("if(id % 3 = 0, 'a', 'b') AS g", "cast(id % 7 < 3 AS int) AS y", "if(id % 500 = 7, null, (id % 11) / 10) AS p")
    got = {r.subgroup: r for r in metrics.subgroup_metrics(s, F.col("g")).collect()}
    assert [k.count() for k in kept] == [s.select("g", "y", "p").distinct().count()]
    for one in (metrics.proper_scores(s, ["g"]), metrics.classification(s, ["g"]), metrics.ece(s, ["g"]), metrics.ranking(s, ["g"]), metrics.calibration_line(s, ["g"])):
        for r in one.collect():
            assert all(got[r.g][c] == pytest.approx(r[c], rel=1e-9, abs=1e-9) for c in one.columns if c != "g" and r[c] is not None)


def test_scores_beside_each_other_rank_as_each_alone(spark, monkeypatch):
    rng = np.random.default_rng(9)
    p = np.column_stack([rng.integers(0, 40, 3_000) / 40, rng.uniform(size=3_000), np.full(3_000, 0.5), np.where(rng.uniform(size=3_000) < 0.7, 0.25, rng.uniform(size=3_000))])
    rows = [(None if i % 97 == 0 else int(rng.uniform() < x[1]), [None if i % 89 == 0 and r == 0 else float(v) for r, v in enumerate(x)]) for i, x in enumerate(p)] + [(1, None)]
    df = spark.createDataFrame(rows, "y int, p array<double>").repartition(5)
    each = df.where("y is not null").select("y", F.posexplode("p").alias("release", "p")).where("p is not null")
    want = {r.release: pytest.approx(r.auc, abs=1e-12) for r in metrics.ranking(each, ["release"]).collect()}
    for size, counted in ((50_000, 100_000), (100, 70)):  # one range, and many from many counts
        monkeypatch.setattr(metrics, "RANGE_ROWS", size)
        monkeypatch.setattr(metrics, "COUNTED_ROWS", counted)
        assert {r.release: r.auc for r in metrics.beside_auc(df).collect()} == want and len(want) == 4
    assert [r.auc for r in metrics.beside_auc(df.where("y = 1")).collect()] == [None] * 4 and metrics.beside_auc(df.limit(0)).count() == 0


def test_fitted_releases_are_kept_beside_a_record(spark, monkeypatch):
    """What is kept of the predictions is a row for each sealed record, not one for each release as well."""
    from relaudit.plans import registry

    kept, stage = {}, tables.staged
    monkeypatch.setattr(tables, "staged", lambda df, what="staged": kept.setdefault(what, stage(df, what)))
    sf = "/root/testdata/sf0.001"
    assert registry.QUERIES["job2_fitted_releases"](spark, sf).count() == 20
    assert kept["predictions"].count() == kept["sealed"].count() == spark.read.parquet(f"{sf}/orders.parquet").count() // 5


def test_keyed_numbers_leave_null_keys_out(spark):
    df = spark.createDataFrame([(1, "a"), (None, "a"), (2, None), (None, None), (3, "")], "i long, s string")
    md5 = lambda g: F.md5(F.concat_ws("#", F.col("i").cast("string"), "s", F.lit(str(g)), F.lit("4")))
    for r in df.select(splits.keyed_uniforms(5, 4, "i", "s").alias("u"), F.array(md5(0), md5(1)).alias("h")).collect():
        assert r.u == [int(r.h[k // 4][k % 4 * 8 :][:8], 16) / 2**32 for k in range(5)]


def test_bags_are_drawn_by_keyed_numbers(spark):
    model = spark.createDataFrame([(0, "a", 0.75), (0, "b", 0.25), (1, "b", 0.5), (1, "c", 0.5)], "y int, token string, probability double")
    lengths = spark.createDataFrame([(0, 3, 1), (1, 4, 1)], "y int, length int, rows long")
    releases = spark.createDataFrame([(7, 0.0), (20, 0.4)], "seed long, flip double")
    u = lambda *keys: int(hashlib.md5("#".join(map(str, keys)).encode()).hexdigest()[:8], 16) / 2**32
    want = Counter()
    for seed, flip in ((7, 0.0), (20, 0.4)):
        for y, bag in ((y, bag) for y in (0, 1) for bag in range(30)):
            shown = 1 - y if u(y, bag, seed + 2) < flip else y
            for place in range(1, 4 + y):
                want[seed, y, bag, shown, "ab"[u(y, bag, place, seed + 1) >= 0.75] if y == 0 else "bc"[u(y, bag, place, seed + 1) >= 0.5]] += 1
    assert {(r.seed, r.y, r.bag, r.shown, r.token): r.n for r in learn.bag_releases(model, lengths, "y", 30, releases).collect()} == want


def test_pilot_roles_decide_what_the_text_audit_draws(spark, monkeypatch):
    """A configuration without a role is neither drawn again nor audited nor given a share of the error; releases of the
    audit are others than the pilot's, and as many as planned."""
    from relaudit.operators import certificates as cer
    from relaudit.plans import registry

    drawn, roles, bags = [], cer.configuration_roles, learn.bag_releases
    monkeypatch.setattr(learn, "bag_releases", lambda *a: drawn.append(a[-1].collect()) or bags(*a))
    monkeypatch.setattr(cer, "configuration_roles", lambda rows: roles(rows).withColumn("role", F.when(F.col("configuration") == "bags::m1", "moderate")))
    monkeypatch.setattr(cer, "planned_releases", lambda *a: 6)
    row, = registry.QUERIES["job6_text_mechanisms"](spark, "/root/testdata/sf0.01").collect()
    assert (row.mechanism, row.role, row.releases) == ("bags::m1", "moderate", 6) and row.direct_only is (row.named_lcb <= 0.5 < row.direct_lcb)
    if row.direct_favorable == 6:
        assert row.direct_score_lcb == round(0.025 ** (1 / 6), 7)  # the error is not shared with another mechanism
    pilot, audit = ({(r.seed, r.flip) for r in part} for part in drawn)
    assert len(pilot) == 10 and len(audit) == 6 and {flip for _, flip in audit} == {0.45}
    assert not {s + i for s, _ in pilot for i in range(3)} & {s + i for s, _ in audit for i in range(3)}
