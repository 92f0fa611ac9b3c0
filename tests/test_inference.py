"""Known values of the formulas, three-way decisions, and input that must be rejected."""

import datetime
import math
import random
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from relaudit.functions import formulas as fx
from relaudit.operators import certificates, evidence, losses, mechanism, metrics, prep, splits
from relaudit.plans.registry import ORACLE_SQL, QUERIES
from relaudit.sources import tables
from relaudit.streaming.stream import Ledger, adaptive_audit, live_audit

REQ = "requirement string, tolerance double, lower double, upper double, slack double, ramp double"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_holm(spark):
    df = spark.createDataFrame([("b", 0.03), ("a", 0.01), ("c", 0.2)], "name string, p double")
    got = {r.name: r.adj for r in evidence.holm(df, "p", ["name"], [], "adj").collect()}
    assert got == pytest.approx({"a": 0.03, "b": 0.06, "c": 0.2})


def test_simes_recognises_what_holm_misses(spark):
    p = [0.002, 0.02, 0.02, 0.02]
    df = spark.createDataFrame([("m", f"r{i}", x, False) for i, x in enumerate(p)], "mechanism string, candidate string, candidate_p double, violation_detected boolean")
    assert mechanism.release_counts(df, 0.05).first().validated_releases == 1
    assert mechanism.release_counts(df, 0.05, "simes").first().validated_releases == 4


def test_binomial_and_clopper_pearson(spark):
    exact = sum(math.comb(20, i) * 0.8**i * 0.2 ** (20 - i) for i in range(17, 21))
    assert one(spark, fx.binomial_tail(20, 17, 0.8)) == pytest.approx(exact, abs=1e-12)
    low = one(spark, fx.clopper_pearson(20, 17, 0.05))
    assert sum(math.comb(20, i) * low**i * (1 - low) ** (20 - i) for i in range(17, 21)) == pytest.approx(0.05, abs=1e-9)
    assert one(spark, fx.clopper_pearson(20, 0, 0.05)) == 0 and one(spark, fx.clopper_pearson(20, 20, 0.05, upper=True)) == 1
    assert one(spark, fx.clopper_pearson(20, 20, 0.05)) == pytest.approx(0.05 ** (1 / 20))


def test_bernstein_p_inverts_its_bound(spark):
    n, mean, var = 500, 0.1, 0.02
    p = one(spark, fx.bernstein_p(n, mean, var, 0.2, 0, 1))
    assert one(spark, fx.bernstein_ucb(n, mean, var, p, 0, 1)) == pytest.approx(0.2, abs=1e-9)
    assert one(spark, fx.bernstein_p(n, mean, var, 1.5, 0, 1)) == 0 and one(spark, fx.bernstein_p(n, mean, var, 0.1, 0, 1)) == 1


def test_kl_bound(spark):
    q = one(spark, fx.kl_lower(0.9, 100, 0.05))
    assert 0.9 * math.log(0.9 / q) + 0.1 * math.log(0.1 / (1 - q)) == pytest.approx(math.log(20) / 100, abs=1e-9)
    assert one(spark, fx.kl_lower(0.0, 10, 0.05)) == 0 and one(spark, fx.kl_lower(1.0, 10, 0.05)) == pytest.approx(0.05**0.1)


def flat(spark, groups, n):
    """Losses of constant value: groups of (mechanism, candidate, value)."""
    return spark.createDataFrame([(m, c, "r", v, i) for m, c, v in groups for i in range(n)], "mechanism string, candidate string, requirement string, value double, record_id int")


def test_three_way_mechanism_decisions(spark):
    groups = [("good", f"g{i}", -0.4) for i in range(30)] + [("bad", f"b{i}", 0.4) for i in range(30)] + [("few", f"f{i}", -0.4) for i in range(3)]
    req = spark.createDataFrame([("r", 0.0, -1.0, 1.0, 0.05, 0.0)], REQ)
    got = {r.mechanism: r.status for r in mechanism.mechanism_audit(flat(spark, groups, 400), req, 0.8).collect()}
    assert got == {"good": "Validated", "bad": "Violation detected", "few": "Unresolved"}


def test_error_budget():
    got = mechanism.error_budget(0.04, 0.25, 0.06, 0.5)
    assert [round(got[k], 12) for k in ("release_alpha", "mechanism_alpha", "release_violation_alpha", "mechanism_violation_alpha")] == [0.01, 0.03, 0.03, 0.03]


def test_certificate_of_zero_losses(spark):
    req = spark.createDataFrame([("r", 0.2, 0.0, 1.0, 0.1, 0.02)], REQ)
    means = certificates.release_means(flat(spark, [("m", f"c{i}", 0.0) for i in range(50)], 20))
    row = certificates.conditional_certificate(means, req, 5000).first()
    assert row.score_mean == 1 and row.allowance < 1e-20 and row.reliability_lcb > 0.8


def test_equal_strata_use_the_plain_tail(spark):
    rows = flat(spark, [("m", "c", 0.1)], 100).withColumn("stratum", F.when(F.col("record_id") < 50, "a").otherwise("b"))
    req = spark.createDataFrame([("r", 0.4, 0.0, 1.0, 0.1, 0.0)], REQ)
    row = certificates.stratified_evidence(rows, req, spark.createDataFrame([("a", 0.5), ("b", 0.5)], "stratum string, weight double")).first()
    kl = 0.1 * math.log(0.1 / 0.4) + 0.9 * math.log(0.9 / 0.6)
    assert row.method == "kl" and row.validation_p == pytest.approx(math.exp(-100 * kl)) and row.violation_p == 1


def test_bad_input_is_rejected(spark):
    req = spark.createDataFrame([("r", 0.0, -1.0, 1.0, 0.05, 0.0)], REQ)
    for v in (2.0, float("nan"), None):
        with pytest.raises(ValueError):
            evidence.validate_losses(flat(spark, [("m", "c", v)], 2), req)
    with pytest.raises(ValueError):
        evidence.badness_p("guess")
    with pytest.raises(ValueError):
        mechanism.mechanism_audit(flat(spark, [("m", "c", 0.0)], 2), req, mode="simes")
    with pytest.raises(ValueError):
        certificates.hybrid(F.lit(0.1), F.lit(0.2), 0.06, 0.05)
    with pytest.raises(ValueError):
        prep.encode(spark.createDataFrame([("z",)], "c string"), "c", ["a"])
    with pytest.raises(ValueError):
        splits.fixed_partition(spark.range(3).withColumn("y", F.lit(1)), "y", 1, ["id"], {"a": 5})
    with pytest.raises(ValueError):
        tables.union_runs({"a": spark.range(2), "b": spark.range(1)}, "id")
    side = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5)], "k int, y int, p double")
    with pytest.raises(ValueError):
        losses.paired_records(side, side, ["k"])
    with pytest.raises(ValueError):
        tables.aligned(spark.range(1), ["x"])


def test_row_index_is_a_permutation_in_order(spark):
    rows = splits.row_index(spark.range(500).repartition(7), -F.col("id"), "id").collect()
    assert all(r.idx == 499 - r.id for r in rows)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, p double")
    assert metrics.ranking(df, []).first().auc == pytest.approx(3.5 / 4)


def test_unique_names():
    assert prep.unique_names(["a b", "a-b", "ok"]) == ["a_b", "a_b_2", "ok"]
    assert prep.unique_names(["a", "a", "a_2", "a", "a_2"]) == ["a", "a_2", "a_2_2", "a_3", "a_2_3"]


def test_ledger_spends_once(spark, tmp_path):
    closed = spark.createDataFrame([("closed", i, i * 1.0, 100, 0.1, 0.01) for i in range(3)], "kind string, candidate long, ts double, n long, mean double, var double")
    ledger = Ledger(spark, f"{tmp_path}/ledger", 0.05, 0.3)
    ledger(closed.where("candidate < 2"), 0)
    ledger(closed, 1)
    ledger(closed, 1)  # a replayed batch
    got = sorted((r.candidate, r.round) for r in ledger.table().collect())
    assert got == [(0, 1), (1, 2), (2, 3)]
    events = spark.createDataFrame([(i, float(i), 50.0) for i in range(3) for _ in range(5)], "user_id long, ts double, value double")
    assert adaptive_audit(events).count() == 3


def test_live_rows_and_rejects_are_the_batch(spark, tmp_path):
    """A pause longer than the gap before a close is kept, losses after it are rejected and counted; a replay changes nothing."""
    day = lambda d: datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(days=d)
    rng = random.Random(4)
    rows = lambda who, *days: [(day(d), who, rng.uniform(0, 600)) for d in days]
    arrive = [
        rows(1, 0, 3, 1) + rows(2, 2) + rows(3, 0, 50) + [(day(1), 4, None), (None, 4, 3.0), (day(1), None, 3.0)],  # 3 pauses within one batch
        rows(5, 85),  # the watermark passes 1, 2 and 3
        rows(1, 90, 91) + rows(6, 90),  # second sessions come after the close
        rows(3, 95) + rows(1, 96),
        rows(7, 400),
    ]
    ledger, at = Ledger(spark, f"{tmp_path}/ledger", 0.05, 0.3), f"{tmp_path}/in"
    schema = "ts timestamp, user_id long, value double"
    for batch in arrive:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(at)
        live_audit(spark.readStream.schema(schema).parquet(at), ledger, f"{tmp_path}/checkpoint", gap="30 days").awaitTermination()
    live, rejects = ledger.table().collect(), ledger.rejects().collect()
    assert sorted((r.candidate, r.n) for r in live) == [(1, 3), (2, 1), (3, 2), (5, 1), (6, 1)]
    assert sorted((r.candidate, r.n) for r in rejects) == [(1, 1), (1, 2), (3, 1)]
    assert [r.round for r in sorted(live, key=lambda r: r.round)] == [1, 2, 3, 4, 5]
    whole = {r.candidate: (r.n, r.mean) for r in adaptive_audit(spark.createDataFrame([x for b in arrive for x in b if x[0]], schema)).where("candidate is not null").collect()}
    for who in (1, 2, 3, 5, 6):
        parts = [(r.n, r.mean) for r in [*live, *rejects] if r.candidate == who]
        assert sum(n for n, _ in parts) == whole[who][0]
        assert sum(n * m for n, m in parts) / whole[who][0] == pytest.approx(whole[who][1])
    values = [min(v / 500, 1.0) for _, who, v in arrive[0] if who == 1]
    assert next(r for r in live if r.candidate == 1).var == pytest.approx(statistics.variance(values))
    last = max(ledger._folders("rounds"))
    replay = ledger.table().where("candidate = 1").selectExpr("'closed' AS kind", "candidate", "ts", "n", "mean", "var")
    ledger(replay, last + 1)
    assert sorted((r.candidate, r.round) for r in ledger.table().collect()) == sorted((r.candidate, r.round) for r in live)


def test_live_rounds_go_by_arrival(spark, tmp_path):
    """A candidate that closes early does not overtake one that came before; first losses may be microseconds apart, and
    the earlier may come in a later batch."""
    at = lambda d, us=0: datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(days=d, microseconds=us)
    arrive = [
        [(at(0, 700), 1, 50.0), (at(0, 300), 2, 60.0), (at(0, 300), 9, 60.0), (at(40), 2, 70.0), (at(80), 9, 1.0)],  # 1 closes first
        [(at(80, 20), 4, 5.0), (at(80, 40), 5, 6.0)],
        [(at(80, 10), 6, 7.0), (at(120), 6, 8.0)],
        [(at(400), 7, 1.0)],
    ]
    ledger, path = Ledger(spark, f"{tmp_path}/ledger", 0.05, 0.3), f"{tmp_path}/in"
    schema = "ts timestamp, user_id long, value double"
    for batch in arrive:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        live_audit(spark.readStream.schema(schema).parquet(path), ledger, f"{tmp_path}/checkpoint", gap="30 days").awaitTermination()
    live = sorted((r.round, r.candidate, r.ts, r.n) for r in ledger.table().collect())
    assert [r[:2] for r in live] == [(1, 2), (2, 9), (3, 1), (4, 6), (5, 4), (6, 5)]
    whole = adaptive_audit(spark.createDataFrame([x for b in arrive for x in b], schema)).where("candidate <> 7").collect()
    assert live == sorted((r.round, r.candidate, r.ts, r.n) for r in whole)


def test_live_means_round_as_their_sql(spark, tmp_path):
    """Means of 64 losses in steps of 1 / 50,000 often lie half way between two numbers of nine digits."""
    at = "/root/testdata/sf0.1/events.parquet"
    events = spark.read.parquet(at)
    some = events.groupBy("user_id").count().where("count = 64").select("user_id")
    events.join(some, "user_id", "left_semi").orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = {r[0]: r[1:4] for r in con.sql(f"select candidate, round, n, mean from ({ORACLE_SQL['str3_live_audit']})").fetchall()}
    got = {r.candidate: (r.round, r.n, r.mean) for r in QUERIES["str3_live_audit"](spark, str(tmp_path)).collect()}
    assert len(want) > 50 and got == want


def test_delimited_scan(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1  2.5 ?\n 3 ? x\n")
    rows = tables.scan_delimited(spark, f"{tmp_path}/a.txt", "a int, b double, c string", sep=" ").collect()
    assert [tuple(r) for r in rows] == [(1, 2.5, None), (3, None, "x")]
    tables.write_new(spark.range(3), f"{tmp_path}/out")
    with pytest.raises(Exception, match="exist"):
        tables.write_new(spark.range(3), f"{tmp_path}/out")
    assert tables.fingerprint(spark.range(9).repartition(3), ["id"]).first() == tables.fingerprint(spark.range(9), ["id"]).first()


def binomial_sum(n, k, p):
    """P(Bin(n, p) >= k) term by term, from the mode outward in exact ratios."""
    top = max(k, int((n + 1) * p))
    log_top = math.lgamma(n + 1) - math.lgamma(top + 1) - math.lgamma(n - top + 1) + top * math.log(p) + (n - top) * math.log1p(-p)
    total, term = 1.0, 1.0
    for i in range(top, n):
        term *= (n - i) / (i + 1) * p / (1 - p)
        total += term
        if term < 1e-20 * total:
            break
    term = 1.0
    for i in range(top, k, -1):
        term *= i / (n - i + 1) * (1 - p) / p
        total += term
        if term < 1e-20 * total:
            break
    return total * math.exp(log_top)


def test_tails_of_large_samples(spark):
    rows = [(n, k, p) for n in (1, 7, 150, 5_000) for k in sorted({0, 1, n // 3, n - 1, n}) for p in (0.003, 0.4, 0.97)]
    rows += [(10**6, 500_000, 0.5), (10**6, 501_500, 0.5), (10**6, 999_100, 0.999), (10**6, 30, 1e-5)]
    for r in spark.createDataFrame(rows, "n long, k long, p double").select("*", fx.binomial_tail("n", "k", "p").alias("x")).collect():
        want = 1.0 if r.k == 0 else min(1.0, binomial_sum(r.n, r.k, r.p))
        assert r.x == pytest.approx(want, abs=3e-9) and (want < 1e-280 or r.x == pytest.approx(want, rel=1e-8))


def test_bounds_of_large_samples_invert_the_tail(spark):
    rows = [(n, k, e) for n in (1, 30, 4_000, 10**6) for k in sorted({1, n // 3, n - 1, n} - {0}) for e in (0.05, 1e-6)]
    df = spark.createDataFrame(rows, "n long, k long, e double").select("*", fx.clopper_pearson("n", "k", "e").alias("lo"), fx.clopper_pearson("n", F.col("n") - F.col("k"), "e", upper=True).alias("hi"))
    for r in df.collect():
        assert binomial_sum(r.n, r.k, r.lo) == pytest.approx(r.e, rel=1e-6)
        assert r.hi == pytest.approx(1 - r.lo, abs=1e-12)


def test_fisher_counts_of_many_small_p_values(spark):
    rows = [("a", str(i), 1e-9) for i in range(1_000)] + [("b", str(i), 1e-30) for i in range(200)] + [("c", str(i), 0.9) for i in range(300)]
    rows += [("d", str(i), p) for i, p in enumerate([1e-4] * 50 + [0.5] * 50)]
    got = {r.mechanism: r.recognised for r in mechanism.fisher_count(spark.createDataFrame(rows, "mechanism string, candidate string, candidate_p double"), 0.0125).collect()}
    ps = sorted(p for m, _, p in rows if m == "d")
    want = 0
    for k in range(1, 101):
        m, x = 100 - k + 1, -sum(map(math.log, ps[k - 1 :]))
        if math.fsum(math.exp(-x + i * math.log(x) - math.lgamma(i + 1)) for i in range(m)) > 0.0125:
            break
        want = k
    assert got == {"a": 1_000, "b": 200, "c": 0, "d": want} and 0 < want < 100
