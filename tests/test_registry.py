"""Every registered query with SQL against DuckDB, at the smallest scale."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from relaudit.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return 0.0 if isinstance(v, float) and v == 0 else v


def rows(names, order, table):
    at = [names.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert rows(got.columns, order, got.collect()) == rows(want.columns, order, want.fetchall())


@pytest.mark.skipif(not os.environ.get("SLOW"), reason="hundreds of releases show what small tables do not; set SLOW to run it")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql_on_larger_tables(spark, name):
    at, con = SF.replace("0.001", "0.1"), duckdb.connect()
    for table in os.listdir(at):
        con.sql(f"create view {table.removesuffix('.parquet')} as select * from '{at}/{table}'")
    got, want = registry.QUERIES[name](spark, at), con.sql(registry.ORACLE_SQL[name])
    order = sorted(got.columns)
    near = lambda table: [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in table]
    assert sorted(near(rows(got.columns, order, got.collect())), key=repr) == sorted(near(rows(want.columns, order, want.fetchall())), key=repr)


@pytest.mark.parametrize("name", ["atk5_gen_lra", "gen2_sampled_releases", "atk8_bootstrap_interval"])
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_every_supplier_is_a_registered_release(spark, tmp_path):
    spark.read.parquet(f"{SF}/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(300).selectExpr("cast(id as int) as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = registry.QUERIES["los7_failed_releases"](spark, str(tmp_path)).collect()
    got = {(r.candidate, r.requirement): r.value for r in rows}
    assert set(got) == {(f"tpch::m{s % 4}::s{s}", q) for s in range(300) for q in ("brier_regret", "logloss_regret")} and len(rows) == 600
    assert got["tpch::m2::s250", "brier_regret"] == 1.0 and got["tpch::m0::s0", "brier_regret"] < 1.0


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "candidate" and df.count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
