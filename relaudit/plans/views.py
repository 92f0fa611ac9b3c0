"""The driver's tables as inputs of an audit: predictions, losses, shared targets, scores; in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attacks, losses

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
REQUIREMENTS = [("brier_regret", 0.02, -1.0, 1.0, 0.05, 0.0), ("logloss_regret", 0.02, -1.0, 1.0, 0.05, 0.0), ("cost5x_regret", 0.10, -1.0, 1.0, 0.05, 0.0)]
RELATIVE = [r[0] for r in REQUIREMENTS]
#: Shared target: three mechanisms of so many releases, each seeing every order.
RELEASES = 40
TARGET_REQUIREMENTS = [("error", 0.45, 0.0, 1.0, 0.15, 0.0), ("brier", 0.40, 0.0, 1.0, 0.15, 0.0)]
SCHEMA = "requirement string, tolerance double, lower double, upper double, slack double, ramp double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requirements(spark: SparkSession, rows=REQUIREMENTS) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def predictions(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """(keys..., mechanism, candidate, y, p_source, p_proxy) from lineitem: a good mechanism, a bad, a mixed, a neutral."""
    s = F.col("l_suppkey")
    m = F.pmod(s, F.lit(4))
    y, p = (F.col("l_returnflag") == "R").cast("int"), F.col("l_discount") * 10
    good, bad = 0.5 * p + 0.5 * y, 0.5 * p + 0.5 * (1 - y)
    mixed = F.when(F.pmod(F.floor(s / 4), F.lit(2)) == 0, good).otherwise(0.9 * p + 0.1 * (1 - y))
    proxy = F.when(m == 0, good).when(m == 1, bad).when(m == 2, mixed).otherwise(0.95 * p + 0.05 * (1 - y))
    name = F.concat(F.lit("tpch::m"), m.cast("string"))
    return table(spark, sf_dir, "lineitem").select(*KEYS, name.alias("mechanism"), F.concat(name, F.lit("::s"), s.cast("string")).alias("candidate"), y.alias("y"), p.alias("p_source"), proxy.alias("p_proxy"), *more)


PREDICTIONS = """
predictions AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
    concat('tpch::m', l_suppkey % 4) AS mechanism, concat('tpch::m', l_suppkey % 4, '::s', l_suppkey) AS candidate, y, p AS p_source,
    CASE WHEN m = 0 OR (m = 2 AND (l_suppkey // 4) % 2 = 0) THEN 0.5e0 * p + 0.5e0 * y WHEN m = 1 THEN 0.5e0 * p + 0.5e0 * (1 - y)
      WHEN m = 2 THEN 0.9e0 * p + 0.1e0 * (1 - y) ELSE 0.95e0 * p + 0.05e0 * (1 - y) END AS p_proxy
  FROM (SELECT *, l_suppkey % 4 AS m, CAST(l_returnflag = 'R' AS INT) AS y, l_discount * 10 AS p FROM lineitem))"""


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.paired_losses(predictions(spark, sf_dir), {5.0: (1 / 6, 1 / 6)})


def _log_loss(p: str) -> str:
    kept = f"greatest(1e-6, least(1 - 1e-6, {p}))"
    return f"CASE WHEN y = 1 THEN -ln({kept}) ELSE -ln(1 - {kept}) END / -ln(1e-6)"


def _cost(p: str) -> str:
    return f"(CASE WHEN y = 1 AND {p} < 1.0e0 / 6 THEN 5.0e0 ELSE 0.0e0 END + CASE WHEN y = 0 AND {p} >= 1.0e0 / 6 THEN 1.0e0 ELSE 0.0e0 END) / 5.0e0"


PAIRED = PREDICTIONS + ", paired AS (SELECT *, brier_proxy - brier_source AS brier_regret, logloss_proxy - logloss_source AS logloss_regret, cost5x_proxy - cost5x_source AS cost5x_regret FROM (SELECT *, " + ", ".join(
    f"(p_{w} - y) * (p_{w} - y) AS brier_{w}, {_log_loss(f'p_{w}')} AS logloss_{w}, {_cost(f'p_{w}')} AS cost5x_{w}" for w in ("source", "proxy")
) + " FROM predictions))"


def audit_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.long_losses(paired(spark, sf_dir), ["mechanism", "candidate"], RELATIVE)


def audit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same losses as statistics by mechanism, candidate and requirement."""
    return losses.wide_statistics(paired(spark, sf_dir), ["mechanism", "candidate"], RELATIVE)


LOSSES = PAIRED + ", losses AS (" + " UNION ALL ".join(f"SELECT mechanism, candidate, '{r}' AS requirement, {r} AS value FROM paired" for r in RELATIVE) + ")"


def requirement_sql(rows) -> str:
    return "requirements(requirement, tolerance, lower, upper, slack, ramp) AS (VALUES " + ", ".join(f"('{r[0]}', {', '.join(f'{x!r}e0' for x in r[1:])})" for r in rows) + ")"


STATS = LOSSES + ", " + requirement_sql(REQUIREMENTS) + """, stats AS (
  SELECT mechanism, candidate, requirement, n, mean, var, tolerance, lower, upper FROM (
    SELECT mechanism, candidate, requirement, count(value) AS n, avg(value) AS mean, var_samp(value) AS var FROM losses GROUP BY ALL) JOIN requirements USING (requirement))"""


def target_releases(spark: SparkSession) -> DataFrame:
    """``(mechanism, candidate, release, level)``: the declared releases of a safe mechanism, one at the limit and a failing one."""
    m = F.col("m")
    level = F.when(m == 0, 0.4).when(m == 1, 0.4 + 0.01 * (F.col("release") % 20)).otherwise(1.0)
    grid = spark.range(3).select(F.col("id").alias("m")).crossJoin(spark.range(RELEASES).select(F.col("id").alias("release")))
    name = F.concat(F.lit("shared::m"), m.cast("string"))
    return grid.select(name.alias("mechanism"), F.concat(name, F.lit("::r"), F.col("release").cast("string")).alias("candidate"), "release", level.alias("level"))


def _share(record: Column) -> Column:
    return F.pmod(record * 31 + F.col("release") * 17, F.lit(100)) / 100.0


#: Losses of a release of :func:`target_releases` on a record.
TARGET_LOSSES = {"error": lambda record: (_share(record) < 0.6 * F.col("level")).cast("double"), "brier": lambda record: _share(record) * F.col("level")}


def target_wide(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Every order beside every release of three mechanisms; ``orders`` may be some of them, with columns of their own."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority") if orders is None else orders
    rows = orders.crossJoin(F.broadcast(target_releases(spark)))
    own = [c for c in orders.columns if c not in ("o_orderkey", "o_orderpriority")]
    return rows.select("mechanism", "candidate", F.col("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("stratum"), *[f(F.col("o_orderkey")).alias(n) for n, f in TARGET_LOSSES.items()], *own)


def target_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.long_losses(target_wide(spark, sf_dir), ["mechanism", "candidate", "record_id", "stratum"], ["error", "brier"])


def target_statistics(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """Count, mean and variance of the same losses by release and requirement, and ``by``."""
    return losses.wide_statistics(target_wide(spark, sf_dir), ["mechanism", "candidate", *by], ["error", "brier"])


TARGET = """
shared AS (
  SELECT concat('shared::m', m) AS mechanism, concat('shared::m', m, '::r', r) AS candidate, o_orderkey AS record_id, o_orderpriority AS stratum,
    CASE WHEN x < 0.6e0 * level THEN 1.0e0 ELSE 0.0e0 END AS error, x * level AS brier
  FROM (SELECT *, ((o_orderkey * 31 + r * 17) % 100) / 100.0e0 AS x, CASE WHEN m = 0 THEN 0.4e0 WHEN m = 1 THEN 0.4e0 + 0.01e0 * (r % 20) ELSE 1.0e0 END AS level
    FROM orders, range(3) AS a(m), range(40) AS b(r))),
target AS (SELECT mechanism, candidate, record_id, stratum, 'error' AS requirement, error AS value FROM shared UNION ALL SELECT mechanism, candidate, record_id, stratum, 'brier', brier FROM shared),
means AS (SELECT mechanism, candidate, requirement, avg(value) AS mean, count(value) AS n FROM target GROUP BY ALL), """ + requirement_sql(TARGET_REQUIREMENTS)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, y, p, keys...): proxy scores by mechanism."""
    return predictions(spark, sf_dir).select(*KEYS, F.col("mechanism").alias("g"), "y", F.col("p_proxy").alias("p"))


SCORED = PREDICTIONS + ", scored AS (SELECT *, mechanism AS g, p_proxy AS p FROM predictions)"

#: Registered levels of the two categorical features, declared whatever the rows hold; and the classes.
FEATURES = ["l_returnflag", "l_linestatus"]
DOMAIN = [*[("l_returnflag", x) for x in ("A", "N", "R", "?")], *[("l_linestatus", x) for x in ("F", "O", "P")]]


def registered_domain(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """``(feature, level)`` and ``(y)``."""
    return spark.createDataFrame(DOMAIN, "feature string, level string"), spark.createDataFrame([(0,), (1,)], "y int")


#: Components of a vector, all of which the attacks on raw vectors read.
DIMS = 64


def attack_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Query rows (members below label 4, nonmembers 4 to 7) and synthetic rows (8 and 9), as they are."""
    v = F.col("embedding").cast("array<double>")
    e = table(spark, sf_dir, "embeddings")
    asks = e.where("label < 8").select(F.col("vec_id").alias("query_id"), v.alias("v"), (F.col("label") < 4).cast("int").alias("member"))
    return asks, e.where("label >= 8").select(F.col("vec_id").alias("syn_id"), v.alias("s"))


def whole_attack_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Query, synthetic and reference (nonmember) rows of whole vectors, in the representation fitted on the reference."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    e = attacks.fit_representation(e.where("label between 4 and 7"), "embedding")(e, "embedding")
    asks = e.where("label < 8").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"), (F.col("label") < 4).cast("int").alias("member"))
    ref = asks.where("member = 0").select(F.col("query_id").alias("syn_id"), F.col("v").alias("s"))
    return asks, e.where("label >= 8").select(F.col("vec_id").alias("syn_id"), F.col("embedding").alias("s")), ref


ATTACK = """
asks AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label < 4 AS INT) AS member FROM embeddings WHERE label < 8),
syn AS (SELECT vec_id AS syn_id, CAST(embedding AS DOUBLE[]) AS s FROM embeddings WHERE label >= 8),
pairs AS (SELECT query_id, member, syn_id, sqrt(list_sum([(v[i] - s[i]) * (v[i] - s[i]) for i in range(1, 65)])) AS d FROM asks, syn),
scores AS (SELECT query_id, member, -min(d) AS score FROM pairs GROUP BY ALL)"""
