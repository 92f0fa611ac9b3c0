"""Audit designs as a table: enumerate, prune by cost, project the bound, and take the best of each scenario."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas as fx


def designs(scenarios: DataFrame, targets: DataFrame, releases: DataFrame, alpha: float, kl: float, target_share: float = 0.5) -> DataFrame:
    """``scenarios(scenario, success, release_cost, target_cost, budget)`` with every affordable (n, R, mode) and its
    projected bound: named = Clopper-Pearson at floor(R p); direct = the same less kappa / delta_target."""
    grid = scenarios.crossJoin(F.broadcast(targets)).crossJoin(F.broadcast(releases))
    grid = grid.withColumn("cost", F.col("releases") * F.col("release_cost") + F.col("target") * F.col("target_cost")).where(F.col("cost") <= F.col("budget"))
    k = F.floor(F.col("releases") * F.col("success"))
    named = fx.clopper_pearson("releases", k, alpha)
    kappa = F.exp(-F.col("target") * kl) / (alpha * target_share)
    direct = F.greatest(F.lit(0.0), fx.clopper_pearson("releases", k, alpha * (1 - target_share)) - F.least(F.lit(1.0), kappa))
    return grid.withColumn("mode", F.explode(F.array(F.lit("named"), F.lit("direct")))).withColumn("bound", F.when(F.col("mode") == "named", named).otherwise(direct))


def recommend(grid: DataFrame) -> DataFrame:
    """The best design of each scenario: highest bound, then lower cost, fewer target rows, fewer releases, direct first."""
    order = Window.partitionBy("scenario").orderBy(F.round("bound", 9).desc(), "cost", "target", "releases", "mode")
    return grid.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def pilot_sensitivity(scenarios: DataFrame, errors: list[float], targets: DataFrame, releases: DataFrame, alpha: float, kl: float) -> DataFrame:
    """What plans lose whose pilot missed the success rate by each error: by release cost the mean and largest regret
    against the best plan at the true rate, and how often the mode changes."""
    spark = scenarios.sparkSession
    asked = scenarios.crossJoin(F.broadcast(spark.createDataFrame([(e,) for e in errors], "error double")))
    asked = asked.withColumn("plan", F.concat_ws("|", "scenario", F.col("error").cast("string")))
    guess = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("success") + F.col("error")))
    true = designs(asked.drop("scenario").withColumnRenamed("plan", "scenario"), targets, releases, alpha, kl)
    planned = designs(asked.withColumn("success", guess).drop("scenario").withColumnRenamed("plan", "scenario"), targets, releases, alpha, kl)
    key = ["scenario", "target", "releases", "mode"]
    achieved = recommend(planned).select(*key).join(true.select(*key, "release_cost", "bound"), key)
    best = recommend(true).select("scenario", F.col("bound").alias("oracle"), F.col("mode").alias("oracle_mode"))
    rows = achieved.join(best, "scenario").withColumn("regret", F.greatest(F.lit(0.0), F.col("oracle") - F.col("bound")))
    changed = F.avg((F.col("mode") != F.col("oracle_mode")).cast("double"))
    return rows.groupBy("release_cost").agg(F.count(F.lit(1)).alias("plans"), F.avg("regret").alias("mean_regret"), F.max("regret").alias("max_regret"), changed.alias("mode_change_rate"))
