"""Evidence for candidates: one grouped pass over losses, then closed forms on what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas as fx

BOUNDS = ("empirical_bernstein", "hoeffding")


def sufficient_statistics(losses: DataFrame, *keys: str) -> DataFrame:
    """Count, mean and sample variance of ``value`` for each key: all that any bound needs. One partial aggregation.

    Losses that are such statistics already, of the same keys, stay as they are; so wherever losses are asked for here.
    """
    if {"n", "mean", "var"} <= set(losses.columns):
        return losses.select(*keys, "n", "mean", "var")
    return losses.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))


def badness_p(method: str, violation: bool = False) -> Column:
    """p-value over columns n, mean, var, tolerance, lower, upper."""
    if method not in BOUNDS:
        raise ValueError(f"bound method {method!r} is not one of {BOUNDS}")
    if method == "hoeffding":
        return fx.hoeffding_p("n", "mean", "tolerance", "lower", "upper", violation)
    return fx.bernstein_p("n", "mean", "var", "tolerance", "lower", "upper", violation)


def bound(method: str, error: Column, upper: bool) -> Column:
    if method == "hoeffding":
        return (fx.hoeffding_ucb if upper else fx.hoeffding_lcb)("n", "mean", error, "lower", "upper")
    return (fx.bernstein_ucb if upper else fx.bernstein_lcb)("n", "mean", "var", error, "lower", "upper")


def holm(rows: DataFrame, p: str, name: list[str], family: list[str], out: str) -> DataFrame:
    """Holm step-down adjusted p-values within each family, ties in order of ``name``; a family is aggregated rows."""
    own = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    order = own.orderBy(p, *name)
    ranked = rows.withColumn("_stepped", (F.count(F.lit(1)).over(own) - F.row_number().over(order) + 1) * F.col(p))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.max("_stepped").over(upto))).drop("_stepped")


def holm_rejections(rows: DataFrame, p: str, name: list[str], family: list[str], alpha: float, out: str = "rejected") -> DataFrame:
    """Holm decisions by family: each p-value against alpha / (m - i + 1), until the first that fails."""
    own = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    order = own.orderBy(p, *name)
    ok = F.col(p) <= alpha / (F.count(F.lit(1)).over(own) - F.row_number().over(order) + 1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_ok", ok).withColumn(out, F.min("_ok").over(upto)).drop("_ok")


def requirement_detail(losses: DataFrame, requirements: DataFrame, alpha: float = 0.05, violation_alpha: float = 0.05, method: str = "empirical_bernstein") -> DataFrame:
    """Evidence for each candidate and requirement, with a simultaneous interval and violation decisions."""
    stats = sufficient_statistics(losses, "candidate", "requirement").join(F.broadcast(requirements), "requirement")
    every = Window.partitionBy(F.lit(0))
    rows = stats.withColumns({
        "badness_p": badness_p(method), "violation_p": badness_p(method, violation=True),
        "upper_bound": bound(method, F.lit(alpha), True), "lower_bound": bound(method, F.lit(violation_alpha), False),
    })
    rows = rows.withColumn("_each", F.lit(alpha) / (2 * F.count(F.lit(1)).over(every)))
    rows = rows.withColumns({"simultaneous_lcb": bound(method, F.col("_each"), False), "simultaneous_ucb": bound(method, F.col("_each"), True)}).drop("_each")
    rows = holm(rows, "violation_p", ["candidate", "requirement"], [], "violation_adjusted_p")
    return rows.withColumn("violation_detected", F.col("violation_adjusted_p") <= violation_alpha)


def status(validated: Column, violated: Column) -> Column:
    return F.when(validated, "Validated").when(violated, "Violation detected").otherwise("Unresolved")


def candidate_summary(detail: DataFrame, alpha: float = 0.05, family: list[str] | None = None) -> DataFrame:
    """A candidate is bad if any requirement is, so its p-value is the largest; Holm runs over the family."""
    family = family or []
    rows = detail.groupBy(*family, "candidate").agg(
        F.count(F.lit(1)).alias("requirements"), F.min("n").alias("audit_n_min"), F.max("badness_p").alias("candidate_p"),
        F.bool_or("violation_detected").alias("violation_detected"), F.max("upper_bound").alias("worst_upper_bound"),
    )
    rows = holm(rows, "candidate_p", ["candidate"], family, "holm_adjusted_p")
    rows = rows.withColumn("validated", F.col("holm_adjusted_p") <= alpha)
    return rows.withColumn("status", status(F.col("validated"), F.col("violation_detected")))


def candidate_audit(losses: DataFrame, requirements: DataFrame, alpha: float = 0.05, violation_alpha: float = 0.05, method: str = "empirical_bernstein") -> DataFrame:
    return candidate_summary(requirement_detail(losses, requirements, alpha, violation_alpha, method), alpha)


def comparison_rules(detail: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Four decisions for each candidate: point threshold, uncorrected, Bonferroni and Holm."""
    rows = detail.groupBy("candidate").agg(F.bool_and(F.col("mean") <= F.col("tolerance")).alias("point"), F.max("badness_p").alias("candidate_p"))
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    rows = rows.withColumns({"uncorrected": F.col("candidate_p") <= alpha, "bonferroni": F.col("candidate_p") <= alpha / m})
    return holm_rejections(rows, "candidate_p", ["candidate"], [], alpha, "holm")


def alone_and_joint(losses: DataFrame, requirements: DataFrame, alpha: float = 0.05, violation_alpha: float = 0.05, method: str = "empirical_bernstein") -> DataFrame:
    """Each candidate's status in the joint family beside its status when audited alone."""
    detail = requirement_detail(losses, requirements, alpha, violation_alpha, method)
    joint = candidate_summary(detail, alpha).select("candidate", F.col("status").alias("joint_status"))
    own = holm(detail.drop("violation_adjusted_p", "violation_detected"), "violation_p", ["requirement"], ["candidate"], "adjusted")
    own = own.groupBy("candidate").agg(F.max("badness_p").alias("p"), F.bool_or(F.col("adjusted") <= violation_alpha).alias("bad"))
    return joint.join(own.select("candidate", status(F.col("p") <= alpha, F.col("bad")).alias("alone_status")), "candidate")


def validate_losses(losses: DataFrame, requirements: DataFrame) -> DataFrame:
    """The losses, after a check that fails the job: finite values inside the bounds, the same requirements for all."""
    seen = losses.groupBy("candidate", "requirement").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_if(F.col("value").isNull() | F.isnan("value")).alias("bad")
    )
    seen = seen.join(F.broadcast(requirements), "requirement", "left")
    wrong = seen.where(F.col("lower").isNull() | (F.col("bad") > 0) | (F.col("lo") < F.col("lower") - 1e-12) | (F.col("hi") > F.col("upper") + 1e-12)).limit(1).collect()
    if wrong:
        raise ValueError(f"losses of {wrong[0]['candidate']} for {wrong[0]['requirement']} are null, not finite or out of bounds")
    short = seen.groupBy("candidate").count().where(F.col("count") != requirements.count()).limit(1).collect()
    if short:
        raise ValueError(f"{short[0]['candidate']} lacks a requirement")
    return losses
