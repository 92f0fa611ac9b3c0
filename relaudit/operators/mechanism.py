"""Inference on mechanisms, the randomised procedures behind releases, from the evidence of their releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..sources.tables import staged
from . import evidence as ev


def simes_count(summary: DataFrame, alpha: Column | float) -> DataFrame:
    """``(mechanism, recognised)``: releases that Simes partial conjunction recognises, the k up to which there is always
    a j >= k with p_(j) <= alpha (j - k + 1) / (R - k + 1).

    Solved for k, a place j serves all k up to R + 1 - alpha (R - j) / (alpha - p_(j)), so the count is a maximum.
    """
    a = alpha if isinstance(alpha, Column) else F.lit(alpha)
    own = Window.partitionBy("mechanism")
    rows = summary.select("mechanism", F.col("candidate_p").alias("p"), F.row_number().over(own.orderBy("candidate_p")).alias("j"), F.count(F.lit(1)).over(own).alias("n"))
    upto = F.when(F.col("p") < a, F.floor(F.col("n") + 1 - a * (F.col("n") - F.col("j")) / (a - F.col("p")) + 1e-9)).when((F.col("p") == a) & (F.col("j") == F.col("n")), F.col("n"))
    return rows.groupBy("mechanism").agg(F.greatest(F.lit(0), F.coalesce(F.max(F.when(upto.isNotNull(), F.least("j", upto))), F.lit(0))).cast("long").alias("recognised"))


def fisher_count(summary: DataFrame, alpha: float) -> DataFrame:
    """``(mechanism, recognised)`` as :func:`simes_count`, with Fisher's combination of the p-values from k on: a suffix
    sum, and the chi-square tail of even degrees by :func:`formulas.gamma_tail`, in log space and at one cost for any rank."""
    own = Window.partitionBy("mechanism")
    down = own.orderBy(F.desc("candidate_p"), "candidate")
    x = -F.sum(F.log(F.greatest("candidate_p", F.lit(1e-300)))).over(down.rowsBetween(Window.unboundedPreceding, 0))
    rows = summary.select("mechanism", x.alias("x"), F.row_number().over(down).alias("m"))
    rows = rows.withColumn("ok", fx.gamma_tail("m", "x") <= alpha)
    on = F.min("ok").over(own.orderBy(F.desc("m")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("on", on).groupBy("mechanism").agg(F.count_if("on").alias("recognised"))


def validity_p(releases: Column, recognised: Column, reliability: float) -> Column:
    """P(Bin(R, reliability) >= V)."""
    return fx.binomial_tail(releases, recognised, F.lit(reliability), upper=True)


def violation_p(releases: Column, failed: Column, reliability: float) -> Column:
    """P(Bin(R, reliability) <= R - F)."""
    return fx.binomial_tail(releases, releases - failed, F.lit(reliability), upper=False)


def mechanism_of(candidate: Column) -> Column:
    """``dataset::mechanism`` of ``dataset::mechanism::release``."""
    parts = F.split(candidate, "::")
    return F.when(F.size(parts) == 3, F.concat_ws("::", parts[0], parts[1]))


def release_counts(summary: DataFrame, local_alpha: Column | float, mode: str = "holm") -> DataFrame:
    """Releases, recognised and violated ones by mechanism, from ``(mechanism, candidate, candidate_p, violation_detected)``."""
    if mode not in ("holm", "simes"):
        raise ValueError("mode is holm or simes")
    rows = ev.holm(summary, "candidate_p", ["candidate"], ["mechanism"], "_within")
    alone = F.count_if(F.col("candidate_p") <= local_alpha)
    out = rows.groupBy("mechanism").agg(F.count(F.lit(1)).alias("releases"), F.count_if(F.col("_within") <= local_alpha).alias("validated_releases"), alone.alias("individually_validated"), F.count_if("violation_detected").alias("violated_releases"))
    if mode == "simes":
        out = out.join(simes_count(summary, local_alpha), "mechanism").withColumn("validated_releases", F.col("recognised")).drop("recognised")
    return out


def mechanism_audit(losses: DataFrame, requirements: DataFrame, reliability: float = 0.8, alpha: float = 0.05, share: float = 0.5, violation_alpha: float = 0.05, violation_share: float = 0.5, mode: str = "holm", collective: bool = False, method: str = "empirical_bernstein") -> DataFrame:
    """Two-level audit: releases at their share of the error, mechanisms at the rest; statuses and reliability bounds, beside
    the error rates that they stand on.

    ``losses(mechanism, candidate, requirement, value)``. Violations of releases come from the family of all of them.
    """
    if mode == "simes" and not collective:
        raise ValueError("Simes counts need collective dependence to be verified")
    release_alpha, release_violation = alpha * share, violation_alpha * violation_share
    losses = staged(ev.sufficient_statistics(losses, "mechanism", "candidate", "requirement"), "statistics")
    names = losses.select("candidate", "mechanism").distinct()
    detail = ev.requirement_detail(losses, requirements, release_alpha, release_violation, method)
    summary = staged(ev.candidate_summary(detail, release_alpha).join(names, "candidate"), "releases")
    m = summary.select("mechanism").distinct().count()
    counts = release_counts(summary, release_alpha / max(m, 1), mode)
    rows = counts.withColumns({
        "validity_p": validity_p(F.col("releases"), F.col("validated_releases"), reliability),
        "violation_p": violation_p(F.col("releases"), F.col("violated_releases"), reliability),
        "reliability_lcb": fx.clopper_pearson("releases", "validated_releases", (alpha - release_alpha) / max(m, 1)),
        "reliability_ucb": fx.clopper_pearson("releases", F.col("releases") - F.col("violated_releases"), (violation_alpha - release_violation) / max(m, 1), upper=True),
    })
    rows = ev.holm(rows, "validity_p", ["mechanism"], [], "validity_adjusted_p")
    rows = ev.holm(rows, "violation_p", ["mechanism"], [], "violation_adjusted_p")
    good, bad = F.col("validity_adjusted_p") <= alpha - release_alpha, F.col("violation_adjusted_p") <= violation_alpha - release_violation
    spent = error_budget(alpha, share, violation_alpha, violation_share) | {"local_release_alpha": release_alpha / max(m, 1), "total_alpha": alpha, "violation_total_alpha": violation_alpha}
    rows = rows.withColumns({"validated": good, "violation_detected": bad, "status": ev.status(good, bad), "minimum_reliability": F.lit(reliability)})
    return rows.withColumns({k: F.lit(float(x)) for k, x in spent.items()} | {"mode": F.lit(mode), "collective": F.lit(collective)})


def error_budget(alpha: float, share: float, violation_alpha: float, violation_share: float) -> dict[str, float]:
    """How the two error rates split over releases and mechanisms, and the coverage that each split leaves."""
    release, violation = alpha * share, violation_alpha * violation_share
    return {
        "release_alpha": release, "mechanism_alpha": alpha - release, "release_violation_alpha": violation,
        "mechanism_violation_alpha": violation_alpha - violation, "lower_coverage": 1 - alpha, "upper_coverage": 1 - violation_alpha,
        "joint_coverage": max(0.0, 1 - alpha - violation_alpha),
    }


def planning_table(pilots: DataFrame, alpha: float) -> DataFrame:
    """``pilots(reliability, mechanisms)`` with the all-good releases that a mechanism needs: ceil(ln(alpha / M) / ln(reliability)); null for a reliability of 0 or 1."""
    need = F.ceil(F.round(F.log(F.lit(alpha) / F.col("mechanisms")) / F.log("reliability"), 9))
    return pilots.withColumn("releases_needed", F.when((F.col("reliability") > 0) & (F.col("reliability") < 1), need))


def diagnostics(rows: DataFrame) -> DataFrame:
    """First settings, and mean and sample deviation of each change, by mechanism: ``(mechanism, auc_change, cost_change)``."""
    return rows.groupBy("mechanism").agg(*[f(c).alias(f"{n}_{c}") for c in ("auc_change", "cost_change") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def stratified_named_summary(evidence: DataFrame, reliability: float, alpha: float, share: float = 0.5) -> DataFrame:
    """Mechanism decisions from stratified evidence: releases by Holm on their largest validation p-value within the
    mechanism, violations by Holm over all components, bounds against the reliability asked for."""
    release = alpha * share
    per = evidence.groupBy("mechanism", "candidate").agg(F.max("validation_p").alias("candidate_p"))
    bad = ev.holm(evidence, "violation_p", ["candidate", "requirement"], [], "_adj").groupBy("candidate").agg(F.bool_or(F.col("_adj") <= release).alias("violation_detected"))
    m = per.select("mechanism").distinct().count()
    rows = release_counts(per.join(bad, "candidate"), release / m)
    outer = (alpha - release) / m
    rows = rows.withColumns({"lcb": fx.clopper_pearson("releases", "validated_releases", outer), "ucb": fx.clopper_pearson("releases", F.col("releases") - F.col("violated_releases"), outer, upper=True)})
    return rows.withColumn("status", ev.status(F.col("lcb") >= reliability, F.col("ucb") < reliability))
