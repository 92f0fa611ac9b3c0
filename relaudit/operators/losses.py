"""Losses of predictions: paired (source against proxy), absolute, and their long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def brier(y: Column, p: Column) -> Column:
    return (p - y) * (p - y)


def log_loss(y: Column, p: Column, clip: float = 1e-6) -> Column:
    """Clipped and divided by its largest value, so in [0, 1]."""
    kept = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))
    return F.when(y == 1, -F.log(kept)).otherwise(-F.log(1 - kept)) / -F.log(F.lit(clip))


def cost_loss(y: Column, p: Column, threshold: Column | float, cost: float) -> Column:
    """A missed positive costs ``cost``, a false alarm 1; divided by the larger of them."""
    at = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (F.when((y == 1) & (p < at), cost).otherwise(0.0) + F.when((y == 0) & (p >= at), 1.0).otherwise(0.0)) / max(cost, 1.0)


def paired_losses(rows: DataFrame, thresholds: dict[float, tuple[float, float]], clip: float = 1e-6) -> DataFrame:
    """``rows(y, p_source, p_proxy, ...)`` with source, proxy and regret columns of every loss.

    ``thresholds`` has a source and a proxy threshold for each cost of a missed positive.
    """
    y = F.col("y")
    out: dict[str, Column] = {}
    for who, k in (("source", 0), ("proxy", 1)):
        p = F.col(f"p_{who}")
        out[f"brier_{who}"], out[f"logloss_{who}"] = brier(y, p), log_loss(y, p, clip)
        for cost, both in thresholds.items():
            out[f"cost{int(cost)}x_{who}"] = cost_loss(y, p, both[k], cost)
    rows = rows.withColumns(out)
    names = ["brier", "logloss", *[f"cost{int(c)}x" for c in thresholds]]
    return rows.withColumns({f"{n}_regret": F.col(f"{n}_proxy") - F.col(f"{n}_source") for n in names})


def constant_policies(rows: DataFrame, group: list[str], cost: float, source_threshold: float, clip: float = 1e-6) -> DataFrame:
    """``(group..., policy, threshold, brier_risk, logloss_risk, cost5x_risk)`` on part 2 of ``rows(group..., y, p_source, part)``: the source
    at its threshold, and constants 0.5 and the prevalence of part 0, whose threshold is 0 (call all) or 1 (call none),
    whichever costs less on part 1, and 0 if both cost the same.

    A constant's losses depend on the label alone, so one aggregate of each part is all that is read of the rows.
    """
    y, part = F.col("y"), F.col("part")
    pos = lambda k: F.count_if((part == k) & (y == 1)).cast("double")
    neg = lambda k: F.count_if((part == k) & (y == 0)).cast("double")
    audited = lambda x: F.avg(F.when(part == 2, x))
    p = F.col("p_source")
    one = rows.groupBy(*group).agg(
        (pos(0) / (pos(0) + neg(0))).alias("q"), (cost * pos(1) < neg(1)).alias("none"), pos(2).alias("pos"), neg(2).alias("neg"),
        audited(brier(y, p)).alias("b"), audited(log_loss(y, p, clip)).alias("l"), audited(cost_loss(y, p, source_threshold, cost)).alias("c"),
    )
    n, threshold = F.col("pos") + F.col("neg"), F.when(F.col("none"), 1.0).otherwise(0.0)
    mean = lambda f, c: (F.col("pos") * f(F.lit(1), c) + F.col("neg") * f(F.lit(0), c)) / n
    row = lambda name, t, b, l, c: F.struct(F.lit(name).alias("policy"), t.alias("threshold"), b.alias("brier_risk"), l.alias("logloss_risk"), c.alias("cost5x_risk"))
    constant = lambda name, c: row(name, threshold, mean(brier, c), mean(lambda y, x: log_loss(y, x, clip), c), mean(lambda y, x: cost_loss(y, x, threshold, cost), c))
    each = F.explode(F.array(row("source", F.lit(source_threshold), F.col("b"), F.col("l"), F.col("c")), constant("half", F.lit(0.5)), constant("prevalence", F.col("q"))))
    return one.select(*group, each.alias("x")).select(*group, "x.*")


def long_losses(wide: DataFrame, keys: list[str], requirements: list[str]) -> DataFrame:
    """One row for each key and requirement; a narrow unpivot."""
    return wide.unpivot(keys, requirements, "requirement", "value")


def wide_statistics(wide: DataFrame, keys: list[str], requirements: list[str]) -> DataFrame:
    """``(keys..., requirement, n, mean, var)`` of losses in columns: they aggregate first, and only the aggregates are
    laid out as rows."""
    one = lambda r: F.struct(F.count(r).alias("n"), F.avg(r).alias("mean"), F.var_samp(r).alias("var")).alias(r)
    rows = wide.groupBy(*keys).agg(*[one(r) for r in requirements])
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("requirement"), f"{r}.n", f"{r}.mean", f"{r}.var") for r in requirements]))
    return rows.select(*keys, each.alias("s")).select(*keys, "s.*")


def weighted_statistics(wide: DataFrame, keys: list[str], requirements: list[str], weight: str) -> DataFrame:
    """:func:`wide_statistics` of rows that stand for ``weight`` equal ones each."""
    w, n = F.col(weight), F.sum(weight)
    one = lambda r: F.struct(n.cast("long").alias("n"), (F.sum(w * F.col(r)) / n).alias("mean"), F.when(n > 1, (F.sum(w * F.col(r) * F.col(r)) - F.sum(w * F.col(r)) * F.sum(w * F.col(r)) / n) / (n - 1)).alias("var")).alias(r)
    rows = wide.groupBy(*keys).agg(*[one(r) for r in requirements])
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("requirement"), f"{r}.n", f"{r}.mean", F.greatest(f"{r}.var", F.lit(0.0)).alias("var")) for r in requirements]))
    return rows.select(*keys, each.alias("s")).select(*keys, "s.*")


def absolute_losses(rows: DataFrame, p: str, threshold: float, miss: float, alarm: float) -> DataFrame:
    """``rows`` with error, Brier and cost = miss * FN + alarm * FP."""
    y, q = F.col("y"), F.col(p)
    called = (q >= threshold).cast("int")
    return rows.withColumns({
        "error": (called != y).cast("double"), "brier": brier(y, q),
        "cost": F.when((y == 1) & (called == 0), miss).otherwise(0.0) + F.when((y == 0) & (called == 1), alarm).otherwise(0.0),
    })


def failed_as_one(registered: DataFrame, losses: DataFrame, keys: list[str]) -> DataFrame:
    """Losses of every registered release; one that is missing lost 1 throughout."""
    return registered.join(losses, keys, "left").withColumn("value", F.coalesce("value", F.lit(1.0)))


def risk_limits(risks: DataFrame, budget: float, ceiling: float) -> DataFrame:
    """``risks(requirement, risk)`` with ``limit`` = risk + budget, at most the ceiling."""
    return risks.withColumn("limit", F.least(F.col("risk") + budget, F.lit(ceiling)))


def rounded_ceiling(x: Column, digits: int = 3) -> Column:
    scale = 10.0**digits
    return F.ceil(x * scale - 1e-12) / scale


def pilot_limits(risks: DataFrame, guard: float, slack: float, lower: float = 0.0, upper: float = 1.0) -> DataFrame:
    """``risks(requirement, risk)``, several rows for a requirement if several pilots measured it, with ``cutoff`` = the greatest
    risk and a guard, and ``tolerance`` = cutoff and slack, each rounded up to three decimals. Limits that leave the
    losses' domain are an error: such a requirement would ask nothing."""
    rows = risks.groupBy("requirement").agg(rounded_ceiling(F.max("risk") + guard).alias("cutoff"))
    rows = rows.withColumn("tolerance", rounded_ceiling(F.col("cutoff") + slack))
    if bad := [r.requirement for r in rows.where(~((F.col("cutoff") > lower) & (F.col("tolerance") < upper))).collect()]:
        raise ValueError(f"limits outside ({lower}, {upper}): {', '.join(sorted(bad))}")
    return rows


def margins(means: DataFrame, limits: DataFrame) -> DataFrame:
    """The least distance of a release's risks from their limits."""
    return means.join(F.broadcast(limits), "requirement").groupBy("candidate").agg(F.min(F.col("limit") - F.col("mean")).alias("margin"))


def paired_records(source: DataFrame, proxy: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one join of two prediction tables on ``keys``; fails on repeated keys, missing partners or other labels."""
    for name, side in (("source", source), ("proxy", proxy)):
        if side.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ValueError(f"{name} records are not unique")
    both = source.select(*keys, F.col("y"), F.col("p").alias("p_source")).join(
        proxy.select(*keys, F.col("y").alias("y_proxy"), F.col("p").alias("p_proxy")), keys, "full_outer"
    )
    if both.where(F.col("y").isNull() | F.col("y_proxy").isNull() | (F.col("y") != F.col("y_proxy"))).limit(1).count():
        raise ValueError("records do not align one to one with equal labels")
    return both.drop("y_proxy")
