"""Prediction quality by group, from ``scored(group..., y, p)``."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..sources.tables import staged
from . import losses, splits


def running_sums(cells: DataFrame, group: list[str], by: str, sums: dict[str, str], parts: int = 200) -> DataFrame:
    """``cells(group..., by, ...)`` with sums of columns over a group's rows from the largest ``by`` down to each row's,
    ``sums`` naming them; a group has one row for each ``by``.

    Quantiles of ``by`` part the rows into ranges, so that no task orders a group: ranges are summed, and only within
    one is a running sum taken.
    """
    cuts = cells.agg(F.percentile_approx(by, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    cuts, step = [float(x) for x in sorted(set(cuts))], 15
    upto = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col(by)))
    every, coarse = (F.array(*[F.lit(x) for x in xs]).cast("array<double>") for xs in (cuts, cuts[step - 1 :: step]))
    below = F.transform(F.array(upto(coarse)), lambda k: k * step + upto(F.slice(every, k * step + 1, step)))[0]  # in two steps, each of about 15 cuts
    rows = cells.withColumn("_range", F.when(F.col(by).isNotNull(), len(cuts) - below).otherwise(0))
    key = [*group, "_range"]
    total = rows.groupBy(*key).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*key, *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    upto = Window.partitionBy(*key).orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()}).join(total, key)
    return rows.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_range", *[f"_{n}" for n in sums])


def weighted_auc(scored: DataFrame, releases: int, weight: str = "w") -> DataFrame:
    """``(release, auc)`` of ``scored(y, p, w array)``: ROC AUC with midranks of every bootstrap release, from one ordering of the
    scores; the releases are columns beside each other, and rows are not copied."""
    w = [F.get(weight, F.lit(r)) for r in range(releases)]
    names = {f"tp{r}": f"pos{r}" for r in range(releases)}
    cells = scored.groupBy("p").agg(*[F.sum(w[r] * F.col("y")).cast("long").alias(f"pos{r}") for r in range(releases)], *[F.sum(w[r] * (1 - F.col("y"))).cast("long").alias(f"neg{r}") for r in range(releases)])
    t = running_sums(cells, [], "p", names)
    one = lambda r: F.sum(F.col(f"neg{r}") * (F.col(f"tp{r}") - F.col(f"pos{r}") / 2)) / F.nullif(F.sum(f"pos{r}") * F.sum(f"neg{r}"), F.lit(0))
    wide = t.agg(*[one(r).alias(f"a{r}") for r in range(releases)])
    return wide.select(F.posexplode(F.array(*[f"a{r}" for r in range(releases)])).alias("release", "auc"))


#: Scores of one release in a range, about; ranges of a release at most; rows that a task counts at once.
RANGE_ROWS, RANGES, COUNTED_ROWS = 50_000, 200, 100_000


def beside_auc(scored: DataFrame) -> DataFrame:
    """``(release, auc)`` of ``scored(y, p array<double>)``: ROC AUC with midranks of every release, whose scores lie beside each other.

    Quantiles part a release's scores into ranges. A task hands on its counts of each distinct score, one row for each release
    and range of up to 100,000 of its rows; a range's counts are ordered together, and ranges meet as sums. Rows without a
    label and missing scores are left out. ``scored`` is read three times, so it should be staged.
    """
    kept = scored.where("y is not null and p is not null").select(F.col("y").cast("long").alias("y"), "p")
    parts = min(RANGES, math.ceil(kept.count() / RANGE_ROWS))
    cuts = {}
    if parts > 1:
        each = kept.select(F.posexplode("p").alias("release", "p")).where("p is not null").groupBy("release")
        cuts = {r.release: r.cuts for r in each.agg(F.percentile_approx("p", [i / parts for i in range(1, parts)], 2_000).alias("cuts")).collect()}

    def counted(y: np.ndarray, p: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
        out = {n: [] for n in ("release", "range", "p", "pos", "neg")}
        for r in range(p.shape[1]):
            score, at = np.unique(p[known[:, r], r], return_inverse=True)
            n = np.bincount(at, minlength=len(score))
            pos = np.bincount(at, weights=y[known[:, r]], minlength=len(score)).astype(np.int64)
            ends = [0, *np.searchsorted(score, cuts.get(r, [])), len(score)]
            for k, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if lo < hi:
                    for c, v in zip(out.values(), (r, k, score[lo:hi], pos[lo:hi], (n - pos)[lo:hi]), strict=True):
                        c.append(v)
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), kinds, strict=True)], list(out))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            if b.num_rows:
                p = b.column("p").flatten()
                held.append([b.column("y").to_numpy(), *[x.to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for x in (p, p.is_valid())]])
            if sum(len(h[0]) for h in held) >= COUNTED_ROWS:
                yield counted(*[np.concatenate(x) for x in zip(*held, strict=True)])
                held = []
        if held:
            yield counted(*[np.concatenate(x) for x in zip(*held, strict=True)])

    def within(t: pa.Table) -> pa.Table:
        p, pos, neg = (t.column(n).combine_chunks().flatten().to_numpy(zero_copy_only=False) for n in ("p", "pos", "neg"))
        score, at = np.unique(p, return_inverse=True)
        pos, neg = (np.bincount(at, weights=x, minlength=len(score)) for x in (pos, neg))
        pairs = (neg * (pos.sum() - pos.cumsum() + pos / 2)).sum()
        return pa.table({"release": t.column("release")[:1], "range": t.column("range")[:1], "pos": [int(pos.sum())], "neg": [int(neg.sum())], "pairs": [float(pairs)]})

    ranges = kept.mapInArrow(pieces, "release int, range int, p array<double>, pos array<long>, neg array<long>")
    ranges = ranges.groupBy("release", "range").applyInArrow(within, "release int, range int, pos long, neg long, pairs double")
    above = F.coalesce(F.sum("pos").over(Window.partitionBy("release").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pos, neg = F.sum("pos"), F.sum("neg")
    return ranges.withColumn("above", above).groupBy("release").agg(F.when((pos > 0) & (neg > 0), F.sum(F.col("pairs") + F.col("neg") * F.col("above")) / (pos * neg)).alias("auc"))


def _times(weight: str | None) -> Column:
    """How often a row counts: once, or as often as its column ``weight`` says."""
    return F.col(weight) if weight else F.lit(1)


def _mean(x: Column, weight: str | None) -> Column:
    return F.sum(x * F.col(weight)) / F.sum(F.when(x.isNotNull(), F.col(weight))) if weight else F.avg(x)


def ranking(scored: DataFrame, group: list[str], weight: str | None = None) -> DataFrame:
    """ROC AUC (midranks for ties) and average precision. Rows meet as counts of each distinct score."""
    by, y, n = [*group, "p"], F.col("y").cast("long"), _times(weight)
    t = scored.groupBy(*by).agg(F.sum(y * n).alias("pos"), F.sum((1 - y) * n).alias("neg"))
    t = running_sums(t, group, "p", {"tp": "pos", "fp": "neg"})
    pairs = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    all_pos, all_neg = F.sum("pos"), F.sum("neg")
    return t.groupBy(*group).agg(
        F.when((all_pos > 0) & (all_neg > 0), pairs / (all_pos * all_neg)).alias("auc"),
        F.when(all_pos > 0, F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / all_pos).alias("average_precision"),
    )


def classification(scored: DataFrame, group: list[str], threshold: float = 0.5, weight: str | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1, 0 where undefined."""
    called = F.col("p") >= threshold
    c = lambda test: F.sum(F.when(test, _times(weight)).otherwise(0)).cast("double")
    rows = scored.groupBy(*group).agg(c(called & (F.col("y") == 1)).alias("tp"), c(called & (F.col("y") == 0)).alias("fp"), c(~called & (F.col("y") == 1)).alias("fn"), c(~called & (F.col("y") == 0)).alias("tn"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return rows.select(*group, div(tp + tn, tp + fp + fn + tn).alias("accuracy"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def proper_scores(scored: DataFrame, group: list[str], clip: float = 1e-6, weight: str | None = None) -> DataFrame:
    """Brier score, log loss, support and positive rate."""
    y, p = F.col("y"), F.col("p")
    kept = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))
    return scored.groupBy(*group).agg(
        _mean(losses.brier(y, p), weight).alias("brier"), _mean(F.when(y == 1, -F.log(kept)).otherwise(-F.log(1 - kept)), weight).alias("log_loss"),
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("support"), _mean(y.cast("double"), weight).alias("positive_rate"),
    )


def ece(scored: DataFrame, group: list[str], bins: int = 10, weight: str | None = None) -> DataFrame:
    """Expected calibration error over equal-width bins; p = 1 lies beyond the last bin and is left out of the sum."""
    cells = scored.withColumn("bin", F.floor(F.col("p") * bins)).groupBy(*group, "bin").agg(F.sum(_times(weight)).alias("n"), _mean(F.col("p"), weight).alias("p"), _mean(F.col("y").cast("double"), weight).alias("y"))
    own = F.when(F.col("bin") < bins, F.col("n") * F.abs(F.col("p") - F.col("y"))).otherwise(0.0)
    return cells.groupBy(*group).agg((F.sum(own) / F.sum("n")).alias("ece"))


def adaptive_ece(scored: DataFrame, group: list[str], ties: list[str], bins: int = 10) -> DataFrame:
    """The same over bins of equal count, the first ones larger by one."""
    rows = splits.row_index(scored, F.struct(*group, "p"), *ties, out="_at")
    sizes = rows.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    same = F.lit(True)
    for g in group:
        same = same & rows[g].eqNullSafe(sizes[f"_{g}"])
    rows = rows.join(F.broadcast(sizes), same).withColumn("_i", F.col("_at") - F.col("_first"))
    each, more = F.floor(F.col("_n") / bins), F.col("_n") % bins
    late = F.col("_i") - more * (each + 1)
    bin_ = F.when(late < 0, F.floor(F.col("_i") / (each + 1))).otherwise(more + F.floor(late / F.greatest(each, F.lit(1))))
    cells = rows.withColumn("bin", bin_).groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"), F.avg(F.col("y").cast("double")).alias("y"))
    return cells.groupBy(*group).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("adaptive_ece"))


def decision_costs(scored: DataFrame, group: list[str], costs: tuple[float, ...] = (2, 5, 10, 20), threshold: float = 0.5) -> DataFrame:
    """Expected cost of a decision for each cost ratio, and relative to approving all."""
    y, p = F.col("y"), F.col("p")
    aggs: list[Column] = []
    for k in costs:
        own = F.avg(F.when((y == 1) & (p < threshold), float(k)).otherwise(0.0) + F.when((y == 0) & (p >= threshold), 1.0).otherwise(0.0))
        all_ = F.avg(y.cast("double")) * float(k)
        aggs += [own.alias(f"cost{k}x"), F.when(all_ > 0, own / all_).alias(f"relative_cost{k}x")]
    return scored.groupBy(*group).agg(*aggs)


def best_threshold(scored: DataFrame, group: list[str], cost: float, grid: int = 100) -> DataFrame:
    """The first of ``grid`` + 1 thresholds with least cost, from one histogram of grid cells and running sums."""
    cells = scored.withColumn("cell", F.floor(F.col("p") * grid + 1e-9).cast("int")).groupBy(*group, "cell").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))
    keys = cells.select(*group).distinct() if group else cells.select(F.lit(0).alias("_g")).distinct()
    every = keys.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(grid))))
    full = every.join(cells, [*group, "cell"], "left").fillna(0, ["pos", "neg"])
    own = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    below = own.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum(F.col("pos") + F.col("neg")).over(own)
    missed, alarms = F.coalesce(F.sum("pos").over(below), F.lit(0)), F.sum("neg").over(own) - F.coalesce(F.sum("neg").over(below), F.lit(0))
    rows = full.withColumn("cost", (missed * float(cost) + alarms) / n).withColumn("threshold", F.col("cell") / grid)
    rows = rows.withColumn("_r", F.row_number().over(own.orderBy("cost", "cell"))).where("_r = 1")
    return rows.select(*group, "threshold", "cost")


def temperature(scored: DataFrame, grid: int = 100, clip: float = 1e-6, group: list[str] | None = None) -> DataFrame:
    """The temperature with least log loss on a grid of log T in [-5, 5], of each group if there are any; one pass for
    all temperatures."""
    by = list(group or [])
    kept = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col("p")))
    t = F.explode(F.transform(F.sequence(F.lit(0), F.lit(grid)), lambda i: -5 + 10 * i / grid)).alias("log_t")
    rows = scored.groupBy(*by, "y", "p").agg(F.count(F.lit(1)).alias("n")).select("*", F.log(kept / (1 - kept)).alias("z"), t)
    x = F.when(F.col("y") == 1, -F.col("z")).otherwise(F.col("z")) / F.exp("log_t")
    soft = F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    each = rows.groupBy(*by, "log_t").agg((F.sum(soft * F.col("n")) / F.sum("n")).alias("log_loss"))
    if not by:
        return each.orderBy(F.round("log_loss", 12), "log_t").limit(1)
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.round("log_loss", 12), "log_t"))
    return each.withColumn("_r", first).where("_r = 1").drop("_r")


def apply_temperature(scored: DataFrame, log_t: Column | float, clip: float = 1e-6) -> DataFrame:
    """``scored`` with ``p`` softened or sharpened: the logistic function of logit(p) / T."""
    kept = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col("p")))
    t = F.exp(log_t if isinstance(log_t, Column) else F.lit(float(log_t)))
    return scored.withColumn("p", 1 / (1 + F.exp(-F.log(kept / (1 - kept)) / t)))


def subgroup_metrics(scored: DataFrame, subgroup: Column, threshold: float = 0.5) -> DataFrame:
    """The full row of metrics of each subgroup of ``scored(y, p)``: ranking, calls at the threshold, proper scores, calibration
    error and line. A null subgroup is ``missing``; with one class only, AUC, average precision and the line are null.

    One pass counts the rows of each class and score; all metrics come from the counts."""
    name = F.coalesce(subgroup.cast("string"), F.lit("missing"))
    rows = scored.select(name.alias("subgroup"), F.col("y").cast("int").alias("y"), F.col("p").cast("double").alias("p"))
    rows = staged(rows.groupBy("subgroup", "y", "p").agg(F.count(F.lit(1)).alias("n")), "subgroups")
    by = ["subgroup"]
    both = rows.groupBy(*by).agg((F.countDistinct("y") > 1).alias("_both"))
    out = proper_scores(rows, by, weight="n").join(F.broadcast(classification(rows, by, threshold, "n")), by).join(F.broadcast(ece(rows, by, weight="n")), by)
    ranked = ranking(rows.join(F.broadcast(both.where("_both")).select(*by), by, "left_semi"), by, "n")
    return out.join(F.broadcast(ranked), by, "left").join(F.broadcast(calibration_line(rows, by, weight="n")), by, "left")


def decision_summary(decisions: DataFrame, error: float = 0.05) -> DataFrame:
    """A row for each method of ``decisions(method, repetition, decision boolean, bound)``: the rate of decisions with its standard
    error, Wilson interval and exact one-sided upper bound, how often any decision of a repetition holds, and the mean
    and median of the bounds."""
    x = F.col("decision").cast("int")
    rows = decisions.groupBy("method").agg(F.count(F.lit(1)).alias("trials"), F.sum(x).alias("events"), F.stddev_samp(x).alias("_sd"), F.avg("bound").alias("mean_bound"), F.median("bound").alias("median_bound"))
    family = decisions.groupBy("method", "repetition").agg(F.max(x).alias("any")).groupBy("method").agg(F.count(F.lit(1)).alias("repetitions"), F.avg("any").alias("familywise_rate"))
    lo, hi = wilson(F.col("events"), F.col("trials"))
    rows = rows.join(family, "method").withColumns({"rate": F.col("events") / F.col("trials"), "se": F.col("_sd") / F.sqrt("trials"), "wilson_lo": lo, "wilson_hi": hi})
    return rows.withColumn("upper", fx.clopper_pearson("trials", "events", error, upper=True)).drop("_sd")


def worst_group_ece(scored: DataFrame, group: str, bins: int = 10, support: int = 50) -> DataFrame:
    n = scored.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    return ece(scored, [group], bins).join(n, group).agg(F.max("ece").alias("worst_ece"))


def summary_with_ci(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean, deviation and normal half-width of each value; a single row has deviation 0."""
    long = rows.unpivot(keys, values, "metric", "x").groupBy(*keys, "metric").agg(F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd"), F.count("x").alias("n"))
    return long.withColumn("half_width", 1.96 * F.col("sd") / F.sqrt("n"))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p = successes / n
    mid, width = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return mid - width, mid + width


def calibration_line(scored: DataFrame, group: list[str], steps: int = 8, clip: float = 1e-6, weight: str | None = None) -> DataFrame:
    """Slope and intercept of the logistic regression of y on logit(p), by Newton steps from the identity.

    A step is one grouped pass over counts of distinct scores, which meet the lines so far, a row for each group, where
    they lie: a join on the group would put all of a group in one task. Null where a group has one class or one score, or where
    scores part its classes.
    """
    kept = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col("p")))
    cells = scored.groupBy(*group, F.log(kept / (1 - kept)).alias("x")).agg(F.sum(_times(weight)).alias("n"), F.sum(F.col("y").cast("double") * _times(weight)).alias("k"))
    line = cells.groupBy(*group).agg(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), ((F.sum("k") > 0) & (F.sum("k") < F.sum("n")) & (F.min("x") < F.max("x"))).alias("fits"))
    for _ in range(steps):
        q = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x"))))
        w, r = F.col("n") * q * (1 - q), F.col("k") - F.col("n") * q
        sums = cells.join(F.broadcast(line), group).groupBy(*group, "a", "b", "fits").agg(
            F.sum(r).alias("g0"), F.sum(r * F.col("x")).alias("g1"), F.sum(w).alias("h00"), F.sum(w * F.col("x")).alias("h01"), F.sum(w * F.col("x") * F.col("x")).alias("h11"),
        )
        d = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")
        d = F.when(d > 1e-9, d)
        a = F.col("a") + (F.col("h11") * F.col("g0") - F.col("h01") * F.col("g1")) / d
        b = F.col("b") + (F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0")) / d
        line = sums.select(*group, F.when(F.col("fits"), a).alias("a"), F.when(F.col("fits"), b).alias("b"), "fits")
    return line.select(*group, F.col("a").alias("intercept"), F.col("b").alias("slope"))


def ranking_stability(importances: DataFrame, split: str, feature: str, value: str, k: int) -> DataFrame:
    """For each pair of splits the Jaccard similarity of their ``k`` most important features and Spearman's correlation
    over the features that both have: ``(a, b, jaccard, spearman)``."""
    own = Window.partitionBy(split)
    rows = importances.select(split, feature, value).withColumn("_top", F.row_number().over(own.orderBy(F.desc(value), feature)) <= k)
    side = lambda n: rows.select(F.col(split).alias(n), F.col(feature), F.col(value).alias(f"v{n}"), F.col("_top").alias(f"t{n}"))
    both = side("a").join(side("b"), feature).where("a < b")
    pair = Window.partitionBy("a", "b")
    mid = lambda c: F.rank().over(pair.orderBy(c)) + (F.count(F.lit(1)).over(pair.partitionBy("a", "b", c)) - 1) / 2
    ranked = both.withColumns({"ra": mid("va"), "rb": mid("vb")})
    tops = rows.where("_top").groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    out = ranked.groupBy("a", "b").agg(F.count_if(F.col("ta") & F.col("tb")).alias("same"), F.corr("ra", "rb").alias("spearman"))
    out = out.join(tops.select(F.col(split).alias("a"), F.col("n").alias("na")), "a").join(tops.select(F.col(split).alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", (F.col("same") / (F.col("na") + F.col("nb") - F.col("same"))).alias("jaccard"), "spearman")


def selected_models(rows: DataFrame, group: str, cost: str, model: str) -> DataFrame:
    """``rows`` with ``selected``: whether a model has the least validation cost of its group, ties by name."""
    order = Window.partitionBy(group).orderBy(F.round(cost, 12), model)
    return rows.withColumn("selected", F.row_number().over(order) == 1)
