"""Membership-exposure attacks: distances and densities of query rows against synthetic rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..sources.tables import staged
from . import metrics, splits
from .quantiles import exact_quantiles


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


#: Rows of a cell on the average, cells at most (their centres are sent to every task), and rows that a task compares with
#: as many queries.
CELL, MAX_CELLS, BLOCK = 2_048, 4_096, 4_096
#: Bounds are widened by this share, which is more than rounding can do.
WIDER = 1e-9


def _matrix(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), dtype=float).reshape(len(x), -1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0.0)


#: Rows that a task holds against all cells, and rows that it hands on, at a time.
SLICE, HANDED = 512, 8_192


def _slices(frames):
    for f in frames:
        for lo in range(0, len(f), SLICE):
            yield f.iloc[lo : lo + SLICE]


def _in_cells(rows: DataFrame, key: str, column: str, centres: np.ndarray) -> DataFrame:
    """``(key, x, cell, r)``: each row's nearest centre, and how far away it is."""

    def run(frames):
        for f in _slices(frames):
            x = _matrix(f["x"])
            cell = _squared(x, centres).argmin(axis=1)
            yield f.assign(cell=cell, r=np.sqrt(((x - centres[cell]) ** 2).sum(axis=1)))

    return rows.select(key, F.col(column).cast("array<double>").alias("x")).where("x is not null").mapInPandas(run, f"{key} long, x array<double>, cell int, r double")


def _meet(asks: DataFrame, data: DataFrame, parts: DataFrame, block: int) -> DataFrame:
    """``(query_id, d)``: the least distance of each of ``asks(query_id, x, cell)`` to the rows of its cell, whose ``parts`` hold about
    ``block`` rows each; as many queries at a time meet a part in a task."""
    chunks = asks.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks")).join(F.broadcast(parts), "cell")  # a row for each cell
    chunks = F.broadcast(staged(chunks, "meetings"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key, F.lit(3)), F.col(n)).cast("int")
    left = asks.join(chunks, "cell").withColumn("chunk", dealt("query_id", "chunks")).withColumn("part", every("parts"))
    right = data.join(chunks, "cell").withColumn("part", dealt("syn_id", "parts")).withColumn("chunk", every("chunks"))

    def run(q: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(f):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "d": pd.Series(dtype="float64")})
        x, rows = _matrix(q["x"]), _matrix(f["x"])
        near = np.concatenate([_squared(x[lo : lo + 512], rows).argmin(axis=1) for lo in range(0, len(x), 512)])
        return pd.DataFrame({"query_id": q["query_id"], "d": np.sqrt(((x - rows[near]) ** 2).sum(axis=1))})

    by = ["cell", "part", "chunk"]
    return left.select("query_id", "x", *by).groupBy(*by).cogroup(right.select("syn_id", "x", *by).groupBy(*by)).applyInPandas(run, "query_id long, d double")


def nearest_record_scores(queries: DataFrame, synthetic: DataFrame, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """``queries(query_id, v)``, ``synthetic(syn_id, s)``: minus the distance to the nearest synthetic row, exact.

    Synthetic rows lie in cells around some of them. A query first meets its own cell; by the triangle inequality it then
    needs only those cells whose centre, less their radius, is no farther than the row it has found. Rows without a
    vector take no part; without any synthetic row there is no score.
    """
    spark = queries.sparkSession
    known = synthetic.where("s is not null")
    n = min(MAX_CELLS, max(1, -(-known.count() // cell)))
    picked = known.orderBy(F.xxhash64("syn_id", F.lit(17)), "syn_id").limit(n).select("s").toPandas()["s"]
    if not len(picked):
        return queries.select("query_id", F.lit(None).cast("double").alias("score")).limit(0)
    centres = _matrix(picked)
    data = staged(_in_cells(known, "syn_id", "s", centres), "cells")
    told = data.groupBy("cell").agg(F.max("r").alias("radius"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")).toPandas()  # a row for each cell
    filled, radius = told["cell"].to_numpy(), told["radius"].to_numpy() * (1 + WIDER)
    parts = spark.createDataFrame(told[["cell", "parts"]], "cell int, parts int")
    kept = centres[filled]
    asks = staged(_in_cells(queries, "query_id", "v", kept).select("query_id", "x", F.get(F.array(*[F.lit(int(c)) for c in filled]), "cell").alias("cell")), "asks")
    found = staged(_meet(asks, data, parts, block).groupBy("query_id").agg(F.min("d").alias("d")), "found")

    def within(frames):
        for f in _slices(frames):
            far = np.sqrt(_squared(_matrix(f["x"]), kept)) * (1 - WIDER) - radius[None, :]
            near = (far <= f["d"].to_numpy()[:, None] * (1 + WIDER) + WIDER) & (filled[None, :] != f["cell"].to_numpy()[:, None])
            i, c = np.nonzero(near)
            ids, x = f["query_id"].to_numpy(), f["x"].to_numpy()
            for lo in range(0, len(i), HANDED):  # a query may need every cell
                part = slice(lo, lo + HANDED)
                yield pd.DataFrame({"query_id": ids[i[part]], "x": x[i[part]], "cell": filled[c[part]]})

    more = staged(asks.join(found, "query_id").mapInPandas(within, "query_id long, x array<double>, cell int"), "more-cells")
    both = found.union(_meet(more, data, parts, block))
    return both.groupBy("query_id").agg((-F.min("d")).alias("score"))


def _met(queries: DataFrame, rows: DataFrame, run: Callable, schema: str, block: int) -> DataFrame:
    """``run(q, f)`` on every block of ``queries(query_id, v)`` with every one of ``rows(syn_id, s)``; quadratic, as the attacks are, but a
    task holds two blocks at a time and only what ``run`` returns leaves it."""
    data, asks = rows.where("s is not null"), queries.where("v is not null")
    n_data, n_asks = (max(1, -(-t.count() // block)) for t in (data, asks))
    place = lambda key, n: F.pmod(F.xxhash64(key, F.lit(5)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asks.select("query_id", F.col("v").cast("array<double>").alias("x"), place("query_id", n_asks).alias("a"), every(n_data).alias("b"))
    right = data.select("syn_id", F.col("s").cast("array<double>").alias("x"), place("syn_id", n_data).alias("b"), every(n_asks).alias("a"))
    names = [c.split()[0] for c in schema.split(", ")]

    def safe(q: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        got = [run(q["query_id"].to_numpy()[lo : lo + SLICE], _matrix(q["x"][lo : lo + SLICE]), f["syn_id"].to_numpy(), _matrix(f["x"])) for lo in range(0, len(q), SLICE)] if len(f) else []
        return pd.concat([pd.DataFrame(dict(zip(names, g, strict=True))) for g in got]) if got else pd.DataFrame(columns=names)

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(safe, schema)


def _exact(x: np.ndarray, s: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of pairs by differences, which do not cancel."""
    out = np.empty(len(i))
    for lo in range(0, len(i), 65_536):
        out[lo : lo + 65_536] = ((x[i[lo : lo + 65_536]] - s[j[lo : lo + 65_536]]) ** 2).sum(axis=1)
    return out


def _close(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Squared distances by products; those that cancel are taken again by differences."""
    d2 = _squared(x, s)
    i, j = np.nonzero(d2 <= 1e-5 * ((x * x).sum(axis=1)[:, None] + (s * s).sum(axis=1)[None, :]))
    d2[i, j] = _exact(x, s, i, j)
    return d2


def pair_summary(queries: DataFrame, rows: DataFrame, bandwidth: float, block: int = BLOCK) -> DataFrame:
    """``(query_id, pairs, nearest, distance, density)`` over all pairs of a query and ``rows``: their number, least and mean
    distance, and log mean kernel."""

    def run(ids, x, _, s):
        d2 = _close(x, s)
        e = -d2 / (2 * bandwidth * bandwidth)
        m = e.max(axis=1)
        return ids, np.full(len(ids), len(s)), np.sqrt(d2.min(axis=1)), np.sqrt(d2).sum(axis=1), m, np.exp(e - m[:, None]).sum(axis=1)

    part = staged(_met(queries, rows, run, "query_id long, n long, d double, t double, m double, k double", block), "pairs")
    top = part.groupBy("query_id").agg(F.max("m").alias("top"))
    return part.join(top, "query_id").groupBy("query_id").agg(
        F.sum("n").alias("pairs"), F.min("d").alias("nearest"), (F.sum("t") / F.sum("n")).alias("distance"),
        (F.max("top") + F.log(F.sum(F.col("k") * F.exp(F.col("m") - F.col("top"))) / F.sum("n"))).alias("density"),
    )


def nearest_rows(queries: DataFrame, rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``(query_id, syn_id, d)``: each query's ``k`` nearest rows, ties by ``syn_id``; a task returns a block's nearest alone."""

    def run(ids, x, keys, s):
        d2, n = _squared(x, s), min(k, len(s))
        size = (x * x).sum(axis=1)[:, None] + (s * s).sum(axis=1)[None, :]
        i, j = np.nonzero(d2 <= np.partition(d2, n - 1, axis=1)[:, n - 1 : n] + 1e-12 * size.max(axis=1, keepdims=True))
        d = np.sqrt(_exact(x, s, i, j))
        order = np.lexsort((keys[j], d, i))
        i, j, d = i[order], j[order], d[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < n
        return ids[i[kept]], keys[j[kept]], d[kept]

    near = _met(queries, rows, run, "query_id long, syn_id long, d double", block)
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "syn_id"))
    return near.withColumn("r", first).where(F.col("r") <= k).drop("r")


def log_density(queries: DataFrame, rows: DataFrame, dims: int, bandwidth: float, out: str, block: int = BLOCK) -> DataFrame:
    """Gaussian kernel log density with one bandwidth of ``queries(query_id, v)`` under ``rows(syn_id, s)``.

    Every query meets every row once, in blocks of both: a task folds a block into each query's peak and its sum of
    exponentials below it, and only such pairs of numbers leave it and are brought to a common peak.
    """
    data, asks = rows.where("s is not null"), queries.where("v is not null")
    n_data, n_asks = (max(1, -(-t.count() // block)) for t in (data, asks))
    place = lambda key, n: F.pmod(F.xxhash64(key, F.lit(5)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asks.select("query_id", F.col("v").cast("array<double>").alias("x"), place("query_id", n_asks).alias("a"), every(n_data).alias("b"))
    right = data.select(F.col("s").cast("array<double>").alias("x"), place("syn_id", n_data).alias("b"), every(n_asks).alias("a"))

    def fold(q: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(f):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "m": pd.Series(dtype="float64"), "t": pd.Series(dtype="float64"), "n": pd.Series(dtype="int64")})
        x, s = _matrix(q["x"]), _matrix(f["x"])
        m, t = np.empty(len(x)), np.empty(len(x))
        for lo in range(0, len(x), 512):
            e = -_squared(x[lo : lo + 512], s) / (2 * bandwidth * bandwidth)
            m[lo : lo + 512] = top = e.max(axis=1)
            t[lo : lo + 512] = np.exp(e - top[:, None]).sum(axis=1)
        return pd.DataFrame({"query_id": q["query_id"], "m": m, "t": t, "n": len(s)})

    part = staged(left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(fold, "query_id long, m double, t double, n long"), "density")
    peak = part.groupBy("query_id").agg(F.max("m").alias("top"))
    total = part.join(peak, "query_id").groupBy("query_id").agg(F.sum(F.col("t") * F.exp(F.col("m") - F.col("top"))).alias("t"), F.max("top").alias("m"), F.sum("n").alias("n"))
    norm = dims * math.log(bandwidth) + dims / 2 * math.log(2 * math.pi)
    return total.select("query_id", (F.col("m") + F.log("t") - F.log("n") - norm).alias(out))


def fit_representation(reference: DataFrame, column: str, dimensions: int = 10) -> Callable[[DataFrame, str], DataFrame]:
    """Median imputation, standardisation and PCA of whole vectors, fitted on the reference alone.

    Returns what puts a table's vectors into that form, in place. Rows without a vector take no part; missing
    components are null or NaN. Only centres, scales and the components (vector length x ``dimensions``) reach the driver.
    """
    clean = lambda c: F.transform(F.col(c).cast("array<double>"), lambda x: F.when(~F.isnan(x), x))
    x = reference.where(F.col(column).isNotNull()).select(F.posexplode(clean(column)).alias("i", "x"))
    longest = reference.agg(F.max(F.size(column)).alias("d")).first().d or 0
    middle = {int(i): q[0] for i, q in exact_quantiles(reference, {str(i): F.get(clean(column), F.lit(i)) for i in range(longest)}, [0.5]).items()}
    some = x.groupBy("i").agg(F.avg("x").alias("m"), F.count("x").alias("k"), F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("v")).orderBy("i").collect()
    fill, centre, scale = [], [], []
    for r in some:
        m = middle[r.i]
        if r.k == 0:
            raise ValueError(f"component {r.i} is missing throughout the reference")
        mean = (r.k * r.m + (r.n - r.k) * m) / r.n
        var = (r.k * (r.v + (r.m - mean) ** 2) + (r.n - r.k) * (m - mean) ** 2) / r.n
        fill.append(m)
        centre.append(mean)
        scale.append(math.sqrt(var) or 1.0)

    def table(values: list[float]) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    def standard(rows: DataFrame, c: str) -> DataFrame:
        whole = F.zip_with(clean(c), table(fill), lambda v, m: F.coalesce(v, m))
        shifted = F.zip_with(whole, table(centre), lambda v, m: v - m)
        return rows.where(F.col(c).isNotNull()).withColumn("_z", array_to_vector(F.zip_with(shifted, table(scale), lambda v, m: v / m)))

    k = min(dimensions, len(some), max(1, (some[0].n if some else 0) - 1))
    model = PCA(k=k, inputCol="_z", outputCol="_p").fit(standard(reference, column))
    return lambda rows, c: model.transform(standard(rows, c)).withColumn(c, vector_to_array("_p")).drop("_z", "_p")


def kernel_log_density(queries: DataFrame, rows: DataFrame, out: str, jitter: float = 1e-6) -> DataFrame:
    """Gaussian kernel log density with the full covariance of ``rows(syn_id, s)`` times Scott's factor.

    One aggregate gives the covariance; its Cholesky factor whitens both tables, where the kernel has width 1.
    """
    d = rows.select(F.size("s").alias("d")).first().d
    at = [(i, j) for i in range(d) for j in range(i + 1)]
    got = rows.agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(F.col("s")[i], F.col("s")[j]).alias(f"c{i}_{j}") for i, j in at]).first()
    cov = np.zeros((d, d))
    for i, j in at:
        cov[i, j] = cov[j, i] = got[f"c{i}_{j}"]
    low = np.linalg.cholesky((cov + jitter**2 * np.eye(d)) * got.n ** (-2 / (d + 4)))
    inverse = np.linalg.inv(low)

    def whitened(c: str) -> Column:
        return F.array(*[sum((F.col(c)[j] * float(inverse[i, j]) for j in range(i + 1)), F.lit(0.0)) for i in range(d)])

    found = log_density(queries.select("query_id", whitened("v").alias("v")), rows.select("syn_id", whitened("s").alias("s")), d, 1.0, out)
    return found.withColumn(out, F.col(out) - float(np.log(np.diag(low)).sum()))


def kernel_ratio_scores(queries: DataFrame, synthetic: DataFrame, reference: DataFrame) -> DataFrame:
    """log p_synthetic - log p_reference, each with its own covariance."""
    a, b = kernel_log_density(queries, synthetic, "a"), kernel_log_density(queries, reference, "b")
    return a.join(b, "query_id").select("query_id", (F.col("a") - F.col("b")).alias("score"))


def density_ratio_scores(queries: DataFrame, synthetic: DataFrame, reference: DataFrame, dims: int, bandwidth: float) -> DataFrame:
    """log p_synthetic - log p_reference."""
    a, b = log_density(queries, synthetic, dims, bandwidth, "a"), log_density(queries, reference, dims, bandwidth, "b")
    return a.join(b, "query_id").select("query_id", (F.col("a") - F.col("b")).alias("score"))


def gen_lra_scores(queries: DataFrame, synthetic: DataFrame, reference: DataFrame, dims: int, k: int) -> DataFrame:
    """Over the k nearest synthetic rows of a query, how much adding it to the reference would raise their likelihood."""
    n = reference.count()
    h = (n * (dims + 2) / 4) ** (-1 / (dims + 4))
    at_syn = log_density(synthetic.select(F.col("syn_id").alias("query_id"), F.col("s").alias("v")), reference, dims, h, "log_ref").withColumnRenamed("query_id", "syn_id")
    near = nearest_rows(queries, synthetic, k)
    norm = dims * math.log(h) + dims / 2 * math.log(2 * math.pi)
    kernel = -F.col("d") * F.col("d") / (2 * h * h) - norm
    gain = fx.log_add(F.log(F.lit(float(n))) + F.col("log_ref"), kernel) - math.log(n + 1) - F.col("log_ref")
    return near.join(at_syn, "syn_id").groupBy("query_id").agg(F.sum(gain).alias("score"))


def tpr_at_fpr(scores: DataFrame, group: list[str], fprs: tuple[float, ...]) -> DataFrame:
    """Threshold at the "higher" quantile of nonmember scores, the rate of members above it, and the realised FPR."""
    own = Window.partitionBy(*group, "member")
    rows = scores.withColumns({"_r": F.row_number().over(own.orderBy("score")) - 1, "_n": F.count(F.lit(1)).over(own)})
    out = None
    for f in fprs:
        cut = rows.where((F.col("member") == 0) & (F.col("_r") == F.ceil((1 - F.lit(f)) * (F.col("_n") - 1)))).select(*group, F.col("score").alias("threshold"))
        each = scores.join(F.broadcast(cut), group).groupBy(*group).agg(
            F.avg(F.when(F.col("member") == 1, (F.col("score") > F.col("threshold")).cast("double"))).alias("tpr"),
            F.avg(F.when(F.col("member") == 0, (F.col("score") > F.col("threshold")).cast("double"))).alias("realised_fpr"),
        ).withColumn("fpr", F.lit(f))
        out = each if out is None else out.union(each)
    return out


def advantage_losses(scores: DataFrame, group: list[str], ids: str) -> DataFrame:
    """Half of the nonmembers set a threshold (their median); the rest are paired with members by position.
    Value: member above minus nonmember above, in {-1, 0, 1}."""
    own = Window.partitionBy(*group, "member").orderBy(ids)
    rows = scores.withColumns({"_i": F.row_number().over(own) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*group, "member"))})
    half = F.floor(F.col("_n") / 2)
    cut = rows.where((F.col("member") == 0) & (F.col("_i") < half)).groupBy(*group).agg(F.median("score").alias("_cut"))
    non = rows.where((F.col("member") == 0) & (F.col("_i") >= half)).select(*group, (F.col("_i") - half).alias("_i"), F.col("score").alias("_non"))
    mem = rows.where("member = 1").select(*group, F.col("_i").cast("long"), F.col("score").alias("_mem"))
    both = mem.join(non, [*group, "_i"]).join(F.broadcast(cut), group)
    return both.select(*group, "_i", ((F.col("_mem") > F.col("_cut")).cast("int") - (F.col("_non") > F.col("_cut")).cast("int")).cast("double").alias("value"))


def bootstrap_interval(scores: DataFrame, draws: int, seed: int, level: float = 0.95) -> DataFrame:
    """Mean and interval ``(mean_auc, lo, hi)`` of the AUC over ``draws`` bootstrap draws of ``scores(query_id, member, score)``.

    Members and nonmembers are drawn apart from each other: a row's Poisson counts follow from its class and id.
    """
    rows = scores.select(F.col("member").alias("y"), F.col("score").alias("p"), splits.poisson_weights(draws, seed, "member", "query_id").alias("w"))
    auc, tail = metrics.weighted_auc(rows, draws), (1 - level) / 2
    return auc.agg(F.avg("auc").alias("mean_auc"), F.percentile("auc", F.lit(tail)).alias("lo"), F.percentile("auc", F.lit(1 - tail)).alias("hi"))
