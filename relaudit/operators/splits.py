"""Table partitions by keyed order: splits, reserves, draws and their lineage, the same on every run and cluster."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..sources.tables import shared_path


def row_index(df: DataFrame, order: Column, *ties: str, out: str = "idx") -> DataFrame:
    """A global index from 0 in the order given, without one task for all rows: range partitions sorted each, and the
    sizes of those before added.

    The sorted partitions are written to the shared folder, so their places are the same however often they are read.
    """
    at = shared_path(df.sparkSession, "row-index")
    parts = df.withColumn("_o", order).repartitionByRange("_o", *ties).sortWithinPartitions("_o", *ties)
    parts = parts.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()).drop("_o")
    parts.write.parquet(at)
    parts = df.sparkSession.read.schema(parts.schema).parquet(at)
    start = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    start = start.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return parts.join(F.broadcast(start.drop("_n")), "_p").withColumn(out, F.col("_i") - F.col("_first") + F.col("_base")).drop("_p", "_i", "_first", "_base")


def class_rank(df: DataFrame, label: str, seed: int, *ids: str) -> DataFrame:
    """Place (from 1) and number of rows in each class, in keyed order: a global index less that of the class's first.

    What is told of the classes, a row for each, is broadcast: a join on the label would put each class in one task.
    """
    rows = row_index(df, F.struct(F.col(label), fx.key_order(seed, *ids)), *ids, out="_idx")
    first = rows.groupBy(F.col(label).alias("_class")).agg(F.min("_idx").alias("_first"), F.count(F.lit(1)).alias("_n"))
    rows = rows.join(F.broadcast(first), rows[label].eqNullSafe(first["_class"]))
    return rows.withColumn("_rank", F.col("_idx") - F.col("_first") + 1).select(*df.columns, "_rank", "_n")


def stratified_split(df: DataFrame, label: str, seed: int, ids: list[str], shares: dict[str, float]) -> DataFrame:
    """``df`` with a role for each row, by share of every class; the last role takes the rest."""
    role, upto = None, 0.0
    for name, share in list(shares.items())[:-1]:
        upto += share
        test = F.col("_rank") <= F.floor(F.col("_n") * upto)
        role = F.when(test, name) if role is None else role.when(test, name)
    return class_rank(df, label, seed, *ids).withColumn("role", role.otherwise(list(shares)[-1])).drop("_rank", "_n")


def fixed_partition(df: DataFrame, label: str, seed: int, ids: list[str], rows: dict[str, int]) -> DataFrame:
    """The rows of each role: a fixed number of every class. Fails if a class is too small."""
    total = sum(rows.values())
    if df.groupBy(label).count().where(F.col("count") < total).limit(1).count():
        raise ValueError(f"a class has fewer than {total} rows")
    role, upto = None, 0
    for name, k in rows.items():
        upto += k
        test = F.col("_rank") <= upto
        role = F.when(test, name) if role is None else role.when(test, name)
    return class_rank(df, label, seed, *ids).withColumn("role", role).where("role is not null").drop("_rank", "_n")


def sealed_rows(df: DataFrame, k: int, seed: int, *ids: str) -> DataFrame:
    """``df`` with ``sealed``: true for ``k`` rows without replacement, the first by a keyed hash; its order is by ranges, so ``k``
    may be a share of a large table."""
    return row_index(df, fx.key_order(seed, *ids), *ids, out="_idx").select(*df.columns, (F.col("_idx") < k).alias("sealed"))


def sealed_reserve(df: DataFrame, k: int, seed: int, *ids: str) -> DataFrame:
    """The ``k`` rows that :func:`sealed_rows` seals."""
    return sealed_rows(df, k, seed, *ids).where("sealed").select(*df.columns)


def complement(df: DataFrame, part: DataFrame, *ids: str) -> DataFrame:
    return df.join(part.select(*ids), list(ids), "left_anti")


def ordered_holdout(df: DataFrame, order: str, share: float = 0.8, *ties: str) -> DataFrame:
    """``df`` with ``held_out``: true for the last rows by position; at least one row on either side."""
    rows = row_index(df, F.col(order), *ties)
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    cut = F.greatest(F.lit(1), F.least(F.rint(F.col("_n") * share), F.col("_n") - 1))
    return rows.crossJoin(F.broadcast(n)).withColumn("held_out", F.col("idx") >= cut).drop("_n")


def epochs(df: DataFrame, order: list[str], value: str, start: str, by: list[str]) -> DataFrame:
    """Epoch of each row: how often the value has turned into ``start`` so far, within each ``by``."""
    w = Window.partitionBy(*by).orderBy(*order)
    begins = (F.col(value) == start) & ~F.lag(F.col(value) == start, 1, False).over(w)
    return df.withColumn("_b", begins.cast("int")).withColumn("epoch", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def draw_with_replacement(df: DataFrame, m: int, seed: int, *ids: str) -> DataFrame:
    """``m`` draws: keyed uniforms pick row indexes, which an equi-join resolves."""
    rows = row_index(df, fx.key_order(seed, *ids), *ids)
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    picks = df.sparkSession.range(m).withColumnRenamed("id", "draw").crossJoin(F.broadcast(n)).withColumn("idx", F.floor(fx.key_uniform(seed, "draw") * F.col("n")))
    return picks.drop("n").join(rows, "idx")


def bootstrap_releases(df: DataFrame, releases: int, seed: int, *ids: str) -> DataFrame:
    """For each release as many draws with replacement as there are rows: ``(release, draw, ...)``."""
    rows = row_index(df, fx.key_order(seed, *ids), *ids)
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    each = df.sparkSession.range(releases).withColumnRenamed("id", "release").crossJoin(F.broadcast(n))
    each = each.withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return each.withColumn("idx", F.floor(fx.key_uniform(seed, "release", "draw") * F.col("n"))).drop("n").join(rows, "idx")


#: P(Poisson(1) <= k) for k = 0, 1, ...; a uniform number of 32 bits tells them apart up to here.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]


def keyed_uniforms(n: int, seed: int, *ids: str) -> Column:
    """``n`` numbers in [0, 1) from keys and a seed, four from each md5 of the keys, its number and the seed, joined by #."""
    uniforms = _uniforms(n, seed)

    def draw(keys: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(0, n * len(keys) + 1, n, dtype=np.int32), uniforms(keys).ravel())

    return F.arrow_udf(draw, "array<double>")(_keys(*ids))


def _keys(*ids: str) -> Column:
    """The keys, each with # after it; nulls are left out."""
    return F.concat_ws("#", *[F.col(i).cast("string") for i in ids], F.lit(""))


def _uniforms(n: int, seed: int) -> Callable[[pa.Array], np.ndarray]:
    """A row of ``n`` numbers for each key; whole digests become numbers at once."""
    ends = [f"{g}#{seed}".encode() for g in range((n + 3) // 4)]

    def rows(keys: pa.Array) -> np.ndarray:
        md5 = hashlib.md5
        digests = b"".join([md5(k + e, usedforsecurity=False).digest() for k in keys.cast(pa.binary()).to_pylist() for e in ends])
        return np.frombuffer(digests, ">u4").reshape(len(keys), 4 * len(ends))[:, :n] / 4294967296.0

    return rows


def poisson_weights(releases: int, seed: int, *ids: str) -> Column:
    """How often each of ``releases`` bootstrap releases holds a row: Poisson(1) counts from its keys, an array.

    A resample of n rows holds each about so often, independently of the others (Chamandy and others, 2012), so nothing has
    to be drawn, joined or copied: statistics of all releases are weighted sums in one pass over the rows.
    """
    uniforms, steps = _uniforms(releases, seed), np.array(POISSON)

    def count(keys: pa.Array) -> pa.Array:
        counts = np.searchsorted(steps, uniforms(keys).ravel(), side="right").astype(np.int32)
        return pa.ListArray.from_arrays(np.arange(0, releases * len(keys) + 1, releases, dtype=np.int32), counts)

    return F.arrow_udf(count, "array<int>")(_keys(*ids))


def poisson_sums(df: DataFrame, releases: int, weight: str, by: list[str], **sums: Callable[[int], Column]) -> DataFrame:
    """``(by..., release, n, sums...)``: for each release the total weight and weighted sums, from one partial aggregation of
    as many columns; only its result is laid out by release. A sum is a function of the release's number."""
    w = [F.get(weight, F.lit(r)) for r in range(releases)]
    wide = df.groupBy(*by).agg(*[F.struct(F.sum(w[r]).alias("n"), *[F.sum(w[r] * f(r)).alias(k) for k, f in sums.items()]).alias(f"_{r}") for r in range(releases)])
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("release"), F.col(f"_{r}").alias("x")) for r in range(releases)]))
    return wide.select(*by, each.alias("e")).select(*by, "e.release", "e.x.*")


def lineage_overlap(audit: DataFrame, pilot: DataFrame, key: str) -> DataFrame:
    """How many audit records each pilot role already held; null stands for records that are new."""
    return audit.select(key).join(pilot.select(key, "role"), key, "left").groupBy("role").agg(F.count(F.lit(1)).alias("records"))
