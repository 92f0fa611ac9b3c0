"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine check, components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import connected_components, spanning

SEED = 7
#: Share of the pairs at the threshold that at least one table brings together; vectors expected in a bucket. Large
#: buckets need few tables, and what is compared in vain is a matrix product.
RECALL, BUCKET = 0.999, 512
#: The largest part of a bucket that one task compares with itself or with another part.
BLOCK = 1024


def plan(n: int, cosine: float, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits for each signature, so that spread-out vectors fill buckets of ``bucket``, and tables that give ``recall``."""
    bits = min(30, max(6, math.ceil(math.log2(max(n, 1) / bucket)))) if n > bucket else 6
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def usable(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(vec_id, v)`` of the rows that take part: no null, no non-finite component, not all zero."""
    v = F.col(column) if vectors.schema[column].dataType.simpleString() == "array<float>" else F.col(column).cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & good & F.exists("v", lambda x: x != 0))


def signatures(vectors: DataFrame, bits: int, tables: int, seed: int = SEED) -> DataFrame:
    """Adds ``sig array<int>``: in each table the signs of ``bits`` random projections, read as a number."""
    schema = f"vec_id long, v {vectors.schema['v'].dataType.simpleString()}, copies long, sig array<int>"

    def run(frames):
        planes: dict[int, np.ndarray] = {}
        for f in frames:
            out = np.zeros((len(f), tables), dtype=np.int32)
            size = f["v"].map(len).to_numpy()
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, bits * tables))
                signs = (np.stack(f["v"].iloc[at].to_numpy()).astype(float) @ planes[d] >= 0).reshape(len(at), tables, bits)
                out[at] = signs @ (1 << np.arange(bits))
            yield f.assign(sig=list(out))

    return vectors.select("vec_id", "v", "copies").mapInPandas(run, schema)


def _compare(cosine: float):
    """What one task does with a bucket, or with two parts of one: exact cosines of the pairs no earlier table brings."""

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        table, p, q = int(key[0]), int(key[2]), int(key[3])
        f = f.sort_values("vec_id", ignore_index=True)
        n, links, edges = len(f), np.zeros(len(f), dtype=np.int64), []
        ids, sig, size = f["vec_id"].to_numpy(), np.stack(f["sig"].to_numpy())[:, :table], f["v"].map(len).to_numpy()
        part, copies = f["part"].to_numpy(), f["copies"].to_numpy()
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            v = np.stack(f["v"].iloc[at].to_numpy()).astype(float)
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            for s in range(0, len(at), 512):
                close = v[s : s + 512] @ v.T >= cosine
                close &= np.arange(len(at))[None, :] > np.arange(s, min(s + 512, len(at)))[:, None]
                if p != q:
                    close &= part[at][s : s + 512, None] != part[at][None, :]
                i, j = np.nonzero(close)
                i, j = at[i + s], at[j]
                for t in range(table):
                    if not len(i):
                        break
                    new = sig[i, t] != sig[j, t]
                    i, j = i[new], j[new]
                links += (np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)).astype(np.int64)
                edges.append((i, j))
        a, b = (np.concatenate([e[k] for e in edges]) for k in (0, 1)) if edges else (np.zeros(0, int), np.zeros(0, int))
        root = spanning(n, a, b)
        hit = links > 0
        return pd.DataFrame({"vec_id": ids[hit], "root": ids[root[hit]], "n": links[hit]})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", column: str = "embedding", recall: float = RECALL, bucket: int = BUCKET, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row for each distinct vec_id.

    Two vectors link when a table brings them together and their cosine, in double precision, is at least ``cosine``;
    vectors that are null, zero, or hold null or non-finite components, and vectors of different lengths, never link.
    A bucket above ``block`` is dealt out as pairs of parts, so that no task holds more than two parts; pairs are
    counted where they are compared, and only a spanning forest of them leaves a task. Equal vectors are compared
    once, weighted by their number. A repeated vec_id counts once, with its greatest vector; rows with a null vec_id
    are one row that links with nothing; an empty table gives an empty table.
    """
    ids = vectors.select(F.col(vec_id).cast("long").alias("vec_id")).distinct()
    good = usable(vectors, vec_id, column).where("vec_id is not null").groupBy("vec_id").agg(F.max("v").alias("v"))
    good = staged(good.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64("v", F.lit(1))}), "vectors")
    same = good.groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), F.min_by("v", "vec_id").alias("v"), F.count("*").alias("copies"))
    same = staged(same, "distinct-vectors")
    bits, tables = plan(same.count(), cosine, recall, bucket)
    signed = staged(signatures(same, bits, tables, seed), "signed")
    each = signed.select("vec_id", F.posexplode("sig").alias("table", "code"))
    parts = F.ceil(F.count("*") / block).cast("int")
    large = each.groupBy("table", "code").agg(F.count("*").alias("rows"), parts.alias("parts")).where("rows > 1")
    placed = signed.select("vec_id", "v", "copies", "sig", F.posexplode("sig").alias("table", "code")).join(large.drop("rows"), ["table", "code"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")})
    found = staged(placed.groupBy("table", "code", "p", "q").applyInPandas(_compare(cosine), "vec_id long, root long, n long"), "links")
    links = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    comp = connected_components(found.where("vec_id <> root").select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    by_value = same.join(links, "vec_id", "left").join(comp.withColumnRenamed("id", "vec_id"), "vec_id", "left").select(
        "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    members = good.select("vec_id", "k1", "k2").join(staged(by_value, "by-value"), ["k1", "k2"]).drop("k1", "k2")
    out = ids.join(members, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
