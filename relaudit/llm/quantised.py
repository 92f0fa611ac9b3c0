"""Vectors with whole-number components, which scores and distances are exact in."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Components that sums of products of 2^17 of them stay exact with, in 64 bits.
LARGEST = 2**23


def floored(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding", scale: int = SCALE, **keep: Column) -> DataFrame:
    """``(vec_id, g array<int>)`` and the columns to ``keep``: each component x as floor(scale * x), x in double precision.

    Rows whose vector is null or holds null or non-finite components are left out, and so are those with a component
    of 2^23 or more after scaling, beyond which products would not be exact.
    """
    v = F.transform(F.col(column), lambda x: x.cast("double") * F.lit(float(scale)))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LARGEST)))
    out = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), *[c.alias(k) for k, c in keep.items()])
    out = out.where(F.col("v").isNotNull()).where(good)
    return out.select("vec_id", F.transform("v", lambda x: F.floor(x).cast("int")).alias("g"), *keep)


def matrix(g: pd.Series, d: int) -> np.ndarray:
    """Vectors of ``d`` components as rows."""
    return np.array(g.tolist(), dtype=np.int32).reshape(len(g), d)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two whole-number matrices, exact: by floats where these hold every sum."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T
