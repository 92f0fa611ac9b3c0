"""Column preparation of feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formulas as fx
from .quantiles import exact_quantiles


def numeric(x: Column) -> Column:
    """A string as a finite double; anything else is null."""
    return fx.finite(x.try_cast("double"))


def binary_label(x: Column, positives: list[str]) -> Column:
    """1 where the trimmed value, without trailing points, is one of ``positives``; null stays null."""
    return F.rtrim(F.trim(x), F.lit(".")).isin(positives).cast("int")


def domain_label(x: Column) -> Column:
    """A 0/1 label; any other value fails the job."""
    ok = F.assert_true(x.isin(0, 1), F.lit("label outside 0 and 1"))
    return F.when(ok.isNull(), x.cast("int"))


def in_range(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Values outside the range become null."""
    ok = F.lit(True) if low is None else x >= low
    return F.when(ok if high is None else ok & (x <= high), x)


def missing_indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_missing": F.isnull(c).cast("int") for c in columns})


def winsorize(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, min_unique: int = 10) -> DataFrame:
    """Clip columns at their interpolated quantiles, but for those with few distinct values."""
    ends = exact_quantiles(df, {c: F.col(c) for c in columns}, [low, high])
    out = df.crossJoin(F.broadcast(df.agg(*[F.count_distinct(F.col(c)).alias(f"_d_{c}") for c in columns])))

    def clipped(c: str) -> Column:
        least, most = ends[c]
        if least is None:
            return F.col(c)
        return F.when(F.col(f"_d_{c}") < min_unique, F.col(c)).when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(least)), F.lit(most)))

    return out.withColumns({c: clipped(c) for c in columns}).select(*df.columns)


def bins(x: Column, edges: list[float], labels: list[str], right: bool = False) -> Column:
    """Bins closed on the left (or on the right); values below the first edge are null, the last bin is open above."""
    out = F.when(x.isNull() | ((x <= edges[0]) if right else (x < edges[0])), None)
    for edge, label in zip(edges[1:], labels[:-1], strict=True):
        out = out.when((x <= edge) if right else (x < edge), label)
    return out.otherwise(labels[-1])


def encode(df: DataFrame, column: str, domain: list[str], unseen: int | None = None) -> DataFrame:
    """Codes of a registered domain. Values outside it fail the job, or get the code ``unseen``."""
    codes = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(domain)], f"`{column}` string, `{column}_code` int")
    if unseen is None and df.where(F.col(column).isNotNull()).join(F.broadcast(codes), column, "left_anti").limit(1).count():
        raise ValueError(f"{column} has a value outside its domain")
    out = df.join(F.broadcast(codes), column, "left")
    return out if unseen is None else out.withColumn(f"{column}_code", F.coalesce(f"{column}_code", F.lit(unseen)))


def one_hot(df: DataFrame, column: str, with_null: bool = False, most: int = 1_000) -> DataFrame:
    """A column for each level; more than ``most`` levels are an error, not a wider table."""
    levels = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect())
    if len(levels) > most:
        raise ValueError(f"{column} has more than {most} levels")
    out = {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in levels}
    return df.withColumns(out | ({f"{column}_null": F.isnull(column).cast("int")} if with_null else {}))


def median_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    mid = exact_quantiles(df, {c: F.col(c) for c in columns}, [0.5])
    return df.withColumns({c: F.coalesce(c, F.lit(mid[c][0])) for c in columns})


def minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scaled to [0, 1] by the table's own range; a constant column has width 1."""
    ends = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    width = lambda c: F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")).otherwise(1.0)
    scaled = {c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(c) - F.col(f"_lo_{c}")) / width(c))) for c in columns}
    return df.crossJoin(F.broadcast(ends)).withColumns(scaled).select(*df.columns)


def ratio_label(df: DataFrame, ratio: str, top: float, shift: float, out: str = "label") -> DataFrame:
    """1 where the ratio is at least its (1 - top) quantile plus ``shift`` population deviations."""
    edge = exact_quantiles(df, {ratio: F.col(ratio)}, [1 - top])[ratio][0]
    cut = df.agg((F.lit(edge) + shift * F.stddev_pop(ratio)).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn(out, (F.col(ratio) >= F.col("_cut")).cast("int")).drop("_cut")


def flip_labels(df: DataFrame, label: str, rate: float, seed: int, *ids: str) -> DataFrame:
    """Exactly round(n * rate) labels flipped, chosen by keyed order."""
    from .splits import row_index

    rows = row_index(df, fx.key_order(seed, *ids), *ids, out="_idx")
    n = rows.agg(F.rint(F.count(F.lit(1)) * rate).alias("_flips"))
    return rows.crossJoin(F.broadcast(n)).withColumn(label, F.when(F.col("_idx") < F.col("_flips"), 1 - F.col(label)).otherwise(F.col(label))).select(*df.columns)


def unique_names(names: list[str]) -> list[str]:
    """Names of letters, digits and underscores, made distinct by a counter that passes over names given out before."""
    given: set[str] = set()
    out = []
    for n in names:
        clean = "".join(c if c.isalnum() or c == "_" else "_" for c in n).strip("_") or "column"
        name, k = clean, 1
        while name in given:
            k += 1
            name = f"{clean}_{k}"
        given.add(name)
        out.append(name)
    return out


def drop_leakage(df: DataFrame, names: list[str] = (), prefixes: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in names and not c.startswith(tuple(prefixes))])
