"""Exact quantiles of large tables, without one task that sees all values."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that one aggregate may hold; beyond, a quantile's surroundings are narrowed first.
SMALL = 20_000
#: Accuracy of the approximate quantiles that narrow, and how far to either side of the rank they are taken.
ACCURACY, ASIDE = 10_000, 3e-4


@dataclass
class _Sought:
    """The value of one rank among the values from ``low`` to ``high``, of which there are ``inside``; ``rank`` counts from 0."""

    name: str
    rank: int
    inside: int
    low: float = -math.inf
    high: float = math.inf
    value: float | None = None


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probabilities: list[float], small: int = SMALL) -> dict[str, list[float | None]]:
    """For each column its quantiles, interpolated between the two values about n - 1 times the probability.

    Nulls and NaN are no values; a column without any has null quantiles. A table up to ``small`` values is one aggregate.
    A larger one takes a few passes: approximate quantiles on either side of a rank bound it, values between them are
    counted, and when few are left they are brought to the driver. All columns and ranks share each pass.
    """
    x = {n: F.when(~F.isnan(c.cast("double")), c.cast("double")) for n, c in columns.items()}
    counted = df.agg(*[F.count(c).alias(n) for n, c in x.items()]).first() if x else {}
    at = {n: [p * (counted[n] - 1) for p in probabilities] for n in x}
    sought = {(n, r): _Sought(n, r, counted[n]) for n in x if counted[n] for pos in at[n] for r in {math.floor(pos), math.ceil(pos)}}
    while open_ := [s for s in sought.values() if s.value is None]:
        within = lambda s: F.when((x[s.name] >= s.low) & (x[s.name] <= s.high), x[s.name])
        few = [s for s in open_ if s.inside <= small]
        many = [s for s in open_ if s.inside > small]
        if few:
            got = df.agg(*[F.get(F.sort_array(F.collect_list(within(s))), F.lit(s.rank)).alias(f"v{i}") for i, s in enumerate(few)]).first()
            for i, s in enumerate(few):
                s.value = got[f"v{i}"]
        if many:
            sides = lambda s: [min(1.0, max(0.0, (s.rank + 0.5) / s.inside + a)) for a in (-ASIDE, ASIDE)]
            cuts = df.agg(*[F.percentile_approx(within(s), sides(s), ACCURACY).alias(f"c{i}") for i, s in enumerate(many)]).first()
            split = lambda s, c: F.struct(F.count_if(within(s) < c[0]).alias("less"), F.count_if(within(s) == c[0]).alias("low"), F.count_if((within(s) > c[0]) & (within(s) < c[1])).alias("between"), F.count_if(within(s) == c[1]).alias("high"))
            told = df.agg(*[split(s, cuts[f"c{i}"]).alias(f"n{i}") for i, s in enumerate(many)]).first()
            for i, s in enumerate(many):
                _narrow(s, *cuts[f"c{i}"], told[f"n{i}"])
    value = lambda n, r: sought[n, r].value

    def between(n: str, pos: float) -> float | None:
        if not counted[n]:
            return None
        low, high = value(n, math.floor(pos)), value(n, math.ceil(pos))
        return low + (high - low) * (pos - math.floor(pos)) if high != low else low

    return {n: [between(n, pos) for pos in at[n]] for n in x}


def _narrow(s: _Sought, low: float, high: float, n) -> None:
    """Go on with that part of the values, cut at two of them, in which the rank lies; a cut itself may be the value."""
    upto = n["less"]
    if s.rank < upto:
        s.high, s.inside = math.nextafter(low, -math.inf), upto
    elif s.rank < upto + n["low"]:
        s.value = low
    elif s.rank < upto + n["low"] + n["between"]:
        s.low, s.high = math.nextafter(low, math.inf), math.nextafter(high, -math.inf)
        s.rank, s.inside = s.rank - upto - n["low"], n["between"]
    elif high > low and s.rank < upto + n["low"] + n["between"] + n["high"]:
        s.value = high
    else:
        past = upto + n["low"] + n["between"] + (n["high"] if high > low else 0)
        s.low, s.rank, s.inside = math.nextafter(high, math.inf), s.rank - past, s.inside - past
