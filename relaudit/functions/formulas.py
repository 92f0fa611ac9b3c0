"""Column formulas of bounded-mean inference: all certificates are closed forms of count, mean and variance."""

from __future__ import annotations

import math
from collections.abc import Callable

from numpy.polynomial.legendre import leggauss
from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float | int | str


def col(x: Num) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def hoeffding_p(n: Num, mean: Num, limit: Num, lower: Num, upper: Num, violation: bool = False) -> Column:
    """p-value of "the mean is at least ``limit``", or with ``violation`` of "it is at most ``limit``"."""
    gap = col(mean) - col(limit) if violation else col(limit) - col(mean)
    width = col(upper) - col(lower)
    return F.when(gap <= 0, 1.0).otherwise(F.exp(-2 * col(n) * gap * gap / (width * width)))


def hoeffding_radius(n: Num, error: Num, lower: Num, upper: Num) -> Column:
    return (col(upper) - col(lower)) * F.sqrt(F.log(1 / col(error)) / (2 * col(n)))


def hoeffding_ucb(n: Num, mean: Num, error: Num, lower: Num, upper: Num) -> Column:
    return F.least(col(upper), col(mean) + hoeffding_radius(n, error, lower, upper))


def hoeffding_lcb(n: Num, mean: Num, error: Num, lower: Num, upper: Num) -> Column:
    return F.greatest(col(lower), col(mean) - hoeffding_radius(n, error, lower, upper))


def bernstein_radius(n: Num, var: Num, error: Num, lower: Num, upper: Num) -> Column:
    """Empirical Bernstein (Maurer and Pontil, 2009)."""
    log2 = F.log(2 / col(error))
    return F.sqrt(2 * col(var) * log2 / col(n)) + 7 * (col(upper) - col(lower)) * log2 / (3 * (col(n) - 1))


def bernstein_ucb(n: Num, mean: Num, var: Num, error: Num, lower: Num, upper: Num) -> Column:
    own = F.least(col(upper), col(mean) + bernstein_radius(n, var, error, lower, upper))
    return F.when(col(n) < 2, hoeffding_ucb(n, mean, error, lower, upper)).otherwise(own)


def bernstein_lcb(n: Num, mean: Num, var: Num, error: Num, lower: Num, upper: Num) -> Column:
    own = F.greatest(col(lower), col(mean) - bernstein_radius(n, var, error, lower, upper))
    return F.when(col(n) < 2, hoeffding_lcb(n, mean, error, lower, upper)).otherwise(own)


def bernstein_p(n: Num, mean: Num, var: Num, limit: Num, lower: Num, upper: Num, violation: bool = False) -> Column:
    """The bound inverted: with s = sqrt(ln(2/p)), gap = a s + b s^2. A limit beyond the clamp decides alone."""
    gap = col(mean) - col(limit) if violation else col(limit) - col(mean)
    beyond = col(limit) < col(lower) if violation else col(limit) > col(upper)
    a = F.sqrt(2 * col(var) / col(n))
    b = 7 * (col(upper) - col(lower)) / (3 * (col(n) - 1))
    s = (F.sqrt(a * a + 4 * b * gap) - a) / (2 * b)
    p = F.least(F.lit(1.0), 2 * F.exp(-s * s))
    return F.when(beyond, 0.0).when(gap <= 0, 1.0).when(col(n) < 2, hoeffding_p(n, mean, limit, lower, upper, violation)).otherwise(p)


#: Gauss-Legendre nodes and weights on [0, 1]; a falling tail is integrated until it has fallen by e^-FALL.
_NODES = "array(" + ", ".join(f"struct({(x + 1) / 2!r}D AS u, {w / 2!r}D AS w)" for x, w in zip(*(a.tolist() for a in leggauss(64)), strict=True)) + ")"
FALL, HALVINGS = 40.0, 45


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, with ``x`` evaluated once."""
    return F.transform(F.array(x), f)[0]


def log_gamma(z: Num) -> Column:
    """ln Gamma(z), z > 0: Stirling's series from z + 10 on, which is right to 1e-15 there, and ten factors back."""

    def series(w: Column) -> Column:
        r = 1 / (w * w)
        return (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / w

    def value(z: Column) -> Column:
        back = z
        for i in range(1, 10):
            back = back * (z + i)
        return F.when(z > 1e6, series(z)).otherwise(series(z + 10) - F.log(back))

    return let(col(z).cast("double"), value)


def log_binomial(n: Column, k: Column, p: Column) -> Column:
    """ln P(Bin(n, p) = k), 0 < p < 1, by deviances (Loader, 2000), so large terms do not cancel."""
    rest = lambda z: F.when(z < 1e4, log_gamma(z + 1) - (z + 0.5) * F.log(z) + z - 0.5 * math.log(2 * math.pi)).otherwise((1 / 12 - 1 / (360 * z * z)) / z)
    deviance = lambda x, m: x * F.log1p((x - m) / m) - (x - m)
    rests = F.aggregate(F.zip_with(F.transform(F.array(n, k, n - k), rest), F.array(F.lit(1), F.lit(-1), F.lit(-1)), lambda x, s: x * s), F.lit(0.0), lambda t, x: t + x)
    inner = rests - deviance(k, n * p) - deviance(n - k, n * (1 - p)) + 0.5 * F.log(n / (2 * math.pi * k * (n - k)))
    return F.when(k <= 0, n * F.log1p(-p)).when(k >= n, n * F.log(p)).otherwise(inner)


def _tail_area(log_f: Callable[[Column], Column], x: Column, room: Column, sign: Column) -> Column:
    """The integral of exp(log_f) over ``room`` from ``x`` towards ``sign``, where it falls, as a share of exp(log_f(x)).

    log_f is concave, so halving the range as long as its half has fallen far enough leaves nothing of weight out, and
    keeps at least half of the nodes where the weight lies. The cost does not depend on how large the arguments are.
    """

    def area(top: Column) -> Column:
        fallen = lambda r: top - log_f(x + sign * r) >= FALL
        width = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), room, lambda r, _: F.when(fallen(r / 2), r / 2).otherwise(r))
        return let(width, lambda r: r * F.aggregate(F.expr(_NODES), F.lit(0.0), lambda s, n: s + n["w"] * F.exp(log_f(x + sign * r * n["u"]) - top)))

    return let(log_f(x), area)


def beta_cdf(a: Num, b: Num, x: Num) -> Column:
    """The regularised incomplete beta function I_x(a, b) for a, b >= 1: of the two sides of ``x`` the one off the mode
    is integrated in log space, so small values keep their digits."""

    def value(v: Column) -> Column:
        a, b, x = v["a"], v["b"], v["x"]
        log_f = lambda t: (a - 1) * F.log(F.greatest(t, F.lit(1e-300))) + (b - 1) * F.log1p(-F.least(t, F.lit(1 - 1e-16)))
        below = x * (a + b - 2) < a - 1
        sign, room = F.when(below, -1.0).otherwise(1.0), F.when(below, x).otherwise(1 - x)
        scale = (a + b - 1) * F.exp(log_binomial(a + b - 2, a - 1, x))
        part = let(F.least(F.lit(1.0), scale * _tail_area(log_f, x, room, sign)), lambda t: F.when(below, t).otherwise(1 - t))
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(part)

    cast = lambda c, n: col(c).cast("double").alias(n)
    return let(F.struct(cast(a, "a"), cast(b, "b"), cast(x, "x")), value)


def gamma_tail(m: Num, x: Num) -> Column:
    """The regularised upper incomplete gamma function Q(m, x), m >= 1: P(chi-square of 2 m degrees >= 2 x)."""

    def value(v: Column) -> Column:
        m, x = v["m"], v["x"]
        log_f = lambda t: (m - 1) * F.log(F.greatest(t, F.lit(1e-300))) - t
        below = x < m - 1
        sign = F.when(below, -1.0).otherwise(1.0)
        room = F.when(below, x).otherwise(60 * (x + m + 10))
        part = let(F.least(F.lit(1.0), F.exp(log_f(x) - log_gamma(m)) * _tail_area(log_f, x, room, sign)), lambda t: F.when(below, 1 - t).otherwise(t))
        return F.when(x <= 0, 1.0).otherwise(part)

    return let(F.struct(col(m).cast("double").alias("m"), col(x).cast("double").alias("x")), value)


def binomial_tail(n: Num, k: Num, p: Num, upper: bool = True) -> Column:
    """P(Bin(n, p) >= k), or <= k, as an incomplete beta function; 0 < p < 1."""
    n, k, p = col(n).cast("double"), col(k).cast("double"), col(p)
    sure, never = (k <= 0, k > n) if upper else (k >= n, k < 0)
    tail = beta_cdf(k, n - k + 1, p) if upper else beta_cdf(n - k, k + 1, 1 - p)
    return F.when(sure, 1.0).when(never, 0.0).otherwise(tail)


def clopper_pearson(n: Num, k: Num, error: Num, upper: bool = False, rounds: int = 30) -> Column:
    """One-sided Clopper-Pearson bound of a success rate: Newton's method on the logarithm of the tail from the observed
    rate, kept within a bracket; a step that leaves it is a bisection."""

    def value(v: Column) -> Column:
        n, k, error = v["n"], v["k"], v["e"]
        a, b = (k + 1, n - k) if upper else (k, n - k + 1)
        # as a function of the rate the tail rises for the lower bound and falls for the upper one
        tail = (lambda p: beta_cdf(b, a, 1 - p)) if upper else (lambda p: beta_cdf(a, b, p))
        turn = -1.0 if upper else 1.0

        def step(acc: Column, _: Column) -> Column:
            p = acc["p"]

            def moved(t: Column) -> Column:
                low = (t > error) if upper else (t < error)  # the bound is above p
                lo, hi = F.when(low, p).otherwise(acc["lo"]), F.when(low, acc["hi"]).otherwise(p)
                slope = n * F.exp(log_binomial(n - 1, a - 1, p))
                newton = p - turn * F.log(t / error) * t / slope
                inside = (newton >= lo) & (newton <= hi)
                return F.struct(lo.alias("lo"), hi.alias("hi"), F.when(inside, newton).otherwise((lo + hi) / 2).alias("p"))

            return let(tail(p), moved)

        first = F.least(F.greatest(k / n, F.lit(1e-12)), F.lit(1 - 1e-12))
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), first.alias("p"))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda acc: acc["p"])
        return F.when(k >= n, 1.0).otherwise(found) if upper else F.when(k <= 0, 0.0).otherwise(found)

    return let(F.struct(col(n).cast("double").alias("n"), col(k).cast("double").alias("k"), col(error).alias("e")), value)


def bernoulli_kl(a: Num, b: Num) -> Column:
    """kl(a || b) of Bernoulli rates, 0 < b < 1."""
    a, b = col(a), col(b)
    one = F.when(a <= 0, 0.0).otherwise(a * F.log(a / b))
    two = F.when(a >= 1, 0.0).otherwise((1 - a) * F.log((1 - a) / (1 - b)))
    return one + two


def kl_lower(mean: Num, n: Num, error: Num, rounds: int = 60) -> Column:
    """The q below ``mean`` with kl(mean || q) = ln(1 / error) / n; 0 at mean 0, error^(1/n) at mean 1."""
    mean, n, error = col(mean), col(n), col(error)
    goal = F.log(1 / error) / n
    start = F.struct(F.lit(0.0).alias("lo"), mean.alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        low = bernoulli_kl(mean, mid) > goal
        return F.struct(F.when(low, mid).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda acc: acc["lo"])
    return F.when(mean <= 0, 0.0).when(mean >= 1, F.pow(error, 1 / n)).otherwise(found)


def log_add(a: Num, b: Num) -> Column:
    return F.greatest(col(a), col(b)) + F.log1p(F.exp(-F.abs(col(a) - col(b))))


def safe_ratio(a: Num, b: Num, fill: float = 0.0) -> Column:
    """a / b, and ``fill`` where the divisor is 0 or the quotient is null or not finite."""
    q = col(a) / F.nullif(col(b), F.lit(0.0))
    return F.when(q.isNull() | F.isnan(q) | (F.abs(q) == float("inf")), fill).otherwise(q)


def finite(x: Num) -> Column:
    """NaN and infinities as null."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def quadratic_alpha(round_: Num, alpha: float) -> Column:
    """The share of ``alpha`` that round t spends: 6 / (pi^2 t^2)."""
    return 6 * F.lit(alpha) / (F.pi() * F.pi() * col(round_) * col(round_))


def quadratic_spent(round_: Num, alpha: float) -> Column:
    """What the rounds up to t spend together: the first ones added up, beyond by the expansion of the sum's remainder."""
    t = col(round_).cast("double")
    z = t + 1
    rest = 1 / z + 1 / (2 * z * z) + 1 / (6 * F.pow(z, 3)) - 1 / (30 * F.pow(z, 5)) + 1 / (42 * F.pow(z, 7))
    first = F.aggregate(F.sequence(F.lit(1), F.least(t, F.lit(20.0)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / (i.cast("double") * i))
    return 6 * F.lit(alpha) / (F.pi() * F.pi()) * F.when(t <= 20, first).otherwise(F.pi() * F.pi() / 6 - rest)


def key_order(seed: int | Column, *ids: str) -> Column:
    """An order that depends on keys and a seed alone, the same in any engine."""
    return F.md5(F.concat_ws("#", *[F.col(i).cast("string") for i in ids], seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))))


def key_uniform(seed: int | Column, *ids: str) -> Column:
    """A number in [0, 1) from keys and a seed: the first 8 hexadecimal digits of an md5."""
    return F.conv(F.substring(key_order(seed, *ids), 1, 8), 16, 10).cast("double") / 4294967296.0
