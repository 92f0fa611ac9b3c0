"""SQL text of the formulas, for the checks."""

from __future__ import annotations

import math


def hoeffding_p(violation: bool = False) -> str:
    gap = "(mean - tolerance)" if violation else "(tolerance - mean)"
    return f"CASE WHEN {gap} <= 0 THEN 1.0e0 ELSE exp(-2 * n * {gap} * {gap} / ((upper - lower) * (upper - lower))) END"


def hoeffding_bound(error: str, up: bool) -> str:
    r = f"(upper - lower) * sqrt(ln(1 / ({error})) / (2 * n))"
    return f"least(upper, mean + {r})" if up else f"greatest(lower, mean - {r})"


def bernstein_bound(error: str, up: bool) -> str:
    r = f"(sqrt(2 * var * ln(2 / ({error})) / n) + 7 * (upper - lower) * ln(2 / ({error})) / (3 * (n - 1)))"
    own = f"least(upper, mean + {r})" if up else f"greatest(lower, mean - {r})"
    return f"CASE WHEN n < 2 THEN {hoeffding_bound(error, up)} ELSE {own} END"


def bernstein_p(violation: bool = False) -> str:
    gap = "(mean - tolerance)" if violation else "(tolerance - mean)"
    beyond = "tolerance < lower" if violation else "tolerance > upper"
    a, b = "sqrt(2 * var / n)", "(7 * (upper - lower) / (3 * (n - 1)))"
    s = f"((sqrt({a} * {a} + 4 * {b} * {gap}) - {a}) / (2 * {b}))"
    return f"CASE WHEN {beyond} THEN 0.0e0 WHEN {gap} <= 0 THEN 1.0e0 WHEN n < 2 THEN {hoeffding_p(violation)} ELSE least(1.0e0, 2 * exp(-{s} * {s})) END"


def holm(p: str, order: str, family: str = "") -> str:
    by = f"PARTITION BY {family} " if family else ""
    return f"least(1.0e0, max(stepped_{p}) OVER ({by}ORDER BY {p}, {order} ROWS UNBOUNDED PRECEDING))"


def stepped(p: str, order: str, family: str = "") -> str:
    by = f"PARTITION BY {family}" if family else ""
    return f"(count(*) OVER ({by}) - row_number() OVER ({by} ORDER BY {p}, {order}) + 1) * {p} AS stepped_{p}"


def tail(n: str, k: str, p: str, up: bool = True) -> str:
    """Binomial tail; terms by the log gamma function."""
    span = f"range(CAST({k} AS BIGINT), CAST({n} AS BIGINT) + 1)" if up else f"range(0, CAST({k} AS BIGINT) + 1)"
    sure = f"{k} <= 0" if up else f"{k} >= {n}"
    term = f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - ({p})))"
    return f"CASE WHEN {sure} THEN 1.0e0 ELSE least(1.0e0, coalesce(list_sum([{term} for i in {span}]), 0.0e0)) END"


def clopper_pearson(name: str, source: str, key: str, n: str, k: str, error: str, up: bool = False) -> str:
    """Recursive bisection as common table expressions ``name``(key, bound)."""
    t = tail("n", "k", "((lo + hi) / 2)", up=not up)
    low = f"({t}) > e" if up else f"({t}) < e"
    edge = "k >= n" if up else "k <= 0"
    return f"""{name}_steps AS (
  SELECT {key} AS key, CAST({n} AS BIGINT) AS n, CAST({k} AS BIGINT) AS k, CAST({error} AS DOUBLE) AS e, 0.0e0 AS lo, 1.0e0 AS hi, 0 AS i FROM {source}
  UNION ALL SELECT key, n, k, e, CASE WHEN {low} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {low} THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM {name}_steps WHERE i < 50),
{name} AS (SELECT key AS {key}, CASE WHEN {edge} THEN {'1.0e0' if up else '0.0e0'} ELSE (lo + hi) / 2 END AS bound FROM {name}_steps WHERE i = 50)"""


def kl(a: str, b: str) -> str:
    return f"(CASE WHEN {a} <= 0 THEN 0.0e0 ELSE {a} * ln({a} / ({b})) END + CASE WHEN {a} >= 1 THEN 0.0e0 ELSE (1 - {a}) * ln((1 - {a}) / (1 - ({b}))) END)"


def kl_lower(name: str, source: str, key: str, mean: str, n: str, error: str) -> str:
    mid = "((lo + hi) / 2)"
    low = f"{kl('m', mid)} > ln(1 / e) / n"
    return f"""{name}_steps AS (
  SELECT {key} AS key, CAST({mean} AS DOUBLE) AS m, CAST({n} AS DOUBLE) AS n, CAST({error} AS DOUBLE) AS e, 0.0e0 AS lo, CAST({mean} AS DOUBLE) AS hi, 0 AS i FROM {source}
  UNION ALL SELECT key, m, n, e, CASE WHEN {low} THEN {mid} ELSE lo END, CASE WHEN {low} THEN hi ELSE {mid} END, i + 1 FROM {name}_steps WHERE i < 60),
{name} AS (SELECT key AS {key}, CASE WHEN m <= 0 THEN 0.0e0 WHEN m >= 1 THEN pow(e, 1 / n) ELSE lo END AS bound FROM {name}_steps WHERE i = 60)"""


def status(good: str, bad: str) -> str:
    return f"CASE WHEN {good} THEN 'Validated' WHEN {bad} THEN 'Violation detected' ELSE 'Unresolved' END"


def key_order(seed: int, *ids: str) -> str:
    return f"md5(concat_ws('#', {', '.join(ids)}, '{seed}'))"


def key_uniform(seed: int, *ids: str) -> str:
    return f"(CAST(CAST(concat('0x', substr({key_order(seed, *ids)}, 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0e0)"


def release_uniform(seed: int, release: str, *ids: str) -> str:
    """The release's number of those that the keys give, four from each md5."""
    hashed = "md5(concat_ws('#', " + ", ".join(ids) + f", {release} // 4, '{seed}'))"
    return f"(CAST(CAST(concat('0x', substr({hashed}, CAST({release} % 4 * 8 + 1 AS INTEGER), 8)) AS BIGINT) AS DOUBLE) / 4294967296.0e0)"


def release_weight(seed: int, release: str, *ids: str) -> str:
    """Poisson(1) counts of those numbers."""
    steps = ", ".join(f"{sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))!r}e0" for k in range(12))
    return f"len(list_filter([{steps}], lambda c: {release_uniform(seed, release, *ids)} >= c))"
