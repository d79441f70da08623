"""Small statistical expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_corr(x: Column, y: Column, on_degenerate: float | None = None) -> Column:
    """Pearson r over pairs where both sides are present.

    A constant side gives ``on_degenerate`` (NULL by default) instead of the
    DIVIDE_BY_ZERO that ``corr`` raises under ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))
    return r if on_degenerate is None else F.coalesce(r, F.lit(float(on_degenerate)))


def strict_corr(x: Column, y: Column, label: str) -> Column:
    """Pearson r that fails the query when a side is constant."""
    r = safe_corr(x, y)
    return F.when(r.isNull(), F.raise_error(F.lit(f"{label}: correlation of a constant column"))).otherwise(r)


def r_from_sums(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson r from (weighted) sums; NULL when a side is constant."""
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    ok = (vx > 0) & (vy > 0)
    return F.when(ok, (n * sxy - sx * sy) / F.sqrt(F.when(ok, vx) * F.when(ok, vy)))


def pinball(y: Column, predicted: Column, q: float | Column) -> Column:
    q_c = F.lit(q) if isinstance(q, float) else q
    e = y - predicted
    return F.greatest(q_c * e, (q_c - 1) * e)


def within(x: Column, lo: Column, hi: Column) -> Column:
    return (x >= lo) & (x <= hi)


def share(condition: Column) -> Column:
    """Share of rows for which a condition holds."""
    return F.avg(condition.cast("int"))


def null_if_nan(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)


def r6(c: Column) -> Column:
    return F.round(c, 6)


def ks_p_value(statistic: Column, n1: Column, n2: Column, terms: int = 20) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value (large samples)."""
    t = statistic * F.sqrt(n1 * n2 / (n1 + n2))
    total = F.lit(0.0)
    for k in range(1, terms + 1):
        total = total + (2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * t * t)
    # below t = 0.2 the alternating series needs many terms while p is 1 to ten digits
    return F.when(t < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def log_gamma_step(x: Column, shift: int = 20) -> Column:
    """ln(Gamma(x + 1/2) / Gamma(x)) for x > 0: ``shift`` steps of the recurrence, then the asymptotic series."""
    up = F.aggregate(F.sequence(F.lit(0), F.lit(shift - 1)), F.lit(0.0), lambda s, k: s + F.log((x + k) / (x + k + 0.5)))
    z = x + shift
    series = 0.5 * F.log(z) - 1 / (8 * z) + 1 / (192 * z * z * z) - 1 / (640 * z * z * z * z * z)
    return up + series


def beta_fraction(a: Column, b: Column, x: Column, terms: int = 600) -> Column:
    """Continued fraction of the incomplete beta function, evaluated from its beginning (Lentz)."""

    def step(state: Column, k: Column) -> Column:
        m = F.ceil(k / 2)
        odd, even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m)), (a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        q = F.when(k % 2 == 1, odd).otherwise(-even)
        d, c = 1 / (1 + q * state["d"]), 1 + q / state["c"]
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * d * c).alias("h"))

    first = 1 / (1 - (a + b) * x / (a + 1))
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), step)["h"]


def pearson_p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of ``n`` pairs: the t statistic's tail, an incomplete beta function of 1 - r^2.

    NULL below three pairs or without r; 0 for a perfect correlation.
    """
    a, square = (n - 2) / 2.0, r * r
    x = 1 - square
    usable = (n > 2) & (square > 0) & (x > 0)
    # what is not usable must not reach a logarithm or a quotient
    a, square, x = (F.when(usable, c) for c in (a, square, x))
    front = F.exp(a * F.log(x) + 0.5 * F.log(square) + log_gamma_step(a) - 0.5 * math.log(math.pi))
    near = x < (a + 1) / (a + 2.5)
    tail = F.when(near, front * beta_fraction(a, F.lit(0.5), x) / a).otherwise(1 - 2 * front * beta_fraction(F.lit(0.5), a, square))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail))
    return F.when((n > 2) & r.isNotNull(), F.when(usable, p).when(r * r > 0, F.lit(0.0)).otherwise(F.lit(1.0)))


def spearman_brown(k: int | Column, r_bar: Column) -> Column:
    """Reliability of k parallel items with mean inter-item correlation r_bar, in [0, 1]."""
    k_c = F.lit(k) if isinstance(k, int) else k
    alpha = (k_c * r_bar) / (1 + (k_c - 1) * r_bar)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha))


def poisson_thresholds(upto: int = 12) -> list[float]:
    """Cumulative Poisson(1) probabilities P(W <= 0), P(W <= 1), ...

    Draws beyond the last one count as ``upto`` + 1: one draw in 1.6e10 is larger.
    """
    total, out = 0.0, []
    for k in range(upto + 1):
        total += math.exp(-1.0) / math.factorial(k)
        out.append(total)
    return out
