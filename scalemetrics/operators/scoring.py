"""Row-level scoring: domain means, percentiles, interval order, calibration."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalemetrics.functions.normal import normal_cdf, with_normal_cdf
from scalemetrics.spec import ScaleSpec

# domain -> (mean, sd)
Norms = Mapping[str, tuple[float, float]]


def mean_of(columns: Iterable[str]) -> Column:
    """Mean of the columns that are present; NULL when none is."""
    cols = [F.col(c) for c in columns]
    if not cols:
        return F.lit(None).cast("double")
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cols])
    answered = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.try_divide(total.cast("double"), answered)


def domain_scores(df: DataFrame, spec: ScaleSpec) -> DataFrame:
    return df.withColumns({f"{d}_score": mean_of(spec.domain_items(d)) for d in spec.domains})


def percentile_of_z(z: Column) -> Column:
    # greatest and least skip NULL, so missing must be kept out explicitly
    return F.when(z.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * normal_cdf(z))))


def add_percentiles(df: DataFrame, pairs: Mapping[str, str], norms: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Add ``target`` percentile columns.  ``pairs`` maps target column -> score column and
    ``norms`` maps target column -> (mean, sd)."""
    z = {f"__z_{t}": (F.col(s) - norms[t][0]) / norms[t][1] for t, s in pairs.items()}
    return _percentiles_of(df.withColumns(z), list(pairs)).drop(*z)


def _percentiles_of(df: DataFrame, targets: list[str]) -> DataFrame:
    """Percentile columns from the ``__z_<target>`` columns."""
    out = with_normal_cdf(df, {t: f"__z_{t}" for t in targets})
    clipped = {t: F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * F.col(t))) for t in targets}
    return out.withColumns({t: F.when(F.col(t).isNotNull(), c) for t, c in clipped.items()})


def score_percentiles(df: DataFrame, norms: Norms, spec: ScaleSpec) -> DataFrame:
    """``<domain>_percentile`` from ``<domain>_score``; a domain without norms is an error."""
    unknown = [d for d in spec.domains if d not in norms]
    if unknown:
        raise ValueError("no norms for: " + ", ".join(unknown))
    return add_percentiles(
        df,
        {f"{d}_percentile": f"{d}_score" for d in spec.domains},
        {f"{d}_percentile": norms[d] for d in spec.domains},
    )


def by_domain(domain: Column, values: Mapping[str, float]) -> Column:
    """Look a per-domain number up in a CASE over the spec's domains; others are an error."""
    expr = F.raise_error(F.concat(F.lit("unknown domain: "), F.coalesce(domain, F.lit("NULL")))).cast("double")
    for d, v in values.items():
        expr = F.when(domain == d, F.lit(float(v))).otherwise(expr)
    return expr


def long_percentiles(df: DataFrame, columns: Mapping[str, str], norms: Norms, domain: str = "domain") -> DataFrame:
    """Percentiles for a long table: ``columns`` maps target column -> raw score column."""
    mean = by_domain(F.col(domain), {d: m for d, (m, _) in norms.items()})
    sd = by_domain(F.col(domain), {d: s for d, (_, s) in norms.items()})
    out = df.withColumns({"__mean": mean, "__sd": sd})
    out = out.withColumns({f"__z_{t}": (F.col(s) - F.col("__mean")) / F.col("__sd") for t, s in columns.items()})
    return _percentiles_of(out, list(columns)).drop("__mean", "__sd", *[f"__z_{t}" for t in columns])


def order_quantiles(df: DataFrame, lower: str = "lower", mid: str = "pred", upper: str = "upper") -> DataFrame:
    """Sort the three quantiles of a row so that lower <= mid <= upper."""
    a, b, c = F.col(lower), F.col(mid), F.col(upper)
    low, high = F.least(a, b, c), F.greatest(a, b, c)
    middle = F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
    return df.withColumns({lower: low, mid: middle, upper: high})


def calibrate(df: DataFrame, scale: Column, lower: str = "lower", mid: str = "pred", upper: str = "upper") -> DataFrame:
    """Stretch the interval around the middle by ``scale``, clipped to 0..100, then order again."""
    half = 0.5 * (F.col(upper) - F.col(lower)) * scale
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    keep = F.coalesce(scale, F.lit(1.0)) == 1.0
    stretched = df.withColumns(
        {
            lower: F.when(keep, F.col(lower)).otherwise(clip(F.col(mid) - half)),
            upper: F.when(keep, F.col(upper)).otherwise(clip(F.col(mid) + half)),
        }
    )
    return order_quantiles(stretched, lower, mid, upper)


def calibration_regime(answered: Column, full_from: int, available: Iterable[str] = ("full", "sparse")) -> Column:
    """Which calibration applies to a row with ``answered`` items; ``none`` when it was not fitted."""
    have = set(available)
    full, sparse = (F.lit(n if n in have else "none") for n in ("full", "sparse"))
    return F.when(answered >= full_from, full).otherwise(sparse)


def keep_items(df: DataFrame, selected: Iterable[str], spec: ScaleSpec) -> DataFrame:
    """Set every unselected item missing."""
    chosen = set(selected)
    return df.withColumns({c: F.lit(None).cast("int") for c in spec.items if c not in chosen})


def answered_map(spec: ScaleSpec) -> Column:
    """Map item -> value of a wide row, without the missing items."""
    entries = F.map_from_arrays(
        F.array(*[F.lit(c) for c in spec.items]), F.array(*[F.col(c).cast("double") for c in spec.items])
    )
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def interval_flags(df: DataFrame, target_width: float = 0.5, lower: str = "raw_lower", upper: str = "raw_upper") -> DataFrame:
    """Raw interval width (after ordering) and whether it has converged."""
    width = F.greatest(lower, upper) - F.least(lower, upper)
    return df.withColumn("raw_width", width).withColumn("converged", F.col("raw_width") <= target_width)
