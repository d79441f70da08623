"""Norm tables: mean and sample sd of the domain scores, full and short form."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalemetrics.operators.scoring import mean_of
from scalemetrics.spec import ScaleSpec


def fit_norms(df: DataFrame, spec: ScaleSpec) -> DataFrame:
    """(form, domain, mean, sd, n) for the full scores and, if declared, the short form.

    One global aggregate with map-side partials; the output has at most
    2 x domains rows.
    """
    sources = {("full", d): F.col(f"{d}_score") for d in spec.domains}
    sources |= {("short", d): mean_of(items) for d, items in spec.short_form.items()}
    prepared = df.select(*[c.alias(f"{f}_{d}") for (f, d), c in sources.items()])
    wide = prepared.agg(
        *[
            F.struct(
                F.lit(f).alias("form"), F.lit(d).alias("domain"), F.avg(f"{f}_{d}").alias("mean"),
                F.stddev_samp(f"{f}_{d}").alias("sd"), F.count(f"{f}_{d}").alias("n"),
            ).alias(f"{f}_{d}")
            for f, d in sources
        ]
    )
    return wide.select(F.inline(F.array(*[F.col(f"{f}_{d}") for f, d in sources])))


def norm_values(norms: DataFrame, spec: ScaleSpec, form: str = "full") -> dict[str, tuple[float, float]]:
    """Norms as literals for the scoring expressions; fails on absent or unusable values."""
    rows = norms.filter(F.col("form") == form).select("domain", "mean", "sd").limit(len(spec.domains) + 1).collect()
    values = {r["domain"]: (r["mean"], r["sd"]) for r in rows}
    for d in spec.domains:
        mean, sd = values.get(d, (None, None))
        if mean is None or sd is None or not (math.isfinite(mean) and math.isfinite(sd)) or sd <= 0:
            raise ValueError(f"norms for {d} are missing or not usable: {(mean, sd)}")
    return values


def norm_drift(current: DataFrame, stored: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Largest absolute difference to a stored norm table, and whether it is within tolerance.

    A row present on one side only is drift.
    """
    c, s = current.alias("c"), stored.alias("s")
    joined = c.join(s, ["form", "domain"], "full_outer")
    diff = F.greatest(F.abs(F.col("c.mean") - F.col("s.mean")), F.abs(F.col("c.sd") - F.col("s.sd")))
    return joined.agg(
        F.max(diff).alias("max_diff"),
        F.count_if(F.col("c.mean").isNull() | F.col("s.mean").isNull()).alias("unmatched"),
    ).withColumn("passed", (F.col("unmatched") == 0) & (F.coalesce(F.col("max_diff"), F.lit(0.0)) <= tolerance))


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """mean, sd, min, max per column as rows, from one aggregate."""
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"),
                F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in columns
        ]
    )
    return wide.select(F.inline(F.array(*[F.col(c) for c in columns])))
