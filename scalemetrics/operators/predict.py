"""Prediction tables: one row per respondent, method and domain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalemetrics.operators.scoring import Norms, calibrate, long_percentiles, mean_of, order_quantiles
from scalemetrics.spec import ScaleSpec

TRIPLE = ("lower", "pred", "upper")


def to_percentile_rows(raw: DataFrame, norms: Norms, empty: float = 50.0) -> DataFrame:
    """Raw quantiles to percentiles, the crossing flag before ordering, and the ordered triple.

    A domain without answered items scores ``empty``.
    """
    out = long_percentiles(raw, {c: f"raw_{c}" for c in TRIPLE}, norms)
    out = out.withColumns({c: F.coalesce(c, F.lit(empty)) for c in TRIPLE})
    crossed = (F.col("lower") > F.col("upper")) | (F.col("pred") < F.col("lower")) | (F.col("pred") > F.col("upper"))
    return order_quantiles(out.withColumn("crossed", crossed))


def averaging_predictions(
    df: DataFrame, spec: ScaleSpec, selections: Mapping[str, Sequence[str]], norms: Norms, spread: float = 0.5
) -> DataFrame:
    """Score each selection by averaging its items.

    The interval ends are the means of the first and of the second half of a
    domain's selected items, moved out by ``spread``.  The rows of one respondent
    are built inside that respondent's row; nothing is joined.  Two methods share
    a projection: more would outgrow the JVM's method limit.
    """
    if len(selections) > 2:
        names = list(selections)
        pairs = [{m: selections[m] for m in names[n:n + 2]} for n in range(0, len(names), 2)]
        parts = [averaging_predictions(df, spec, pair, norms, spread) for pair in pairs]
        return reduce(DataFrame.unionByName, parts)
    rows: list[Column] = []
    for method, items in selections.items():
        for d in spec.domains:
            chosen = [i for i in items if spec.domain_of[i] == d]
            half = (len(chosen) + 1) // 2
            rows.append(
                F.struct(
                    F.lit(method).alias("method"), F.lit(len(items)).alias("k"), F.lit(d).alias("domain"),
                    F.col(f"{d}_percentile").alias("true"), F.col(f"{d}_score").alias("raw_true"),
                    (mean_of(chosen[:half]) - spread).alias("raw_lower"),
                    mean_of(chosen).alias("raw_pred"),
                    (mean_of(chosen[half:] or chosen) + spread).alias("raw_upper"),
                )
            )
    keep = [c for c in ("respondent_id", "split", "split_stratum") if c in df.columns]
    return to_percentile_rows(df.select(*keep, F.inline(F.array(*rows))), norms)


def model_predictions(df: DataFrame, spec: ScaleSpec, predicted: Mapping[tuple[str, str], Column], norms: Norms, method: str) -> DataFrame:
    """Prediction rows from fitted quantile expressions, keyed (domain, quantile name)."""
    rows = [
        F.struct(
            F.lit(method).alias("method"), F.lit(d).alias("domain"),
            F.col(f"{d}_percentile").alias("true"), F.col(f"{d}_score").alias("raw_true"),
            predicted[d, "q05"].alias("raw_lower"), predicted[d, "q50"].alias("raw_pred"),
            predicted[d, "q95"].alias("raw_upper"),
        )
        for d in spec.domains
        if (d, "q50") in predicted
    ]
    keep = [c for c in ("respondent_id", "split", "split_stratum", "mask_id", "fold") if c in df.columns]
    return to_percentile_rows(df.select(*keep, F.inline(F.array(*rows))), norms)


def apply_calibration(predictions: DataFrame, calibration: DataFrame, regime: str) -> DataFrame:
    """Stretch intervals with the fitted factors of one regime.

    ``calibration`` has one row per regime and domain; its values become a CASE. A
    prediction of a domain without a factor fails the job.
    """
    rows = calibration.filter(F.col("regime") == regime).select("domain", "scale_factor").collect()
    scale = F.raise_error(F.concat(F.lit(f"no {regime} calibration factor for domain "), F.col("domain"))).cast("double")
    for r in rows:
        if r["scale_factor"] is not None:
            scale = F.when(F.col("domain") == r["domain"], F.lit(r["scale_factor"])).otherwise(scale)
    return calibrate(predictions, scale)
