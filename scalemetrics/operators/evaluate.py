"""Accuracy, coverage and calibration statistics of prediction rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalemetrics.functions.stats import pearson_p_value, safe_corr, share, strict_corr, within
from scalemetrics.operators.quantiles import exact_quantiles

OVERALL = "overall"


def metric_columns(strict: bool = True) -> dict[str, Column]:
    """Aggregates over rows with true, pred, lower, upper, raw_true, raw_pred."""
    true, pred, lower, upper = (F.col(c) for c in ("true", "pred", "lower", "upper"))
    raw_error = F.col("raw_true") - F.col("raw_pred")
    error, inside = true - pred, within(true, lower, upper)
    central = within(true, F.lit(20.0), F.lit(80.0))
    r = (lambda x, y, label: strict_corr(x, y, label)) if strict else (lambda x, y, _: safe_corr(x, y))
    return {
        "n": F.count(true),
        "pearson_r": r(true, pred, "percentile scale"),
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "mean_error": F.avg(error),
        "within_3_pct": share(F.abs(error) <= 3),
        "within_5_pct": share(F.abs(error) <= 5),
        "within_10_pct": share(F.abs(error) <= 10),
        "coverage_90": share(inside),
        "coverage_central": F.avg(F.when(central, inside.cast("int"))),
        "coverage_tail": F.avg(F.when(~central, inside.cast("int"))),
        "mean_interval_width": F.avg(upper - lower),
        "std_interval_width": F.stddev_pop(upper - lower),
        "raw_pearson_r": safe_corr(F.col("raw_true"), F.col("raw_pred")),
        "raw_mae": F.avg(F.abs(raw_error)),
        "raw_rmse": F.sqrt(F.avg(raw_error * raw_error)),
    }


def accuracy(df: DataFrame, by: list[str] | None = None, metrics: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Metrics per (by..., domain) and over all domains together, in one pass.

    The overall rows have domain ``overall``.
    """
    by = by or []
    wanted = {k: c for k, c in metric_columns(strict).items() if metrics is None or k in metrics}
    keys = [F.col(c) for c in by]
    grouped = df.groupingSets([[*keys, F.col("domain")], keys], *keys, F.col("domain")).agg(
        *[c.alias(k) for k, c in wanted.items()]
    )
    return grouped.withColumn("domain", F.coalesce("domain", F.lit(OVERALL)))


def with_p_value(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("p_value", pearson_p_value(F.col("pearson_r"), F.col("n")))


def median_error(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Exact median of true - pred per domain, for tables of any size."""
    keys = [*(by or []), "domain"]
    errors = df.select(*keys, (F.col("true") - F.col("pred")).alias("error"))
    return exact_quantiles(errors, keys, "error", [0.5]).select(*keys, F.col("value").alias("median_error"))


def crossing_rate(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(share(F.col("crossed")).alias("raw_crossing_rate"))


def quintile_metrics(df: DataFrame, column: str = "true", bins: int = 5) -> DataFrame:
    """Accuracy inside equal-frequency bins of the true value, per domain.

    A domain whose bin edges coincide (with each other or with an extreme) is left out.
    """
    probs = [k / bins for k in range(bins + 1)]
    edges = exact_quantiles(df, ["domain"], column, probs).groupBy("domain").agg(
        F.array_sort(F.collect_list("value")).alias("edges")  # bins + 1 values
    )
    usable = edges.filter(F.size(F.array_distinct("edges")) == bins + 1)
    inner = F.slice("edges", 2, bins - 1)
    placed = df.join(usable, "domain").withColumn(
        "bin", F.size(F.filter(inner, lambda e: e < F.col(column))) + 1
    )
    inside = within(F.col("true"), F.col("lower"), F.col("upper"))
    return placed.groupBy("domain", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("true").alias("mean_true"), F.avg("pred").alias("mean_pred"),
        F.avg(F.abs(F.col("true") - F.col("pred"))).alias("mae"), share(inside).alias("coverage_90"),
        F.avg(F.col("upper") - F.col("lower")).alias("mean_interval_width"),
    )


def tails_and_centre(quintiles: DataFrame, bins: int = 5) -> DataFrame:
    """Plain means of the bin metrics over the outer bins and over the middle bin."""
    zone = F.when(F.col("bin").isin(1, bins), "tails").when(F.col("bin") == (bins + 1) // 2, "centre")
    return quintiles.withColumn("zone", zone).filter(F.col("zone").isNotNull()).groupBy("zone").agg(
        F.avg("mae").alias("mae"), F.avg("coverage_90").alias("coverage_90"),
        F.avg("mean_interval_width").alias("mean_interval_width"),
    )


def scale_for_coverage(coverage: Column) -> Column:
    # Accepted band 0.85..0.95, target 0.90, floor 0.5.
    return (
        F.when(coverage < 0.85, 0.90 / F.greatest(coverage, F.lit(0.5)))
        .when(coverage > 0.95, 0.90 / F.greatest(coverage, F.lit(0.5)))
        .otherwise(F.lit(1.0))
    )


def fit_calibration(df: DataFrame, regime: str) -> DataFrame:
    """(regime, domain, observed_coverage, scale_factor) from ordered intervals."""
    coverage = share(within(F.col("true"), F.col("lower"), F.col("upper")))
    return calibration_from_metrics(df.groupBy("domain").agg(coverage.alias("coverage_90")), regime)


def calibration_from_metrics(metrics: DataFrame, regime: str) -> DataFrame:
    usable = metrics.filter(
        F.col("coverage_90").isNotNull() & ~F.isnan("coverage_90") & (F.col("domain") != OVERALL)
    )
    return usable.select(
        F.lit(regime).alias("regime"), "domain", F.col("coverage_90").alias("observed_coverage"),
        scale_for_coverage(F.col("coverage_90")).alias("scale_factor"),
    )


def melt(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Metric columns to (keys..., metric, value) rows."""
    typed = metrics.select(*keys, *[F.col(n).cast("double").alias(n) for n in names])
    return typed.unpivot(keys, names, "metric", "value")


def average_runs(runs: DataFrame, run: str = "run", section: str = "domain") -> DataFrame:
    """Mean of each (section, metric) over runs; NaN unless every run has a finite value."""
    total = runs.agg(F.count_distinct(run).alias("n_runs"))
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    grouped = runs.groupBy(section, "metric").agg(
        F.count_if(finite).alias("ok"), F.count(F.lit(1)).alias("present"),
        F.avg(F.when(finite, F.col("value"))).alias("mean_value"),
    )
    complete = (F.col("ok") == total.scalar()) & (F.col("present") == F.col("ok"))
    return grouped.select(section, "metric", F.when(complete, F.col("mean_value")).otherwise(F.lit(float("nan"))).alias("value"))


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean, population sd, min and max of each (domain, metric) over folds."""
    return folds.groupBy("domain", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )


def cross_validate(df: DataFrame, fold: str, folds: int, evaluate: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``evaluate(train, test)`` for every fold, as one table with a ``fold`` column.

    Only fold numbers are looped over; each fold is a filter.
    """
    parts = [evaluate(df.filter(F.col(fold) != n), df.filter(F.col(fold) == n)).withColumn("fold", F.lit(n)) for n in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def output_check(predicted: DataFrame, model: str = "model", value: str = "value") -> DataFrame:
    """Detect collapsed or out-of-range models from their predictions."""
    stats = predicted.groupBy(model).agg(
        F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    # Sd 0.1, range 0.5, allowed span 0.5..5.5.
    issues = F.array_compact(
        F.array(
            F.when(F.col("std") < 0.1, F.lit("low variance")),
            F.when(F.col("max") - F.col("min") < 0.5, F.lit("narrow range")),
            F.when((F.col("min") < 0.5) | (F.col("max") > 5.5), F.lit("out of range")),
        )
    )
    return stats.withColumn("issues", issues).withColumn("passed", F.size("issues") == 0)


def require_sound(checked: DataFrame, model: str = "model") -> None:
    """Fail when any model of an ``output_check`` table (one row per model) collapsed or left the range."""
    bad = checked.filter(~F.coalesce("passed", F.lit(False))).select(model, F.array_join("issues", ", ").alias("issues")).collect()
    if bad:
        raise ValueError("unsound models: " + "; ".join(f"{r[model]} ({r['issues'] or 'no predictions'})" for r in sorted(bad)))


def ordering_check(means: DataFrame) -> DataFrame:
    """Per domain: are the mean predictions of the three quantiles strictly ordered?"""
    return means.withColumn("ordered", (F.col("q05") < F.col("q50")) & (F.col("q50") < F.col("q95")))


def quality_gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Failed gates.  ``metrics`` is (regime, domain, metric, value); ``thresholds`` is
    (regime, domain, metric, minimum) where a NULL domain is the default."""
    own = thresholds.filter(F.col("domain").isNotNull()).select("regime", "domain", "metric", F.col("minimum").alias("own_min"))
    default = thresholds.filter(F.col("domain").isNull()).select("regime", "metric", F.col("minimum").alias("default_min"))
    limit = F.coalesce("own_min", "default_min")
    checked = metrics.join(own, ["regime", "domain", "metric"], "left").join(default, ["regime", "metric"], "left")
    failed = F.col("value").isNull() | F.isnan("value") | (F.col("value") < limit)
    return checked.filter(limit.isNotNull() & failed).select("regime", "domain", "metric", "value", limit.alias("minimum"))


def scoring_deltas(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """r, MAE and within-5 of two scorings of the same rows and their differences.

    ``df`` has one row per (respondent, domain, keys...) with ``true``, ``pred_<a>``
    and ``pred_<b>``.
    """
    def stats(p: str) -> dict[str, Column]:
        e = F.abs(F.col("true") - F.col(f"pred_{p}"))
        return {f"r_{p}": safe_corr(F.col("true"), F.col(f"pred_{p}")), f"mae_{p}": F.avg(e), f"within_5_{p}": share(e <= 5)}

    out = df.groupBy(*keys).agg(*[c.alias(n) for p in (a, b) for n, c in stats(p).items()])
    return out.withColumns({f"delta_{m}": F.col(f"{m}_{a}") - F.col(f"{m}_{b}") for m in ("r", "mae", "within_5")})
