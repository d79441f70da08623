"""Accuracy, coverage, calibration, gates and comparisons of prediction rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalemetrics.functions.stats import safe_corr, null_if_nan, r6
from scalemetrics.operators import compare, evaluate, strata
from scalemetrics.plans.itemstats import rounded
from scalemetrics.plans.registry import query
from scalemetrics.plans.sqlparts import corr, part, pct, r6 as sr6, row_hash, sql, values
from scalemetrics.plans.tables import SEED, SPEC, predictions, scored
from scalemetrics.workspace import written

INSIDE = "CASE WHEN true_pct BETWEEN lower AND upper THEN 1.0::DOUBLE ELSE 0 END"
E = "abs(true_pct - pred)"


def within_sql(limit: int) -> str:
    return f"avg(CASE WHEN {E} <= {limit} THEN 1.0::DOUBLE ELSE 0 END)"


METRIC_SQL = {
    "pearson_r": corr("true_pct", "pred"),
    "mae": f"avg({E})",
    "rmse": "sqrt(avg((true_pct - pred) * (true_pct - pred)))",
    "mean_error": "avg(true_pct - pred)",
    "within_3_pct": within_sql(3),
    "within_5_pct": within_sql(5),
    "within_10_pct": within_sql(10),
    "coverage_90": f"avg({INSIDE})",
    "coverage_central": f"avg({INSIDE}) FILTER (WHERE true_pct BETWEEN 20 AND 80)",
    "coverage_tail": f"avg({INSIDE}) FILTER (WHERE true_pct NOT BETWEEN 20 AND 80)",
    "mean_interval_width": "avg(upper - lower)",
    "std_interval_width": "stddev_pop(upper - lower)",
    "raw_pearson_r": corr("raw_true", "raw_pred"),
    "raw_mae": "avg(abs(raw_true - raw_pred))",
    "raw_rmse": "sqrt(avg((raw_true - raw_pred) * (raw_true - raw_pred)))",
}


def metric_sql(names: list[str], source: str = "pred", by: str = "method") -> str:
    cols = ", ".join(f"{METRIC_SQL[n]} AS {n}" for n in names)
    return f"""SELECT {by}, coalesce(domain, 'overall') AS domain, count(*) AS n, {cols} FROM {source}
    GROUP BY GROUPING SETS (({by}, domain), ({by}))"""


def rounded_sql(names: list[str]) -> str:
    return ", ".join(f"{sr6(n)} AS {n}" for n in names)


def p_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation from the finite series of the t distribution with whole degrees of freedom."""
    even = f"abs({r}) * list_sum(list_transform(range(0, ({n} - 2) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - 0.5 * ln(pi()) + k * ln(1 - {r} * {r}))))"
    odd = f"""2 / pi() * (asin(abs({r})) + abs({r}) * sqrt(1 - {r} * {r}) * coalesce(list_sum(list_transform(range(0, ({n} - 3) // 2),
        lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5) + k * ln(1 - {r} * {r})))), 0))"""
    return f"CASE WHEN {n} > 2 THEN CASE WHEN abs({r}) >= 1 THEN 0 ELSE greatest(0, 1 - CASE WHEN {n} % 2 = 0 THEN {even} ELSE {odd} END) END END"


ACCURACY = ["pearson_r", "mae", "rmse", "mean_error", "within_3_pct", "within_5_pct", "within_10_pct"]
INTERVALS = ["coverage_90", "coverage_central", "coverage_tail", "mean_interval_width", "std_interval_width"]
RAW = ["raw_pearson_r", "raw_mae", "raw_rmse"]


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """All metrics of both scorers per domain and overall: one pass."""
    return written(
        spark, f"metrics|{sf}", lambda: evaluate.accuracy(predictions(spark, sf), ["method"]).coalesce(1)
    )


@query("a13_accuracy_by_domain", sql(
    f"SELECT method, m.domain, n, {rounded_sql(ACCURACY)}, {sr6('md')} AS median_error, p < 0.000001 AS significant FROM (SELECT *, {p_sql('pearson_r', 'n')} AS p FROM ({metric_sql(ACCURACY)}) WHERE domain <> 'overall') m JOIN (SELECT method AS m2, domain AS d2, median(true_pct - pred) AS md FROM pred GROUP BY ALL) ON m2 = method AND d2 = m.domain",
    "pred"))
def a13(spark: SparkSession, sf: str) -> DataFrame:
    pred = predictions(spark, sf)
    table = evaluate.with_p_value(evaluate.accuracy(pred, ["method"], ["n", *ACCURACY]).filter("domain <> 'overall'"))
    out = table.join(evaluate.median_error(pred, ["method"]), ["method", "domain"])
    return rounded(out, *ACCURACY, "median_error").withColumn("significant", F.col("p_value") < 1e-6).drop("p_value")


@query("a13_error_trend", sql(
    f"""SELECT method, domain, split_stratum, n, {sr6('r')} AS pearson_r, {sr6(p_sql('r', 'n'))} AS p_value FROM
    (SELECT method, domain, CAST(stratum AS VARCHAR) AS split_stratum, count(*) AS n, {corr('true_pct', 'e')} AS r
     FROM (SELECT *, abs(true_pct - pred) AS e FROM pred JOIN st USING (rid)) GROUP BY ALL)""", "pred", "st"))
def a13_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Whether errors grow with the true value: r and its p in every stratum, most of them small samples."""
    pred = predictions(spark, sf).withColumn("e", F.abs(F.col("true") - F.col("pred")))
    r = pred.groupBy("method", "domain", F.col("split_stratum").cast("string").alias("split_stratum")).agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("true"), F.col("e")).alias("pearson_r"))
    return rounded(evaluate.with_p_value(r), "pearson_r", "p_value")


@query("a14_overall_metrics", sql(
    f"SELECT method, domain, n, {rounded_sql(ACCURACY + ['coverage_90'])} FROM ({metric_sql(ACCURACY + ['coverage_90'])})", "pred"))
def a14(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.accuracy(predictions(spark, sf), ["method"], ["n", *ACCURACY, "coverage_90"])
    return rounded(out, *ACCURACY, "coverage_90")


@query("a15_central_tail_coverage", sql(f"SELECT method, domain, {rounded_sql(INTERVALS)} FROM ({metric_sql(INTERVALS)})", "pred"))
def a15(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.accuracy(predictions(spark, sf), ["method"], INTERVALS), *INTERVALS)


@query("a16_raw_metrics", sql(f"SELECT method, domain, {rounded_sql(RAW)} FROM ({metric_sql(RAW)}) WHERE domain <> 'overall'", "pred"))
def a16(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.accuracy(predictions(spark, sf), ["method"], RAW).filter("domain <> 'overall'"), *RAW)


part(
    "quint",
    f"""SELECT domain, CAST(bin AS INTEGER) AS bin, count(*) AS n, avg(true_pct) AS mean_true, avg(pred) AS mean_pred, avg({E}) AS mae,
    avg({INSIDE}) AS coverage_90, avg(upper - lower) AS mean_interval_width FROM (
      SELECT p.*, 1 + (true_pct > e[2])::INT + (true_pct > e[3])::INT + (true_pct > e[4])::INT + (true_pct > e[5])::INT AS bin FROM pred p
      JOIN (SELECT domain, quantile_cont(true_pct, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM pred WHERE method = 'short_form' GROUP BY domain) q
      ON q.domain = p.domain AND len(list_distinct(e)) = 6 WHERE method = 'short_form') GROUP BY ALL""",
    "pred",
)
QUINT = ["mean_true", "mean_pred", "mae", "coverage_90", "mean_interval_width"]


@query("a17_quintile_metrics", sql(f"SELECT domain, bin, n, {rounded_sql(QUINT)} FROM quint", "quint"))
def a17(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.quintile_metrics(predictions(spark, sf).filter("method = 'short_form'")), *QUINT)


@query("a18_tails_and_centre", sql(
    f"SELECT CASE WHEN bin = 3 THEN 'centre' ELSE 'tails' END AS zone, {', '.join(f'{sr6(f'avg({c})')} AS {c}' for c in QUINT[2:])} FROM quint WHERE bin IN (1, 3, 5) GROUP BY 1", "quint"))
def a18(spark: SparkSession, sf: str) -> DataFrame:
    bins = evaluate.quintile_metrics(predictions(spark, sf).filter("method = 'short_form'"))
    return rounded(evaluate.tails_and_centre(bins), *QUINT[2:])


LONG_NAMES = ["pearson_r", "mae", "coverage_90"]


def long_sql(names: list[str], source: str = "pred", by: str = "method") -> str:
    return " UNION ALL ".join(
        f"SELECT {by}, domain, '{n}' AS metric, {n} AS value FROM ({metric_sql(names, source, by)})" for n in names
    )


@query("a20_mask_average", sql(
    f"""SELECT domain, metric, CASE WHEN count(value) = 2 THEN {sr6('avg(value)')} END AS value FROM ({long_sql(LONG_NAMES)})
    WHERE NOT (method = 'first_n' AND domain = 'opn' AND metric = 'mae') GROUP BY ALL""", "pred"))
def a20(spark: SparkSession, sf: str) -> DataFrame:
    runs = evaluate.melt(metrics(spark, sf), ["method", "domain"], LONG_NAMES)
    # one run lacks one metric, so its average must not be reported
    partial = runs.filter("NOT (method = 'first_n' AND domain = 'opn' AND metric = 'mae')")
    return evaluate.average_runs(partial, "method").withColumn("value", r6(null_if_nan(F.col("value"))))


part(
    "predf",
    f"""SELECT pred.*, fold FROM pred JOIN (SELECT rid AS r, CAST(((rn - 1) * 3) // n AS INTEGER) AS fold FROM (SELECT rid,
    row_number() OVER (PARTITION BY stratum ORDER BY {row_hash(SEED, 'rid')}, rid) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM st))
    ON r = rid WHERE method = 'short_form'""",
    "pred", "st",
)


@query("a21_fold_summary", sql(
    f"""SELECT domain, metric, {sr6('avg(value)')} AS mean, {sr6('stddev_pop(value)')} AS std, {sr6('min(value)')} AS min, {sr6('max(value)')} AS max
    FROM ({long_sql(LONG_NAMES, 'predf', 'fold')}) GROUP BY ALL""", "predf"))
def a21(spark: SparkSession, sf: str) -> DataFrame:
    folds = strata.assign_folds(
        scored(spark, sf).select("respondent_id", "split_stratum"), "respondent_id", 3, SEED, "split_stratum"
    )
    rows = predictions(spark, sf).filter("method = 'short_form'").join(folds.select("respondent_id", "fold"), "respondent_id")
    per_fold = evaluate.melt(evaluate.accuracy(rows, ["fold"], LONG_NAMES), ["fold", "domain"], LONG_NAMES)
    return rounded(evaluate.fold_summary(per_fold), "mean", "std", "min", "max")


@query("a22_output_check", sql(
    f"""SELECT domain || '_' || q AS model, {sr6('stddev_pop(v)')} AS std, {sr6('min(v)')} AS min, {sr6('max(v)')} AS max,
    concat_ws(',', CASE WHEN stddev_pop(v) < 0.1 THEN 'low variance' END, CASE WHEN max(v) - min(v) < 0.5 THEN 'narrow range' END,
      CASE WHEN min(v) < 0.5 OR max(v) > 5.5 THEN 'out of range' END) AS issues,
    stddev_pop(v) >= 0.1 AND max(v) - min(v) >= 0.5 AND min(v) >= 0.5 AND max(v) <= 5.5 AS passed FROM
    (SELECT rid, domain, unnest(['q05', 'q50', 'q95']) AS q, unnest([raw_lower, raw_pred, raw_upper]) AS v FROM pred WHERE method = 'short_form')
     GROUP BY domain, q""", "pred"))
def a22(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf).filter("method = 'short_form'")
    long = rows.select("domain", F.inline(F.array(*[
        F.struct(F.lit(q).alias("q"), F.col(c).alias("value")) for q, c in (("q05", "raw_lower"), ("q50", "raw_pred"), ("q95", "raw_upper"))
    ]))).select(F.concat_ws("_", "domain", "q").alias("model"), "value")
    out = evaluate.output_check(long).withColumn("issues", F.array_join("issues", ","))
    return rounded(out, "std", "min", "max")


@query("a22_quantile_order", sql(
    f"SELECT domain, {sr6('avg(raw_lower)')} AS q05, {sr6('avg(raw_pred)')} AS q50, {sr6('avg(raw_upper)')} AS q95, avg(raw_lower) < avg(raw_pred) AND avg(raw_pred) < avg(raw_upper) AS ordered FROM pred WHERE method = 'short_form' GROUP BY domain", "pred"))
def a22_order(spark: SparkSession, sf: str) -> DataFrame:
    means = predictions(spark, sf).filter("method = 'short_form'").groupBy("domain").agg(
        F.avg("raw_lower").alias("q05"), F.avg("raw_pred").alias("q50"), F.avg("raw_upper").alias("q95")
    )
    return rounded(evaluate.ordering_check(means), "q05", "q50", "q95")


THRESHOLDS = [
    ("short_form", None, "pearson_r", 0.93), ("short_form", "opn", "pearson_r", 0.99), ("short_form", "overall", "coverage_90", 0.8),
    ("first_n", None, "coverage_90", 0.9),
]


@query("a23_quality_gates", sql(
    f"""SELECT regime, domain, metric, {sr6('value')} AS value, minimum FROM (SELECT m.method AS regime, m.domain, m.metric, m.value,
    coalesce(o.minimum, d.minimum) AS minimum FROM ({long_sql(LONG_NAMES)}) m
    LEFT JOIN th o ON o.regime = m.method AND o.domain = m.domain AND o.metric = m.metric
    LEFT JOIN th d ON d.regime = m.method AND d.domain IS NULL AND d.metric = m.metric) WHERE value IS NULL OR value < minimum""".replace(
        " th ", f" (SELECT * FROM ({values(THRESHOLDS)}) t(regime, domain, metric, minimum)) "), "pred"))
def a23(spark: SparkSession, sf: str) -> DataFrame:
    thresholds = spark.createDataFrame(THRESHOLDS, "regime string, domain string, metric string, minimum double")
    long = evaluate.melt(metrics(spark, sf), ["method", "domain"], LONG_NAMES).withColumnRenamed("method", "regime")
    return rounded(evaluate.quality_gates(long, thresholds), "value")


@query("a28_scoring_deltas", sql(
    f"""SELECT method, k, {", ".join(f"{sr6(c)} AS {c}" for c in ("r_avg", "mae_avg", "within_5_avg", "r_mid", "mae_mid", "within_5_mid"))},
    {sr6('r_avg - r_mid')} AS delta_r, {sr6('mae_avg - mae_mid')} AS delta_mae, {sr6('within_5_avg - within_5_mid')} AS delta_within_5 FROM
    (SELECT method, 20 AS k, {corr('true_pct', 'pred')} AS r_avg, avg(abs(true_pct - pred)) AS mae_avg, avg((abs(true_pct - pred) <= 5)::INT) AS within_5_avg,
     {corr('true_pct', 'mid')} AS r_mid, avg(abs(true_pct - mid)) AS mae_mid, avg((abs(true_pct - mid) <= 5)::INT) AS within_5_mid
     FROM (SELECT *, (lower + upper) / 2 AS mid FROM pred) GROUP BY method)""", "pred"))
def a28(spark: SparkSession, sf: str) -> DataFrame:
    both = predictions(spark, sf).withColumns({"pred_avg": F.col("pred"), "pred_mid": (F.col("lower") + F.col("upper")) / 2})
    out = evaluate.scoring_deltas(both, "avg", "mid", ["method", "k"])
    return rounded(out, *[c for c in out.columns if c not in ("method", "k")])


@query("j2_targets_and_predictions", sql(
    f"SELECT pred.rid AS respondent_id, method, pred.domain, {sr6('pc.pct - pred.pred')} AS error FROM pred JOIN pc ON pc.rid = pred.rid AND pc.domain = pred.domain",
    "pred", "pc"))
def j2(spark: SparkSession, sf: str) -> DataFrame:
    """Targets joined to predictions on their keys instead of by position."""
    targets = scored(spark, sf).select("respondent_id", *SPEC.percentiles).unpivot(
        ["respondent_id"], list(SPEC.percentiles), "column", "target"
    ).select("respondent_id", F.substring_index("column", "_", 1).alias("domain"), "target")
    preds = predictions(spark, sf).select("respondent_id", "domain", "method", "pred")
    return preds.join(targets, ["respondent_id", "domain"]).select(
        "respondent_id", "method", "domain", r6(F.col("target") - F.col("pred")).alias("error")
    )


@query("j5_concatenate", sql("SELECT split, count(*) AS n, count(DISTINCT rid) AS respondents FROM sp WHERE split <> 'test' GROUP BY split", "sp"))
def j5(spark: SparkSession, sf: str) -> DataFrame:
    from scalemetrics.plans.tables import part as split_part

    both = split_part(spark, sf, "train").unionByName(split_part(spark, sf, "val"))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("respondent_id").alias("respondents"))


@query("j8_prediction_parity", sql(
    f"""SELECT count(*) AS compared, {sr6('max(abs(a.pred - b.pred))')} AS max_abs, count(*) FILTER (WHERE abs(a.pred - b.pred) > 0.0001 + 0.00005 * abs(b.pred)) AS violations,
    0::BIGINT AS one_sided, count(*) FILTER (WHERE abs(a.pred - b.pred) > 0.0001 + 0.00005 * abs(b.pred)) = 0 AS passed FROM pred a JOIN pred b
    ON a.rid = b.rid AND a.domain = b.domain AND a.method = 'short_form' AND b.method = 'first_n'""", "pred"))
def j8(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda m: predictions(spark, sf).filter(F.col("method") == m)
    out = compare.parity(of("short_form"), of("first_n"), ["respondent_id", "domain"], "pred")
    return rounded(out.drop("max_rel"), "max_abs")
