"""Report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalemetrics.functions.stats import r6
from scalemetrics.operators import bootstrap, evaluate, report, selection, sessions, similarity, sweep
from scalemetrics.plans import adaptive, checks, resampling
from scalemetrics.plans.evaluation import metric_sql, metrics
from scalemetrics.plans.itemstats import rounded, sweep_metrics
from scalemetrics.plans.population import KS_SQL
from scalemetrics.plans.registry import query
from scalemetrics.plans.sqlparts import r6 as sr6, sql
from scalemetrics.plans.tables import SPEC, item_pool, norms, predictions, responses, selected

HEAD = ["pearson_r", "mae", "coverage_90"]


@query("r1_headline", sql(
    " UNION ALL ".join(
        f"SELECT m.method, '{n}' AS metric, {sr6(f'm.{n}')} AS value, {sr6(f'lo.{n}')} AS ci_lo, {sr6(f'hi.{n}')} AS ci_hi FROM ({metric_sql(HEAD)}) m JOIN (SELECT method, quantile_cont({n}, 0.025) AS {n} FROM bmet WHERE domain = 'overall' GROUP BY 1) lo USING (method) JOIN (SELECT method, quantile_cont({n}, 0.975) AS {n} FROM bmet WHERE domain = 'overall' GROUP BY 1) hi USING (method) WHERE domain = 'overall'"
        for n in HEAD), "pred", "bmet"))
def r1(spark: SparkSession, sf: str) -> DataFrame:
    values = evaluate.melt(metrics(spark, sf).filter("domain = 'overall'"), ["method"], HEAD)
    cis = bootstrap.intervals(resampling.replicates(spark, sf).filter("domain = 'overall'"), ["method"], tuple(HEAD)).drop("n_reps")
    return rounded(values.join(cis, ["method", "metric"]), "value", "ci_lo", "ci_hi")


GRID = ["adaptive_topk", "domain_balanced", "domain_constrained", "first_n", "greedy_balanced", "worst_k", "random", "short_form"]


@query("r2_method_grid", sql(
    f"SELECT k, {', '.join(f'max(CASE WHEN method = $${m}$$ THEN r END) AS {m}' for m in GRID)} FROM (SELECT method, k, {sr6('pearson_r')} AS r FROM sweep WHERE domain = 'overall' UNION ALL SELECT 'random', k, {sr6('avg(pearson_r)')} FROM rsweep WHERE domain = 'overall' GROUP BY k) GROUP BY k",
    "sweep", "rsweep"))
def r2(spark: SparkSession, sf: str) -> DataFrame:
    m = sweep_metrics(spark, sf)
    everything = m.select("method", "k", "domain", "pearson_r").unionByName(
        sweep.average_over_seeds(m, ["pearson_r"]).select("method", "k", "domain", "pearson_r")
    )
    return report.method_grid(everything.withColumn("pearson_r", r6(F.col("pearson_r"))), GRID)


@query("r3_domain_table", sql(
    f"SELECT method, domain, {sr6('pearson_r')} AS pearson_r, {sr6('mae')} AS mae FROM sweep WHERE k = 20 AND domain <> 'overall'", "sweep"))
def r3(spark: SparkSession, sf: str) -> DataFrame:
    m = sweep_metrics(spark, sf).filter("k = 20 AND domain <> 'overall' AND method NOT LIKE 'random%'")
    return rounded(m.select("method", "domain", "pearson_r", "mae"), "pearson_r", "mae")


@query("r4_starvation_table", sql(
    f"SELECT domain, (SELECT count(*) FROM sel WHERE method = 'adaptive_topk' AND k = 20 AND home = domain) AS items, CAST((SELECT count(*) FROM sel WHERE method = 'adaptive_topk' AND k = 20 AND home = domain) * 100 // 20 AS INTEGER) AS share, {sr6('pearson_r')} AS pearson_r FROM sweep WHERE method = 'adaptive_topk' AND k = 20 AND domain <> 'overall'",
    "sel", "sweep"))
def r4(spark: SparkSession, sf: str) -> DataFrame:
    counts = selection.domain_counts(selected(spark, sf).filter("method = 'adaptive_topk' AND k = 20"), SPEC)
    r = sweep_metrics(spark, sf).filter("method = 'adaptive_topk' AND k = 20").select("domain", "pearson_r")
    return rounded(report.starvation_table(counts, r, 20), "pearson_r")


@query("r5_balanced_items", sql(
    f"SELECT domain, item, place::INT AS place, {sr6('own_r')} AS own_r FROM (SELECT home AS domain, item, own_r, row_number() OVER (PARTITION BY home ORDER BY abs(own_r) DESC, rank) AS place FROM pool) WHERE place <= 4", "pool"))
def r5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.strongest_items(item_pool(spark, sf), 4), "own_r")


@query("r6_split_table", sql(
    f"""SELECT s.split, n, {sr6('n / sum(n) OVER ()')} AS fraction, {sr6('ks')} AS worst_ks FROM (SELECT split, count(*) AS n FROM sp GROUP BY 1) s
    LEFT JOIN (SELECT 'test' AS split, max(ks) AS ks FROM ({KS_SQL.format(key='domain', v='score', first="split = 'train'", second="split = 'test'", source='(SELECT * FROM sc JOIN sp USING (rid))')})) k ON k.split = s.split""",
    "sc", "sp"))
def r6_table(spark: SparkSession, sf: str) -> DataFrame:
    df = responses(spark, sf)
    return rounded(report.split_table(df, similarity.split_similarity(df, SPEC)), "fraction", "worst_ks")


@query("r7_item_ranking_table", sql(
    f"SELECT rank::INT AS rank, pool.item, {sr6('composite')} AS composite, {', '.join(sr6(f'max(CASE WHEN domain = $${d}$$ THEN abs(r) END)') + f' AS r_{d}' for d in SPEC.domains)} FROM pool JOIN cor ON cor.item = pool.item WHERE rank <= 20 GROUP BY rank, pool.item, composite", "pool", "cor"))
def r7(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.ranking_table(item_pool(spark, sf), SPEC, 20), "composite", *[f"r_{d}" for d in SPEC.domains])


@query("r8_scoring_table", sql(
    f"""SELECT method, {sr6('r_avg')} AS r_avg, {sr6('r_mid')} AS r_mid, {sr6('r_avg - r_mid')} AS delta_r FROM (SELECT method, covar_pop(true_pct, pred) / (stddev_pop(true_pct) * stddev_pop(pred)) AS r_avg,
    covar_pop(true_pct, mid) / (stddev_pop(true_pct) * stddev_pop(mid)) AS r_mid FROM (SELECT *, (lower + upper) / 2 AS mid FROM pred) GROUP BY method)""", "pred"))
def r8(spark: SparkSession, sf: str) -> DataFrame:
    both = predictions(spark, sf).withColumns({"pred_avg": F.col("pred"), "pred_mid": (F.col("lower") + F.col("upper")) / 2})
    deltas = evaluate.scoring_deltas(both, "avg", "mid", ["method", "k"]).orderBy("method", "k")
    return rounded(deltas.select("method", "r_avg", "r_mid", "delta_r"), "r_avg", "r_mid", "delta_r")


@query("r9_validation_table", sql(
    f"SELECT coalesce(dno, 6)::INT AS place, m.domain, {sr6('pearson_r')} AS pearson_r, {sr6('mae')} AS mae, {sr6('rmse')} AS rmse, {sr6('coverage_90')} AS coverage_90 FROM ({metric_sql(['pearson_r', 'mae', 'rmse', 'coverage_90'])}) m LEFT JOIN dom ON dom.domain = m.domain WHERE method = 'short_form'", "pred", "dom"))
def r9(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics(spark, sf).filter("method = 'short_form'").select("domain", "pearson_r", "mae", "rmse", "coverage_90")
    return rounded(report.in_domain_order(m, SPEC), "pearson_r", "mae", "rmse", "coverage_90")


@query("r9_session_table", sql(
    f"SELECT threshold, {sr6('avg(n_items)')} AS mean_items, {sr6('quantile_cont(n_items, 0.5)')} AS median_items, {sr6('avg((reason = $$sem_threshold_met$$)::INT)')} AS sem_share FROM stops GROUP BY threshold", "stops"))
def r9_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = adaptive.stops(spark, sf)
    lengths = sessions.session_lengths(s, ["threshold"]).select("threshold", F.col("mean").alias("mean_items"), F.col("median").alias("median_items"))
    out = lengths.join(sessions.threshold_sweep(s).select("threshold", "sem_share"), "threshold").orderBy("threshold")
    return rounded(out, "mean_items", "median_items", "sem_share")


@query("r10_reference_values", sql(
    f"""SELECT 'norm_' || form AS section, domain AS name, {sr6('mean')} AS a, {sr6('sd')} AS b FROM nm
    UNION ALL SELECT 'calibration', domain, {sr6('cov')}, {sr6('scale')} FROM cal
    UNION ALL SELECT 'short_form', item, NULL, NULL FROM itm WHERE in_short UNION ALL SELECT 'lock', artifact || '=' || token, NULL, NULL FROM tok""",
    "nm", "cal", "itm", "tok"))
def r10(spark: SparkSession, sf: str) -> DataFrame:
    fitted = evaluate.fit_calibration(predictions(spark, sf).filter("method = 'short_form'"), "sparse")
    short = item_pool(spark, sf).filter(F.col("item").isin(*SPEC.short_items)).select("item")
    return rounded(report.reference_values(norms(spark, sf), fitted, short, checks.split_tokens(spark, sf)), "a", "b")
