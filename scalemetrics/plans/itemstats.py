"""Item statistics, ranking, selections and the method x K sweep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalemetrics.functions.stats import r6
from scalemetrics.operators import items, selection, sweep
from scalemetrics.plans.ingest import scratch
from scalemetrics.plans.registry import query
from scalemetrics.plans.sqlparts import corr, part, pct, r6 as sr6, row_hash, sql, values
from scalemetrics.plans.tables import (
    SEED, SPEC, clean, full_norms, item_pool, item_sums, r_bars, selected, short_norms, sweep_cells,
)
from scalemetrics.sources import artifacts

part(
    "cor",
    f"""SELECT item, home, ino, num, rev, domain, {corr('x', 's')} AS r, count(*) AS n FROM (
    SELECT item, ino, num, rev, cl.domain AS home, x, sc.domain, CASE WHEN sc.domain = cl.domain THEN (10 * score - x) / 9 ELSE score END AS s
    FROM cl JOIN sc USING (rid)) GROUP BY item, home, ino, num, rev, domain""",
    "cl", "sc",
)
part(
    "rbar",
    f"""SELECT domain, avg(r) AS r_bar FROM (SELECT a.domain, a.item, b.item, {corr('a.x', 'b.x')} AS r FROM cl a JOIN cl b
    ON a.rid = b.rid AND a.domain = b.domain AND a.ino < b.ino GROUP BY 1, 2, 3) GROUP BY domain""",
    "cl",
)
part(
    "dist",
    """SELECT item, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std,
    avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5) AS skew, avg(pow(x - m, 4)) / pow(avg(pow(x - m, 2)), 2) - 3 AS kurtosis,
    max(ent) AS entropy FROM (SELECT item, x, avg(x) OVER (PARTITION BY item) AS m FROM cl) JOIN
    (SELECT item AS it, -sum(p * ln(p + 1e-10)) AS ent FROM (SELECT item, x, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY item) AS p
      FROM cl GROUP BY item, x) GROUP BY 1) ON it = item GROUP BY item""",
    "cl",
)
part(
    "pool",
    """SELECT *, info + 0.2 * entropy - 0.1 * abs(skew) AS composite,
    row_number() OVER (ORDER BY info + 0.2 * entropy - 0.1 * abs(skew) DESC, ino) AS rank FROM (
    SELECT cor.item, home, ino, num, rev, sum(abs(r)) AS info, max(CASE WHEN domain = home THEN r END) AS own_r,
    max(entropy) AS entropy, max(skew) AS skew FROM cor JOIN dist ON dist.item = cor.item GROUP BY ALL)""",
    "cor", "dist",
)
part("ks", f"SELECT * FROM ({values([(k,) for k in selection.K_GRID])}) t(k)")
part(
    "sel",
    """SELECT 'adaptive_topk' AS method, k, item, home FROM pool, ks WHERE rank <= k
    UNION ALL SELECT 'greedy_balanced', k, item, home FROM (SELECT item, home, row_number() OVER (ORDER BY (b = 1) DESC, rank) AS p FROM
      (SELECT *, row_number() OVER (PARTITION BY home ORDER BY rank) AS b FROM pool)), ks WHERE p <= k
    UNION ALL SELECT 'first_n', k, item, home FROM (SELECT item, home, row_number() OVER (ORDER BY num, dno) AS p FROM pool JOIN dom ON domain = home), ks WHERE p <= k
    UNION ALL SELECT 'worst_k', k, item, home FROM (SELECT item, home, row_number() OVER (ORDER BY abs(own_r), rank) AS p FROM pool), ks WHERE p <= k
    UNION ALL SELECT 'domain_balanced', k, item, home FROM (SELECT item, home, row_number() OVER (PARTITION BY home ORDER BY abs(own_r) DESC, rank) AS p FROM pool), ks WHERE p <= k // 5
    UNION ALL SELECT 'domain_constrained', k, item, home FROM (SELECT item, home, row_number() OVER (PARTITION BY home ORDER BY info DESC, rank) AS p FROM pool), ks WHERE p <= k // 5
    UNION ALL SELECT 'short_form', 20, item, home FROM pool JOIN itm USING (item) WHERE in_short
    UNION ALL SELECT 'full', 50, item, home FROM pool""",
    "pool", "ks", "dom", "itm",
)
part(
    "rsel",
    "SELECT 'random_' || seed AS method, k, item, home FROM (SELECT seed, item, home, row_number() OVER (PARTITION BY seed ORDER BY "
    + row_hash("pick", "seed || '|' || item") + ", ino) AS p FROM pool CROSS JOIN range(42, 52) s(seed)), ks WHERE p <= k",
    "pool", "ks",
)


def cells_sql(sel: str, norm_form: str = "full") -> str:
    """Per respondent, selection and domain: true and predicted percentile (50 without items)."""
    return f"""SELECT g.method, g.k, pc.domain, pc.pct AS t, CASE WHEN picked.z IS NULL THEN 50.0 ELSE {pct('picked.z')} END AS p
    FROM (SELECT DISTINCT method, k FROM {sel}) g CROSS JOIN pc LEFT JOIN
    (SELECT method, k, rid, a.domain, (m - mean) / sd AS z FROM
      (SELECT method, k, rid, domain, avg(x) AS m FROM cl JOIN {sel} USING (item) GROUP BY ALL) a
      JOIN nm ON nm.domain = a.domain AND form = '{norm_form}') picked
    ON picked.method = g.method AND picked.k = g.k AND picked.rid = pc.rid AND picked.domain = pc.domain"""


METRICS = ["pearson_r", "mae", "rmse", "within_5_pct", "within_10_pct"]


def metrics_sql(source: str) -> str:
    e = "abs(t - p)"
    return f"""SELECT method, k, coalesce(domain, 'overall') AS domain, count(*) AS n,
    CASE WHEN min(p) = max(p) THEN NULL ELSE {corr('t', 'p')} END AS pearson_r, avg({e}) AS mae, sqrt(avg((t - p) * (t - p))) AS rmse,
    avg(CASE WHEN {e} <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS within_5_pct, avg(CASE WHEN {e} <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS within_10_pct
    FROM ({source}) GROUP BY GROUPING SETS ((method, k, domain), (method, k))"""


part("sweep", metrics_sql(cells_sql("sel")), "sel", "pc", "cl", "nm")
part("rsweep", metrics_sql(cells_sql("rsel")), "rsel", "pc", "cl", "nm")
ROUNDED = ", ".join(f"{sr6(m)} AS {m}" for m in METRICS)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in columns})


@query("a7_item_distribution", sql(
    f"SELECT item, n, {', '.join(f'{sr6(c)} AS {c}' for c in ('mean', 'std', 'skew', 'kurtosis', 'entropy'))} FROM dist", "dist"))
def a7(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(items.response_distributions(clean(spark, sf), SPEC), "mean", "std", "skew", "kurtosis", "entropy")


@query("a8_item_domain_corr", sql(f"SELECT item, domain, {sr6('r')} AS r, n FROM cor", "cor"))
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(items.item_domain_correlations(items.item_sums(clean(spark, sf), SPEC)), "r")


@query("a9_inter_item_r", sql(f"SELECT domain, {sr6('r_bar')} AS r_bar FROM rbar", "rbar"))
def a9(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(items.inter_item_r(items.item_sums(clean(spark, sf), SPEC)), "r_bar")


@query("a10_cross_domain_info", sql(f"SELECT item, {sr6('sum(abs(r))')} AS info FROM cor GROUP BY item", "cor"))
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(items.cross_domain_info(items.item_domain_correlations(item_sums(spark, sf))), "info")


@query("a11_own_r_summary", sql(
    f"SELECT domain, {sr6('avg(r)')} AS mean_r, {sr6('min(r)')} AS min_r, {sr6('max(r)')} AS max_r FROM cor WHERE home = domain GROUP BY domain", "cor"))
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(items.own_r_summary(items.item_domain_correlations(item_sums(spark, sf))), "mean_r", "min_r", "max_r")


@query("w7_item_ranking", sql(
    f"SELECT item, home AS home_domain, num AS item_number, rev AS is_reverse_keyed, {sr6('info')} AS info, {sr6('own_r')} AS own_r, {sr6('composite')} AS composite, CAST(rank AS INTEGER) AS rank FROM pool", "pool"))
def w7(spark: SparkSession, sf: str) -> DataFrame:
    correlations = items.item_domain_correlations(items.item_sums(clean(spark, sf), SPEC))
    pool = items.rank_items(correlations, items.response_distributions(clean(spark, sf), SPEC), SPEC)
    return rounded(
        pool.select("item", "home_domain", "item_number", "is_reverse_keyed", "info", "own_r", "composite", "rank"),
        "info", "own_r", "composite",
    )


@query("s7_item_pool_artifact", sql(
    f"SELECT item AS id, home AS home_domain, rev AS is_reverse_keyed, {sr6('own_r')} AS own_domain_r, CAST(rank AS INTEGER) AS rank, 2 AS spellings FROM pool", "pool"))
def s7_pool(spark: SparkSession, sf: str) -> DataFrame:
    """The pool written in both spellings and read back by one reader."""
    pool = item_pool(spark, sf).select(
        F.col("item").alias("id"), "rank", "home_domain", F.col("own_r").alias("own_domain_r"),
        F.col("info").alias("cross_domain_info"), "domain_correlations", "is_reverse_keyed",
    )
    read = []
    for camel in (False, True):
        path = scratch(spark, sf, f"pool-{camel}")
        artifacts.write_item_pool(pool, path, camel)
        read.append(artifacts.read_item_pool(spark, path))
    both = read[0].unionByName(read[1])
    return both.groupBy("id", "home_domain", "is_reverse_keyed", r6(F.col("own_domain_r")).alias("own_domain_r"), "rank").agg(
        F.count(F.lit(1)).cast("int").alias("spellings")
    )


FIRST_SQL = "SELECT item, home, info FROM pool ORDER BY (abs(skew) < 1 AND entropy > 1.3) DESC, CASE WHEN abs(skew) < 1 AND entropy > 1.3 THEN info END DESC NULLS LAST, rank LIMIT 1"


@query("s7_item_info_artifact", sql(
    f"""SELECT * FROM (SELECT 'first_item' AS part, item AS name, home AS text, NULL::DOUBLE AS value FROM ({FIRST_SQL})
    UNION ALL SELECT 'inter_item_r_bar', domain, NULL, {sr6('r_bar')} FROM rbar UNION ALL SELECT 'provenance', 'seed', '{SEED}', NULL
    UNION ALL SELECT 'item_pool', item, home, {sr6('own_r')} FROM pool) CROSS JOIN (SELECT 2 AS spellings)""", "pool", "rbar"))
def s7_info(spark: SparkSession, sf: str) -> DataFrame:
    """The whole item document written in both spellings and read back by one reader."""
    pool = item_pool(spark, sf).select(
        F.col("item").alias("id"), "rank", "home_domain", F.col("own_r").alias("own_domain_r"),
        F.col("info").alias("cross_domain_info"), "domain_correlations", "is_reverse_keyed",
    )
    first = items.first_item(item_pool(spark, sf)).select(F.col("item").alias("id"), F.lit("").alias("text"), F.col("home_domain").alias("domain"))
    origin = spark.range(1).select(F.lit("seed").alias("name"), F.lit(str(SEED)).alias("value"))
    info = artifacts.ItemInfo(pool, first, r_bars(spark, sf), origin)
    parts = []
    for camel in (False, True):
        path = scratch(spark, sf, f"item-info-{camel}")
        artifacts.write_item_info(info, path, camel)
        back, number = artifacts.read_item_info(spark, path), F.lit(None).cast("double")
        parts += [
            back.first_item.select(F.lit("first_item").alias("part"), F.col("id").alias("name"), F.col("domain").alias("text"), number.alias("value")),
            back.inter_item_r_bar.select(F.lit("inter_item_r_bar"), "domain", F.lit(None).cast("string"), r6(F.col("r_bar"))),
            back.provenance.select(F.lit("provenance"), "name", "value", number),
            back.item_pool.select(F.lit("item_pool"), "id", "home_domain", r6(F.col("own_domain_r"))),
        ]
    return reduce(DataFrame.union, parts).groupBy("part", "name", "text", "value").agg(F.count(F.lit(1)).cast("int").alias("spellings"))


@query("j1_item_lookup", sql(
    f"SELECT rid AS respondent_id, {sr6('sum(x * own_r) / sum(own_r)')} AS weighted_mean FROM cl JOIN pool USING (item) GROUP BY rid", "cl", "pool"))
def j1(spark: SparkSession, sf: str) -> DataFrame:
    """Item attributes joined to answers; the pool has one row per item of the scale."""
    long = clean(spark, sf).unpivot(["respondent_id"], list(SPEC.items), "item", "x")
    joined = long.join(F.broadcast(item_pool(spark, sf).select("item", "own_r")), "item")
    return joined.groupBy("respondent_id").agg(
        r6(F.sum(F.col("x") * F.col("own_r")) / F.sum("own_r")).alias("weighted_mean")
    )


@query("w9_first_item", sql(
    f"SELECT item, {sr6('info')} AS info, CAST(rank AS INTEGER) AS rank FROM pool ORDER BY (abs(skew) < 1 AND entropy > 1.3) DESC, CASE WHEN abs(skew) < 1 AND entropy > 1.3 THEN info END DESC NULLS LAST, rank LIMIT 1", "pool"))
def w9(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(items.first_item(item_pool(spark, sf)).select("item", "info", "rank"), "info")


@query("w8_item_selection", sql("SELECT method, k, item, home AS home_domain FROM sel UNION ALL SELECT * FROM rsel", "sel", "rsel"))
def w8(spark: SparkSession, sf: str) -> DataFrame:
    return selection.selections(selection.placements(item_pool(spark, sf), SPEC), SPEC)


@query("a24_domain_counts", sql(
    "SELECT method, k, domain, count(*) FILTER (WHERE home = domain) AS n_items FROM (SELECT * FROM sel UNION ALL SELECT * FROM rsel) CROSS JOIN dom GROUP BY ALL",
    "sel", "rsel", "dom"))
def a24(spark: SparkSession, sf: str) -> DataFrame:
    return selection.domain_counts(selected(spark, sf), SPEC)


@query("w11_cumulative_counts", sql(
    "SELECT CAST(c AS INTEGER) AS k, domain, count(*) FILTER (WHERE rank <= c AND home = domain) AS n_items FROM pool CROSS JOIN dom CROSS JOIN (VALUES (5), (10), (15), (20), (25)) t(c) GROUP BY ALL",
    "pool", "dom"))
def w11(spark: SparkSession, sf: str) -> DataFrame:
    return selection.cumulative_domain_counts(item_pool(spark, sf), SPEC)


@query("w12_starvation", sql(
    """SELECT home AS domain, CAST(min(rank) AS INTEGER) AS first_rank, count(*) FILTER (WHERE rank <= 5) AS items_at_k, count(*) FILTER (WHERE rank <= 5) = 0 AS starved
    FROM pool GROUP BY home""", "pool"))
def w12(spark: SparkSession, sf: str) -> DataFrame:
    return selection.starvation(item_pool(spark, sf), 5)


@query("w12_starved_domains", sql("SELECT DISTINCT home AS domain FROM pool WHERE home NOT IN (SELECT home FROM pool WHERE rank <= 5)", "pool"))
def w12_anti(spark: SparkSession, sf: str) -> DataFrame:
    return selection.starved_domains(item_pool(spark, sf), 5)


def sweep_metrics(spark: SparkSession, sf: str) -> DataFrame:
    cells = sweep.cell_percentiles(sweep_cells(spark, sf), SPEC, full_norms(spark, sf))
    return sweep.cell_metrics(cells, ["method", "k"])


@query("w10_method_sweep", sql(f"SELECT method, k, domain, n, {ROUNDED} FROM sweep", "sweep"))
def w10(spark: SparkSession, sf: str) -> DataFrame:
    cells = sweep.score_cells(clean(spark, sf), selected(spark, sf).filter("method NOT LIKE 'random%'"), SPEC)
    out = sweep.cell_metrics(sweep.cell_percentiles(cells, SPEC, full_norms(spark, sf)), ["method", "k"])
    return rounded(out, *METRICS)


@query("a25_simple_average", sql(f"SELECT method, k, domain, n, {ROUNDED} FROM sweep WHERE k = 20", "sweep"))
def a25(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sweep_metrics(spark, sf).filter("k = 20 AND method NOT LIKE 'random%'"), *METRICS)


@query("a26_short_form", sql(
    f"SELECT method, k, domain, n, {ROUNDED} FROM ({metrics_sql(cells_sql('(SELECT * FROM sel WHERE method = $$short_form$$)', 'short'))})",
    "sel", "pc", "cl", "nm"))
def a26(spark: SparkSession, sf: str) -> DataFrame:
    """The short form on its own norms; its item counts per domain must match the declared lists."""
    chosen = selected(spark, sf).filter("method = 'short_form'")
    want = F.map_from_arrays(F.array(*[F.lit(d) for d in SPEC.domains]), F.array(*[F.lit(len(SPEC.short_form[d])) for d in SPEC.domains]))
    wrong = selection.domain_counts(chosen, SPEC).filter(F.col("n_items") != want[F.col("domain")])
    if wrong.take(1):
        raise ValueError("short form does not cover its domains as declared")
    cells = sweep_cells(spark, sf).filter("method = 'short_form'")
    scored = sweep.cell_percentiles(cells, SPEC, full_norms(spark, sf), short_norms(spark, sf))
    return rounded(sweep.cell_metrics(scored, ["method", "k"]), *METRICS)


@query("a27_random_average", sql(
    f"SELECT 'random' AS method, k, domain, {', '.join(f'{sr6(f'avg({m})')} AS {m}' for m in METRICS)} FROM rsweep GROUP BY k, domain", "rsweep"))
def a27(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sweep.average_over_seeds(sweep_metrics(spark, sf), METRICS), *METRICS)


@query("ml4_candidate_score", sql(
    f"""SELECT method AS candidate, {sr6("0.8 * ms + 0.2 * mf - 2 * greatest(0, 0.85 - ns) - greatest(0, 0.95 - mf)")} AS score,
    {sr6("mf - 1.5 * greatest(0, 0.9 - nf)")} AS full_only_score FROM (SELECT method,
    avg(r) FILTER (WHERE k = 20) AS ms, min(r) FILTER (WHERE k = 20) AS ns, avg(r) FILTER (WHERE k = 40) AS mf, min(r) FILTER (WHERE k = 40) AS nf
    FROM (SELECT method, k, coalesce(pearson_r, -1) AS r FROM sweep WHERE domain <> 'overall') GROUP BY method) WHERE ms IS NOT NULL AND mf IS NOT NULL""",
    "sweep"))
def ml4(spark: SparkSession, sf: str) -> DataFrame:
    from scalemetrics.operators.tuning import candidate_scores

    m = sweep_metrics(spark, sf).filter("domain <> 'overall' AND k IN (20, 40) AND method NOT LIKE 'random%'")
    regimes = m.select(
        F.col("method").alias("candidate"), "domain", "pearson_r",
        F.when(F.col("k") == 20, "sparse").otherwise("full").alias("regime"),
    )
    both = candidate_scores(regimes).filter("has_sparse AND has_full")
    return rounded(both.select("candidate", "score", "full_only_score"), "score", "full_only_score")
