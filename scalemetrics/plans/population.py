"""Norms, percentiles, strata, splits and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalemetrics.functions.stats import r6
from scalemetrics.operators import norms as norm_ops, scoring, similarity, strata
from scalemetrics.plans.registry import query
from scalemetrics.plans.sqlparts import merged, pct, quota, r6 as sr6, row_hash, sql
from scalemetrics.plans.tables import SEED, SPEC, clean, clean_rows, full_norms, norms, responses, scored, table

DOCS = "SELECT doc_id, lang || '/' || source AS s FROM documents"


def long_scores(df: DataFrame, keys: list[str], columns: tuple[str, ...], name: str) -> DataFrame:
    return df.select(*keys, *columns).unpivot(keys, list(columns), "domain", name).withColumn(
        "domain", F.substring("domain", 1, 3)
    )


NORM_SQL = f"SELECT form, domain, {sr6('mean')} AS mean, {sr6('sd')} AS sd, CAST(n AS BIGINT) AS n FROM nm"


@query("a1_norms", sql(NORM_SQL + " WHERE form = 'full'", "nm"))
def a1(spark: SparkSession, sf: str) -> DataFrame:
    out = norm_ops.fit_norms(clean(spark, sf), SPEC).filter("form = 'full'")
    return out.withColumns({c: r6(F.col(c)) for c in ("mean", "sd")})


@query("a2_short_norms", sql(NORM_SQL + " WHERE form = 'short'", "nm"))
def a2(spark: SparkSession, sf: str) -> DataFrame:
    out = norm_ops.fit_norms(clean(spark, sf), SPEC).filter("form = 'short'")
    return out.withColumns({c: r6(F.col(c)) for c in ("mean", "sd")})


@query(
    "a1_norms_by_segment",
    f"""SELECT c_mktsegment AS segment, {sr6('avg(c_acctbal)')} AS mean, {sr6('stddev_samp(c_acctbal)')} AS sd, count(*) AS n
    FROM customer GROUP BY 1""",
)
def a1_segments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        r6(F.avg("c_acctbal")).alias("mean"), r6(F.stddev_samp("c_acctbal")).alias("sd"), F.count(F.lit(1)).alias("n")
    )


@query(
    "a3_norm_drift",
    sql(
        """SELECT max(greatest(abs(d_mean), abs(d_sd))) < 1e-9 AS same, 0 AS unmatched, TRUE AS passed FROM
        (SELECT mean - mean AS d_mean, sd - sd AS d_sd FROM nm)""",
        "nm",
    ),
)
def a3(spark: SparkSession, sf: str) -> DataFrame:
    current = norm_ops.fit_norms(clean(spark, sf), SPEC)
    out = norm_ops.norm_drift(current, norms(spark, sf))
    return out.select((F.col("max_diff") < 1e-9).alias("same"), F.col("unmatched").cast("int").alias("unmatched"), "passed")


@query(
    "a3_norm_drift_between_splits",
    sql(
        f"""SELECT {sr6('max(greatest(abs(a.mean - b.mean), abs(a.sd - b.sd)))')} AS max_diff, 0::BIGINT AS unmatched,
        max(greatest(abs(a.mean - b.mean), abs(a.sd - b.sd))) <= 0.05 AS passed FROM
        (SELECT domain, avg(score) AS mean, stddev_samp(score) AS sd FROM sc JOIN sp USING (rid) WHERE split = 'train' GROUP BY 1) a
        JOIN (SELECT domain, avg(score) AS mean, stddev_samp(score) AS sd FROM sc JOIN sp USING (rid) WHERE split = 'test' GROUP BY 1) b
        USING (domain)""",
        "sc", "sp",
    ),
)
def a3_splits(spark: SparkSession, sf: str) -> DataFrame:
    fit = lambda s: norm_ops.fit_norms(responses(spark, sf).filter(F.col("split") == s), SPEC).filter("form = 'full'")
    return norm_ops.norm_drift(fit("train"), fit("test"), 0.05).withColumn("max_diff", r6(F.col("max_diff")))


@query(
    "a5_column_summary",
    sql(
        f"""SELECT domain || '_score' AS "column", {sr6('avg(score)')} AS mean, {sr6('stddev_samp(score)')} AS sd,
        {sr6('min(score)')} AS min, {sr6('max(score)')} AS max FROM pc GROUP BY domain
        UNION ALL SELECT domain || '_percentile', {sr6('avg(pct)')}, {sr6('stddev_samp(pct)')}, {sr6('min(pct)')}, {sr6('max(pct)')}
        FROM pc GROUP BY domain""",
        "pc",
    ),
)
def a5(spark: SparkSession, sf: str) -> DataFrame:
    out = norm_ops.column_summary(scored(spark, sf), [*SPEC.scores, *SPEC.percentiles])
    return out.withColumns({c: r6(F.col(c)) for c in ("mean", "sd", "min", "max")})


@query("a6_stratum_counts", sql("SELECT stratum AS split_stratum, count(*) AS count FROM st GROUP BY 1", "st"))
def a6(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).groupBy("split_stratum").count()


@query(
    "a6_stratum_sizes",
    sql("SELECT count(*) AS strata, min(n) AS smallest, max(n) AS largest FROM (SELECT stratum, count(*) AS n FROM st GROUP BY 1)", "st"),
)
def a6_sizes(spark: SparkSession, sf: str) -> DataFrame:
    counts = scored(spark, sf).groupBy("split_stratum").count()
    return counts.agg(F.count(F.lit(1)).alias("strata"), F.min("count").alias("smallest"), F.max("count").alias("largest"))


@query(
    "p8_percentile_summary",
    sql(
        f"""SELECT domain, count(*) AS n, {sr6('avg(score)')} AS mean_score, {sr6('stddev_samp(score)')} AS sd_score,
        {sr6('avg(pct)')} AS mean_percentile, {sr6('min(pct)')} AS min_percentile, {sr6('max(pct)')} AS max_percentile
        FROM pc GROUP BY domain""",
        "pc",
    ),
)
def p8_summary(spark: SparkSession, sf: str) -> DataFrame:
    """From raw answers to a percentile summary: filter, key, score, norm, percentile."""
    df = scoring.score_percentiles(clean_rows(spark, sf), full_norms(spark, sf), SPEC)
    both = F.array(*[
        F.struct(F.lit(d).alias("domain"), F.col(f"{d}_score").alias("score"), F.col(f"{d}_percentile").alias("pct"))
        for d in SPEC.domains
    ])
    return df.select(F.inline(both)).groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("score")).alias("mean_score"), r6(F.stddev_samp("score")).alias("sd_score"),
        r6(F.avg("pct")).alias("mean_percentile"), r6(F.min("pct")).alias("min_percentile"),
        r6(F.max("pct")).alias("max_percentile"),
    )


@query("p8_percentiles", sql(f"SELECT rid AS respondent_id, domain, {sr6('pct')} AS percentile FROM pc", "pc"))
def p8(spark: SparkSession, sf: str) -> DataFrame:
    df = scoring.score_percentiles(clean(spark, sf), full_norms(spark, sf), SPEC)
    return long_scores(df, ["respondent_id"], SPEC.percentiles, "percentile").withColumn("percentile", r6(F.col("percentile")))


@query(
    "p8_percentile_by_segment",
    f"""SELECT c_custkey, {sr6(pct('z'))} AS percentile FROM (SELECT c_custkey, (c_acctbal - m) / s AS z FROM customer JOIN
    (SELECT c_mktsegment AS seg, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer GROUP BY 1) ON seg = c_mktsegment)""",
)
def p8_segments(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    seg = customers.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("m"), F.stddev_samp("c_acctbal").alias("s"))
    z = customers.join(seg, "c_mktsegment").withColumn("z", (F.col("c_acctbal") - F.col("m")) / F.col("s"))
    return z.select("c_custkey", r6(scoring.percentile_of_z(F.col("z"))).alias("percentile"))


@query(
    "p9_anchor_check",
    sql(
        f"""SELECT domain, zz AS z, {sr6(pct('z'))} AS percentile, abs({pct('z')} - want) <= 0.01 AS passed FROM
        (SELECT domain, zz, want, (mean + zz * sd - mean) / sd AS z FROM nm CROSS JOIN
        (VALUES (-2, 2.275), (-1, 15.866), (0, 50.0), (1, 84.134), (2, 97.725)) t(zz, want) WHERE form = 'full')""",
        "nm",
    ),
)
def p9(spark: SparkSession, sf: str) -> DataFrame:
    # Normal distribution at whole standard deviations.
    anchors = {-2: 2.275, -1: 15.866, 0: 50.0, 1: 84.134, 2: 97.725}
    rows = F.array(*[F.struct(F.lit(z).alias("z"), F.lit(w).alias("want")) for z, w in anchors.items()])
    at = norms(spark, sf).filter("form = 'full'").select("domain", "mean", "sd", F.inline(rows))
    at = at.withColumn("raw", F.col("mean") + F.col("z") * F.col("sd"))
    out = scoring.long_percentiles(at, {"percentile": "raw"}, full_norms(spark, sf))
    return out.select("domain", "z", r6(F.col("percentile")).alias("percentile"),
                      (F.abs(F.col("percentile") - F.col("want")) <= 0.01).alias("passed"))


@query("w1_quantile_bins", sql("SELECT rid AS respondent_id, domain, CAST(q AS INTEGER) AS bin FROM bins", "bins"))
def w1(spark: SparkSession, sf: str) -> DataFrame:
    df = strata.add_bins(clean(spark, sf), {f"{d}_q": f"{d}_score" for d in SPEC.domains})
    return long_scores(df, ["respondent_id"], tuple(f"{d}_q" for d in SPEC.domains), "bin")


@query(
    "w1_exact_quantiles",
    f"""SELECT l_returnflag, prob, {sr6('value')} AS value FROM (SELECT l_returnflag, unnest([0.05, 0.5, 0.95]) AS prob,
    unnest(quantile_cont(l_extendedprice, [0.05, 0.5, 0.95])) AS value FROM lineitem GROUP BY 1)""",
)
def w1_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    from scalemetrics.operators.quantiles import exact_quantiles

    out = exact_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95])
    return out.select("l_returnflag", F.col("prob").cast("decimal(3,2)").alias("prob"), r6(F.col("value")).alias("value"))


@query("w2_composite_stratum", sql("SELECT rid AS respondent_id, stratum AS ext_est, stratum3 AS ext_est_opn FROM st", "st"))
def w2(spark: SparkSession, sf: str) -> DataFrame:
    df = strata.add_bins(clean(spark, sf), {f"{d}_q": f"{d}_score" for d in ("ext", "est", "opn")})
    return df.select(
        "respondent_id", strata.composite_stratum(["ext_q", "est_q"]).alias("ext_est"),
        strata.composite_stratum(["ext_q", "est_q", "opn_q"]).alias("ext_est_opn"),
    )


def _with_125(spark: SparkSession, sf: str) -> DataFrame:
    df = strata.add_bins(clean(spark, sf), {f"{d}_q": f"{d}_score" for d in ("ext", "est", "opn")})
    return df.withColumn("split_stratum", strata.composite_stratum(["ext_q", "est_q", "opn_q"]))


@query(
    "w3_merge_rare",
    sql(
        f"SELECT rid AS respondent_id, stratum3 AS split_stratum, CAST(m AS SMALLINT) AS merged_stratum FROM st JOIN ({merged('st', 'stratum3')}) ON s = stratum3",
        "st",
    ),
)
def w3(spark: SparkSession, sf: str) -> DataFrame:
    return strata.merge_rare(_with_125(spark, sf), "split_stratum").select("respondent_id", "split_stratum", "merged_stratum")


@query("w4_stratified_split", sql("SELECT rid AS respondent_id, stratum AS split_stratum, split FROM sp", "sp"))
def w4(spark: SparkSession, sf: str) -> DataFrame:
    df = scored(spark, sf).select("respondent_id", "split_stratum")
    return strata.stratified_split(df, "split_stratum", "respondent_id", seed=SEED)


@query(
    "w4_document_sample",
    f"""WITH d AS ({DOCS}), c AS ({quota('d', 's', 0.2)}) SELECT doc_id, rn <= quota AS chosen FROM
    (SELECT doc_id, s, row_number() OVER (PARTITION BY s ORDER BY {row_hash(7, 'doc_id')}, doc_id) AS rn FROM d) JOIN c USING (s)""",
)
def w4_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("s"))
    return strata.take_share(docs, "s", "doc_id", 0.2, 7, "chosen").select("doc_id", "chosen")


@query(
    "w5_folds",
    sql(
        f"""SELECT rid AS respondent_id, CAST(((rn - 1) * 3) // n AS INTEGER) AS fold FROM (SELECT rid,
        row_number() OVER (PARTITION BY stratum ORDER BY {row_hash(SEED, 'rid')}, rid) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM st)""",
        "st",
    ),
)
def w5(spark: SparkSession, sf: str) -> DataFrame:
    df = scored(spark, sf).select("respondent_id", "split_stratum")
    return strata.assign_folds(df, "respondent_id", 3, SEED, "split_stratum").select("respondent_id", "fold")


@query(
    "w5_plain_folds",
    f"""SELECT o_orderkey, CAST(((rn - 1) * 4) // n AS INTEGER) AS fold FROM (SELECT o_orderkey,
    row_number() OVER (ORDER BY {row_hash(3, 'o_orderkey')}, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)""",
)
def w5_plain(spark: SparkSession, sf: str) -> DataFrame:
    return strata.assign_folds(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 4, 3)


@query(
    "w6_random_rows",
    sql(f"SELECT rid AS respondent_id FROM good ORDER BY {row_hash(SEED, 'rid')}, rid LIMIT 1000", "good"),
)
def w6(spark: SparkSession, sf: str) -> DataFrame:
    return strata.random_rows(scored(spark, sf).select("respondent_id"), "respondent_id", 1000, SEED)


KS_SQL = """SELECT {key} AS domain, max(abs(c1 / n1 - c2 / n2)) AS ks, max(n1) AS n1, max(n2) AS n2 FROM (
    SELECT {key}, v, sum(a) OVER w AS c1, sum(b) OVER w AS c2, sum(a) OVER (PARTITION BY {key}) AS n1, sum(b) OVER (PARTITION BY {key}) AS n2 FROM
    (SELECT {key}, {v} AS v, CAST(count(*) FILTER (WHERE {first}) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE {second}) AS DOUBLE) AS b
     FROM {source} GROUP BY 1, 2) WINDOW w AS (PARTITION BY {key} ORDER BY v ROWS UNBOUNDED PRECEDING)) GROUP BY 1"""


def _p_sql() -> str:
    t = "(ks * sqrt(n1 * n2 / (n1 + n2)))"
    series = " + ".join(f"({2.0 if k % 2 else -2.0}::DOUBLE * exp(-2.0::DOUBLE * {k * k} * {t} * {t}))" for k in range(1, 21))
    return f"CASE WHEN {t} < 0.2 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, {series})) END"


@query(
    "a12_split_similarity",
    sql(
        f"""SELECT domain, {", ".join(f"{sr6(f'{s}_mean')} AS {s}_mean, {sr6(f'{s}_std')} AS {s}_std" for s in ("train", "val", "test"))},
        {sr6('mx')} AS max_mean_diff, {sr6('ks')} AS ks_statistic, {sr6('p')} AS ks_pvalue, mx < 0.05 AND p > 0.01 AS similar FROM (
        SELECT *, greatest(abs(train_mean - val_mean), abs(train_mean - test_mean), abs(val_mean - test_mean)) AS mx, {_p_sql()} AS p FROM
        (SELECT domain, {", ".join(f"avg(score) FILTER (WHERE split = '{s}') AS {s}_mean, stddev_samp(score) FILTER (WHERE split = '{s}') AS {s}_std" for s in ("train", "val", "test"))}
         FROM sc JOIN sp USING (rid) GROUP BY domain)
        JOIN ({KS_SQL.format(key='domain', v='score', first="split = 'train'", second="split = 'test'", source='(SELECT * FROM sc JOIN sp USING (rid))')}) USING (domain))""",
        "sc", "sp",
    ),
)
def a12(spark: SparkSession, sf: str) -> DataFrame:
    out = similarity.split_similarity(responses(spark, sf), SPEC)
    return out.withColumns({c: r6(F.col(c)) for c in out.columns if c not in ("domain", "similar")})


@query(
    "a12_ks_by_flag",
    "SELECT domain, " + f"{sr6('ks')} AS ks_statistic, {sr6(_p_sql())} AS ks_pvalue FROM ("
    + KS_SQL.format(key="l_linestatus", v="l_quantity", first="l_returnflag = 'R'", second="l_returnflag <> 'R'", source="lineitem") + ")",
)
def a12_flag(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_linestatus", "l_quantity", "l_returnflag")
    out = similarity.ks_two_sample(
        lines, ["l_linestatus"], "l_quantity", F.col("l_returnflag") == "R", F.col("l_returnflag") != "R"
    )
    return out.select(F.col("l_linestatus").alias("domain"), r6(F.col("ks_statistic")).alias("ks_statistic"),
                      r6(F.col("ks_pvalue")).alias("ks_pvalue"))
