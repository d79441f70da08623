"""Integrity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalemetrics.operators import compare, evaluate, integrity
from scalemetrics.plans import itemstats, rows  # noqa: F401  (register the pool and calibration CTEs)
from scalemetrics.plans.evaluation import metrics
from scalemetrics.plans.registry import query
from scalemetrics.plans.sqlparts import part, sql
from scalemetrics.plans.tables import (
    SPEC, clean, item_pool, norms, predictions, r_bars, responses, selected, table,
)


def hash_sql(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def fields_sql(*columns: str) -> str:
    """Fields with their lengths, a missing one marked apart."""
    one = lambda c: f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    return f"concat_ws('|', {', '.join(map(one, columns))})"


def fp_sql(text: str, source: str, key: str | None = None) -> str:
    k = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    return f"SELECT {k}count(*) AS n, CAST(sum(CAST(hh AS HUGEINT)) AS VARCHAR) AS hash_sum, bit_xor(hh) AS hash_xor FROM (SELECT {k}{hash_sql(text)} AS hh FROM {source}) {group}"


@query("i1_table_fingerprint", fp_sql(fields_sql("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "orders", "o_orderstatus"))
def i1(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.fingerprint(
        table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], ["o_orderstatus"]
    )


@query("i1_document_fingerprint", fp_sql(fields_sql("doc_id", "text", "lang"), "documents", "lang"))
def i1_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts enter the row hash."""
    return integrity.fingerprint(table(spark, sf, "documents"), ["doc_id", "text", "lang"], ["lang"])


part("fps", fp_sql(fields_sql("rid", "stratum", "split"), "sp", "split"), "sp")
part("tok", "SELECT split AS artifact, concat_ws(':', n, hash_sum, hash_xor) AS token FROM fps", "fps")


def split_tokens(spark: SparkSession, sf: str, df: DataFrame | None = None) -> DataFrame:
    source = df if df is not None else responses(spark, sf)
    fp = integrity.fingerprint(source, ["respondent_id", "split_stratum", "split"], ["split"])
    return integrity.as_tokens(fp, F.col("split"))


@query("i2_split_signature", sql("SELECT sha256(string_agg(artifact || '=' || token, chr(10) ORDER BY artifact)) AS signature FROM tok", "tok"))
def i2(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.signature(split_tokens(spark, sf))


@query("i3_lock_report", sql(
    """SELECT artifact, CASE artifact WHEN 'val' THEN 'mismatch' ELSE 'match' END AS status FROM tok UNION ALL SELECT 'holdout', 'missing'""", "tok"))
def i3(spark: SparkSession, sf: str) -> DataFrame:
    """Stored tokens against a table whose validation rows changed; one stored artifact is gone."""
    gone = split_tokens(spark, sf).filter("artifact = 'test'").withColumn("artifact", F.lit("holdout"))
    stored = split_tokens(spark, sf).unionByName(gone)
    changed = responses(spark, sf).withColumn(
        "split_stratum", F.when(F.col("split") == "val", F.col("split_stratum") + 1).otherwise(F.col("split_stratum"))
    )
    return integrity.lock_report(stored, split_tokens(spark, sf, changed))


@query("i3_lock_not_strict", sql("SELECT artifact, 'not_locked' AS status FROM tok", "tok"))
def i3_loose(spark: SparkSession, sf: str) -> DataFrame:
    tokens = split_tokens(spark, sf)
    return integrity.lock_report(tokens.withColumn("token", F.lit(None).cast("string")), tokens, strict=False)


def variants(spark: SparkSession, sf: str) -> DataFrame:
    """One artifact per split and scorer: both tell the same signature except for the test split."""
    tokens = split_tokens(spark, sf)
    a = tokens.select(F.col("artifact").alias("variant"), F.lit("model").alias("kind"), F.sha2("token", 256).alias("signature"))
    changed = F.when(F.col("artifact") == "test", F.concat("token", F.lit("*"))).otherwise(F.col("token"))
    b = tokens.select(F.col("artifact").alias("variant"), F.lit("metrics").alias("kind"), F.sha2(changed, 256).alias("signature"))
    return a.unionByName(b)


@query("i4_variant_consistency", sql("SELECT artifact AS variant, 2::BIGINT AS signatures FROM tok WHERE artifact = 'test'", "tok"))
def i4(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.inconsistent_variants(variants(spark, sf))


@query("j3_signature_match", sql(
    "SELECT artifact AS variant, sha256(CASE artifact WHEN 'test' THEN token || '*' ELSE token END) AS signature, artifact <> 'test' AS accepted FROM tok", "tok"))
def j3(spark: SparkSession, sf: str) -> DataFrame:
    both = variants(spark, sf)
    found = both.filter("kind = 'metrics'").select("variant", "signature")
    return compare.signature_matches(found, both.filter("kind = 'model'").select("variant", "signature"), ["variant", "signature"])


@query("j4_variant_overview", sql(
    """SELECT variant, coalesce(CAST(tr.n AS VARCHAR), '---') AS rows, coalesce(CAST(st.n AS VARCHAR), '---') AS strata, tr.n IS NOT NULL AND st.n IS NOT NULL AS complete
    FROM (VALUES ('train'), ('val'), ('test'), ('extra')) v(variant) LEFT JOIN (SELECT split, count(*) AS n FROM sp GROUP BY 1) tr ON tr.split = variant
    LEFT JOIN (SELECT split, count(DISTINCT stratum) AS n FROM sp WHERE split <> 'val' GROUP BY 1) st ON st.split = variant""", "sp"))
def j4(spark: SparkSession, sf: str) -> DataFrame:
    r = responses(spark, sf)
    names = spark.createDataFrame([(v,) for v in ("train", "val", "test", "extra")], "variant string")
    per = lambda df, agg: df.groupBy(F.col("split").alias("variant")).agg(agg.alias("value"))
    return compare.overview(names, {
        "rows": per(r, F.count(F.lit(1))), "strata": per(r.filter("split <> 'val'"), F.count_distinct("split_stratum")),
    })


@query("j6_id_report", sql(
    """SELECT item, 'missing' AS status FROM itm WHERE item NOT IN (SELECT item FROM sel WHERE method = 'adaptive_topk' AND k = 30)
    UNION ALL SELECT 'zzz1', 'extra'""", "itm", "sel"))
def j6(spark: SparkSession, sf: str) -> DataFrame:
    expected = clean(spark, sf).limit(1).select(F.explode(F.array(*[F.lit(i) for i in SPEC.items])).alias("item"))
    picked = selected(spark, sf).filter("method = 'adaptive_topk' AND k = 30").select("item")
    stray = picked.limit(1).select(F.lit("zzz1").alias("item"))
    return compare.id_report(expected, picked.unionByName(stray), "item")


@query("j7_required_combinations", sql(
    """SELECT method, k, 'unexpected' AS problem FROM (SELECT DISTINCT method, k FROM sel) WHERE method = 'worst_k'
    UNION ALL SELECT method, k, 'duplicated' FROM (SELECT DISTINCT method, k FROM sel) WHERE method = 'first_n'
    UNION ALL SELECT 'absent_method', 20, 'absent'""", "sel"))
def j7(spark: SparkSession, sf: str) -> DataFrame:
    have = selected(spark, sf).filter("method NOT LIKE 'random%'").select("method", "k").distinct()
    needed = have.filter("method <> 'worst_k'")
    absent = have.filter("method = 'full'").select(F.lit("absent_method").alias("method"), F.lit(20).alias("k"))
    present = have.unionByName(have.filter("method = 'first_n'"))
    return compare.combination_report(needed.unionByName(absent), present, ["method", "k"])


def damaged_pool(spark: SparkSession, sf: str) -> DataFrame:
    """The item pool with a wrong domain, a zero rank, a repeated and a missing item."""
    pool = item_pool(spark, sf).select(
        F.col("item").alias("id"), F.when(F.col("rank") == 3, 0).otherwise(F.col("rank")).alias("rank"),
        F.when(F.col("rank") == 2, "zzz").otherwise(F.col("home_domain")).alias("home_domain"),
        F.col("own_r").alias("own_domain_r"), F.col("info").alias("cross_domain_info"), "domain_correlations",
    )
    return pool.filter("rank <> 50").unionByName(pool.filter("rank = 1"))


@query("i5_item_pool_rules", sql(
    """SELECT item AS subject, unnest(CASE rank WHEN 1 THEN ['unique_id'] WHEN 2 THEN ['known_domain', 'domain_matches_id'] WHEN 3 THEN ['rank_from_one'] ELSE ['missing_id'] END) AS rule
    FROM pool WHERE rank IN (1, 2, 3, 50)""", "pool"))
def i5(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.check_item_pool(damaged_pool(spark, sf), SPEC)


@query("i6_norm_rules", sql("SELECT domain AS subject, 'positive_sd' AS rule FROM nm WHERE form = 'full' AND domain = 'agr' UNION ALL SELECT 'opn', 'missing_domain'", "nm"))
def i6(spark: SparkSession, sf: str) -> DataFrame:
    broken = norms(spark, sf).filter("form = 'full' AND domain <> 'opn'").withColumn(
        "sd", F.when(F.col("domain") == "agr", F.lit(0.0)).otherwise(F.col("sd"))
    )
    return integrity.check_norms(broken, SPEC)


@query("i6_calibration_rules", sql("SELECT domain AS subject, 'coverage_is_share' AS rule FROM cal WHERE domain = 'ext'", "cal"))
def i6_calibration(spark: SparkSession, sf: str) -> DataFrame:
    fitted = evaluate.fit_calibration(predictions(spark, sf).filter("method = 'short_form'"), "sparse")
    broken = fitted.withColumn("observed_coverage", F.when(F.col("domain") == "ext", F.col("observed_coverage") + 1).otherwise(F.col("observed_coverage")))
    return integrity.check_calibration(broken, SPEC)


@query("i7_short_form_rules", sql(
    """SELECT home AS subject, 'item_count' AS rule FROM sel WHERE method = 'adaptive_topk' AND k = 20 GROUP BY home HAVING count(*) <> 4
    UNION ALL SELECT domain, 'missing_domain' FROM dom WHERE domain NOT IN (SELECT home FROM sel WHERE method = 'adaptive_topk' AND k = 20)""", "sel", "dom"))
def i7(spark: SparkSession, sf: str) -> DataFrame:
    """The top-20 selection checked as if it were a short form."""
    mapping = selected(spark, sf).filter("method = 'adaptive_topk' AND k = 20").groupBy(F.col("home_domain").alias("domain")).agg(
        F.collect_list("item").alias("items")  # at most the items of a domain
    )
    return integrity.check_short_form(mapping, SPEC)


@query("i8_check_report", sql(
    """SELECT status, count(*) AS checks FROM (VALUES ('fail'), ('pass'), ('pass'), ('pass'), ('skip')) t(status) WHERE (SELECT count(*) FROM good) > 0 GROUP BY status""", "good"))
def i8(spark: SparkSession, sf: str) -> DataFrame:
    fitted = evaluate.calibration_from_metrics(metrics(spark, sf).filter("method = 'short_form'"), "sparse")
    report = integrity.check_report(
        {
            "item_pool": integrity.check_item_pool(damaged_pool(spark, sf), SPEC), "norms": integrity.check_norms(norms(spark, sf).filter("form = 'full'"), SPEC),
            "r_bars": integrity.check_r_bars(r_bars(spark, sf), SPEC), "calibration": integrity.check_calibration(fitted, SPEC),
        },
        skipped=("session_report",),
    )
    return integrity.status_counts(report)
