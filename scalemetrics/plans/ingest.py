"""Sources and sinks, validity and origin filters, funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalemetrics.functions.stats import r6
from scalemetrics.operators import cleaning, scoring
from scalemetrics.plans.registry import query
from scalemetrics.plans.sqlparts import r6 as sr6, sql
from scalemetrics.plans.tables import SPEC, answers, clean, clean_rows, norms, responses, scored
from scalemetrics.sources import artifacts, delimited, metric_csv, tables
from scalemetrics.workspace import shared_dir


def digits(prefix: str = "") -> F.Column:
    """All answers of a row as one string, '-' where missing. One small expression for all: spelled out it outgrows what the JVM compiles."""
    return F.array_join(F.transform(F.array(*[F.col(f"{prefix}{i}") for i in SPEC.items]), lambda v: v.cast("string")), "", "-")


def scratch(spark: SparkSession, sf: str, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{abs(hash(sf))}"


@query(
    "s1_read_delimited",
    sql(
        "SELECT rid AS respondent_id, string_agg(CAST(val AS VARCHAR), '' ORDER BY ino) AS answers FROM raw GROUP BY rid",
        "raw",
    ),
)
def s1(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, sf, "answers-tsv")
    header = ["respondent_id", *[i.upper() for i in SPEC.items], "origin_count"]
    raw = answers(spark, sf).select("respondent_id", *[F.col(i).alias(i.upper()) for i in SPEC.items], "origin_count")
    raw.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    read = delimited.read_answers(spark, path, SPEC, header, id_column="respondent_id")
    return read.select("respondent_id", digits().alias("answers"))


@query(
    "s1_read_reordered",
    sql(
        "SELECT rid AS respondent_id, string_agg(CAST(val AS VARCHAR), '' ORDER BY ino) AS answers FROM raw GROUP BY rid",
        "raw",
    ),
)
def s1_reordered(spark: SparkSession, sf: str) -> DataFrame:
    """The same answers from a file with its columns in reverse order."""
    path = scratch(spark, sf, "answers-reversed-tsv")
    raw = answers(spark, sf).select("origin_count", *[F.col(i).alias(i.upper()) for i in reversed(SPEC.items)], "respondent_id")
    raw.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    return delimited.read_answers(spark, path, SPEC, id_column="respondent_id").select("respondent_id", digits().alias("answers"))


@query(
    "s2_require_columns",
    "SELECT count(*) AS n, 50 AS item_columns FROM orders",
)
def s2(spark: SparkSession, sf: str) -> DataFrame:
    df = cleaning.require_columns(answers(spark, sf), SPEC.items)
    return df.agg(F.count(F.lit(1)).alias("n")).withColumn("item_columns", F.lit(len(set(df.columns) & set(SPEC.items))))


@query("s3_write_clean", sql("SELECT count(*) AS written, count(*) AS stored FROM good", "good"))
def s3(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, sf, "clean")
    n = tables.write_counted(clean_rows(spark, sf), path)
    return spark.read.parquet(path).agg(F.lit(n).cast("bigint").alias("written"), F.count(F.lit(1)).alias("stored"))


@query(
    "s4_first_rows",
    sql(
        f"""SELECT rid AS respondent_id, {sr6("max(CASE WHEN domain = 'ext' THEN score END)")} AS ext_score,
        {sr6("max(CASE WHEN domain = 'opn' THEN score END)")} AS opn_score FROM sc GROUP BY rid ORDER BY rid LIMIT 500""",
        "sc",
    ),
)
def s4(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, sf, "clean-for-limit")
    clean(spark, sf).write.mode("overwrite").parquet(path)
    df = tables.read_table(spark, path, ["respondent_id", "ext_score", "opn_score"], first=500)
    return df.withColumns({c: r6(F.col(c)) for c in ("ext_score", "opn_score")})


@query(
    "s5_split_tables",
    sql(
        "SELECT split, stratum AS split_stratum, count(*) AS n, CAST(sum(rid) AS BIGINT) AS id_sum FROM sp GROUP BY ALL",
        "sp",
    ),
)
def s5(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, sf, "splits")
    tables.split_columns(responses(spark, sf), SPEC).write.mode("overwrite").partitionBy("split").parquet(path)
    parts = [tables.read_split(spark, path, s) for s in ("train", "val", "test")]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.groupBy("split", "split_stratum").agg(
        F.count(F.lit(1)).alias("n"), F.sum("respondent_id").alias("id_sum")
    )


@query(
    "s7_norm_artifact",
    sql(
        f"SELECT domain, {sr6('mean')} AS mean, {sr6('sd')} AS sd, CAST(n AS BIGINT) AS n FROM nm WHERE form = 'full'",
        "nm",
    ),
)
def s7_norms(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, sf, "norms-json")
    artifacts.write_domain_table(norms(spark, sf).filter("form = 'full'"), path, ["mean", "sd", "n"])
    read = artifacts.read_domain_table(spark, path, "mean double, sd double, n bigint")
    return read.select("domain", r6(F.col("mean")).alias("mean"), r6(F.col("sd")).alias("sd"), "n")


@query(
    "s8_metric_csv",
    sql(
        f"""SELECT 50 AS k, 'stratum_' || stratum AS method, {", ".join(
            sr6(f"avg(score) FILTER (WHERE domain = '{d}')") + f" AS r_{d}" for d in SPEC.domains)}
        FROM pc JOIN st USING (rid) GROUP BY stratum""",
        "pc", "st",
    ),
)
def s8(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, sf, "metrics-csv")
    long = (
        scored(spark, sf).select("split_stratum", *SPEC.scores)
        .unpivot(["split_stratum"], list(SPEC.scores), "domain", "score")
        .groupBy("split_stratum", F.substring("domain", 1, 3).alias("domain"))
        .agg(r6(F.avg("score")).alias("value"))
        .select(F.lit(50).alias("k"), F.concat(F.lit("stratum_"), "split_stratum").alias("method"), "domain", "value")
    )
    metric_csv.write_metrics(metric_csv.wide_metrics(long, list(SPEC.domains)), path)
    schema = "k int, method string, " + ", ".join(f"r_{d} double" for d in SPEC.domains)
    return metric_csv.read_metrics(spark, path, schema)


@query(
    "p1_valid_answers",
    sql("SELECT rid AS respondent_id FROM raw GROUP BY rid HAVING min(val) >= 1 AND max(val) <= 5", "raw"),
)
def p1(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.valid_answers(answers(spark, sf), SPEC).select("respondent_id")


@query("p2_unique_origin", sql("SELECT rid AS respondent_id, origin FROM resp0 JOIN oc USING (origin) WHERE origin_count = 1", "oc"))
def p2(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.unique_origin(answers(spark, sf)).select("respondent_id", "origin")


@query(
    "p2_unique_origin_counted",
    sql(
        """SELECT rid AS respondent_id, origin, string_agg(CAST(val AS VARCHAR), '' ORDER BY ino) AS answers
        FROM raw JOIN oc USING (origin) WHERE origin_count = 1 GROUP BY rid, origin""",
        "raw", "oc",
    ),
)
def p2_counted(spark: SparkSession, sf: str) -> DataFrame:
    kept = cleaning.single_origin_rows(answers(spark, sf).drop("origin_count"))
    return kept.select("respondent_id", "origin", digits().alias("answers"))


@query(
    "p3_reverse_key",
    sql("SELECT rid AS respondent_id, string_agg(CAST(x AS VARCHAR), '' ORDER BY ino) AS answers FROM cl GROUP BY rid", "cl"),
)
def p3(spark: SparkSession, sf: str) -> DataFrame:
    return clean_rows(spark, sf).select("respondent_id", digits().alias("answers"))


@query("p4_domain_score", sql(f"SELECT rid AS respondent_id, domain, {sr6('score')} AS score FROM sc", "sc"))
def p4(spark: SparkSession, sf: str) -> DataFrame:
    long = clean_rows(spark, sf).unpivot(["respondent_id"], list(SPEC.scores), "domain", "score")
    return long.select("respondent_id", F.substring("domain", 1, 3).alias("domain"), r6(F.col("score")).alias("score"))


@query(
    "p5_rename_order",
    sql("SELECT rid AS respondent_id, " + ", ".join(f"max(CASE WHEN item = '{i}' THEN x END) AS {i}" for i in SPEC.items)
        + " FROM cl GROUP BY rid", "cl"),
)
def p5(spark: SparkSession, sf: str) -> DataFrame:
    upper = clean(spark, sf).withColumnsRenamed({i: i.upper() for i in SPEC.items}).drop(*SPEC.scores)
    return delimited.tidy(upper, SPEC)


@query(
    "p6_casts",
    sql(
        f"""SELECT st.rid AS respondent_id, stratum AS split_stratum, CAST(x AS FLOAT) AS opn3, {sr6('score')} AS opn_score
        FROM st JOIN cl ON cl.rid = st.rid AND item = 'opn3' JOIN sc ON sc.rid = st.rid AND sc.domain = 'opn'""",
        "st", "cl", "sc",
    ),
)
def p6(spark: SparkSession, sf: str) -> DataFrame:
    df = tables.split_columns(scored(spark, sf), SPEC)
    return df.select("respondent_id", "split_stratum", "opn3", r6(F.col("opn_score")).alias("opn_score"))


@query(
    "p7_complete_targets",
    sql(
        f"""SELECT rid AS respondent_id, {sr6('avg(pct)')} AS mean_pct FROM
        (SELECT pc.rid, pc.pct, count(*) FILTER (WHERE x = 1) OVER (PARTITION BY pc.rid) AS ones FROM pc JOIN
          (SELECT rid, max(x) AS x FROM cl WHERE item = 'ext1' GROUP BY rid) USING (rid)) WHERE ones = 0 GROUP BY rid""",
        "pc", "cl",
    ),
)
def p7(spark: SparkSession, sf: str) -> DataFrame:
    # answers of 1 on the first item stand for a target that could not be computed
    holed = scored(spark, sf).withColumn("ext_score", F.when(F.col("ext1") > 1, F.col("ext_score")))
    return cleaning.complete_targets(holed, SPEC).select("respondent_id", r6(scoring.mean_of(SPEC.percentiles)).alias("mean_pct"))


@query(
    "a4_funnel",
    sql(
        """SELECT (SELECT count(*) FROM resp0) AS raw_rows, v AS valid_items, (SELECT count(*) FROM good) AS kept,
        (SELECT count(*) FROM resp0) - v AS dropped_invalid, v - (SELECT count(*) FROM good) AS dropped_origin
        FROM (SELECT count(*) AS v FROM (SELECT rid FROM raw GROUP BY rid HAVING min(val) >= 1 AND max(val) <= 5))""",
        "raw", "good",
    ),
)
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.funnel(answers(spark, sf), SPEC)
