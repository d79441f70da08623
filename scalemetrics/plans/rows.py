"""Row-level work: masks by selection, intervals, calibration, answer maps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalemetrics.functions.stats import pinball, r6
from scalemetrics.operators import cleaning, evaluate, predict, requests, scoring
from scalemetrics.plans.ingest import digits, scratch
from scalemetrics.plans.registry import ORACLES, query
from scalemetrics.plans.sqlparts import part, pct, r6 as sr6, sql
from scalemetrics.plans.tables import SPEC, answers, full_norms, predictions, scored
from scalemetrics.streaming import score_stream


@query(
    "p10_keep_items",
    sql(
        """SELECT rid AS respondent_id, string_agg(CASE WHEN in_short THEN CAST(x AS VARCHAR) ELSE '-' END, '' ORDER BY ino) AS answers
        FROM cl GROUP BY rid""",
        "cl",
    ),
)
def p10(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.keep_items(scored(spark, sf), SPEC.short_items, SPEC).select("respondent_id", digits().alias("answers"))


@query(
    "a30_missing_share",
    sql(
        f"""SELECT CAST(sum(CASE WHEN in_short THEN 0 ELSE 1 END) AS BIGINT) AS missing_cells, count(*) AS cells,
        {sr6("sum(CASE WHEN in_short THEN 0 ELSE 1 END) / count(*)")} AS missing_share FROM cl""",
        "cl",
    ),
)
def a30(spark: SparkSession, sf: str) -> DataFrame:
    out = cleaning.missing_share(scoring.keep_items(scored(spark, sf), SPEC.short_items, SPEC), SPEC)
    return out.withColumn("missing_share", r6(F.col("missing_share")))


@query(
    "p11_order_quantiles",
    sql(
        f"""SELECT rid AS respondent_id, method, domain, {sr6('lower')} AS lower, {sr6('pred')} AS pred, {sr6('upper')} AS upper FROM pred""",
        "pred",
    ),
)
def p11(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).select(
        "respondent_id", "method", "domain", *[r6(F.col(c)).alias(c) for c in ("lower", "pred", "upper")]
    )


part(
    "cal",
    """SELECT domain, cov, CASE WHEN cov < 0.85 THEN 0.9 / greatest(cov, 0.5) WHEN cov > 0.95 THEN 0.9 / cov ELSE 1.0 END AS scale
    FROM (SELECT domain, avg(CASE WHEN true_pct BETWEEN lower AND upper THEN 1.0::DOUBLE ELSE 0 END) AS cov FROM pred
          WHERE method = 'short_form' GROUP BY domain)""",
    "pred",
)


@query(
    "a19_calibration_fit",
    sql(f"SELECT 'sparse' AS regime, domain, {sr6('cov')} AS observed_coverage, {sr6('scale')} AS scale_factor FROM cal", "cal"),
)
def a19(spark: SparkSession, sf: str) -> DataFrame:
    short = predictions(spark, sf).filter("method = 'short_form'")
    out = evaluate.fit_calibration(short, "sparse")
    return out.withColumns({c: r6(F.col(c)) for c in ("observed_coverage", "scale_factor")})


@query(
    "p12_apply_calibration",
    sql(
        f"""SELECT rid AS respondent_id, domain, {sr6("list_sort([lo, pred, hi])[1]")} AS lower, {sr6("list_sort([lo, pred, hi])[2]")} AS pred,
        {sr6("list_sort([lo, pred, hi])[3]")} AS upper FROM (SELECT rid, pred.domain, pred,
        CASE WHEN scale = 1 THEN lower ELSE greatest(0, least(100, pred - 0.5 * (upper - lower) * scale)) END AS lo,
        CASE WHEN scale = 1 THEN upper ELSE greatest(0, least(100, pred + 0.5 * (upper - lower) * scale)) END AS hi
        FROM pred JOIN cal ON cal.domain = pred.domain WHERE method = 'short_form')""",
        "pred", "cal",
    ),
)
def p12(spark: SparkSession, sf: str) -> DataFrame:
    short = predictions(spark, sf).filter("method = 'short_form'")
    out = predict.apply_calibration(short, evaluate.fit_calibration(short, "sparse"), "sparse")
    return out.select("respondent_id", "domain", *[r6(F.col(c)).alias(c) for c in ("lower", "pred", "upper")])


# Requests: the raw answers a respondent gave to the short form plus, for odd ids, to the
# whole first domain; every 97th id also sends an item nobody knows.
REQUEST_ITEMS = (
    "(in_short OR (rid % 2 = 1 AND domain = 'ext') OR rid % 3 = 0)"
)
part("req", f"SELECT rid, domain, item, num, ino, rev, val FROM raw WHERE {REQUEST_ITEMS}", "raw")
part(
    "reqv",
    """SELECT rid, CASE WHEN rid % 97 = 0 THEN 'zzz1' ELSE '' END AS unknown_items,
    coalesce(string_agg(item, ',' ORDER BY item) FILTER (WHERE val < 1 OR val > 5), '') AS bad_values, count(*) AS answered
    FROM req GROUP BY rid""",
    "req",
)


def request_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(respondent_id, answers map) built from the raw answers."""
    short = set(SPEC.short_items)
    rid = F.col("respondent_id")

    def value(i: str) -> F.Column:
        if i in short:
            return F.col(i).cast("double")
        sent = (rid % 3 == 0) | ((rid % 2 == 1) if SPEC.domain_of[i] == "ext" else F.lit(False))
        return F.when(sent, F.col(i).cast("double"))

    names = F.array(*[F.lit(i) for i in SPEC.items], F.lit("zzz1"))
    cells = F.array(*[value(i) for i in SPEC.items], F.when(rid % 97 == 0, F.lit(3.0)))
    sent = F.map_filter(F.map_from_arrays(names, cells), lambda _, v: v.isNotNull())
    return answers(spark, sf).select("respondent_id", sent.alias("answers"))


@query(
    "p14_validate_requests",
    sql(
        """SELECT rid AS respondent_id, unknown_items, bad_values, unknown_items = '' AND bad_values = '' AS valid FROM reqv""",
        "reqv",
    ),
)
def p14(spark: SparkSession, sf: str) -> DataFrame:
    out = requests.validate(request_rows(spark, sf), SPEC)
    return out.select(
        "respondent_id", F.array_join("unknown_items", ",").alias("unknown_items"),
        F.array_join("bad_values", ",").alias("bad_values"), "valid",
    )


@query(
    "p3_reverse_map",
    sql(
        """SELECT rid AS respondent_id, string_agg(item || '=' || CASE WHEN rev THEN 6 - val ELSE val END, ',' ORDER BY item) AS answers
        FROM req JOIN reqv USING (rid) WHERE unknown_items = '' AND bad_values = '' GROUP BY rid""",
        "req", "reqv",
    ),
)
def p3_map(spark: SparkSession, sf: str) -> DataFrame:
    good = requests.validate(request_rows(spark, sf), SPEC).filter("valid")
    flipped = requests.reverse_map(F.col("answers"), SPEC)
    cells = F.transform(F.array_sort(F.map_entries(flipped)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("int").cast("string")))
    return good.select("respondent_id", F.array_join(cells, ",").alias("answers"))


@query(
    "p15_dense_vector",
    sql(
        """SELECT rid AS respondent_id, string_agg(CASE WHEN val IS NULL THEN '-' ELSE CAST(val AS VARCHAR) END, '' ORDER BY ino) AS answers
        FROM (SELECT g.rid, itm.ino, req.val FROM (SELECT rid FROM reqv WHERE unknown_items = '' AND bad_values = '') g CROSS JOIN itm
        LEFT JOIN req ON req.rid = g.rid AND req.item = itm.item) GROUP BY rid""",
        "req", "reqv", "itm",
    ),
)
def p15(spark: SparkSession, sf: str) -> DataFrame:
    good = requests.validate(request_rows(spark, sf), SPEC).filter("valid")
    wide = requests.dense(good, SPEC).withColumns({i: F.col(i).cast("int") for i in SPEC.items})
    return wide.select("respondent_id", digits().alias("answers"))


@query(
    "p13_calibration_regime",
    sql(
        """SELECT rid AS respondent_id, answered, CASE WHEN answered >= 50 THEN 'full' ELSE 'sparse' END AS regime,
        CASE WHEN answered >= 50 THEN 'none' ELSE 'sparse' END AS only_sparse_fitted
        FROM reqv WHERE unknown_items = '' AND bad_values = ''""",
        "reqv",
    ),
)
def p13(spark: SparkSession, sf: str) -> DataFrame:
    good = requests.validate(request_rows(spark, sf), SPEC).filter("valid")
    n = F.size("answers").cast("bigint")
    return good.select(
        "respondent_id", n.alias("answered"), scoring.calibration_regime(n, SPEC.n_items).alias("regime"),
        scoring.calibration_regime(n, SPEC.n_items, ("sparse",)).alias("only_sparse_fitted"),
    )


@query(
    "p16_rounded_result",
    sql(
        f"""SELECT rid AS respondent_id, domain, round(m, 4) + 0::DOUBLE AS raw, round({pct('z')}, 1) + 0::DOUBLE AS percentile FROM
        (SELECT rid, r.domain, m, (m - mean) / sd AS z FROM
          (SELECT rid, domain, avg(CASE WHEN rev THEN 6 - val ELSE val END) AS m FROM req GROUP BY 1, 2) r
         JOIN reqv USING (rid) JOIN nm ON nm.domain = r.domain AND form = 'full' WHERE unknown_items = '' AND bad_values = '')""",
        "req", "reqv", "nm",
    ),
)
def p16(spark: SparkSession, sf: str) -> DataFrame:
    out = requests.score(request_rows(spark, sf), SPEC, full_norms(spark, sf))
    return out.select("respondent_id", "domain", F.col("result.raw.q50").alias("raw"), F.col("result.percentile.q50").alias("percentile"))


@query("s6_stream_scoring", ORACLES["p16_rounded_result"])
def s6(spark: SparkSession, sf: str) -> DataFrame:
    """The same requests arriving as files and scored by a stream until none is left."""
    base = scratch(spark, sf, f"stream-{uuid.uuid4().hex}")  # a stream of its own each time
    request_rows(spark, sf).write.mode("overwrite").json(f"{base}/requests")
    requests_in = score_stream.read_requests(spark, f"{base}/requests", max_files=4)
    score_stream.write_results(
        requests.score(requests_in, SPEC, full_norms(spark, sf)), f"{base}/results", f"{base}/results-state"
    ).awaitTermination()
    out = spark.read.parquet(f"{base}/results")
    return out.select("respondent_id", "domain", F.col("result.raw.q50").alias("raw"), F.col("result.percentile.q50").alias("percentile"))


@query("s6_stream_rejects", sql(
    "SELECT rid AS respondent_id, unknown_items, bad_values FROM reqv WHERE NOT (unknown_items = '' AND bad_values = '')", "reqv"))
def s6_rejects(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch(spark, sf, f"stream-rejects-{uuid.uuid4().hex}")
    request_rows(spark, sf).write.mode("overwrite").json(f"{base}/requests")
    bad = requests.rejected(score_stream.read_requests(spark, f"{base}/requests"), SPEC)
    score_stream.write_results(bad, f"{base}/rejects", f"{base}/rejects-state").awaitTermination()
    out = spark.read.parquet(f"{base}/rejects")
    return out.select("respondent_id", F.array_join("unknown_items", ",").alias("unknown_items"), F.array_join("bad_values", ",").alias("bad_values"))


@query(
    "p17_item_id",
    sql("SELECT domain, num AS item_number, count(*) AS n, CAST(sum(x) AS BIGINT) AS total FROM cl GROUP BY ALL", "cl"),
)
def p17(spark: SparkSession, sf: str) -> DataFrame:
    long = scored(spark, sf).unpivot([], list(SPEC.items), "item", "x")
    parsed = long.groupBy(
        F.regexp_extract("item", r"^([a-z]+)(\d+)$", 1).alias("domain"),
        F.regexp_extract("item", r"^([a-z]+)(\d+)$", 2).cast("int").alias("item_number"),
    )
    return parsed.agg(F.count("x").alias("n"), F.sum("x").alias("total"))


@query(
    "p18_bulk_prediction",
    sql(
        f"""SELECT rid AS respondent_id, method, 20 AS k, domain, {sr6('true_pct')} AS "true", {sr6('pred')} AS pred, {sr6('raw_true')} AS raw_true,
        {sr6('raw_pred')} AS raw_pred FROM pred""",
        "pred",
    ),
)
def p18(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).select(
        "respondent_id", "method", "k", "domain", *[r6(F.col(c)).alias(c) for c in ("true", "pred", "raw_true", "raw_pred")]
    )


@query(
    "p19_crossing_rate",
    sql(f"SELECT method, domain, {sr6('avg(CAST(crossed AS INTEGER))')} AS raw_crossing_rate FROM pred GROUP BY ALL", "pred"),
)
def p19(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.crossing_rate(predictions(spark, sf), ["method", "domain"])
    return out.withColumn("raw_crossing_rate", r6(F.col("raw_crossing_rate")))


@query(
    "p20_answered_map",
    sql(
        """SELECT rid AS respondent_id, string_agg(item || '=' || x, ',' ORDER BY item) AS answered, count(*) AS n FROM cl WHERE in_short GROUP BY rid""",
        "cl",
    ),
)
def p20(spark: SparkSession, sf: str) -> DataFrame:
    masked = scoring.keep_items(scored(spark, sf), SPEC.short_items, SPEC)
    entries = F.transform(
        F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("int").cast("string"))
    )
    return masked.withColumn("m", scoring.answered_map(SPEC)).select(
        "respondent_id", F.array_join(F.array_sort(entries), ",").alias("answered"), F.size("m").cast("bigint").alias("n")
    )


@query(
    "p21_interval_flags",
    sql(
        f"""SELECT rid AS respondent_id, method, domain, {sr6('abs(raw_upper - raw_lower)')} AS raw_width,
        abs(raw_upper - raw_lower) <= 0.5 AS converged, {sr6('upper - lower')} AS percentile_width FROM pred""",
        "pred",
    ),
)
def p21(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.interval_flags(predictions(spark, sf), 0.5)
    return out.select("respondent_id", "method", "domain", r6(F.col("raw_width")).alias("raw_width"), "converged",
                      r6(F.col("upper") - F.col("lower")).alias("percentile_width"))


@query(
    "ml2_pinball_loss",
    sql(
        f"""SELECT method, domain, {sr6('avg(greatest(0.05 * (raw_true - raw_lower), -0.95 * (raw_true - raw_lower)))')} AS q05,
        {sr6('avg(greatest(0.5 * (raw_true - raw_pred), -0.5 * (raw_true - raw_pred)))')} AS q50,
        {sr6('avg(greatest(0.95 * (raw_true - raw_upper), -0.05 * (raw_true - raw_upper)))')} AS q95 FROM pred GROUP BY ALL""",
        "pred",
    ),
)
def ml2(spark: SparkSession, sf: str) -> DataFrame:
    y = F.col("raw_true")
    loss = lambda c, q: r6(F.avg(pinball(y, F.col(c), q)))
    return predictions(spark, sf).groupBy("method", "domain").agg(
        loss("raw_lower", 0.05).alias("q05"), loss("raw_pred", 0.5).alias("q50"), loss("raw_upper", 0.95).alias("q95")
    )
