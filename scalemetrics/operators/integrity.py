"""Fingerprints, locks and validity rules as tables of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scalemetrics.spec import ScaleSpec


def fingerprint(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys..., n, hash_sum, hash_xor) of the rows, whatever their order or partitioning.

    The sum and the exclusive-or of 60-bit row hashes are partial aggregates, so
    the fingerprint of a table of any size is one pass and a tiny shuffle. Each field carries its length, so no
    other fields and no missing one give the same text.
    """
    field = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    text = F.concat_ws("|", *[field(F.col(c).cast("string")) for c in columns])
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    hashed = df.select(*(keys or []), h.alias("__h"))
    return hashed.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("__h").cast("decimal(38,0)")).cast("string").alias("hash_sum"),
        F.bit_xor("__h").alias("hash_xor"),
    )


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of artefact files (documents of a few kilobytes, one row each)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def as_tokens(fingerprints: DataFrame, artifact: Column) -> DataFrame:
    """(artifact, token) rows of a fingerprint table."""
    return fingerprints.select(
        artifact.alias("artifact"), F.concat_ws(":", F.col("n").cast("string"), "hash_sum", F.col("hash_xor").cast("string")).alias("token")
    )


def signature(tokens: DataFrame) -> DataFrame:
    """One SHA-256 over the tokens in artifact order (a handful of rows)."""
    ordered = F.array_sort(F.collect_list(F.struct("artifact", "token")))
    lines = F.transform(ordered, lambda t: F.concat_ws("=", t["artifact"], t["token"]))
    return tokens.groupBy().agg(F.sha2(F.concat_ws("\n", lines), 256).alias("signature"))


def lock_report(stored: DataFrame, current: DataFrame, strict: bool = True, optional: tuple[str, ...] = ()) -> DataFrame:
    """(artifact, status): match, mismatch, missing or new.

    A token stored as NULL is not compared when the artifact is optional, and
    nothing is compared when the lock is not strict.
    """
    s = stored.select("artifact", F.col("token").alias("stored"), F.lit(True).alias("in_stored"))
    c = current.select("artifact", F.col("token").alias("current"), F.lit(True).alias("in_current"))
    waived = F.lit(not strict) | (F.col("stored").isNull() & F.col("artifact").isin(*optional))
    status = (
        F.when(F.col("in_stored").isNull(), "new").when(F.col("in_current").isNull(), "missing")
        .when(waived, "not_locked").when(F.col("stored").eqNullSafe(F.col("current")), "match").otherwise("mismatch")
    )
    return s.join(c, "artifact", "full_outer").select("artifact", status.alias("status"))


def require_locked(report: DataFrame) -> None:
    """Fail when any artifact does not match its lock."""
    bad = report.filter(F.col("status").isin("mismatch", "missing"))
    total = bad.count()
    if total:
        first = ", ".join(f"{r['artifact']} ({r['status']})" for r in bad.orderBy("artifact").limit(20).collect())
        raise ValueError(f"{total} locked artifacts changed: {first}" + ", and more" * (total > 20))


def inconsistent_variants(artifacts: DataFrame) -> DataFrame:
    """Variants whose artifacts carry more than one signature."""
    return artifacts.groupBy("variant").agg(F.count_distinct("signature").alias("signatures")).filter("signatures > 1")


def violations(df: DataFrame, subject: str, rules: dict[str, Column]) -> DataFrame:
    """(subject, rule) for every broken rule; one pass, all rules in one row expression."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.col(subject).alias("subject"), F.explode(broken).alias("rule"))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def check_item_pool(pool: DataFrame, spec: ScaleSpec) -> DataFrame:
    """Pool rows (id, rank, home_domain, own_domain_r, cross_domain_info, domain_correlations)."""
    home = F.regexp_extract("id", r"^(.*?)\d+$", 1)
    known = F.array(*[F.lit(d) for d in spec.domains])
    corrs = F.col("domain_correlations")
    rules = {
        "known_domain": F.col("home_domain").isin(*spec.domains),
        "domain_matches_id": F.col("home_domain") == home,
        "rank_from_one": F.col("rank") >= 1,
        "finite_numbers": _finite(F.coalesce("own_domain_r", F.lit(0.0))) & _finite(F.coalesce("cross_domain_info", F.lit(0.0))),
        "correlations_present": F.size(corrs) > 0,
        "correlation_domains": F.size(F.array_except(F.map_keys(corrs), known)) == 0,
        "finite_correlations": F.forall(F.map_values(corrs), lambda r: _finite(r)),
        "unique_id": F.col("__copies") == 1,
    }
    counted = pool.join(pool.groupBy("id").agg(F.count(F.lit(1)).alias("__copies")), "id")
    per_row = violations(counted, "id", rules).distinct()
    expected = pool.sparkSession.createDataFrame([(i,) for i in spec.items], "id string")
    absent = expected.join(pool, "id", "left_anti").select(F.col("id").alias("subject"), F.lit("missing_id").alias("rule"))
    extra = pool.join(expected, "id", "left_anti").select(F.col("id").alias("subject"), F.lit("extra_id").alias("rule")).distinct()
    return per_row.unionByName(absent).unionByName(extra)


def _missing_domains(df: DataFrame, spec: ScaleSpec) -> DataFrame:
    expected = df.sparkSession.createDataFrame([(d,) for d in spec.domains], "domain string")
    return expected.join(df, "domain", "left_anti").select(F.col("domain").alias("subject"), F.lit("missing_domain").alias("rule"))


def check_r_bars(r_bars: DataFrame, spec: ScaleSpec) -> DataFrame:
    rules = {"positive_r_bar": _finite(F.col("r_bar")) & (F.col("r_bar") > 0)}
    return violations(r_bars, "domain", rules).unionByName(_missing_domains(r_bars, spec))


def check_norms(norms: DataFrame, spec: ScaleSpec) -> DataFrame:
    rules = {"finite_mean": _finite(F.col("mean")), "finite_sd": _finite(F.col("sd")), "positive_sd": F.col("sd") > 0}
    return violations(norms, "domain", rules).unionByName(_missing_domains(norms, spec))


def check_calibration(calibration: DataFrame, spec: ScaleSpec) -> DataFrame:
    cov = F.col("observed_coverage")
    rules = {
        "positive_scale": _finite(F.col("scale_factor")) & (F.col("scale_factor") > 0),
        "coverage_is_share": _finite(cov) & (cov >= 0) & (cov <= 1),
    }
    return violations(calibration, "domain", rules).unionByName(_missing_domains(calibration, spec))


def check_short_form(mapping: DataFrame, spec: ScaleSpec, per_domain: int = 4) -> DataFrame:
    """``mapping`` is (domain, items array)."""
    known = F.array(*[F.lit(i) for i in spec.items])
    items = F.col("items")
    rules = {
        "known_domain": F.col("domain").isin(*spec.domains),
        "item_count": F.size(items) == per_domain,
        "unique_items": F.size(F.array_distinct(items)) == F.size(items),
        "known_items": F.size(F.array_except(items, known)) == 0,
        "own_items": F.forall(items, lambda i: F.regexp_extract(i, r"^(.*?)\d+$", 1) == F.col("domain")),
    }
    return violations(mapping, "domain", rules).unionByName(_missing_domains(mapping, spec))


def check_report(checks: dict[str, DataFrame], skipped: tuple[str, ...] = ()) -> DataFrame:
    """(check, problems, status) of several violation tables."""
    rows = [
        t.agg(F.count(F.lit(1)).alias("problems")).select(
            F.lit(name).alias("check"), "problems", F.when(F.col("problems") == 0, "pass").otherwise("fail").alias("status")
        )
        for name, t in checks.items()
    ]
    out = reduce(DataFrame.unionByName, rows)
    if skipped:
        spark = out.sparkSession
        out = out.unionByName(spark.createDataFrame([(name, 0, "skip") for name in skipped], "check string, problems bigint, status string"))
    return out


def status_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("checks"))
