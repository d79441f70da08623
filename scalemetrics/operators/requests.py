"""Sparse answer maps (item -> value): validation, keying, dense vectors, rounded results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalemetrics.operators.cleaning import reverse_key
from scalemetrics.operators.scoring import Norms, long_percentiles, mean_of
from scalemetrics.spec import ScaleSpec


def validate(df: DataFrame, spec: ScaleSpec, answers: str = "answers") -> DataFrame:
    """Add ``unknown_items``, ``bad_values`` (sorted arrays) and ``valid``."""
    known = F.array(*[F.lit(i) for i in spec.items])
    a = F.col(answers)
    bad = F.map_filter(
        a, lambda k, v: v.isNull() | F.isnan(v) | (v < spec.lo) | (v > spec.hi)
    )
    return df.withColumns(
        {
            "unknown_items": F.array_sort(F.array_except(F.map_keys(a), known)),
            "bad_values": F.array_sort(F.map_keys(bad)),
        }
    ).withColumn("valid", (F.size("unknown_items") == 0) & (F.size("bad_values") == 0))


def reverse_map(answers: Column, spec: ScaleSpec) -> Column:
    """Reverse-key the listed items of a map; the input map is unchanged."""
    flipped = F.array(*[F.lit(i) for i in spec.reversed_items])
    return F.transform_values(
        answers, lambda k, v: F.when(F.array_contains(flipped, k), F.lit(spec.lo + spec.hi) - v).otherwise(v)
    )


def dense(df: DataFrame, spec: ScaleSpec, answers: str = "answers") -> DataFrame:
    """One column per item, missing where unanswered.

    The items are looked up by one small expression: spelled out per item, the lookups outgrow what the JVM compiles. The map
    is bound to a lambda variable, so that it is worked out once per row, not per item.
    """
    items = F.array(*[F.lit(i) for i in spec.items])
    found = F.transform(F.array(answers), lambda a: F.transform(items, lambda i: F.try_element_at(a, i)))
    return df.withColumn("__dense", F.get(found, F.lit(0))).withColumns({i: F.get("__dense", F.lit(n)) for n, i in enumerate(spec.items)}).drop("__dense")


def rounded_result(raw: dict[str, Column], percentile: dict[str, Column]) -> Column:
    """Struct of raw (4 digits) and percentile (1 digit, half up) per quantile."""
    return F.struct(
        F.struct(*[F.round(c, 4).alias(n) for n, c in raw.items()]).alias("raw"),
        F.struct(*[F.round(c, 1).alias(n) for n, c in percentile.items()]).alias("percentile"),
    )


def score(rows: DataFrame, spec: ScaleSpec, norms: Norms) -> DataFrame:
    """Valid requests to one rounded result per domain: one narrow stage, batch or stream."""
    good = validate(rows, spec).filter("valid")
    wide = reverse_key(dense(good, spec), spec)
    raw = F.array(*[F.struct(F.lit(d).alias("domain"), mean_of(spec.domain_items(d)).alias("raw")) for d in spec.domains])
    long = long_percentiles(wide.select("respondent_id", F.inline(raw)), {"percentile": "raw"}, norms)
    result = rounded_result({"q50": F.col("raw")}, {"q50": F.col("percentile")})
    return long.filter(F.col("raw").isNotNull()).select("respondent_id", "domain", result.alias("result"))


def rejected(rows: DataFrame, spec: ScaleSpec) -> DataFrame:
    """Invalid requests with what is wrong with them."""
    return validate(rows, spec).filter(~F.col("valid")).select("respondent_id", "unknown_items", "bad_values")
