"""Set and join checks between tables: ids, required combinations, parity, signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_report(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, each with its status."""
    e = expected.select(key).distinct().withColumn("__e", F.lit(True))
    a = actual.select(key).distinct().withColumn("__a", F.lit(True))
    joined = e.join(a, key, "full_outer")
    status = F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "extra")
    return joined.select(key, status.alias("status")).filter(F.col("status").isNotNull())


def combination_report(required: DataFrame, present: DataFrame, keys: list[str], needed: list[str] | None = None) -> DataFrame:
    """(keys..., problem): absent, unexpected, duplicated, or lacking a needed value."""
    complete = F.lit(True)
    for c in needed or []:
        complete = complete & F.col(c).isNotNull()
    found = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bool_and(complete).alias("complete"))
    wanted = required.select(*keys).distinct().withColumn("wanted", F.lit(True))
    problem = (
        F.when(F.col("n").isNull(), "absent").when(F.col("wanted").isNull(), "unexpected")
        .when(F.col("n") > 1, "duplicated").when(~F.col("complete"), "incomplete")
    )
    joined = wanted.join(found, keys, "full_outer")
    return joined.select(*keys, problem.alias("problem")).filter(F.col("problem").isNotNull())


def parity(a: DataFrame, b: DataFrame, keys: list[str], value: str, atol: float = 1e-4, rtol: float = 5e-5) -> DataFrame:
    """Do two scored tables agree within atol + rtol * |b|, row by row and without lone rows?"""
    left = a.select(*keys, F.col(value).alias("a"), F.lit(True).alias("in_a"))
    right = b.select(*keys, F.col(value).alias("b"), F.lit(True).alias("in_b"))
    diff = F.abs(F.col("a") - F.col("b"))
    lone = F.col("in_a").isNull() | F.col("in_b").isNull()
    out = left.join(right, keys, "full_outer").agg(
        F.count_if(~lone).alias("compared"), F.max(diff).alias("max_abs"),
        F.max(F.try_divide(diff, F.abs("b"))).alias("max_rel"),
        F.count_if(~lone & F.coalesce(diff > atol + rtol * F.abs("b"), F.lit(True))).alias("violations"),
        F.count_if(lone).alias("one_sided"),
    )
    return out.withColumn("passed", (F.col("violations") == 0) & (F.col("one_sided") == 0))


def signature_matches(artifacts: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """Mark each artifact accepted when all its keys equal those of a model."""
    known = models.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct().withColumn("__known", F.lit(True))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = artifacts.join(known, same, "left")
    return joined.withColumn("accepted", F.col("__known").isNotNull()).drop("__known", *[f"__{k}" for k in keys])


def overview(variants: DataFrame, sources: dict[str, DataFrame], key: str = "variant") -> DataFrame:
    """One row per variant with a column from each source; absent values show as ``---``.

    Every source has (key, value), at most one row per variant.
    """
    out = variants
    for name, table in sources.items():
        out = out.join(table.select(key, F.col("value").cast("string").alias(name)), key, "left")
    present = F.lit(True)
    for name in sources:
        present = present & F.col(name).isNotNull()
    out = out.withColumn("complete", present)
    return out.withColumns({name: F.coalesce(name, F.lit("---")) for name in sources})
