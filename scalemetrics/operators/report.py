"""Small tables for reports; their inputs are metric and item tables, not respondents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scalemetrics.spec import ScaleSpec


def method_grid(metrics: DataFrame, methods: list[str], value: str = "pearson_r") -> DataFrame:
    """One row per K, one column per method, of the overall metric."""
    overall = metrics.filter("domain = 'overall'")
    return overall.groupBy("k").pivot("method", methods).agg(F.first(value)).orderBy("k")


def starvation_table(counts: DataFrame, correlations: DataFrame, k: int) -> DataFrame:
    """Items and share of every domain with its r, most items first."""
    joined = counts.select("domain", F.col("n_items").alias("items")).join(correlations, "domain")
    share = F.floor(F.col("items") * 100 / k).cast("int")
    return joined.select("domain", "items", share.alias("share"), "pearson_r").orderBy(F.desc("items"), "domain")


def strongest_items(pool: DataFrame, per_domain: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("home_domain").orderBy(F.desc(F.abs("own_r")), "rank"))
    return pool.select(F.col("home_domain").alias("domain"), "item", place.alias("place"), "own_r").filter(F.col("place") <= per_domain)


def split_table(df: DataFrame, similarity: DataFrame, tested: str = "test") -> DataFrame:
    """Rows and share per split, and the largest KS statistic of the tested split."""
    counts = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    worst = similarity.agg(F.max("ks_statistic").alias("worst_ks")).withColumn("split", F.lit(tested))
    total = F.sum("n").over(Window.partitionBy())  # over the three split rows
    return counts.select("split", "n", (F.col("n") / total).alias("fraction")).join(worst, "split", "left")


def ranking_table(pool: DataFrame, spec: ScaleSpec, top: int) -> DataFrame:
    """Best-ranked items with |r| per domain as columns."""
    r = [F.abs(F.try_element_at("domain_correlations", F.lit(d))).alias(f"r_{d}") for d in spec.domains]
    return pool.filter(F.col("rank") <= top).select("rank", "item", "composite", *r).orderBy("rank")


def in_domain_order(metrics: DataFrame, spec: ScaleSpec) -> DataFrame:
    """Domain rows in layout order, the overall row last."""
    names = F.array(*[F.lit(d) for d in spec.domains])
    place = F.when(F.col("domain") == "overall", len(spec.domains) + 1).otherwise(F.array_position(names, F.col("domain")))
    return metrics.withColumn("place", place.cast("int")).orderBy("place")


def reference_values(norms: DataFrame, calibration: DataFrame, short_items: DataFrame, tokens: DataFrame) -> DataFrame:
    """Norms, calibration, short form and locks as (section, name, a, b) rows."""
    none = F.lit(None).cast("double")
    return (
        norms.select(F.concat(F.lit("norm_"), "form").alias("section"), F.col("domain").alias("name"), F.col("mean").alias("a"), F.col("sd").alias("b"))
        .unionByName(calibration.select(F.lit("calibration").alias("section"), F.col("domain").alias("name"), F.col("observed_coverage").alias("a"), F.col("scale_factor").alias("b")))
        .unionByName(short_items.select(F.lit("short_form").alias("section"), F.col("item").alias("name"), none.alias("a"), none.alias("b")))
        .unionByName(tokens.select(F.lit("lock").alias("section"), F.concat_ws("=", "artifact", "token").alias("name"), none.alias("a"), none.alias("b")))
    )
