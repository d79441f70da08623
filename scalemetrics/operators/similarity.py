"""Do the splits of a table look alike?"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scalemetrics.functions.stats import ks_p_value
from scalemetrics.spec import ScaleSpec
from scalemetrics.workspace import settle

SLICES = 256


def ks_two_sample(df: DataFrame, keys: list[str], value: str, first: Column, second: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p per key.

    Rows collapse to one count per distinct value before anything is ordered.
    The running count is taken inside slices holding about equally many distinct
    values and the slice totals are added on top, so no task orders a whole key.
    """
    counts = settle(
        df.select(*keys, F.col(value).cast("double").alias("v"), first.cast("int").alias("a"), second.cast("int").alias("b"))
        .filter(F.col("v").isNotNull())
        .groupBy(*keys, "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    cuts = F.array(*[F.lit(n / SLICES) for n in range(1, SLICES)])
    # written out, so that Spark knows its size and broadcasts it: no key's values meet in one task
    span = settle(counts.groupBy(*keys).agg(
        F.percentile_approx("v", cuts, 10 * SLICES).alias("cuts"), F.sum("a").alias("n1"), F.sum("b").alias("n2")
    ))
    slice_no = F.size(F.filter(F.array_distinct("cuts"), lambda c: c < F.col("v")))
    sliced = counts.join(span, keys).withColumn("slice", slice_no).drop("cuts")
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sliced.groupBy(*keys, "slice").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).select(
        *keys, "slice", F.coalesce(F.sum("a").over(earlier), F.lit(0)).alias("a0"),
        F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("b0"),
    )
    running = Window.partitionBy(*keys, "slice").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cdf = sliced.join(before, [*keys, "slice"]).select(
        *keys, "n1", "n2",
        F.abs((F.col("a0") + F.sum("a").over(running)) / F.col("n1") - (F.col("b0") + F.sum("b").over(running)) / F.col("n2")).alias("d"),
    )
    return cdf.groupBy(*keys).agg(F.max("d").alias("ks_statistic"), F.max("n1").alias("n1"), F.max("n2").alias("n2")).withColumn(
        "ks_pvalue", ks_p_value(F.col("ks_statistic"), F.col("n1"), F.col("n2"))
    )


def split_similarity(df: DataFrame, spec: ScaleSpec, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Mean and sd per split, largest mean difference and train/test KS, per domain."""
    long = df.select("split", *spec.scores).unpivot(["split"], list(spec.scores), "column", "score").select(
        "split", F.substring_index("column", "_", 1).alias("domain"), "score"
    )
    of = lambda s: F.when(F.col("split") == s, F.col("score"))
    stats = long.groupBy("domain").agg(
        *[F.avg(of(s)).alias(f"{s}_mean") for s in splits], *[F.stddev_samp(of(s)).alias(f"{s}_std") for s in splits]
    )
    gaps = [F.abs(F.col(f"{a}_mean") - F.col(f"{b}_mean")) for a, b in combinations(splits, 2)]
    stats = stats.withColumn("max_mean_diff", F.greatest(*gaps))
    ks = ks_two_sample(long, ["domain"], "score", F.col("split") == splits[0], F.col("split") == splits[-1])
    # Mean difference 0.05, p 0.01.
    return stats.join(ks.drop("n1", "n2"), "domain").withColumn(
        "similar", (F.col("max_mean_diff") < 0.05) & (F.col("ks_pvalue") > 0.01)
    )
