"""Exact quantiles and exact rank cuts of columns with any number of distinct values.

``percentile`` keeps every distinct value of a group in one buffer.  That is fine
for scores (few distinct values) and wrong for continuous columns of a table with
billions of rows; here a first pass narrows down where the wanted rank lies and
only that narrow part is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scalemetrics.workspace import settle

ACCURACY = 20_000  # percentile_approx is off by at most 1 / ACCURACY of the rows
SLACKS = (2.0 / ACCURACY, 0.01, 1.0)  # half widths of a bracket; the narrowest that spans two ranks beyond the error is used


def exact_quantiles(df: DataFrame, keys: list[str], column: str, probs: list[float]) -> DataFrame:
    """(keys..., prob, value) with linear interpolation, for a few groups of any size.

    An approximate quantile on either side brackets each wanted one.  Rows below
    the bracket collapse to one count, rows above it are dropped, and the distinct
    values inside it (a ten-thousandth of the rows, whatever the distribution) are
    ordered. NaN counts as missing.
    """
    data = df.select(*keys, F.nanvl(F.col(column).cast("double"), F.lit(None)).alias("__x")).filter(F.col("__x").isNotNull())
    if not keys:
        return exact_quantiles(data.withColumn("__all", F.lit(1)), ["__all"], "__x", probs).drop("__all")
    ends = [F.lit(min(1.0, max(0.0, p + s))) for slack in SLACKS for p in probs for s in (-slack, slack)]
    spread = settle(data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.percentile_approx("__x", F.array(*ends), ACCURACY).alias("__e")
    ))

    def end(n: int) -> Column:
        widest = F.col("__e")[2 * len(probs) * (len(SLACKS) - 1) + n]
        for level in reversed(range(len(SLACKS) - 1)):
            wide_enough = F.col("__n") * (SLACKS[level] - 1.0 / ACCURACY) >= 2
            widest = F.when(wide_enough, F.col("__e")[2 * len(probs) * level + n]).otherwise(widest)
        return widest

    def bracket(n: int, p: float) -> Column:
        position = F.lit(p) * (F.col("__n") - 1)
        return F.struct(
            F.lit(p).alias("prob"), end(2 * n).alias("__lo"), end(2 * n + 1).alias("__hi"),
            F.floor(position).cast("bigint").alias("__r0"), F.ceil(position).cast("bigint").alias("__r1"),
            (position - F.floor(position)).alias("__frac"),
        )

    brackets = spread.select(*keys, F.array(*[bracket(n, p) for n, p in enumerate(probs)]).alias("__b"))
    cells = (
        data.join(brackets, keys).select(*keys, "__x", F.inline("__b")).filter("__x <= __hi")
        .groupBy(*keys, "prob", "__r0", "__r1", "__frac", F.when(F.col("__x") >= F.col("__lo"), F.col("__x")).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    upto = Window.partitionBy(*keys, "prob").orderBy(F.asc_nulls_first("__v")).rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.withColumn("__to", F.sum("__c").over(upto)).withColumn("__from", F.col("__to") - F.col("__c"))
    at = lambda r: F.max(F.when((F.col(r) >= F.col("__from")) & (F.col(r) < F.col("__to")), F.col("__v")))
    found = placed.groupBy(*keys, "prob").agg(at("__r0").alias("__a"), at("__r1").alias("__z"), F.max("__frac").alias("__f"))
    return found.select(*keys, "prob", (F.col("__a") + (F.col("__z") - F.col("__a")) * F.col("__f")).alias("value"))


HASH_BITS, RANGE_BITS = 60, 12
MOST_IN_RANGE = 100_000


def hash_ranges(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """(keys..., range, count): how many rows fall in each of 2^RANGE_BITS equal ranges of a 60-bit hash."""
    return df.groupBy(*keys, hash_range(order).alias("__b")).agg(F.count(F.lit(1)).alias("__c"))


def hash_range(order: Column, bits: int = RANGE_BITS) -> Column:
    return F.shiftright(order, HASH_BITS - bits)


def rank_cuts(df: DataFrame, keys: list[str], order: Column, tie: str, ranges: DataFrame, quotas: DataFrame, most: int = MOST_IN_RANGE) -> DataFrame:
    """The row that closes each quota when rows are ordered by (hash, tie) inside their keys.

    ``ranges`` comes from ``hash_ranges`` and ``quotas`` has (keys..., cut, quota).
    The counts locate the range that holds the quota. As long as the largest range has more than ``most`` rows, the located
    ranges are counted again in finer ones; then only the rows of the last ranges are ranked, however many a key has. Returns
    (keys..., cut, cut_hash, cut_id); a quota of zero gives no row.
    """
    upto = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = ranges.withColumn("__cum", F.sum("__c").over(upto)).withColumn("__before", F.col("__cum") - F.col("__c"))
    located = settle(quotas.join(cumulative, keys).filter("quota > __before AND quota <= __cum"))
    hashed, bits = df.select(*keys, order.alias("__h"), F.col(tie).alias("__id")), RANGE_BITS

    def of_located(rows: DataFrame, bits: int) -> DataFrame:
        return rows.withColumn("__b", hash_range(F.col("__h"), bits)).join(located.select(*keys, "__b").distinct(), [*keys, "__b"], "left_semi")

    while bits < HASH_BITS and (located.agg(F.max("__c")).first()[0] or 0) > most:
        finer = min(HASH_BITS, bits + RANGE_BITS)
        counts = of_located(hashed, bits).groupBy(*keys, "__b", hash_range(F.col("__h"), finer).alias("__f")).agg(F.count(F.lit(1)).alias("__n"))
        inside = Window.partitionBy(*keys, "__b").orderBy("__f").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("__to", F.sum("__n").over(inside))
        found = located.join(counts, [*keys, "__b"]).filter("quota > __before + __to - __n AND quota <= __before + __to")
        located = settle(found.select(*keys, "cut", "quota", F.col("__f").alias("__b"), F.col("__n").alias("__c"), (F.col("__before") + F.col("__to") - F.col("__n")).alias("__before")))
        bits = finer
    inside = Window.partitionBy(*keys, "__b").orderBy("__h", "__id")
    ranked = of_located(hashed, bits).withColumn("__rn", F.row_number().over(inside))
    return (
        located.join(ranked, [*keys, "__b"]).filter("__before + __rn = quota")
        .select(*keys, "cut", F.col("__h").alias("cut_hash"), F.col("__id").alias("cut_id"))
    )
