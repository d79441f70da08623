"""Quantile bins, composite strata, rare-stratum merge, exact stratified splits and folds.

Strata come from a few bins per domain, so stratum tables are small by
construction; respondents are never ranked inside a whole stratum (one may hold a
third of the rows), see ``rank_cuts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scalemetrics.functions.draws import row_hash
from scalemetrics.operators.quantiles import hash_ranges, rank_cuts
from scalemetrics.workspace import settle


def bin_edges(df: DataFrame, columns: list[str], bins: int = 5) -> dict[str, list[float]]:
    """Inner edges of equal-frequency bins for score columns (few distinct values).

    Edges that coincide with each other or with the minimum are dropped; edges at
    the maximum are kept out too because no value lies above them.
    """
    probs = [k / bins for k in range(1, bins)]
    row = df.agg(
        *[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(f"{c}__q") for c in columns],
        *[F.min(c).alias(f"{c}__lo") for c in columns],
        *[F.max(c).alias(f"{c}__hi") for c in columns],
    ).first()
    return {
        c: sorted({e for e in row[f"{c}__q"] if row[f"{c}__lo"] < e < row[f"{c}__hi"]}) for c in columns
    }


def bin_index(column: Column, edges: list[float]) -> Column:
    """Right-closed bin number: how many inner edges lie below the value."""
    total = F.lit(0)
    for e in edges:
        total = total + (column > F.lit(e)).cast("int")
    return F.when(column.isNotNull(), total)


def add_bins(df: DataFrame, columns: dict[str, str], bins: int = 5) -> DataFrame:
    """Add a bin column per score column; ``columns`` maps bin column -> score column."""
    edges = bin_edges(df, list(columns.values()), bins)
    return df.withColumns({b: bin_index(F.col(c), edges[c]) for b, c in columns.items()})


def composite_stratum(parts: list[str], bins: int = 5) -> Column:
    """Mixed-radix number of several bin columns."""
    acc = F.lit(0)
    for p in parts:
        acc = acc * bins + F.col(p)
    return acc.cast("short")


def rare_remap(counts: DataFrame, stratum: str, out: str, min_count: int = 3) -> DataFrame:
    """(stratum, out) from (stratum, count): where the rows of each stratum go.

    Strata with fewer than ``min_count`` rows go to the nearest populated id; the
    lower id wins ties; with no populated stratum everything becomes 0.  Two
    running windows over the stratum table find the nearest neighbours.
    """
    w = Window.orderBy(stratum)  # one row per stratum
    id_if_big = F.when(F.col("count") >= min_count, F.col(stratum))
    below = F.last(id_if_big, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first(id_if_big, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    nearest = (
        F.when(below.isNull() & above.isNull(), F.lit(0))
        .when(above.isNull() | (F.col(stratum) - below <= above - F.col(stratum)), below)
        .otherwise(above)
    )
    return counts.select(stratum, nearest.cast(counts.schema[stratum].dataType).alias(out))


def merge_rare(df: DataFrame, stratum: str = "split_stratum", out: str = "merged_stratum", min_count: int = 3) -> DataFrame:
    """Add the merged stratum of every row."""
    remap = settle(rare_remap(df.groupBy(stratum).count(), stratum, out, min_count))
    return df.join(remap, stratum)


def _largest_remainder(counts: DataFrame, stratum: str, fraction: float) -> DataFrame:
    """Quota per stratum adding up to ceil(fraction * N)."""
    everything = Window.partitionBy()  # over the stratum table only
    totals = counts.withColumn("__total", F.sum("count").over(everything)).withColumn(
        "__target", F.ceil(F.lit(fraction) * F.col("__total")).cast("bigint")
    )
    shares = totals.withColumns(
        {
            "__base": F.expr("(count * __target) div __total"),
            "__rem": F.expr("(count * __target) % __total"),
        }
    )
    spare = F.col("__target") - F.sum("__base").over(everything)
    place = F.row_number().over(Window.orderBy(F.desc("__rem"), stratum))
    return shares.select(stratum, (F.col("__base") + (place <= spare).cast("int")).alias("quota"))


def share_cuts(df: DataFrame, stratum: str, key: str, fraction: float, seed: int, merge: bool = False) -> DataFrame:
    """(stratum, cut_hash, cut_id): rows up to the cut make ceil(fraction * N) rows in all.

    Two passes over (stratum, key); the tables in between have one row per stratum
    and hash range.
    """
    h = row_hash(seed, F.col(key))
    ranges = settle(hash_ranges(df.select(stratum, key), [stratum], h))
    counts = ranges.groupBy(stratum).agg(F.sum("__c").alias("count"))
    if not merge:
        quotas = _largest_remainder(counts, stratum, fraction).withColumn("cut", F.lit(1))
        return settle(rank_cuts(df.select(stratum, key), [stratum], h, key, ranges, quotas).drop("cut"))
    remap = settle(rare_remap(counts, stratum, "__m"))
    merged = ranges.join(remap, stratum).groupBy("__m", "__b").agg(F.sum("__c").alias("__c"))
    quotas = _largest_remainder(merged.groupBy("__m").agg(F.sum("__c").alias("count")), "__m", fraction)
    rows = df.select(stratum, key).join(remap, stratum)
    cuts = rank_cuts(rows, ["__m"], h, key, merged, quotas.withColumn("cut", F.lit(1)))
    return settle(remap.join(cuts, "__m").select(stratum, "cut_hash", "cut_id"))


def take_share(df: DataFrame, stratum: str, key: str, fraction: float, seed: int, flag: str, merge: bool = False) -> DataFrame:
    """Mark ``flag`` on exactly ceil(fraction * N) rows, proportionally per stratum."""
    cuts = share_cuts(df, stratum, key, fraction, seed, merge)
    at = F.struct(row_hash(seed, F.col(key)).alias("cut_hash"), F.col(key).alias("cut_id"))
    inside = at <= F.struct("cut_hash", "cut_id")
    marked = df.join(cuts, stratum, "left")
    return marked.withColumn(flag, F.col("cut_hash").isNotNull() & F.coalesce(inside, F.lit(False))).drop("cut_hash", "cut_id")


def stratified_split(
    df: DataFrame, stratum: str, key: str, test: float = 0.15, val: float = 0.15, seed: int = 42
) -> DataFrame:
    """Add ``split`` (train / val / test) with exact proportions inside strata.

    The validation share is taken from what the test share leaves.  Rows are only
    compared with two cut tables; no row is shuffled to receive its label.
    """
    held = take_share(df, stratum, key, test, seed, "__is_test", merge=True)
    rest = held.filter(~F.col("__is_test")).select(stratum, key)
    cuts = share_cuts(rest, stratum, key, val / (1 - test), seed, merge=True)
    at = F.struct(row_hash(seed, F.col(key)).alias("cut_hash"), F.col(key).alias("cut_id"))
    inside = F.col("cut_hash").isNotNull() & F.coalesce(at <= F.struct("cut_hash", "cut_id"), F.lit(False))
    label = F.when(F.col("__is_test"), "test").when(inside, "val").otherwise("train")
    return held.join(cuts, stratum, "left").withColumn("split", label).drop("__is_test", "cut_hash", "cut_id")


def assign_folds(df: DataFrame, key: str, folds: int, seed: int, stratum: str | None = None) -> DataFrame:
    """Add ``fold`` in 0..folds-1: consecutive blocks of the random order inside each stratum."""
    base = df if stratum else df.withColumn("__one", F.lit(0))
    by = stratum or "__one"
    h = row_hash(seed, F.col(key))
    ranges = settle(hash_ranges(base.select(by, key), [by], h))
    counts = ranges.groupBy(by).agg(F.sum("__c").alias("count"))
    if stratum:
        least, n = counts.agg(F.min("count"), F.count(F.lit(1))).first()
        if n < 2:
            raise ValueError("stratified folds need at least 2 strata")
        if least < folds:
            raise ValueError(f"a stratum has {least} rows, fewer than {folds} folds")
    ends = F.array(
        *[
            F.struct(F.lit(j).alias("cut"), F.ceil(F.col("count") * j / F.lit(folds)).cast("bigint").alias("quota"))
            for j in range(1, folds)
        ]
    )
    quotas = counts.select(by, F.inline(ends))
    cuts = settle(
        rank_cuts(base, [by], h, key, ranges, quotas)
        .groupBy(by).pivot("cut", list(range(1, folds)))
        .agg(F.first(F.struct("cut_hash", "cut_id")))
    )
    marked = base.join(cuts, by, "left").withColumn("__at", F.struct(h.alias("cut_hash"), F.col(key).alias("cut_id")))
    fold = F.lit(0)
    for j in range(1, folds):
        # an absent cut means a quota of zero rows: everything lies beyond it
        fold = fold + F.coalesce((F.col("__at") > F.col(str(j))).cast("int"), F.lit(1))
    return marked.withColumn("fold", fold).drop("__at", "__one", *[str(j) for j in range(1, folds)])


def random_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows in hash order (all rows when there are fewer)."""
    h = row_hash(seed, F.col(key))
    base = df.withColumn("__one", F.lit(0))
    ranges = settle(hash_ranges(base.select("__one", key), ["__one"], h))
    total = ranges.groupBy("__one").agg(F.sum("__c").alias("count"))
    quotas = total.select("__one", F.lit(1).alias("cut"), F.least(F.lit(n), F.col("count")).alias("quota"))
    cuts = settle(rank_cuts(base, ["__one"], h, key, ranges, quotas))
    at = F.struct(F.col("__h").alias("cut_hash"), F.col(key).alias("cut_id"))
    return (
        base.withColumn("__h", h).join(cuts, "__one").filter(at <= F.struct("cut_hash", "cut_id"))
        .drop("__h", "__one", "cut", "cut_hash", "cut_id")
    )
