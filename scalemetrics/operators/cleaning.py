"""Raw answers to clean answers: casts, validity and origin filters, funnel counts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalemetrics.spec import ScaleSpec


def require_columns(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """Fail before any job when a column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df


def cast_items(df: DataFrame, spec: ScaleSpec) -> DataFrame:
    """Text answers to integers; anything that is not a number becomes NULL (and so invalid)."""
    return df.withColumns({c: F.col(c).try_cast("int") for c in spec.items})


def all_valid(spec: ScaleSpec):
    """Every item is an integer within the answer range; simple comparisons that reach the scan."""
    return reduce(and_, [F.col(c).between(spec.lo, spec.hi) for c in spec.items])


def valid_answers(df: DataFrame, spec: ScaleSpec) -> DataFrame:
    return df.filter(all_valid(spec))


def unique_origin(df: DataFrame, count_column: str = "origin_count") -> DataFrame:
    """Keep rows whose precomputed origin count is one."""
    return df.filter(F.col(count_column) == 1)


def single_origin_rows(df: DataFrame, origin: str = "origin") -> DataFrame:
    """Keep rows whose origin occurs once in ``df``, counting over the unfiltered rows.

    One aggregation and no join or window: an origin seen once has one row, so
    ``max`` of each column is that row.  A hot origin shrinks to one record per
    map task before the shuffle.
    """
    rest = [c for c in df.columns if c != origin]
    counted = df.groupBy(origin).agg(F.count(F.lit(1)).alias("__n"), *[F.max(c).alias(c) for c in rest])
    return counted.filter("__n = 1").select(*df.columns)


def reverse_key(df: DataFrame, spec: ScaleSpec) -> DataFrame:
    """x -> lo + hi - x on reverse-keyed items; missing stays missing."""
    return df.withColumns({c: F.lit(spec.lo + spec.hi) - F.col(c) for c in spec.reversed_items})


def funnel(df: DataFrame, spec: ScaleSpec, count_column: str = "origin_count") -> DataFrame:
    """Rows read, rows with valid items, rows kept, and what each step dropped: one pass."""
    ok = all_valid(spec)
    kept = ok & (F.col(count_column) == 1)
    return df.agg(
        F.count(F.lit(1)).alias("raw_rows"), F.count_if(ok).alias("valid_items"), F.count_if(kept).alias("kept")
    ).withColumns(
        {
            "dropped_invalid": F.col("raw_rows") - F.col("valid_items"),
            "dropped_origin": F.col("valid_items") - F.col("kept"),
        }
    )


def missing_share(df: DataFrame, spec: ScaleSpec) -> DataFrame:
    """Unanswered cells over all cells."""
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in spec.items])
    return df.agg(
        F.sum(nulls).cast("bigint").alias("missing_cells"),
        (F.count(F.lit(1)) * spec.n_items).alias("cells"),
    ).withColumn("missing_share", F.try_divide(F.col("missing_cells"), F.col("cells")))


def complete_targets(df: DataFrame, spec: ScaleSpec, percentiles_only: bool = False) -> DataFrame:
    """Rows whose targets are all present."""
    wanted = list(spec.percentiles) + ([] if percentiles_only else list(spec.scores))
    return df.dropna(how="any", subset=wanted)
