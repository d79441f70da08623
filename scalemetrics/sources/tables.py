"""Parquet tables: counted writes, projected reads, partitioned splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scalemetrics.spec import ScaleSpec


def write_counted(df: DataFrame, path: str, *partition_by: str) -> int:
    """Write and return the row count, taken during the write."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return seen.get["rows"]


def read_table(
    spark: SparkSession, path: str, columns: list[str] | None = None, first: int | None = None, key: str = "respondent_id"
) -> DataFrame:
    """Read with a projection; ``first`` rows by key (partial top-k per task, then merge)."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.orderBy(key).limit(first)
    return df.select(*columns) if columns else df


def split_columns(df: DataFrame, spec: ScaleSpec) -> DataFrame:
    """Types of the split tables: float items, double targets, short stratum."""
    casts = {c: F.col(c).cast("float") for c in spec.items}
    casts |= {c: F.col(c).cast("double") for c in (*spec.scores, *spec.percentiles)}
    return df.withColumns(casts | {"split_stratum": F.col("split_stratum").cast("short")})


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; the filter prunes to its folder."""
    return spark.read.parquet(path).filter(F.col("split") == split)
