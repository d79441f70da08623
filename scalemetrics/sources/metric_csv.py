"""Flat metric export: one line per (k, method), a column per domain, and its row/column count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def wide_metrics(long: DataFrame, domains: list[str], value: str = "value", prefix: str = "r_") -> DataFrame:
    """Pivot (k, method, domain, value) rows."""
    wide = long.groupBy("k", "method").pivot("domain", domains).agg(F.first(value))
    return wide.withColumnsRenamed({d: f"{prefix}{d}" for d in domains})


def write_metrics(wide: DataFrame, path: str) -> None:
    """A report table (methods x K lines): one file, plus a sidecar with its shape."""
    wide.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/data")
    wide.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(wide.columns))).write.mode(
        "overwrite"
    ).json(f"{path}/shape")


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read back; fails when the file does not have the recorded shape."""
    df = spark.read.schema(schema).option("header", True).csv(f"{path}/data")
    shape = spark.read.schema("rows bigint, columns int").json(f"{path}/shape").first()
    n = df.count()
    if (n, len(df.columns)) != (shape["rows"], shape["columns"]):
        raise ValueError(f"metric file has shape {(n, len(df.columns))}, recorded {tuple(shape)}")
    return df
