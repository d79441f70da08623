"""Delimited answer files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scalemetrics.operators.cleaning import cast_items, require_columns
from scalemetrics.spec import ScaleSpec


def read_answers(
    spark: SparkSession, path: str, spec: ScaleSpec, header: list[str] | None = None, sep: str = "\t", id_column: str | None = None
) -> DataFrame:
    """Read answer columns by the names in the files' own header and cast them.

    Names count in any case and any order; columns beyond the items are kept as text. An item without a column
    raises, and so does, when it is read, a file whose header differs from the first one's. ``header`` may name columns
    that must be there. Without ``id_column`` the id is a hash of the row and of its number among equal
    rows: the same files give the same ids, however they are split.
    """
    files = spark.read.option("sep", sep).option("header", True)
    own = files.csv(path).columns
    lower = [c.lower() for c in own]
    missing = (set(spec.items) | {c.lower() for c in header or ()}) - set(lower)
    missing |= set(spec.items) - {c.lower() for c in header} if header is not None else set()
    if missing:
        raise ValueError("missing columns: " + ", ".join(sorted(missing)))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in own])
    df = files.schema(schema).option("enforceSchema", False).csv(path).toDF(*lower)
    if id_column is not None:
        return cast_items(require_columns(df, spec.items), spec).withColumn("respondent_id", F.col(id_column).cast("bigint"))
    content = F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in lower])
    equal = Window.partitionBy("__row").orderBy(F.lit(0))
    numbered = df.withColumn("__row", content).withColumn("respondent_id", F.xxhash64("__row", F.row_number().over(equal))).drop("__row")
    return cast_items(require_columns(numbered, spec.items), spec)


def tidy(df: DataFrame, spec: ScaleSpec, optional: tuple[str, ...] = ("country",)) -> DataFrame:
    """Lower-case names in a fixed order; optional columns only if present."""
    lowered = df.withColumnsRenamed({c: c.lower() for c in df.columns})
    extra = [c for c in optional if c in lowered.columns]
    scores = [s for s in spec.scores if s in lowered.columns]
    return lowered.select("respondent_id", *spec.items, *scores, *extra)
