"""Shards that all carry the mixture of the corpus: proportional stratified interleaving.

Rows are ranked in a seeded random order within their source; row r of n has the fractional rank
(2r - 1) / 2n. In the order of fractional ranks every stretch holds each source in its share, and equal
cuts of that order are the shards. Both ranks are exact, and neither sorts a source or the corpus in one
task: a table of counts per range of the order gives where a range starts, and only rows of one range are
numbered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scalemetrics.llm.common import draw, range_bits, source_key, table
from scalemetrics.llm.registry import query
from scalemetrics.workspace import settle

ROWS_PER_RANGE = 512
DRAW_BITS = 52


def starts(df: DataFrame, group: list[str], part: str) -> DataFrame:
    """Rows before each range of each group, from the counts per range."""
    counts = df.groupBy(*group, part).agg(F.count("*").alias("__n"))
    before = W.partitionBy(*group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    return counts.select(*group, part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))


def numbered(df: DataFrame, group: list[str], part: str, order: list[Column], name: str) -> DataFrame:
    """Add the exact 0-based place of each row in its group; only rows of one range are sorted together."""
    rank = F.row_number().over(W.partitionBy(*group, part).orderBy(*order))
    return df.join(starts(df, group, part), [*group, part]).withColumn(name, F.col("__start") + rank - 1).drop("__start")


def interleave(
    docs: DataFrame, n_shards: int = 16, seed: str = "shards", doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``rows``: shards differ by one row at most, and every source is spread over them in proportion, whatever its
    share of the corpus. ``slot`` is the place inside the shard. Null texts have size 1 and the checksum of nothing; a null source is
    a source of its own. Rows with equal ids are ordered by their text; rows equal in full take neighbouring
    places. Empty tables give no rows. Only ids, sizes and checksums are shuffled, never texts.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        source_key(F.col(source)).alias("__source"),
    )
    narrow = narrow.withColumn("__draw", draw(seed, F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("__source")))
    narrow = settle(narrow)
    total = narrow.count()
    bits = range_bits(total, ROWS_PER_RANGE, 16)
    by_draw = narrow.withColumn("__range", F.shiftrightunsigned("__draw", DRAW_BITS - bits))
    ranked = numbered(by_draw, ["__source"], "__range", [F.col("__draw"), F.col("doc_id"), F.col("text_crc32"), F.col("size")], "__rank").drop("__range")
    per_source = narrow.groupBy("__source").agg(F.count("*").alias("__rows"))
    odd = 2 * F.col("__rank") + 1
    fraction = ranked.join(per_source, "__source").select(
        "doc_id", "size", "text_crc32",
        (odd / (2 * F.col("__rows"))).alias("__fraction"),
        F.call_function("div", odd * F.lit(1 << bits).cast("long"), 2 * F.col("__rows")).alias("__range"),
        "__source", "__rank", F.lit(0).alias("__all"),
    )
    placed = numbered(fraction, ["__all"], "__range", [F.col("__fraction"), F.col("__source"), F.col("__rank")], "__place")
    rows, k = F.lit(max(total, 1)).cast("long"), F.lit(n_shards).cast("long")
    shard = F.call_function("div", F.col("__place") * k, rows)
    first = F.call_function("div", shard * rows + k - 1, k)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        (F.col("__place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents"))
