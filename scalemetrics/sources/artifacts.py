"""Nested JSON artefacts: item pools with camelCase or snake_case fields, norms, calibration."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POOL_FIELDS = (
    ("id", None, "string"), ("rank", None, "int"), ("home_domain", "homeDomain", "string"),
    ("own_domain_r", "ownDomainR", "double"), ("cross_domain_info", "crossDomainInfo", "double"),
    ("domain_correlations", "domainCorrelations", "map<string,double>"),
    ("is_reverse_keyed", "isReverseKeyed", "boolean"),
)


def _both(name: str, camel: str | None, kind: str) -> str:
    return f"{name}: {kind}" + (f", {camel}: {kind}" if camel else "")


def read_item_pool(spark: SparkSession, path: str) -> DataFrame:
    """Item rows of a pool document; each field is taken from whichever spelling is present."""
    item = "struct<" + ", ".join(_both(*f) for f in _POOL_FIELDS) + ">"
    schema = f"item_pool array<{item}>, itemPool array<{item}>"
    # the two spellings differ in more than case, so case-insensitive names are fine
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = doc.select(F.explode(F.coalesce("item_pool", "itemPool")).alias("i"))
    return rows.select(
        *[(F.coalesce(f"i.{n}", f"i.{c}") if c else F.col(f"i.{n}")).alias(n) for n, c, _ in _POOL_FIELDS]
    )


def write_item_pool(pool: DataFrame, path: str, camel: bool = False) -> None:
    """One document holding the pool (as many records as the scale has items)."""
    fields = [F.col(n).alias(c if camel and c else n) for n, c, _ in _POOL_FIELDS]
    name = "itemPool" if camel else "item_pool"
    by_rank = lambda a, b: a["rank"] - b["rank"]
    doc = pool.groupBy().agg(F.array_sort(F.collect_list(F.struct(*fields)), by_rank).alias(name))
    doc.coalesce(1).write.mode("overwrite").json(path)


@dataclass(frozen=True)
class ItemInfo:
    """The whole item document: the pool, the first item to ask, inter-item correlations and where it came from."""

    item_pool: DataFrame  # one row per item
    first_item: DataFrame  # one row: id, text, domain
    inter_item_r_bar: DataFrame  # domain, r_bar
    provenance: DataFrame  # name, value


def write_item_info(info: ItemInfo, path: str, camel: bool = False) -> None:
    """One document in either spelling; every part has a size that the scale gives."""
    name = lambda snake, c: c if camel else snake
    fields = [F.col(n).alias(c if camel and c else n) for n, c, _ in _POOL_FIELDS]
    by_rank = lambda a, b: a["rank"] - b["rank"]
    pool = info.item_pool.groupBy().agg(F.array_sort(F.collect_list(F.struct(*fields)), by_rank).alias(name("item_pool", "itemPool")))
    as_map = lambda df, key, value, n: df.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(n))
    first = info.first_item.limit(1)
    if camel:
        first = first.select(F.col("id").alias("firstItemId"), F.col("text").alias("firstItemText"), F.col("domain").alias("firstItemDomain"))
    else:
        first = first.select(F.struct("id", "text", "domain").alias("first_item"))
    r_bar = as_map(info.inter_item_r_bar, "domain", "r_bar", name("inter_item_r_bar", "interItemRBar"))
    # four tables of one row each
    doc = reduce(lambda a, b: a.join(F.broadcast(b)), [first, r_bar, as_map(info.provenance, "name", "value", "provenance")], pool)
    doc.coalesce(1).write.mode("overwrite").json(path)


def read_item_info(spark: SparkSession, path: str) -> ItemInfo:
    """All parts of an item document in either spelling.

    A pool item without a home domain takes its id without the number; fields that are missing are 0, false or empty. A document
    without a pool, or with a number that is not finite, fails.
    """
    item = "struct<" + ", ".join(_both(*f) for f in _POOL_FIELDS) + ">"
    numbers = "map<string,double>"
    schema = f"""item_pool array<{item}>, itemPool array<{item}>, first_item struct<id: string, text: string, domain: string>, firstItemId string, firstItemText string,
        firstItemDomain string, inter_item_r_bar {numbers}, interItemRBar {numbers}, provenance map<string,string>"""
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    pool = F.coalesce("itemPool", "item_pool")
    doc = doc.withColumn("pool", F.when(pool.isNull(), F.raise_error(F.lit("the item document has no pool"))).otherwise(pool))
    rows = doc.select(F.explode("pool").alias("i")).select(*[(F.coalesce(f"i.{n}", f"i.{c}") if c else F.col(f"i.{n}")).alias(n) for n, c, _ in _POOL_FIELDS])
    rows = rows.withColumns({
        "home_domain": F.coalesce("home_domain", F.regexp_replace("id", "[0-9]+$", ""), F.lit("")), "is_reverse_keyed": F.coalesce("is_reverse_keyed", F.lit(False)),
        "domain_correlations": F.coalesce("domain_correlations", F.create_map().cast(numbers)),
        **{c: finite(F.coalesce(F.col(c), F.lit(0.0)), c) for c in ("own_domain_r", "cross_domain_info")},
    })
    camel = F.col("itemPool").isNotNull()
    part = lambda flat, nested: F.when(camel, F.col(flat)).otherwise(F.col(f"first_item.{nested}"))
    first = doc.select(part("firstItemId", "id").alias("id"), F.coalesce(part("firstItemText", "text"), F.lit("")).alias("text"), F.coalesce(part("firstItemDomain", "domain"), F.lit("")).alias("domain"))
    r_bar = doc.select(F.explode(F.coalesce("interItemRBar", "inter_item_r_bar")).alias("domain", "r_bar"))
    return ItemInfo(rows, first, r_bar.withColumn("r_bar", finite(F.col("r_bar"), "inter-item r")), doc.select(F.explode("provenance").alias("name", "value")))


def finite(value: Column, what: str) -> Column:
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.raise_error(F.lit(f"{what} is not a finite number")).cast("double")).otherwise(value)


def read_domain_table(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """{domain: {fields}} documents (norms, calibration) as rows."""
    schema = f"domains map<string, struct<{fields}>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return doc.select(F.explode("domains").alias("domain", "v")).select("domain", "v.*")


def write_domain_table(table: DataFrame, path: str, fields: list[str]) -> None:
    entry = F.struct("domain", F.struct(*fields))
    table.groupBy().agg(F.map_from_entries(F.collect_list(entry)).alias("domains")).coalesce(1).write.mode(
        "overwrite"
    ).json(path)
