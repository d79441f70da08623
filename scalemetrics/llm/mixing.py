"""Mix sources to target weights by Pareto order sampling.

The budget is shared among sources by weight, no source above its cap; within a source, classes of documents
share its target by rate. A document is expected e = target / size of its class times: floor(e) copies are
certain, and one more is drawn with inclusion probability p = e - floor(e). The draw ranks documents by their
random odds over their inclusion odds and takes them in that order until the words left of the target are
filled: a sample of fixed size with unequal probabilities.

The place where a source is full is found by counting words per range of the order, then per range inside that
range, so no source is ever sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scalemetrics.llm.common import draw, source_key, table, word_count
from scalemetrics.llm.registry import query
from scalemetrics.workspace import settle

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2.0
#: Documents outside these numbers of words get half the rate of the others.
USUAL_WORDS = (64, 4096)
RANGES = 1 << 16
SCALE = float(1 << 52)


def fill(parts: DataFrame, group: list[str], size: str, weight: str, budget: Column, most: float = MOST) -> DataFrame:
    """Add ``share``: the budget of the group by weight, no part above ``most`` times its size, the excess reshared.

    The parts that reach their cap are those with the least cap per weight; the level of the others is what is left
    per weight. ``budget`` is an expression over the parts' columns, equal within a group.
    """
    cap = F.col(size) * F.lit(most)
    level = cap / F.col(weight)
    ascending = W.partitionBy(*group).orderBy(level, *[F.col(c) for c in parts.columns if c not in (size, weight)])
    before, onward = ascending.rowsBetween(W.unboundedPreceding, -1), ascending.rowsBetween(0, W.unboundedFollowing)
    left = budget - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    tried = parts.withColumn("__level", left / F.sum(F.col(weight).cast("double")).over(onward))
    reached = F.max(F.when(F.col("__level") <= level, F.col("__level"))).over(W.partitionBy(*group))
    share = F.coalesce(F.least(cap, reached * F.col(weight)), cap)
    return tried.withColumn("share", share).drop("__level")


def documents_with_sizes(docs: DataFrame, seed: str, doc_id: str, text: str, source: str) -> DataFrame:
    """Add __source, __size (words), __class (rate class) and __u (a draw in (0, 1)) to the documents."""
    low, high = USUAL_WORDS
    u = draw(seed, F.col(doc_id), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")), F.col(source))
    sized = docs.withColumn("__size", word_count(F.col(text))).withColumn("__u", (u + 0.5) / F.lit(SCALE))
    return sized.withColumns({"__source": source_key(F.col(source)), "__class": F.when(F.col("__size").between(low, high), 2).otherwise(1)})


def shares(slim: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """One row per (source, rate class): __target and __source_size of the source, __whole copies and inclusion __odds."""
    classes = slim.groupBy("__source", "__class").agg(F.sum("__size").alias("size"))
    sources = classes.groupBy("__source").agg(F.sum("size").alias("source_size"))
    # a null source is "-", a named one starts with "=", so nulls are put last explicitly
    place = F.row_number().over(W.orderBy(F.col("__source") == "-", "__source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    total = F.sum("source_size").over(W.partitionBy())
    weighted = sources.withColumns({"weight": weight, "all_words": total})
    targets = fill(weighted, [], "source_size", "weight", F.col("all_words") * F.lit(budget), most).withColumnRenamed("share", "target")
    # in a class, words grow with the rate of its documents
    rated = classes.join(targets.select("__source", "source_size", "target"), "__source").withColumn("rated", F.col("__class") * F.col("size"))
    shared = fill(rated.select("__source", "__class", "size", "rated", "source_size", "target").filter("size > 0"), ["__source"], "size", "rated", F.col("target"), most)
    times = F.col("share") / F.col("size")
    whole = F.floor(times + 1e-9)
    p = F.greatest(times - whole, F.lit(0.0))
    full = rated.select("__source", "__class", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    drawn = shared.select("__source", "__class", whole.cast("long").alias("__whole"), (p / (1 - p)).alias("__odds"))
    return full.join(drawn, ["__source", "__class"], "left")


def with_order(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """Add the plan of the class and __v in [0, 1]: u-odds over inclusion odds, as a fraction; null where no copy can be drawn."""
    joined = slim.join(plan, ["__source", "__class"], "left")
    q = F.col("__u") / (1 - F.col("__u")) / F.col("__odds")
    return joined.withColumn("__v", F.when(F.col("__odds") > 0, q / (1 + q)))


def cuts(ordered: DataFrame) -> DataFrame:
    """Per source the last value of __v that still takes a copy.

    Values are taken in order while the words before plus the words after stay within twice what is left of the
    target, so the mix ends as close to the target as an end of the order can be. Equal values, which only rows
    with the same id and text have, are taken together.
    """
    needed = ordered.groupBy("__source").agg(F.max("__target").alias("__t"), F.sum(F.col("__size") * F.coalesce("__whole", F.lit(0))).alias("__w"))
    left = needed.select("__source", F.greatest(F.col("__t") - F.col("__w"), F.lit(0.0)).alias("__left"))
    first = F.least(F.floor(F.col("__v") * RANGES), F.lit(RANGES - 1)).cast("int")
    second = F.least(F.floor((F.col("__v") * RANGES - first) * RANGES), F.lit(RANGES - 1)).cast("int")
    open_rows = ordered.filter(F.col("__v").isNotNull()).select("__source", "__size", "__v", first.alias("__r1"), second.alias("__r2"))

    def last_open(rows: DataFrame, part: str, limits: DataFrame) -> DataFrame:
        """Per source the last range that starts before the target is full, and what is left at its start."""
        counts = rows.groupBy("__source", part).agg(F.sum("__size").alias("__n"))
        before = W.partitionBy("__source").orderBy(part).rowsBetween(W.unboundedPreceding, -1)
        started = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        reached = started.join(limits, "__source").filter(F.col("__before") <= F.col("__left"))
        last = reached.groupBy("__source").agg(F.max(F.struct(part, (F.col("__left") - F.col("__before")).alias("__left"))).alias("m"))
        return last.select("__source", F.col(f"m.{part}").alias(part), F.col("m.__left").alias("__left"))

    one = settle(last_open(open_rows, "__r1", left))
    inside = open_rows.join(one.drop("__left"), ["__source", "__r1"], "left_semi")
    two = settle(last_open(inside, "__r2", one.drop("__r1")))
    rows = inside.join(two.drop("__left"), ["__source", "__r2"], "left_semi").groupBy("__source", "__v").agg(F.sum("__size").alias("__n"))
    upto = F.sum("__n").over(W.partitionBy("__source").orderBy("__v"))
    taken = rows.withColumn("__upto", upto).join(two, "__source").filter(2 * F.col("__upto") - F.col("__n") <= 2 * F.col("__left"))
    cut = taken.groupBy("__source").agg(F.max("__v").alias("__cut"))
    # a source whose last range takes none of its own values still takes everything before that range
    floor = two.join(one.drop("__left"), "__source").select("__source", ((F.col("__r1") + F.col("__r2") / RANGES) / RANGES).alias("__floor"))
    return floor.join(cut, "__source", "left").select("__source", "__floor", "__cut")


def with_copies(ordered: DataFrame, cut: DataFrame) -> DataFrame:
    """Add __copies: how often the mix takes the row."""
    joined = ordered.join(cut, "__source", "left")
    extra = (F.col("__v") < F.col("__floor")) | F.coalesce(F.col("__v") <= F.col("__cut"), F.lit(False))
    return joined.withColumn("__copies", F.coalesce(F.col("__whole"), F.lit(0)) + F.coalesce(extra, F.lit(False)).cast("long"))


def mix(docs: DataFrame, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies and taken (copies * size).

    Null texts have size 0 and are taken no times; a null source is the last source. Draws depend on seed, id, text and source
    alone, so reruns agree on any partitioning; rows repeated in full are taken together. Empty tables give no rows.
    """
    slim = documents_with_sizes(docs, seed, doc_id, text, source)
    slim = settle(slim.select(F.col(doc_id).alias("doc_id"), "__size", "__u", "__source", "__class"))
    plan = settle(shares(slim))
    ordered = with_order(slim, plan)
    mixed = with_copies(ordered, settle(cuts(ordered)))
    return mixed.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), F.col("__copies").alias("copies"), (F.col("__copies") * F.col("__size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus: each document as many times as the mix takes it, with its own columns."""
    sized = documents_with_sizes(docs, seed, doc_id, text, source)
    slim = settle(sized.select("__size", "__u", "__source", "__class"))
    plan = settle(shares(slim))
    cut = settle(cuts(with_order(slim, plan)))
    rows = with_copies(with_order(sized, plan), cut).filter("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(docs.columns)


@query("op5_mixing")
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
