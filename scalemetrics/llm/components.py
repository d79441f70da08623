"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalemetrics.workspace import settle


def _state(edges: DataFrame) -> tuple[int, int]:
    # a bigint would overflow at 2^24 edges
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)).cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    Alternates two steps until nothing changes: every node hands its larger neighbours, then its smaller ones, to
    the smallest node it knows. Edges of a node are never gathered in one place; each round is a few
    aggregations over the edge table, and the number of rounds grows with the logarithm of a component's size.
    Each round's edges are written out, so a lost executor repeats one round at most.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now = settle(edges.select(u.alias("u"), v.alias("v")).filter("u <> v").distinct())
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        handed = large.join(smallest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = settle(handed.select("e.u", "e.v").filter("u <> v").distinct())
        new_state = _state(after)
        now = after
        if new_state == state:
            break
        state = new_state
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
