"""Item selections: which items a method keeps at a given K.

The item pool has one row per item, so windows here are over at most that many
rows per method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scalemetrics.functions.draws import row_hash
from scalemetrics.spec import ScaleSpec

# K grid, and the checkpoints of the domain-count report.
K_GRID = (5, 10, 15, 20, 25, 30, 40, 50)
CHECKPOINTS = (5, 10, 15, 20, 25)


def _place(*order: Column | str) -> Column:
    return F.row_number().over(Window.orderBy(*order))


def _place_in_domain(*order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy("home_domain").orderBy(*order))


def placements(pool: DataFrame, spec: ScaleSpec, seeds: range = range(42, 52)) -> DataFrame:
    """(method, item, home_domain, pos, domain_pos): every method's order of the whole pool.

    A selection at K is ``pos <= K`` or, for the domain-wise methods,
    ``domain_pos <= K / domains``.
    """
    best_of_domain = F.row_number().over(Window.partitionBy("home_domain").orderBy("rank")) == 1
    domain_no = F.array_position(F.array(*[F.lit(d) for d in spec.domains]), F.col("home_domain"))
    own = F.abs("own_r")
    orders: dict[str, list[Column | str]] = {
        "adaptive_topk": ["rank"],
        "greedy_balanced": [F.desc("best"), "rank"],
        "first_n": ["item_number", "domain_no"],
        "worst_k": [own, "rank"],
    }
    base = pool.withColumns({"best": best_of_domain, "domain_no": domain_no})
    ranked = [
        base.select(F.lit(m).alias("method"), "item", "home_domain", _place(*o).alias("pos"), F.lit(None).cast("int").alias("domain_pos"))
        for m, o in orders.items()
    ]
    ranked += [
        base.select(
            F.lit(m).alias("method"), "item", "home_domain",
            _place(_in_domain(o), "domain_no").alias("pos"), _in_domain(o).alias("domain_pos"),
        )
        for m, o in {"domain_balanced": F.desc(own), "domain_constrained": F.desc("info")}.items()
    ]
    drawn = base.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    by_seed = Window.partitionBy("seed").orderBy(row_hash("pick", F.concat_ws("|", "seed", "item")), "item_no")
    ranked.append(
        drawn.select(
            F.concat(F.lit("random_"), F.col("seed").cast("string")).alias("method"), "item", "home_domain",
            F.row_number().over(by_seed).alias("pos"), F.lit(None).cast("int").alias("domain_pos"),
        )
    )
    out = ranked[0]
    for r in ranked[1:]:
        out = out.unionByName(r)
    return out


def _in_domain(order: Column) -> Column:
    return _place_in_domain(order, "rank")


def selections(placed: DataFrame, spec: ScaleSpec, ks: tuple[int, ...] = K_GRID) -> DataFrame:
    """(method, k, item, home_domain) for every method at every K it is defined for.

    Domain-wise methods need K divisible by the number of domains; the greedy
    method falls back to the plain ranking below one item per domain; the short
    form exists at its own length and the full set at the scale's length.
    """
    n = len(spec.domains)
    at = placed.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    wise = F.col("domain_pos").isNotNull()
    greedy_small = (F.col("method") == "greedy_balanced") & (F.col("k") < n)
    chosen = at.filter(
        F.when(wise, (F.col("k") % n == 0) & (F.col("domain_pos") <= F.col("k") / n)).otherwise(F.col("pos") <= F.col("k"))
        & ~greedy_small
    )
    plain = at.filter((F.col("method") == "adaptive_topk") & (F.col("k") < n) & (F.col("pos") <= F.col("k")))
    columns = ["method", "k", "item", "home_domain"]
    out = chosen.select(*columns).unionByName(plain.withColumn("method", F.lit("greedy_balanced")).select(*columns))
    items = placed.filter("method = 'adaptive_topk'")
    if len(spec.short_items) in ks:
        short = items.filter(F.col("item").isin(*spec.short_items))
        out = out.unionByName(short.select(F.lit("short_form").alias("method"), F.lit(len(spec.short_items)).alias("k"), "item", "home_domain"))
    if spec.n_items in ks:
        out = out.unionByName(items.select(F.lit("full").alias("method"), F.lit(spec.n_items).alias("k"), "item", "home_domain"))
    return out


def domain_counts(selected: DataFrame, spec: ScaleSpec) -> DataFrame:
    """Items per domain of every selection, zeros included."""
    counts = [F.struct(F.lit(d).alias("domain"), F.count_if(F.col("home_domain") == d).alias("n_items")) for d in spec.domains]
    return selected.groupBy("method", "k").agg(F.array(*counts).alias("c")).select("method", "k", F.inline("c"))


def cumulative_domain_counts(pool: DataFrame, spec: ScaleSpec, checkpoints: tuple[int, ...] = CHECKPOINTS) -> DataFrame:
    """Items per domain within the top K of the ranking, for each checkpoint."""
    cells = [
        F.struct(F.lit(k).alias("k"), F.lit(d).alias("domain"),
                 F.count_if((F.col("rank") <= k) & (F.col("home_domain") == d)).alias("n_items"))
        for k in checkpoints for d in spec.domains
    ]
    return pool.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def starvation(pool: DataFrame, k: int = 20) -> DataFrame:
    """First rank of every domain and whether it has no item within the top k."""
    return pool.groupBy(F.col("home_domain").alias("domain")).agg(
        F.min("rank").alias("first_rank"), F.count_if(F.col("rank") <= k).alias("items_at_k")
    ).withColumn("starved", F.col("items_at_k") == 0)


def starved_domains(pool: DataFrame, k: int = 20) -> DataFrame:
    everywhere = pool.select(F.col("home_domain").alias("domain")).distinct()
    present = pool.filter(F.col("rank") <= k).select(F.col("home_domain").alias("domain"))
    return everywhere.join(present, "domain", "left_anti")
