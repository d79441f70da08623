"""Item statistics: response distributions, item-domain and inter-item correlations, ranking.

Each partition reduces its rows to a few hundred sums with one matrix product per
Arrow batch; only those sums are shuffled.  Everything after that is tables with
one row per item or item pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scalemetrics.functions.stats import r_from_sums
from scalemetrics.spec import ScaleSpec

MIN_PAIRS = 100  # fixed value: fewer observations give no statistic
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _pairwise(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums over rows where both are present, for every column of x with every column of y."""
    mx, my = ~np.isnan(x), ~np.isnan(y)
    x0, y0 = np.where(mx, x, 0.0), np.where(my, y, 0.0)
    mxf, myf = mx.astype(float), my.astype(float)
    return np.stack([
        mxf.T @ myf, x0.T @ myf, mxf.T @ y0, (x0 * x0).T @ myf, mxf.T @ (y0 * y0), x0.T @ y0
    ])


def item_sums(df: DataFrame, spec: ScaleSpec) -> DataFrame:
    """(kind, x, y, n, sx, sy, sxx, syy, sxy) summed over all rows.

    kind ``score``: item x with the score of another domain y; kind ``rest``: item x
    with the mean of its domain's other answered items; kind ``pair``: items x, y of
    one domain.  Values are centred on the middle of the answer range.
    """
    items, domains, width = list(spec.items), list(spec.domains), spec.items_per_domain
    middle = (spec.lo + spec.hi) / 2
    names: list[tuple[str, str, str]] = []
    for d in domains:
        names += [("score", i, e) for i in spec.domain_items(d) for e in domains if e != d]
        names += [("rest", i, d) for i in spec.domain_items(d)]
        names += [("pair", a, b) for n, a in enumerate(spec.domain_items(d)) for b in spec.domain_items(d)[n + 1:]]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        upper = np.triu_indices(width, k=1)
        for pdf in batches:
            x = pdf[items].to_numpy(dtype=float) - middle
            scores = pdf[[f"{d}_score" for d in domains]].to_numpy(dtype=float) - middle
            parts = []
            for n, d in enumerate(domains):
                own = x[:, n * width:(n + 1) * width]
                others = [k for k in range(len(domains)) if k != n]
                parts.append(_pairwise(own, scores[:, others]).reshape(6, -1))
                present = ~np.isnan(own)
                count = present.sum(axis=1, keepdims=True) - present
                left = np.where(present, own, 0.0)
                rest = np.divide(
                    left.sum(axis=1, keepdims=True) - left, count, out=np.full(own.shape, np.nan), where=count > 0
                )
                both = present & ~np.isnan(rest)
                a, b = np.where(both, own, 0.0), np.where(both, rest, 0.0)
                parts.append(np.stack([
                    both.sum(axis=0), a.sum(axis=0), b.sum(axis=0), (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
                ]))
                parts.append(_pairwise(own, own)[:, upper[0], upper[1]])
            batch = np.concatenate(parts, axis=1)
            total = batch if total is None else total + batch
        if total is not None:
            out = pd.DataFrame(names, columns=["kind", "x", "y"])
            for k, c in enumerate(_SUMS):
                out[c] = total[k]
            yield out

    schema = "kind string, x string, y string, " + ", ".join(f"{c} double" for c in _SUMS)
    partial = df.select(*items, *spec.scores).mapInPandas(sums, schema)
    return partial.groupBy("kind", "x", "y").agg(*[F.sum(c).alias(c) for c in _SUMS])


def item_domain_correlations(sums: DataFrame) -> DataFrame:
    """(item, domain, r, n): own domain without the item itself; too few pairs give no row."""
    r = r_from_sums(*[F.col(c) for c in _SUMS])
    return sums.filter(F.col("kind").isin("score", "rest") & (F.col("n") >= MIN_PAIRS)).select(
        F.col("x").alias("item"), F.col("y").alias("domain"), r.alias("r"), F.col("n").cast("bigint").alias("n")
    )


def domain_of_item(item: Column) -> Column:
    return F.regexp_extract(item, r"^([a-z]+)\d+$", 1)


def domain_name(item: str) -> str:
    """``domain_of_item`` of one text."""
    found = re.match(r"([a-z]+)[0-9]+(\r\n|[\n\r\u0085\u2028\u2029])?\Z", item)  # the pattern of Columns allows a line's end
    return found[1] if found else ""


def inter_item_r(sums: DataFrame) -> DataFrame:
    """(domain, r_bar): mean correlation over the item pairs of a domain; 0 when there is none."""
    r = r_from_sums(*[F.col(c) for c in _SUMS])
    return sums.filter("kind = 'pair'").groupBy(domain_of_item(F.col("x")).alias("domain")).agg(
        F.coalesce(F.avg(r), F.lit(0.0)).alias("r_bar")
    )


def cross_domain_info(correlations: DataFrame) -> DataFrame:
    return correlations.groupBy("item").agg(F.sum(F.abs("r")).alias("info"))


def own_r_summary(correlations: DataFrame) -> DataFrame:
    own = correlations.filter(domain_of_item(F.col("item")) == F.col("domain"))
    return own.groupBy("domain").agg(F.avg("r").alias("mean_r"), F.min("r").alias("min_r"), F.max("r").alias("max_r"))


def response_distributions(df: DataFrame, spec: ScaleSpec) -> DataFrame:
    """Mean, sample sd, population skew, excess kurtosis and entropy per item.

    Answers first collapse to counts per (item, value); the moments come from the
    counts (answer levels x items rows).
    """
    counts = (
        df.select(*spec.items).unpivot([], list(spec.items), "item", "v").filter(F.col("v").isNotNull())
        .groupBy("item", "v").agg(F.count(F.lit(1)).alias("c"))
    )
    means = counts.groupBy("item").agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    dev = F.col("v") - F.col("mean")
    p = F.col("c") / F.col("n")
    moments = counts.join(means, "item").groupBy("item").agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"),
        F.sum(p * dev * dev).alias("m2"), F.sum(p * dev * dev * dev).alias("m3"), F.sum(p * dev * dev * dev * dev).alias("m4"),
        (-F.sum(p * F.log(p + 1e-10))).alias("entropy"),
    )
    m2, n = F.col("m2"), F.col("n")
    return moments.filter(n >= MIN_PAIRS).select(
        "item", "n", "mean", F.sqrt(m2 * n / (n - 1)).alias("std"),
        F.try_divide(F.col("m3"), F.pow(m2, F.lit(1.5))).alias("skew"),
        (F.try_divide(F.col("m4"), m2 * m2) - 3).alias("kurtosis"), "entropy",
    )


def item_layout(df: DataFrame, spec: ScaleSpec, item: str = "item") -> DataFrame:
    """Add domain, layout number, number in the domain and keying to a table of items."""
    domain = domain_of_item(F.col(item))
    number = F.regexp_extract(item, r"(\d+)$", 1).cast("int")
    place = F.array_position(F.array(*[F.lit(d) for d in spec.domains]), domain)
    return df.withColumns({
        "home_domain": domain, "item_number": number,
        "item_no": ((place - 1) * spec.items_per_domain + number).cast("int"),
        "is_reverse_keyed": F.col(item).isin(*spec.reversed_items),
    })


def rank_items(correlations: DataFrame, distributions: DataFrame, spec: ScaleSpec) -> DataFrame:
    """One row per item with its statistics, composite score and rank.

    Composite = info + 0.2 entropy - 0.1 |skew|; equal scores keep layout order.
    """
    per_item = correlations.groupBy("item").agg(
        F.map_from_entries(F.collect_list(F.struct("domain", "r"))).alias("domain_correlations"),
        F.sum(F.abs("r")).alias("info"),
    )
    pool = item_layout(per_item.join(distributions, "item"), spec)
    pool = pool.withColumns({
        "own_r": F.coalesce(F.try_element_at("domain_correlations", "home_domain"), F.lit(0.0)),
        # Weights of entropy and skew.
        "composite": F.col("info") + 0.2 * F.col("entropy") - 0.1 * F.abs("skew"),
    })
    order = Window.orderBy(F.desc("composite"), "item_no")  # as many rows as the scale has items
    return pool.withColumn("rank", F.row_number().over(order))


def first_item(pool: DataFrame) -> DataFrame:
    """Most informative item with |skew| < 1 and entropy > 1.3, else the top-ranked one."""
    fits = (F.abs("skew") < 1.0) & (F.col("entropy") > 1.3)
    info = F.when(fits, F.col("info"))
    return pool.orderBy(fits.desc(), F.desc_nulls_last(info), "rank").limit(1)
