"""Scoring by averaging for many selections at once.

All selections are one 0/1 matrix (items x selection-domains, bounded by the
spec).  A task multiplies each Arrow batch by it and counts how often each pair
(sum over all items of the domain, sum over the selected items) occurs.  Only
these integer cells are shuffled; every metric follows exactly from them, so a
sweep over dozens of selections costs one pass over the respondents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalemetrics.operators.scoring import Norms, long_percentiles
from scalemetrics.spec import ScaleSpec


def score_cells(df: DataFrame, selected: DataFrame, spec: ScaleSpec) -> DataFrame:
    """(method, k, domain, n_selected, true_sum, picked_sum, count) over complete rows.

    Fails on missing answers: a mean over what is left would need other cells.
    """
    chosen: dict[tuple[str, int], set[str]] = {}
    bound = 64 * 16 * spec.n_items
    rows = selected.select("method", "k", "item").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError("selection table is larger than any sweep over this scale can be")
    for r in rows:
        chosen.setdefault((r["method"], r["k"]), set()).add(r["item"])
    cells = [(m, k, d) for m, k in sorted(chosen) for d in spec.domains]
    picks = np.array([
        [1 if i in chosen[m, k] and spec.domain_of[i] == d else 0 for m, k, d in cells] for i in spec.items
    ], dtype=np.int64)
    home = np.array([[1 if spec.domain_of[i] == d else 0 for d in spec.domains] for i in spec.items], dtype=np.int64)
    base = spec.hi * spec.items_per_domain + 1
    items, n_domains = list(spec.items), len(spec.domains)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(cells), base * base), dtype=np.int64)
        for pdf in batches:
            if pdf.isna().to_numpy().any():
                raise ValueError("score_cells needs complete answers")
            x = pdf[items].to_numpy(dtype=np.float64)
            true = (x @ home).astype(np.int64)
            picked = (x @ picks).astype(np.int64)
            for c in range(len(cells)):
                code = true[:, c % n_domains] * base + picked[:, c]
                total[c] += np.bincount(code, minlength=base * base)
        where, code = np.nonzero(total)
        if len(where):
            yield pd.DataFrame({
                "cell": where, "true_sum": code // base, "picked_sum": code % base, "count": total[where, code],
            })

    counted = df.select(*items).mapInPandas(count, "cell int, true_sum int, picked_sum int, count bigint")
    summed = counted.groupBy("cell", "true_sum", "picked_sum").agg(F.sum("count").alias("count"))
    names = F.array(*[
        F.struct(F.lit(m).alias("method"), F.lit(k).alias("k"), F.lit(d).alias("domain"), F.lit(int(picks[:, c].sum())).alias("n_selected"))
        for c, (m, k, d) in enumerate(cells)
    ])
    return summed.select(F.get(names, F.col("cell")).alias("s"), "true_sum", "picked_sum", "count").select(
        "s.*", "true_sum", "picked_sum", "count"
    )


def cell_percentiles(cells: DataFrame, spec: ScaleSpec, norms: Norms, picked_norms: Norms | None = None) -> DataFrame:
    """Cells with true and predicted percentile; a domain without items predicts 50."""
    raw = cells.withColumns({
        "raw_true": F.col("true_sum") / F.lit(float(spec.items_per_domain)),
        "raw_pred": F.try_divide(F.col("picked_sum").cast("double"), F.col("n_selected")),
    })
    out = long_percentiles(raw, {"true": "raw_true"}, norms)
    out = long_percentiles(out, {"pred": "raw_pred"}, picked_norms or norms)
    return out.withColumn("pred", F.coalesce("pred", F.lit(50.0)))


def cell_metrics(cells: DataFrame, keys: list[str], overall: bool = True) -> DataFrame:
    """r, MAE, RMSE and within-5/10 per (keys..., domain) and over all domains.

    A constant prediction has no r.
    """
    w, t, p = F.col("count"), F.col("true"), F.col("pred")
    e = t - p
    # centred on 50 so that the sums stay small next to the variance
    x, y = t - 50.0, p - 50.0
    sums = {
        "n": F.sum(w), "sx": F.sum(w * x), "sy": F.sum(w * y), "sxx": F.sum(w * x * x), "syy": F.sum(w * y * y),
        "sxy": F.sum(w * x * y), "se": F.sum(w * F.abs(e)), "see": F.sum(w * e * e),
        "w5": F.sum(F.when(F.abs(e) <= 5, w).otherwise(0)), "w10": F.sum(F.when(F.abs(e) <= 10, w).otherwise(0)),
        "flat": (F.min(p) == F.max(p)) | (F.min(t) == F.max(t)),
    }
    cols = [F.col(k) for k in keys]
    grouped = (
        cells.groupingSets([[*cols, F.col("domain")], cols], *cols, F.col("domain")) if overall else cells.groupBy(*cols, F.col("domain"))
    ).agg(*[c.alias(k) for k, c in sums.items()])
    n = F.col("n")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    var = (n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy"))
    return grouped.select(
        *keys, F.coalesce("domain", F.lit("overall")).alias("domain"), "n",
        F.when(~F.col("flat"), cov / F.sqrt(F.greatest(var, F.lit(0.0)))).alias("pearson_r"),
        (F.col("se") / n).alias("mae"), F.sqrt(F.col("see") / n).alias("rmse"),
        (F.col("w5") / n).alias("within_5_pct"), (F.col("w10") / n).alias("within_10_pct"),
    )


def average_over_seeds(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Metrics of the seeded random selections averaged into one method."""
    drawn = metrics.filter(F.col("method").startswith("random_"))
    return drawn.groupBy("k", "domain").agg(*[F.avg(c).alias(c) for c in names]).withColumn("method", F.lit("random"))
