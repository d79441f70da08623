"""Scores of candidate settings from their per-domain correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalemetrics.functions.draws import uniform


def candidate_scores(metrics: DataFrame) -> DataFrame:
    """``metrics``: (candidate, regime sparse|full, domain, pearson_r); an absent r counts as -1.

    With sparse results: 0.8 mean sparse + 0.2 mean full - 2 max(0, 0.85 - min sparse)
    - max(0, 0.95 - mean full); otherwise mean full - 1.5 max(0, 0.90 - min full).
    """
    r = F.coalesce(F.col("pearson_r"), F.lit(-1.0))
    of = lambda regime: F.when(F.col("regime") == regime, r)
    s = metrics.groupBy("candidate").agg(
        F.avg(of("sparse")).alias("mean_sparse"), F.min(of("sparse")).alias("min_sparse"),
        F.avg(of("full")).alias("mean_full"), F.min(of("full")).alias("min_full"),
    )
    mean_full = F.coalesce("mean_full", "mean_sparse")
    short = lambda limit, c: F.greatest(F.lit(0.0), F.lit(limit) - c)
    sparse = 0.8 * F.col("mean_sparse") + 0.2 * mean_full - 2.0 * short(0.85, F.col("min_sparse")) - short(0.95, mean_full)
    full_only = F.col("mean_full") - 1.5 * short(0.90, F.col("min_full"))
    return s.select(
        "candidate", F.coalesce(sparse, full_only).alias("score"), full_only.alias("full_only_score"),
        F.col("mean_sparse").isNotNull().alias("has_sparse"), F.col("mean_full").isNotNull().alias("has_full"),
    )


def random_candidates(candidates: DataFrame, key: str, box: dict[str, tuple[float, float]], seed: int) -> DataFrame:
    """Give each candidate row a uniform setting from the search box."""
    draw = lambda n, lo, hi: F.lit(lo) + uniform(seed, "setting", F.col(key), n) * F.lit(hi - lo)
    return candidates.withColumns({name: draw(n, lo, hi) for n, (name, (lo, hi)) in enumerate(box.items())})
