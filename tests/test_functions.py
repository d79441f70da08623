from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scalemetrics.functions import draws, stats
from scalemetrics.functions.normal import normal_cdf, with_normal_cdf
from scalemetrics.functions.stats import pearson_p_value
from scalemetrics.operators import scoring
from scalemetrics.spec import FIVE_DOMAIN as SPEC


def test_normal_cdf_matches_erfc(spark):
    z = spark.range(-9000, 9001, 7).select((F.col("id") / 1000).alias("z"))
    for r in with_normal_cdf(z.withColumn("p", normal_cdf(F.col("z"))), {"q": "z"}).collect():
        exact = 0.5 * math.erfc(-r["z"] / math.sqrt(2))
        assert abs(r["p"] - exact) < 1e-14 and abs(r["q"] - exact) < 1e-14


def test_percentile_anchors_monotone_and_missing(spark):
    norms = {d: (3.0, 0.5) for d in SPEC.domains}
    raw = spark.createDataFrame([("ext", 3.0), ("ext", 3.5), ("ext", None), ("ext", 9.0), ("ext", -9.0)], "domain string, raw double")
    out = [r["p"] for r in scoring.long_percentiles(raw, {"p": "raw"}, norms).collect()]
    assert out[0] == pytest.approx(50) and out[1] == pytest.approx(84.1345, abs=1e-3)
    assert out[2] is None and 99.9 < out[3] <= 100 and 0 <= out[4] < 0.1


def test_unknown_domain_is_an_error(spark):
    with pytest.raises(ValueError):
        scoring.score_percentiles(spark.range(1), {"ext": (3.0, 1.0)}, SPEC)
    raw = spark.createDataFrame([("zzz", 3.0)], "domain string, raw double")
    with pytest.raises(Exception, match="unknown domain"):
        scoring.long_percentiles(raw, {"p": "raw"}, {"ext": (3.0, 1.0)}).collect()


def test_correlation_policies(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, None, 5.0), (4.0, 7.7, 5.0)], "x double, y double, c double")
    r, constant, floor = df.agg(
        stats.safe_corr(F.col("x"), F.col("y")), stats.safe_corr(F.col("x"), F.col("c")), stats.safe_corr(F.col("x"), F.col("c"), -1)
    ).first()
    assert r == pytest.approx(np.corrcoef([1, 2, 4], [2, 4.1, 7.7])[0, 1]) and constant is None and floor == -1
    with pytest.raises(Exception, match="constant"):
        df.agg(stats.strict_corr(F.col("x"), F.col("c"), "here")).collect()


def test_draws_are_uniform_and_do_not_depend_on_partitioning(spark):
    ids = spark.range(20000)
    u = lambda df: df.select("id", draws.uniform(1, "s", F.col("id"), 5).alias("u"))
    a = u(ids).toPandas().sort_values("id")["u"].to_numpy()
    b = u(ids.repartition(7)).toPandas().sort_values("id")["u"].to_numpy()
    assert (a == b).all() and 0 < a.min() and a.max() < 1
    assert abs(a.mean() - 0.5) < 0.01 and abs(a.std() - math.sqrt(1 / 12)) < 0.01


def test_draw_array_agrees_with_single_draws(spark):
    row = spark.range(3).select(
        draws.draw_array(7, "s", F.col("id"), 10).alias("a"), F.array(*[draws.uniform(7, "s", F.col("id"), n) for n in range(10)]).alias("b")
    ).collect()
    assert all(r["a"] == r["b"] for r in row)


def test_pinball_and_spearman_brown(spark):
    df = spark.createDataFrame([(3.0, 2.0), (1.0, 2.0)], "y double, p double")
    assert df.agg(F.avg(stats.pinball(F.col("y"), F.col("p"), 0.9))).first()[0] == pytest.approx((0.9 + 0.1) / 2)
    k4 = spark.range(1).select(stats.spearman_brown(4, F.lit(0.3))).first()[0]
    assert k4 == pytest.approx(4 * 0.3 / 1.9)


def test_ks_p_value(spark):
    # reference point of the Kolmogorov distribution: P(K > 1.36) is about 0.049
    p = spark.range(1).select(stats.ks_p_value(F.lit(1.36 / math.sqrt(500.0)), F.lit(1000.0), F.lit(1000.0))).first()[0]
    assert p == pytest.approx(0.0495, abs=5e-4)


def test_intervals_order_and_calibrate(spark):
    df = spark.createDataFrame([(60.0, 40.0, 50.0), (10.0, 20.0, 95.0)], "lower double, pred double, upper double")
    out = scoring.order_quantiles(df).collect()
    assert [tuple(r) for r in out] == [(40.0, 50.0, 60.0), (10.0, 20.0, 95.0)]
    wide = scoring.calibrate(scoring.order_quantiles(df), F.lit(2.0)).collect()
    assert tuple(wide[0]) == (30.0, 50.0, 70.0) and tuple(wide[1]) == (0.0, 20.0, 100.0)


def test_exact_quantiles_match_numpy_on_skewed_data(spark):
    from scalemetrics.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.lognormal(0, 2, 3000), np.full(1500, 1.25)])  # a third of the rows share one value
    pdf = pd.DataFrame({"k": "a", "x": x})
    out = {r["prob"]: r["value"] for r in exact_quantiles(spark.createDataFrame(pdf), ["k"], "x", [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    for p, v in out.items():
        assert v == pytest.approx(np.quantile(x, p))
    assert len(out) == 5


def test_exact_quantiles_of_a_large_group_use_the_bracket(spark):
    from scalemetrics.operators import quantiles

    x = np.concatenate([np.random.default_rng(6).lognormal(0, 3, 80_000), np.full(40_000, 2.5)])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    out = {r["prob"]: r["value"] for r in quantiles.exact_quantiles(df, [], "x", [0.05, 0.5, 0.77, 0.999]).collect()}
    assert {p: pytest.approx(np.quantile(x, p)) for p in out} == out and len(out) == 4


@pytest.mark.parametrize("n, r", [(3, 0.5), (4, -0.9), (5, 0.1), (5, 0.95), (30, 0.3), (30, -0.02), (31, 0.7), (1000, 0.05), (1000, 0.0007), (100_000, 0.01)])
def test_p_of_a_correlation_equals_the_integral_of_the_t_density(spark, n, r):
    df = n - 2
    t = abs(r) * math.sqrt(df / (1 - r * r))
    constant = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    x = np.linspace(0, t, 200_001)
    y = constant * (1 + x * x / df) ** (-(df + 1) / 2)
    central = 2 * (x[1] - x[0]) * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) / 3
    got = spark.range(1).select(pearson_p_value(F.lit(r), F.lit(n)).alias("p")).first()["p"]
    assert got == pytest.approx(1 - central, abs=1e-8)


def test_p_of_a_correlation_has_literal_values_and_edges(spark):
    # fixed values: t tables (two-sided 0.05 at 3 and 28 degrees of freedom, 0.01 at 998)
    for n, t, p in ((5, 3.182446, 0.05), (30, 2.048407, 0.05), (1000, 2.580765, 0.01)):
        r = t / math.sqrt(n - 2 + t * t)
        assert spark.range(1).select(pearson_p_value(F.lit(r), F.lit(n)).alias("p")).first()["p"] == pytest.approx(p, abs=1e-6)
    edges = spark.createDataFrame([(1.0, 9), (-1.0, 9), (0.0, 9), (0.5, 2), (None, 9), (0.9, 2_000_000_000)], "r double, n long")
    assert [x.p for x in edges.select(pearson_p_value(F.col("r"), F.col("n")).alias("p")).collect()] == [0.0, 0.0, 1.0, None, None, 0.0]


def test_words_of_batches_are_the_md5_of_columns():
    keys = np.array([0, 7, 10, 99, -5, 123456, 2**62, 10**6 + 1, -(2**63)])
    found = np.empty((4, len(keys)), np.uint32)
    for rows, digits in draws.decimals(keys):
        found[:, rows] = draws.md5_words(b"log|order|", digits, b"|12")
    expected = [hashlib.md5(f"log|order|{k}|12".encode()).digest() for k in keys.tolist()]
    assert [found[:, n].astype(">u4").tobytes() for n in range(len(keys))] == expected
    assert list(draws.decimals(np.empty(0, np.int64))) == []
