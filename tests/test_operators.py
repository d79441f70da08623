from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scalemetrics.operators import (
    bootstrap, cleaning, compare, evaluate, integrity, items, masks, norms, requests, selection, sessions, strata, sweep,
)
from scalemetrics.operators.masks import MaskPlan
from scalemetrics.operators.sessions import PoolItem, Rules
from scalemetrics.functions.draws import row_hash
from scalemetrics.plans.ingest import digits
from scalemetrics.plans.tables import derive_answers
from scalemetrics.spec import FIVE_DOMAIN as SPEC
from scalemetrics.spec import ScaleSpec

RANKS = {i: n for n, i in enumerate(SPEC.items, start=1)}


def wide(spark, n=400, missing=0.0, seed=1):
    rng = np.random.default_rng(seed)
    trait = {d: rng.normal(size=n) for d in SPEC.domains}
    pdf = pd.DataFrame({"respondent_id": np.arange(n)})
    for i in SPEC.items:
        v = np.clip(np.round(3 + trait[SPEC.domain_of[i]] + rng.normal(size=n)), 1, 5)
        v[rng.random(n) < missing] = np.nan
        pdf[i] = v
    df = spark.createDataFrame(pdf)
    df = df.withColumns({i: F.when(F.isnan(i), None).otherwise(F.col(i)).cast("int") for i in SPEC.items})
    from scalemetrics.operators.scoring import domain_scores

    return domain_scores(df, SPEC), pdf


def test_funnel_and_filters(spark):
    base = {i: 3 for i in SPEC.items}
    rows = [
        {**base, "respondent_id": 1, "origin": 1, "origin_count": 1}, {**base, "ext1": 0, "respondent_id": 2, "origin": 2, "origin_count": 1},
        {**base, "respondent_id": 3, "origin": 3, "origin_count": 2},
    ]
    df = spark.createDataFrame(pd.DataFrame(rows))
    f = cleaning.funnel(df, SPEC).first()
    assert (f["raw_rows"], f["valid_items"], f["kept"], f["dropped_invalid"], f["dropped_origin"]) == (3, 2, 1, 1, 1)
    assert [r["respondent_id"] for r in cleaning.unique_origin(cleaning.valid_answers(df, SPEC)).collect()] == [1]


def test_missing_item_is_invalid_and_missing_columns_fail(spark):
    df = spark.createDataFrame(pd.DataFrame([{i: 3 for i in SPEC.items}])).withColumn("opn9", F.lit(None).cast("int"))
    assert cleaning.valid_answers(df, SPEC).count() == 0
    with pytest.raises(ValueError, match="opn10"):
        cleaning.require_columns(df.drop("opn10"), SPEC.items)


def test_reverse_keying_is_an_involution(spark):
    df, pdf = wide(spark, 50, missing=0.2)
    twice = cleaning.reverse_key(cleaning.reverse_key(df, SPEC), SPEC)
    assert twice.select(*SPEC.items).collect() == df.select(*SPEC.items).collect()


def test_single_origin_rows_with_a_hot_origin(spark):
    df = spark.range(300).select(F.col("id").alias("respondent_id"), F.when(F.col("id") < 100, -1).otherwise(F.col("id")).alias("origin"))
    out = cleaning.single_origin_rows(df)
    assert out.count() == 200 and out.filter("origin = -1").count() == 0


def test_norms_exact_and_fail_closed(spark):
    pdf = pd.DataFrame({f"{d}_score": [1.0, 2.0, 3.0, 4.0] for d in SPEC.domains} | {i: [1, 2, 3, 4] for i in SPEC.items})
    table = norms.fit_norms(spark.createDataFrame(pdf), SPEC)
    full = norms.norm_values(table, SPEC)
    assert full["ext"] == (2.5, pytest.approx(np.std([1, 2, 3, 4], ddof=1)))
    with pytest.raises(ValueError):
        norms.norm_values(table.withColumn("sd", F.lit(0.0)), SPEC)
    with pytest.raises(ValueError):
        norms.norm_values(table.filter("domain <> 'agr'"), SPEC)
    moved = table.withColumn("mean", F.col("mean") + F.when(F.col("domain") == "csn", 1e-6).otherwise(0.0))
    assert norms.norm_drift(table, table).first()["passed"] and not norms.norm_drift(moved, table).first()["passed"]
    assert not norms.norm_drift(table.filter("domain <> 'agr'"), table).first()["passed"]


def test_split_keeps_proportions_with_a_hot_stratum(spark):
    stratum = F.when(F.col("id") < 4000, 7).otherwise(F.col("id") % 6).cast("short")
    df = spark.range(10000).select(F.col("id").alias("respondent_id"), stratum.alias("s"))
    out = strata.stratified_split(df, "s", "respondent_id").toPandas()
    assert out["respondent_id"].nunique() == 10000 and (out["split"] == "test").sum() == 1500 and (out["split"] == "val").sum() == 1500
    shares = pd.crosstab(out["s"], out["split"], normalize="index")
    assert (abs(shares["test"] - 0.15) < 0.002).all() and (abs(shares["val"] - 0.15) < 0.002).all()
    again = strata.stratified_split(df.repartition(5), "s", "respondent_id").toPandas()
    assert out.sort_values("respondent_id")["split"].tolist() == again.sort_values("respondent_id")["split"].tolist()


def test_folds_and_their_preconditions(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 4).cast("short").alias("s"))
    out = strata.assign_folds(df, "k", 5, 1, "s").groupBy("s", "fold").count().toPandas()
    assert (out["count"] == 50).all() and len(out) == 20
    with pytest.raises(ValueError):
        strata.assign_folds(df.filter("s = 0"), "k", 5, 1, "s")
    with pytest.raises(ValueError):
        strata.assign_folds(df.filter("s > 0 OR k < 8"), "k", 5, 1, "s")


def test_rare_strata_go_to_the_nearest(spark):
    rows = [(1,)] * 5 + [(2,)] * 2 + [(3,)] * 5 + [(9,)]
    df = spark.createDataFrame(rows, "s short")
    out = {(r["s"], r["m"]) for r in strata.merge_rare(df, "s", "m").collect()}
    assert out == {(1, 1), (2, 1), (3, 3), (9, 3)}
    lonely = spark.createDataFrame([(4,), (6,)], "s short")
    assert {r["m"] for r in strata.merge_rare(lonely, "s", "m").collect()} == {0}


def test_item_statistics_with_missing_answers(spark):
    df, _ = wide(spark, 600, missing=0.15, seed=3)
    pdf = df.toPandas()
    sums = items.item_sums(df.repartition(5), SPEC)
    got = {(r["item"], r["domain"]): r["r"] for r in items.item_domain_correlations(sums).collect()}
    assert len(got) == 250
    rest = pdf[[c for c in SPEC.domain_items("agr") if c != "agr3"]].mean(axis=1)
    assert got["agr3", "agr"] == pytest.approx(pdf["agr3"].corr(rest))
    assert got["agr3", "opn"] == pytest.approx(pdf["agr3"].corr(pdf["opn_score"]))
    r_bar = {r["domain"]: r["r_bar"] for r in items.inter_item_r(sums).collect()}
    c = pdf[list(SPEC.domain_items("est"))].corr().to_numpy()
    assert r_bar["est"] == pytest.approx(c[np.triu_indices(10, 1)].mean())
    dist = {r["item"]: r for r in items.response_distributions(df, SPEC).collect()}
    x = pdf["csn4"].dropna()
    z = (x - x.mean()) / x.std(ddof=0)
    assert dist["csn4"]["skew"] == pytest.approx((z**3).mean()) and dist["csn4"]["kurtosis"] == pytest.approx((z**4).mean() - 3)
    assert dist["csn4"]["std"] == pytest.approx(x.std())


def test_too_few_answers_give_no_statistics(spark):
    df, _ = wide(spark, 60)
    assert items.item_domain_correlations(items.item_sums(df, SPEC)).count() == 0
    assert items.response_distributions(df, SPEC).count() == 0


def kept(spark, plan, n=4000, seed=42, parts=4):
    rows = spark.range(n).withColumnRenamed("id", "respondent_id").repartition(parts)
    out = masks.with_mask(rows, SPEC, RANKS, plan, seed=seed).toPandas()
    out["kept"] = out["kept"].map(lambda words: [n for n in range(1, 51) if words[0] >> (n - 1) & 1])
    return out


def per_domain(numbers):
    return np.bincount([(n - 1) // 10 for n in numbers], minlength=5)


def test_weighted_mask_prefers_better_ranks(spark):
    out = kept(spark, MaskPlan(balanced=False))
    sizes = out["kept"].map(len)
    assert sizes.min() == 8 and sizes.max() == 40
    freq = np.bincount(np.concatenate(out["kept"].tolist()), minlength=51)[1:]
    rank = pd.Series(np.arange(50)).corr(pd.Series(freq).rank(), method="pearson")
    assert rank < -0.9


def test_balanced_mask_covers_domains_and_repeats(spark):
    out = kept(spark, MaskPlan())
    assert out["kept"].map(lambda k: per_domain(k).min()).min() >= 4
    assert set(out["kept"].map(len)) == set(range(20, 41))
    again = kept(spark, MaskPlan(), parts=7).sort_values("respondent_id")["kept"].map(tuple).tolist()
    assert out.sort_values("respondent_id")["kept"].map(tuple).tolist() == again
    other = kept(spark, MaskPlan(), seed=43).sort_values("respondent_id")["kept"].map(tuple).tolist()
    assert again != other


def test_bucket_shares(spark):
    out = kept(spark, MaskPlan(focused=True, with_imbalanced=True), 8000)
    short = sorted(SPEC.item_no[i] for i in SPEC.short_items)
    is_short = out["kept"].map(lambda k: list(k) == short)
    size = out["kept"].map(len)
    assert abs(is_short.mean() - 0.10) < 0.02
    assert abs((size >= 36).mean() - 0.15) < 0.02
    assert abs(out["kept"].map(lambda k: per_domain(k).min() == 0).mean() - 0.10) < 0.06


def test_imbalanced_mask_allows_empty_domains(spark):
    out = kept(spark, MaskPlan(only_imbalanced=True))
    assert out["kept"].map(lambda k: per_domain(k).min() == 0).mean() > 0.5
    assert out["kept"].map(len).max() <= 25


def test_mask_keeps_values_and_targets(spark):
    df, pdf = wide(spark, 200)
    out = masks.apply_mask(masks.multi_pass(df, SPEC, RANKS, MaskPlan(), 3), SPEC).toPandas()
    assert len(out) == 600 and out.groupby("respondent_id").size().eq(3).all()
    base = pdf.set_index("respondent_id")
    for i in ("ext1", "opn10"):
        seen = out[out[i].notna()]
        assert (seen[i].to_numpy() == base.loc[seen["respondent_id"], i].to_numpy()).all()
    assert (out.groupby("respondent_id")["ext_score"].nunique() == 1).all()


def test_hold_out_never_shares_respondents(spark):
    df = spark.range(1000).select(F.col("id").alias("respondent_id"), (F.col("id") % 3).cast("short").alias("split_stratum"))
    out = masks.hold_out_then_mask(df, SPEC, RANKS, MaskPlan(), passes=3).toPandas()
    held = set(out[out["held_out"]]["respondent_id"])
    assert len(held) == 150 and not held & set(out[~out["held_out"]]["respondent_id"])
    assert len(out) == 150 + 3 * 850


def predictions(spark, n=3000, noise=8.0, seed=2, method="a"):
    rng = np.random.default_rng(seed)
    frames = []
    for d in SPEC.domains:
        t = np.clip(rng.normal(50, 20, n), 0, 100)
        p = np.clip(t + rng.normal(0, noise, n), 0, 100)
        frames.append(pd.DataFrame({
            "respondent_id": np.arange(n), "method": method, "domain": d, "true": t, "pred": p, "lower": p - 12, "upper": p + 12,
            "raw_true": t / 25 + 1, "raw_pred": p / 25 + 1, "split_stratum": np.arange(n) % 3,
        }))
    return pd.concat(frames)


def test_accuracy_against_numpy(spark):
    pdf = predictions(spark)
    out = {r["domain"]: r for r in evaluate.accuracy(spark.createDataFrame(pdf)).collect()}
    e = pdf["true"] - pdf["pred"]
    assert out["overall"]["n"] == len(pdf) and out["overall"]["mae"] == pytest.approx(e.abs().mean())
    ext = pdf[pdf["domain"] == "ext"]
    assert out["ext"]["pearson_r"] == pytest.approx(np.corrcoef(ext["true"], ext["pred"])[0, 1])
    assert out["ext"]["coverage_90"] == pytest.approx(((ext["true"] >= ext["lower"]) & (ext["true"] <= ext["upper"])).mean())
    med = {r["domain"]: r["median_error"] for r in evaluate.median_error(spark.createDataFrame(pdf)).collect()}
    assert med["ext"] == pytest.approx(np.median(ext["true"] - ext["pred"]))


def test_calibration_factors(spark):
    rows = [("ext", 0.4), ("agr", 0.8), ("csn", 0.9), ("est", 0.99), ("opn", None), ("overall", 0.5)]
    df = spark.createDataFrame(rows, "domain string, coverage_90 double")
    out = {r["domain"]: r["scale_factor"] for r in evaluate.calibration_from_metrics(df, "full").collect()}
    assert out == {"ext": pytest.approx(1.8), "agr": pytest.approx(1.125), "csn": 1.0, "est": pytest.approx(0.90 / 0.99)}


def test_average_runs_needs_every_run(spark):
    nan = float("nan")
    rows = [(0, "ext", "r", 0.5), (1, "ext", "r", 0.7), (0, "agr", "r", 0.5), (0, "opn", "r", 0.5), (1, "opn", "r", nan)]
    out = {r["domain"]: r["value"] for r in evaluate.average_runs(spark.createDataFrame(rows, "run int, domain string, metric string, value double")).collect()}
    assert out["ext"] == pytest.approx(0.6) and math.isnan(out["agr"]) and math.isnan(out["opn"])


def test_gates_use_domain_then_default(spark):
    m = spark.createDataFrame([("full", "ext", "r", 0.8), ("full", "opn", "r", 0.8), ("full", "agr", "r", None)], "regime string, domain string, metric string, value double")
    t = spark.createDataFrame([("full", None, "r", 0.9), ("full", "opn", "r", 0.7)], "regime string, domain string, metric string, minimum double")
    assert {r["domain"] for r in evaluate.quality_gates(m, t).collect()} == {"ext", "agr"}


def test_output_check_flags_collapsed_models(spark):
    rows = [("flat", 3.0)] * 5 + [("wild", float(v)) for v in range(0, 7)] + [("fine", v) for v in (1.0, 2.0, 3.0, 4.0)]
    out = {r["model"]: r for r in evaluate.output_check(spark.createDataFrame(rows, "model string, value double")).collect()}
    assert "low variance" in out["flat"]["issues"] and out["wild"]["issues"] == ["out of range"] and out["fine"]["passed"]


def test_bootstrap_interval_agrees_with_standard_error(spark):
    pdf = predictions(spark, 2000)
    df = spark.createDataFrame(pdf[pdf["domain"] == "ext"])
    sums = bootstrap.replicate_sums(df, ["method", "domain"], 400, 7)
    ci = {r["metric"]: r for r in bootstrap.intervals(bootstrap.replicate_metrics(sums, ["method"], overall=False), ["domain"]).collect()}
    e = (pdf[pdf["domain"] == "ext"]["true"] - pdf[pdf["domain"] == "ext"]["pred"]).abs()
    half = 1.96 * e.std() / math.sqrt(len(e))
    assert (ci["mae"]["ci_hi"] - ci["mae"]["ci_lo"]) / 2 == pytest.approx(half, rel=0.2)
    assert ci["mae"]["ci_lo"] < e.mean() < ci["mae"]["ci_hi"]


def test_weights_by_cells_are_those_of_the_thresholds():
    """Also next to the thresholds, which lie inside cells."""
    from scalemetrics.functions.draws import expand
    from scalemetrics.functions.stats import poisson_thresholds

    hashes, replicates = np.random.default_rng(1).integers(0, 1 << 60, 5000), np.arange(1, 41)
    drawn = expand(hashes[None, :], replicates[:, None])
    plain = np.searchsorted(np.array(poisson_thresholds()), drawn, side="right")
    assert (bootstrap.replicate_weights(hashes, replicates) == plain).all()
    cells, least = bootstrap.count_cells()
    assert 0 < (cells < 0).sum() <= len(least)
    for k, t in enumerate(poisson_thresholds()):
        below, at = (np.searchsorted(least, np.uint64(v), side="right") for v in (least[k] - np.uint64(1), least[k]))
        assert (below, at) == (k, k + 1) and (float(least[k]) / 2**53 >= t) and (float(least[k] - np.uint64(1)) / 2**53 < t)


def test_groups_of_one_product_add_up_repeated_rows():
    sums, owner = np.arange(18.0).reshape(6, 3), np.array([0, 1, 1, 0, 2, 2])
    groups = [np.array([0, 1, 2]), np.array([3, 4, 5])]
    got = bootstrap.sums_per_owner(sums, owner, groups, 4)
    assert got[:, 0].tolist() == [sums[0].tolist(), (sums[1] + sums[2]).tolist(), [0] * 3, [0] * 3]
    assert got[:, 1].tolist() == [sums[3].tolist(), [0] * 3, (sums[4] + sums[5]).tolist(), [0] * 3]


def test_sums_of_dense_and_scattered_groups_agree(spark):
    """Rows of a respondent come in all groups, in some or twice; weights times rows one by one."""
    pdf = predictions(spark, 60)
    few = pdf[(pdf["respondent_id"] % 9 == 0) | (pdf["domain"] == "ext")]
    for rows in (pd.concat([pdf, pdf[pdf["respondent_id"] < 7]]), few):
        got = bootstrap.replicate_sums(spark.createDataFrame(rows), ["method", "domain"], 3, 5).toPandas()
        hashes = spark.createDataFrame(rows).select(bootstrap.row_hash(5, F.col("respondent_id")).alias("h")).toPandas()["h"].to_numpy()
        weights = bootstrap.replicate_weights(hashes, np.arange(1, 4))
        for r in got.itertuples():
            inside = ((rows["method"] == r.method) & (rows["domain"] == r.domain)).to_numpy()
            w, e = weights[r.rep - 1, inside], (rows["true"] - rows["pred"]).abs().to_numpy()[inside]
            assert r.w == w.sum() and r.se == pytest.approx((w * e).sum())


def test_bootstrap_is_paired_and_repeatable(spark):
    pdf = predictions(spark, 500)
    twin = pd.concat([pdf, pdf.assign(method="b")])
    reps = lambda df: bootstrap.replicate_metrics(bootstrap.replicate_sums(df, ["method", "domain"], 30, 3), ["method"])
    delta = bootstrap.metric_deltas(reps(spark.createDataFrame(twin)), "a", "b", ["domain"]).toPandas()
    assert (delta[list(bootstrap.METRICS)].abs().to_numpy() < 1e-12).all()
    one = reps(spark.createDataFrame(pdf)).toPandas().sort_values(["rep", "domain"])["mae"].to_numpy()
    two = reps(spark.createDataFrame(pdf).repartition(6)).toPandas().sort_values(["rep", "domain"])["mae"].to_numpy()
    assert np.allclose(one, two)


def test_stratified_bootstrap_keeps_stratum_sizes(spark):
    pdf = predictions(spark, 900)
    df = spark.createDataFrame(pdf)
    sums = bootstrap.replicate_sums(df, ["domain", "split_stratum"], 20, 3)
    sizes = df.groupBy("domain", F.col("split_stratum").cast("string").alias("split_stratum")).agg(F.count(F.lit(1)).alias("n"))
    out = bootstrap.rescale_strata(sums, sizes, ["domain"], "split_stratum").toPandas()
    assert np.allclose(out["w"], 900)


def test_undefined_replicates_are_dropped(spark):
    pdf = predictions(spark, 50).assign(pred=50.0)
    ci = bootstrap.intervals(bootstrap.replicate_metrics(bootstrap.replicate_sums(spark.createDataFrame(pdf), ["method", "domain"], 10, 1), ["method"]), ["domain"])
    r = ci.filter("metric = 'pearson_r' AND domain = 'ext'").first()
    assert r["n_reps"] == 0 and r["ci_lo"] is None


def test_sweep_cells_reject_missing_answers(spark):
    df, _ = wide(spark, 100, missing=0.1)
    chosen = spark.createDataFrame([("m", 1, "ext1")], "method string, k int, item string")
    with pytest.raises(Exception, match="complete answers"):
        sweep.score_cells(df, chosen, SPEC).collect()


def test_request_validation(spark):
    rows = [(1, {"ext1": 3.0}), (2, {"ext1": 6.0, "nope": 1.0}), (3, {"ext2": float("nan")}), (4, {})]
    df = spark.createDataFrame(rows, "respondent_id long, answers map<string,double>")
    out = {r["respondent_id"]: r for r in requests.validate(df, SPEC).collect()}
    assert out[1]["valid"] and out[4]["valid"] and not out[2]["valid"] and out[2]["unknown_items"] == ["nope"]
    assert "ext1" in out[2]["bad_values"] and out[3]["bad_values"] == ["ext2"]


def pool(n_per_domain=10):
    rng = np.random.default_rng(0)
    return [
        PoolItem(i, SPEC.domain_of[i], SPEC.domain_no[SPEC.domain_of[i]], float(rng.uniform(0.3, 0.8)), r, {d: float(rng.uniform(0, 0.6)) for d in SPEC.domains})
        for i, r in RANKS.items()
    ]


def state(spark, answered):
    log = spark.createDataFrame([(1, n, i, 3) for n, i in enumerate(answered, start=1)], "session long, pos int, item string, value int")
    df = sessions.session_state(log, SPEC)
    return df.withColumns({f"width_{d}": F.lit(4.0) for d in SPEC.domains})


def test_next_item_follows_coverage_then_strength(spark):
    p = pool()
    best = {d: max((x for x in p if x.domain == d), key=lambda x: x.own_r).item for d in SPEC.domains}
    start = [best["ext"]]
    assert sessions.next_ranked(state(spark, start), p, SPEC).first()["item"] == best["agr"]
    full = list(SPEC.domain_items("agr")) + [i for d in ("ext", "csn", "est", "opn") for i in SPEC.domain_items(d)]
    assert sessions.next_ranked(state(spark, full), p, SPEC).first() is None
    # an exhausted domain is passed over
    most = [i for i in full if SPEC.domain_of[i] != "opn"]
    assert sessions.next_ranked(state(spark, most), p, SPEC).first()["item"] == best["opn"]


def test_weighted_next_item_against_plain_python(spark):
    p, answered = pool(), ["ext1", "ext2", "agr4", "opn5", "opn6", "opn7"]
    r_bars, sds, rules = {d: 0.3 for d in SPEC.domains}, {d: 0.7 for d in SPEC.domains}, Rules()
    n = {d: sum(SPEC.domain_of[i] == d for i in answered) for d in SPEC.domains}

    def sem(k, d):
        return math.inf if k <= 0 else sds[d] * math.sqrt(1 - k * r_bars[d] / (1 + (k - 1) * r_bars[d]))

    def score(x, by_sem):
        d = x.domain
        info = min(sem(n[d], d) - sem(n[d] + 1, d), 1.0) / 0.3 if by_sem else sum(16 / 4 * r * r for r in x.correlations.values()) / 2
        return 0.5 * info * 0.75 ** n[d] + 0.3 * max(0, 4 - n[d]) / 6 + 0.2 * 4.0 / 4

    free = [x for x in p if x.item not in answered]
    for rule in (rules, Rules(use_sem=False)):
        want = max(free, key=lambda x: (score(x, rule.use_sem), -x.rank)).item
        assert sessions.next_weighted(state(spark, answered), p, SPEC, rule, r_bars, sds).first()["item"] == want


def test_stop_rules(spark):
    cols = {f"n_{d}": 4 for d in SPEC.domains} | {f"sem_{d}": 0.4 for d in SPEC.domains}
    at = lambda **kw: spark.createDataFrame(pd.DataFrame([{**cols, "n_items": 20, **kw}]))
    reason = lambda df, rules=Rules(): df.select(sessions.stop_reason(SPEC, rules).alias("r")).first()["r"]
    assert reason(at()) == "sem_threshold_met" and reason(at(n_items=7)) == "below_min_items"
    assert reason(at(n_items=50, n_ext=0)) == "max_items_reached" and reason(at(n_ext=3)) == "continuing"
    assert reason(at(n_ext=7)) == "continuing" and reason(at(sem_opn=0.5)) == "continuing"
    assert reason(at(sem_opn=9.0), Rules(use_sem=False)) == "domain_coverage_met"
    with pytest.raises(ValueError):
        sessions.sem(F.lit(3), 0.0, 0.7)


def test_calibration_only_for_the_fitted_settings():
    assert sessions.calibration_applies(Rules(), "ranked") and not sessions.calibration_applies(Rules(), "weighted")
    assert not sessions.calibration_applies(Rules(min_items=5), "ranked")
    assert not sessions.calibration_applies(Rules(use_sem=False, use_ci=True), "balanced")


def test_repeated_answers_keep_the_first(spark):
    log = spark.createDataFrame([(1, 1, "ext1", 2), (1, 2, "ext1", 5), (1, 3, "agr1", 4)], "session long, pos int, item string, value int")
    assert {(r["item"], r["value"]) for r in sessions.first_answers(log).collect()} == {("ext1", 2), ("agr1", 4)}


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 2)
    token = lambda t: integrity.fingerprint(t, ["id", "v"]).first()
    assert token(df) == token(df.orderBy(F.desc("id")).repartition(3))
    assert token(df) != token(df.withColumn("v", F.when(F.col("id") == 9, 0).otherwise(F.col("v"))))


def test_locks(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "2"), ("opt", None)], "artifact string, token string")
    current = spark.createDataFrame([("a", "1"), ("b", "3"), ("opt", "9"), ("c", "4")], "artifact string, token string")
    report = integrity.lock_report(stored, current, optional=("opt",))
    assert {tuple(r) for r in report.collect()} == {("a", "match"), ("b", "mismatch"), ("opt", "not_locked"), ("c", "new")}
    with pytest.raises(ValueError, match="b"):
        integrity.require_locked(report)
    integrity.require_locked(integrity.lock_report(stored, current, strict=False))


def test_file_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "x.json").write_text('{"a": 1}')
    assert integrity.file_hashes(spark, str(tmp_path)).first()["sha256"] == hashlib.sha256(b'{"a": 1}').hexdigest()


def test_parity_counts_lone_rows(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, v double")
    b = spark.createDataFrame([(1, 1.00005), (3, 2.0)], "id int, v double")
    out = compare.parity(a, b, ["id"], "v").first()
    assert (out["compared"], out["violations"], out["one_sided"], out["passed"]) == (1, 0, 2, False)


def test_selection_order_and_greedy_fallback(spark):
    rows = [(p.item, p.domain, int(p.item[3:]), SPEC.item_no[p.item], p.own_r, sum(p.correlations.values()), p.rank) for p in pool()]
    df = spark.createDataFrame(rows, "item string, home_domain string, item_number int, item_no int, own_r double, info double, rank int")
    placed = selection.placements(df, SPEC, range(42, 44))
    sel = selection.selections(placed, SPEC, (3, 5, 20)).toPandas()
    at = lambda m, k: set(sel[(sel["method"] == m) & (sel["k"] == k)]["item"])
    assert at("greedy_balanced", 3) == at("adaptive_topk", 3)
    assert {SPEC.domain_of[i] for i in at("greedy_balanced", 5)} == set(SPEC.domains)
    assert at("first_n", 5) == {f"{d}1" for d in SPEC.domains} and not at("domain_balanced", 3)
    assert at("short_form", 20) == set(SPEC.short_items) and at("random_42", 20) != at("random_43", 20)


def test_fingerprints_tell_separators_and_missing_fields_apart(spark):
    prints = []
    for row in (("x|y", "z"), ("x", "y|z"), (None, "z"), ("NULL", "z"), ("-", "z"), ("", "z")):
        prints.append(integrity.fingerprint(spark.createDataFrame([row], "a string, b string"), ["a", "b"]).first()["hash_sum"])
    assert len(set(prints)) == len(prints)


def test_exact_quantiles_ignore_nan(spark):
    from scalemetrics.operators.quantiles import exact_quantiles

    df = spark.createDataFrame([(float(n),) for n in range(1, 11)] + [(float("nan"),)] * 5 + [(None,)], "x double")
    assert exact_quantiles(df, [], "x", [0.5]).first()["value"] == 5.5


def test_weighted_masks_obey_the_plan(spark):
    sizes = kept(spark, MaskPlan(balanced=False, lo=10, hi=12))["kept"].map(len)
    assert set(sizes) == {10, 11, 12}


def test_calibration_without_a_factor_fails(spark):
    from scalemetrics.operators import predict

    rows = spark.createDataFrame([("ext", 1.0, 2.0, 3.0), ("agr", 1.0, 2.0, 3.0)], "domain string, lower double, pred double, upper double")
    factors = spark.createDataFrame([("r", "ext", 1.2)], "regime string, domain string, scale_factor double")
    with pytest.raises(Exception, match="no r calibration factor for domain agr"):
        predict.apply_calibration(rows, factors, "r").collect()
    assert predict.apply_calibration(rows.filter("domain = 'ext'"), factors, "r").count() == 1


def test_a_collapsed_model_stops_the_run(spark):
    from scalemetrics.operators import evaluate

    flat = spark.createDataFrame([("m", 3.0)] * 5, "model string, value double")
    with pytest.raises(ValueError, match="low variance"):
        evaluate.require_sound(evaluate.output_check(flat))


def test_all_changed_locks_are_counted(spark):
    report = spark.createDataFrame([(f"a{n:02}", "mismatch") for n in range(25)], "artifact string, status string")
    with pytest.raises(ValueError, match="25 locked artifacts"):
        integrity.require_locked(report)


def test_streams_give_the_same_rows_each_time(spark, sf):
    from scalemetrics.plans import QUERIES

    for name in ("s6_stream_scoring", "s6_stream_rejects"):
        assert len({QUERIES[name](spark, sf).count() for _ in range(3)}) == 1


def test_targets_may_differ_by_domain(spark):
    row = {f"n_{d}": 2 for d in SPEC.domains} | {"n_items": 10}
    df = spark.createDataFrame([row])
    from scalemetrics.operators.sessions import stop_reason

    reason = lambda targets: df.select(stop_reason(SPEC, Rules(use_sem=False, target_per_domain=targets)).alias("r")).first()["r"]
    unequal = dict.fromkeys(SPEC.domains, 2)
    assert reason(2) == reason(unequal) == "domain_coverage_met"
    assert reason(unequal | {"opn": 3}) == "continuing"


def test_masks_of_scales_with_more_items_than_a_word_has_flags(spark):
    spec = ScaleSpec(domains=("one", "two", "three", "four"), items_per_domain=30, reverse_keyed={})
    ranks = {i: n for n, i in enumerate(spec.items, start=1)}
    df = spark.range(500).withColumnRenamed("id", "respondent_id").withColumns({i: F.lit(3) for i in spec.items})
    marked = masks.with_mask(df, spec, ranks, MaskPlan(lo=70, hi=110), seed=1)
    out = masks.apply_mask(marked, spec).select("respondent_id", masks.n_kept().alias("n"), masks.kept_names(spec).alias("names"), F.array(*spec.items).alias("left")).collect()
    draw = masks.drawn_by(spec, ranks, MaskPlan(lo=70, hi=110))
    hashes = {r.respondent_id: r.h for r in df.select("respondent_id", row_hash(1, F.col("respondent_id")).alias("h")).collect()}
    for r in out:
        want = draw(np.array([hashes[r.respondent_id]]))[0]
        assert 70 <= r.n <= 110 and r.n == want.sum()
        assert r.names.split(",") == [i for i, k in zip(spec.items, want) if k] and [v is not None for v in r.left] == want.tolist()


def test_rank_cuts_narrow_until_a_range_holds_few_rows(spark):
    from scalemetrics.operators import quantiles

    df = spark.range(1_000_000).select(F.col("id"), F.lit("all").alias("stratum"), row_hash(3, F.col("id")).alias("h"))
    df = df.withColumn("h", F.when(F.col("id") < 50, F.lit(123_456_789)).otherwise(F.col("h"))).persist()
    ordered = [r.id for r in df.orderBy("h", "id").collect()]
    quotas = spark.createDataFrame([("all", n, q) for n, q in enumerate((1, 7, 30, 50, 51, 123_456, 999_999, 1_000_000))], "stratum string, cut int, quota long")
    for most in (1_000_000, 1_000, 10):
        got = quantiles.rank_cuts(df, ["stratum"], F.col("h"), "id", quantiles.hash_ranges(df, ["stratum"], F.col("h")), quotas, most=most).collect()
        assert {r.cut: r.cut_id for r in got} == {r.cut: ordered[r.quota - 1] for r in quotas.collect()}, most
    df.unpersist()


def largest_method(df):
    """Bytes of the largest generated method; the JVM compiles none beyond 8,000."""
    parts = df._jdf.queryExecution().debug().codegenToSeq()
    return max((parts.apply(n)._3().maxMethodCodeSize() for n in range(parts.size())), default=0)


def sparse_maps(spark):
    names, cells = F.array(*[F.lit(i) for i in SPEC.items]), F.array(*[(F.col("id") % 5 + n % 2).cast("double") for n in range(SPEC.n_items)])
    return spark.range(4).select(F.col("id").alias("respondent_id"), F.map_filter(F.map_from_arrays(names, cells), lambda _, v: v > 1).alias("answers"))


def test_dense_vectors_stay_small_methods(spark):
    vectors = requests.dense(sparse_maps(spark), SPEC).withColumns({i: F.col(i).cast("int") for i in SPEC.items})
    assert largest_method(vectors.select("respondent_id", digits())) < 8000


def test_dense_works_a_derived_map_out_once(spark):
    vectors = requests.dense(sparse_maps(spark), SPEC)
    by_id = {r["respondent_id"]: r for r in vectors.collect()}
    assert [by_id[0]["ext1"], by_id[1]["ext1"], by_id[1]["ext2"], by_id[3]["ext1"]] == [None, None, 2.0, 3.0]
    plan = vectors.select(*SPEC.items)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_arrays") == 1 and "element_at(map_filter" not in plan


def test_answers_of_unknown_and_negative_keys(spark):
    rows = spark.createDataFrame([(None, 1, 1), (-12, 2, 1), (123456, 3, 1)], "o_orderkey long, origin long, origin_count int")
    found = {r["respondent_id"]: r for r in derive_answers(rows).collect()}
    assert all(found[None][i] is None for i in SPEC.items)
    for key in (-12, 123456):
        h = lambda name: int(hashlib.md5(f"{name}|{key}".encode()).hexdigest()[:8], 16)
        for i in SPEC.items:
            value = 1 + (5 * (h(SPEC.domain_of[i]) % 1000) + h("g") % 1000 + 4 * (h(i) % 1000)) // 10 // 200
            expected = 6 - value if i in SPEC.reversed_items else value
            assert found[key][i] == (0 if i == "ext1" and h("bad") % 100 < 3 else expected)


def test_sessions_in_any_order_and_many_batches_are_counted_whole(spark):
    from scalemetrics.operators.grouped import whole_groups

    rows = [(s, p, i, 1 + (s + p) % 5) for s in range(40) for p, i in enumerate(SPEC.items[: 8 + s], start=1)]
    repeats = [(s, p + 60, i, 9) for s, p, i, _ in rows] + [(None, 1, "ext1", 3), (None, 2, "agr1", 3)]
    log = spark.createDataFrame(rows + repeats, "session long, pos int, item string, value int").repartition(5, "item")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        first = sessions.first_answers(log)
        assert {tuple(r) for r in first.collect()} == set(rows) | {(None, 1, "ext1", 3), (None, 2, "agr1", 3)}
        plan = first._jdf.queryExecution().toString()
        assert "SortAggregate" not in plan and "Window" not in plan  # rows of the log are neither sorted nor grouped one by one
        found = sessions.prefix_coverage(first, SPEC).filter("session is not null").collect()
        assert len(found) == len(rows)
        for r in found:
            items = SPEC.items[: r["pos"]]
            assert r["n_items"] == r["pos"] and all(r[f"n_{d}"] == sum(SPEC.domain_of[i] == d for i in items) for d in SPEC.domains)
        assert sessions.session_state(log, SPEC).filter("session = 3 and size(answered) = 11").count() == 1
        sizes = whole_groups(log.select("session", "pos"), "session", lambda t: t.slice(0, 0), log.select("session", "pos").schema)
        assert sizes.count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_written_tables_come_from_methods_that_are_compiled(spark):
    from scalemetrics import workspace

    before = spark.conf.get(workspace.METHOD_LIMIT)
    try:
        for own, used in (("65535", "8000"), ("3000", "3000")):
            spark.conf.set(workspace.METHOD_LIMIT, own)
            assert workspace.written(spark, f"limit {own}", lambda: spark.range(3)).count() == 3
            assert spark.conf.get(workspace.METHOD_LIMIT) == used
    finally:
        spark.conf.set(workspace.METHOD_LIMIT, before)


def test_work_on_whole_groups_goes_on_without_another_shuffle(spark):
    rows = [(s, p, i, 1) for s in range(9) for p, i in enumerate(["agr1", "ext2", "ext1", "odd", "x1y", None, "opn10\n", "ext2"], start=1)] + [(9, 2, None, 1), (9, 1, None, 2), (None, 4, "ext1", 1)]
    log = spark.createDataFrame(rows, "session long, pos int, item string, value int").repartition(4, "pos")
    found = sessions.prefix_coverage(sessions.first_answers(log), SPEC)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2  # that of the log above, and one for the sessions
    assert plan.count("MapInArrow") == 2
    alone = sessions.prefix_coverage(sessions.first_answers(log).select("session", "pos", "item", "value"), SPEC)
    assert sorted(map(str, found.collect())) == sorted(map(str, alone.collect()))
    at = {r["pos"]: r for r in found.filter("session = 3").collect()}
    assert len(at) == 7 and (at[7]["n_ext"], at[7]["n_agr"], at[7]["n_opn"], at[7]["n_items"]) == (2, 1, 1, 7)
    assert [(r["n_items"], r["n_ext"]) for r in found.filter("session = 9").collect()] == [(1, None)]


def test_domains_of_names_are_those_of_columns(spark):
    from scalemetrics.operators.items import domain_name, domain_of_item

    names = ["ext1", "ext10", "ext", "1", "", "Ext1", "ext1 ", "ext1\n", "ext1\r\n", "ext1\n\n", "ext\u0661", "\next1", "ab1c2", "opn1\u2028"]
    got = spark.createDataFrame([(n,) for n in names], "item string").select("item", domain_of_item(F.col("item")).alias("d")).collect()
    assert {r["item"]: r["d"] for r in got} == {n: domain_name(n) for n in names}


def test_earliest_stops_hold_length_reason_and_sem(spark):
    sems = [f"sem_{d}" for d in SPEC.domains]
    columns = ["session", "pos", "n_items", *(f"n_{d}" for d in SPEC.domains), *sems]
    row = lambda s, n, sem: (s, n, n, *[n // 5] * 5, *[float(sem)] * 5)
    prefixes = spark.createDataFrame([row(1, 20, 0.6), row(1, 21, 0.42), row(1, 22, 0.3), row(2, 7, 0.1), row(2, 9, 0.8), row(3, 50, 0.9)], columns)
    found = {(r["session"], r["threshold"]): tuple(r)[2:] for r in sessions.earliest_stops(prefixes, SPEC, Rules(), [0.35, 0.45]).collect()}
    assert found == {
        (1, 0.35): (22, "sem_threshold_met", 0.3), (1, 0.45): (21, "sem_threshold_met", 0.42), (2, 0.35): (9, "log_end", 0.8), (2, 0.45): (9, "log_end", 0.8),
        (3, 0.35): (50, "max_items_reached", 0.9), (3, 0.45): (50, "max_items_reached", 0.9),
    }
