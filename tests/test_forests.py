"""Forests grown together: against plain loops over rows, trees and candidates."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scalemetrics.functions.normal import normal_cdf_array
from scalemetrics.operators import forests, masks
from scalemetrics.operators.forests import Forest, Growth, Job
from scalemetrics.operators.masks import MaskPlan
from scalemetrics.spec import FIVE_DOMAIN as SPEC

MISSING = forests.n_bins(SPEC) - 1


def answers(n, missing, seed=1):
    """Bins (n x items) with missing ones, the full answers and the domain scores."""
    rng = np.random.default_rng(seed)
    trait = {d: rng.normal(size=n) for d in SPEC.domains}
    full = np.stack([np.clip(np.round(3 + trait[SPEC.domain_of[i]] + rng.normal(size=n)), 1, 5) for i in SPEC.items], axis=1).astype(int) - 1
    scores = np.stack([full[:, [SPEC.item_no[i] - 1 for i in SPEC.domain_items(d)]].mean(axis=1) + 1 for d in SPEC.domains], axis=1)
    bins = np.where(rng.random(full.shape) < missing, MISSING, full)
    return bins, full, scores


def table(spark, bins, scores, held, fold):
    pdf = pd.DataFrame({"bins": bins.tolist(), "y": scores.tolist(), "held": held, "fold": fold})
    return spark.createDataFrame(pdf, "bins array<tinyint>, y array<double>, held boolean, fold int").repartition(3)


def wide(spark, bins, scores):
    """One column per item, null where missing."""
    rows = [[n, *[None if b == MISSING else int(b) + 1 for b in row], *map(float, y), *[10.0 * v for v in map(float, y)]] for n, (row, y) in enumerate(zip(bins, scores))]
    schema = "respondent_id long, " + ", ".join([f"{i} int" for i in SPEC.items] + [f"{s} double" for s in (*SPEC.scores, *SPEC.percentiles)])
    return spark.createDataFrame(rows, schema)


def random_forest(models, trees, depth, seed=2):
    rng = np.random.default_rng(seed)
    shape = (models, trees, (1 << depth) - 1)
    return Forest(rng.normal(3, 0.2, models), rng.integers(0, SPEC.n_items, shape).astype(np.int16), rng.integers(0, 64, shape).astype(np.int64), rng.normal(0, 0.1, (models, trees, 1 << depth)))


def walked(forest, row, model):
    """One tree after the other, node by node."""
    value = forest.base[model]
    for items, rules, leaves in zip(forest.items[model], forest.masks[model], forest.leaves[model]):
        node = 0
        while node < len(items):
            node = 2 * node + (1 if rules[node] >> row[items[node]] & 1 else 2)
        value += leaves[node - len(items)]
    return value


def test_prediction_equals_a_plain_tree_walk(spark):
    bins, _, scores = answers(40, 0.4)
    forest = random_forest(15, 100, 4)
    fitted = forests.Fitted(forests.jobs_of(SPEC.domains), forest)
    df = wide(spark, bins, scores)
    out, columns = forests.predicted(df, fitted, SPEC)
    got = out.orderBy("respondent_id").select([c.alias(f"{d}_{q}") for (d, q), c in columns.items()]).collect()
    for row, values in zip(bins, got):
        for m, v in enumerate(values):
            assert v == pytest.approx(np.clip(walked(forest, row, m), 1, 5), abs=1e-12)


def plain_split(bins, residual, q, min_leaf):
    """Largest gain over all items, thresholds and sides of the missing answers, row by row."""
    gradient = np.where(residual > 0, q, q - 1)
    best = 0.0
    for item in range(bins.shape[1]):
        for last in range(MISSING):
            for side in (False, True):
                left = (bins[:, item] <= last) | (side & (bins[:, item] == MISSING))
                a, b = left.sum(), (~left).sum()
                if min(a, b) >= min_leaf:
                    best = max(best, gradient[left].sum() ** 2 / a + gradient[~left].sum() ** 2 / b - gradient.sum() ** 2 / len(bins))
    return best


def gain(left, residual, q):
    gradient = np.where(residual > 0, q, q - 1)
    return gradient[left].sum() ** 2 / left.sum() + gradient[~left].sum() ** 2 / (~left).sum() - gradient.sum() ** 2 / len(left)


def test_first_split_and_leaves_are_the_best(spark):
    bins, _, scores = answers(600, 0.3, seed=3)
    none = np.zeros(600, bool)
    jobs = [Job("ext", q, Growth(rounds=1, depth=2, rate=1.0, min_leaf=15)) for q in forests.QUANTILES]
    fitted = forests.fit(table(spark, bins, scores, none, np.zeros(600, int)), SPEC, jobs)
    f = fitted.forest
    for m, q in enumerate(forests.QUANTILES.values()):
        residual = scores[:, 0] - f.base[m]
        assert f.base[m] == pytest.approx(np.quantile(scores[:, 0], q), abs=0.11)  # scores are multiples of 0.1
        left = (f.masks[m, 0, 0] >> bins[:, f.items[m, 0, 0]]) & 1 == 1
        assert gain(left, residual, q) == pytest.approx(plain_split(bins, residual, q, 15), rel=1e-9)
        place = f.places(bins.astype(np.uint8), m, slice(0, 1), 2)[:, 0]
        for leaf in set(place):
            inside = residual[place == leaf]
            below = (inside < f.leaves[m, 0, leaf] + 0.02).mean(), (inside < f.leaves[m, 0, leaf] - 0.02).mean()
            assert below[1] <= q <= below[0] + 1e-9


def test_losses_fall_stopping_fires_and_the_best_round_is_kept(spark):
    bins, full, scores = answers(3000, 0.5, seed=4)
    held = np.arange(3000) % 4 == 0
    growth = Growth(rounds=60, depth=3, rate=0.5, patience=5, min_leaf=10)
    fitted = forests.fit(table(spark, bins, scores, held, np.zeros(3000, int)), SPEC, forests.jobs_of(SPEC.domains, growth))
    assert any(fitted.stopped) and all(r < 60 for r, s in zip(fitted.rounds, fitted.stopped) if s)
    for m, job in enumerate(fitted.jobs):
        history = [(n, fit, out) for k, n, fit, out in fitted.history if k == m]
        assert all(b[1] <= a[1] + 1e-3 for a, b in zip(history, history[1:])) and history[-1][1] < history[0][1]
        assert fitted.rounds[m] == min(history, key=lambda h: (h[2], h[0]))[0]
        q, y = forests.QUANTILES[job.quantile], scores[held, SPEC.domain_no[job.domain] - 1]
        e = y - fitted.forest.predict(bins[held].astype(np.uint8))[:, m]
        assert np.maximum(q * e, (q - 1) * e).mean() == pytest.approx(min(h[2] for h in history), abs=1e-9)
    # passes: one for the bases, and depth + 1 per round, whatever the number of models
    assert fitted.passes <= 2 + (growth.depth + 1) * (1 + max(n for _, n, *_ in fitted.history))


def test_a_model_never_sees_its_fold(spark):
    bins, _, scores = answers(800, 0.3, seed=5)
    fold, none = np.arange(800) % 4, np.zeros(800, bool)
    growth = Growth(rounds=4, depth=3, rate=0.5, min_leaf=10)
    jobs = [j for f in range(4) for j in forests.jobs_of(("ext", "opn"), growth, fold=f)]
    together = forests.fit(table(spark, bins, scores, none, fold), SPEC, jobs).forest
    alone = forests.fit(table(spark, bins[fold != 2], scores[fold != 2], none[fold != 2], fold[fold != 2]), SPEC, forests.jobs_of(("ext", "opn"), growth)).forest
    assert np.allclose(together.predict(bins.astype(np.uint8))[:, 12:18], alone.predict(bins.astype(np.uint8)), atol=1e-9)


def test_settings_are_per_model(spark):
    bins, _, scores = answers(500, 0.2, seed=6)
    rows = table(spark, bins, scores, np.zeros(500, bool), np.zeros(500, int))
    settings = [Growth(rounds=2, depth=1, rate=0.5, min_leaf=5), Growth(rounds=5, depth=3, rate=0.2, min_leaf=50)]
    both = forests.fit(rows, SPEC, [Job("agr", "q50", g, candidate=n) for n, g in enumerate(settings)])
    for n, g in enumerate(settings):
        alone = forests.fit(rows, SPEC, [Job("agr", "q50", g)])
        assert np.allclose(both.forest.predict(bins.astype(np.uint8))[:, n], alone.forest.predict(bins.astype(np.uint8))[:, 0], atol=1e-9)
    assert both.rounds == [2, 5]


def test_counts_of_many_tasks_are_added_in_groups(spark, monkeypatch):
    bins, _, scores = answers(300, 0.2, seed=7)
    growth = Growth(rounds=2, depth=2, min_leaf=5)
    rows = table(spark, bins, scores, np.zeros(300, bool), np.zeros(300, int))
    whole = forests.fit(rows, SPEC, forests.jobs_of(("csn",), growth))
    monkeypatch.setattr(forests, "ADD_AT_ONCE", 2)
    grouped = forests.fit(rows.repartition(9), SPEC, forests.jobs_of(("csn",), growth))
    assert np.allclose(whole.forest.predict(bins.astype(np.uint8)), grouped.forest.predict(bins.astype(np.uint8)), atol=1e-12)


def test_an_empty_table_predicts_nothing_learnt(spark):
    bins, _, scores = answers(5, 0.2)
    rows = table(spark, bins, scores, np.zeros(5, bool), np.zeros(5, int)).limit(0)
    fitted = forests.fit(rows, SPEC, forests.jobs_of(("ext",), Growth(rounds=3)))
    assert fitted.rounds == [0, 0, 0] and (fitted.forest.predict(bins.astype(np.uint8)) == 0).all()


def test_masks_are_drawn_where_they_are_scored(spark):
    bins, full, scores = answers(60, 0.0, seed=8)
    df = wide(spark, full, scores)
    fitted = forests.Fitted(forests.jobs_of(SPEC.domains), random_forest(15, 10, 3))
    ranks = {i: n for n, i in enumerate(SPEC.items, start=1)}
    draw = masks.drawn_by(SPEC, ranks, MaskPlan(lo=20, hi=20))
    hashes = [masks.row_hash(F.lit(40 + p), F.col("respondent_id")) for p in range(3)]
    got = df.select("respondent_id", F.array(*hashes).alias("h"), forests.masked_predictions(df, fitted, SPEC, draw, hashes).alias("p")).collect()
    for r in got:
        for p in range(3):
            keep = draw(np.array([r.h[p]]))[0]
            assert keep.sum() == 20
            row = np.where(keep, full[r.respondent_id], MISSING)
            assert r.p[p] == pytest.approx([np.clip(walked(fitted.forest, row, m), 1, 5) for m in range(15)], abs=1e-12)


def test_selections_are_scored_as_by_plain_loops(spark):
    bins, full, scores = answers(80, 0.0, seed=9)
    fitted = forests.Fitted(forests.jobs_of(SPEC.domains), random_forest(15, 6, 3))
    norms = {d: (3.0 + 0.1 * n, 0.8) for n, d in enumerate(SPEC.domains)}
    selections = {("few", 5): ["ext1", "ext2", "agr3", "opn1", "opn9"], ("short", 20): list(SPEC.short_items)}
    sums = forests.cell_sums(wide(spark, full, scores).repartition(3), fitted, SPEC, selections, norms, 0.53)
    metrics = {(r.method, r.scoring, r.domain): r for r in forests.cell_metrics(sums).collect()}
    deltas = {(r.method, r.domain): r for r in forests.scoring_deltas(forests.cell_metrics(sums)).collect()}
    assert len(metrics) == 2 * 2 * 6
    for (method, _), items in selections.items():
        for scoring in ("model", "average"):
            everything = []
            for n, d in enumerate(SPEC.domains):
                rows = []
                for answered, y in zip(full, scores):
                    own = [i for i in items if SPEC.domain_of[i] == d]
                    pct = lambda x: float(np.clip(100 * normal_cdf_array(np.array((x - norms[d][0]) / norms[d][1])), 0, 100))  # noqa: B023, E731
                    if scoring == "model":
                        row = np.array([answered[k] if i in items else MISSING for k, i in enumerate(SPEC.items)])
                        triple = sorted(pct(np.clip(walked(fitted.forest, row, 3 * n + q), 1, 5)) for q in range(3))
                    else:
                        mean = np.mean([answered[SPEC.item_no[i] - 1] + 1 for i in own]) if own else None
                        triple = [pct(mean + s) for s in (-0.53, 0, 0.53)] if own else [50.0] * 3
                    rows.append((10 * y[n], *triple))
                everything += rows
                check(metrics[method, scoring, d], rows)
            check(metrics[method, scoring, "overall"], everything)
        assert deltas[method, "ext"].delta_mae == pytest.approx(metrics[method, "model", "ext"].mae - metrics[method, "average", "ext"].mae)


def check(got, rows):
    true, low, mid, high = np.array(rows).T
    e = np.abs(true - mid)
    assert got.n == len(rows) and got.mae == pytest.approx(e.mean()) and got.rmse == pytest.approx(np.sqrt((e * e).mean()))
    assert got.within_5_pct == pytest.approx((e <= 5).mean()) and got.coverage_90 == pytest.approx(((true >= low) & (true <= high)).mean())
    assert (got.pearson_r is None) if mid.std() < 1e-9 else got.pearson_r == pytest.approx(np.corrcoef(true, mid)[0, 1])


def test_counts_by_matrix_product_equal_a_plain_count():
    """Groups and rows beyond one product, every bin, rows of no group."""
    rng = np.random.default_rng(11)
    by_item = rng.integers(0, MISSING + 1, (4, forests.COUNTED_AT_ONCE + 300)).astype(np.uint8)
    groups = rng.random((forests.COLUMNS_AT_ONCE + 3, by_item.shape[1])) < 0.2
    groups[1] = False
    got = forests.answer_counts(by_item, groups, MISSING)
    for g in (0, 1, len(groups) - 1):
        for item in range(4):
            assert got[g, item].tolist() == np.bincount(by_item[item, groups[g]], minlength=MISSING + 1).tolist()


def test_only_left_children_are_counted_and_the_right_ones_follow():
    """Rows of a level by node, item, bin and side, against plain counts; rows of no model, more rows than a product takes."""
    rng = np.random.default_rng(13)
    n, depth, models = forests.COUNTED_AT_ONCE + 700, 3, [0, 2]
    by_item = rng.integers(0, MISSING + 1, (SPEC.n_items, n)).astype(np.uint8)
    residual, train = rng.normal(size=(3, n)), rng.random((3, n)) < 0.8
    node = rng.integers(0, 1 << depth, (3, n)).astype(np.uint8)

    class Fit:
        spec = SPEC

    def counted(level):
        count = forests.with_losses(Fit, np.array([0.05, 0.5, 0.95]), level)
        return {m: (losses, found) for m, losses, found in count(by_item, models, lambda m: (residual[m], train[m], ~train[m]), lambda m, d: node[m] >> (depth - d))}

    parents = {}
    for level in range(depth + 1):
        for m, (losses, found) in counted(level).items():
            nodes = 1 << level
            assert len(found) == max(1, nodes // 2) * SPEC.n_items * (MISSING + 1) * 2 and len(losses) == (0 if level else 4)
            lefts = found.reshape(-1, 1, SPEC.n_items, MISSING + 1, 2)
            both = np.concatenate([lefts, parents[m][:, None] - lefts], axis=1) if level else lefts
            parents[m] = both.reshape(nodes, *lefts.shape[2:])
            for k in range(nodes):
                for side in (0, 1):
                    inside = train[m] & (node[m] >> (depth - level) == k) & ((residual[m] > 0) == side)
                    for item in (0, 7, SPEC.n_items - 1):
                        assert parents[m][k, item, :, side].tolist() == np.bincount(by_item[item, inside], minlength=MISSING + 1).tolist()


def test_losses_leave_out_rows_that_are_no_numbers():
    residual, train, held = np.array([1.0, -2.0, np.nan, 4.0]), np.array([True, True, False, False]), np.array([False, False, False, True])
    found = forests.all_losses(np.array([0.5]), [0], lambda m: (residual, train, held))
    assert found[0].tolist() == [2, 1.5, 1, 2.0]


def test_small_batches_make_whole_blocks():
    batches = [pa.record_batch({"a": pa.array(range(10 * k, 10 * k + size))}) for k, size in enumerate((3, 0, 9, 1, 5))]
    found = list(forests.whole_blocks(batches, 7))
    assert [b.num_rows for b in found] == [7, 7, 4] and [v for b in found for v in b.column("a").to_pylist()] == [v for b in batches for v in b.column("a").to_pylist()]
    assert list(forests.whole_blocks([], 7)) == []


def test_packed_counts_come_back():
    for counts in (np.zeros(50, np.int64), np.eye(1, 5000, 7, dtype=np.int64)[0] * 70_000, np.arange(300), np.zeros(0, np.int64), np.array([2**33])):
        losses, back = forests.unpacked_counts(*forests.packed_counts(np.array([0.5, 2.0]), counts))
        assert losses.tolist() == [0.5, 2.0] and back.tolist() == counts.tolist()


def test_a_pass_carries_only_the_tree_that_grows(spark, monkeypatch):
    """The rows carry the predictions, so a pass looks at one tree however many there are (before: all since the last writing)."""
    bins, _, scores = answers(200, 0.2, seed=12)
    rows = table(spark, bins, scores, np.zeros(200, bool), np.zeros(200, int))
    sizes, old = [], forests.Grower.counted

    def counted(self, count, active, tree):
        assert self.blocks.is_cached
        if tree:
            block = self.blocks.first()
            sizes.append(np.allclose(block[4], forests.Forest(self.forest.base, *(a[:, :tree] for a in (self.forest.items, self.forest.masks, self.forest.leaves))).predict(block[0].T).T))
        return old(self, count, active, tree)

    monkeypatch.setattr(forests.Grower, "counted", counted)
    forests.fit(rows, SPEC, forests.jobs_of(("csn",), Growth(rounds=12, depth=2, min_leaf=5)))
    assert sizes and all(sizes)
