"""Quantile models of answers that may be missing: many boosted forests grown together.

Answers are bins (one byte each, the last bin is "missing"), so what a split needs to know is a histogram: how many rows of a
node have a bin, and how many of them lie above their prediction. One pass over the table returns these counts for
every model and node of a level at once, whatever the number of models; quantiles, domains, folds and candidate
settings are all just models. A pass costs one job: tasks count by matrix products, the counts of many tasks are added per model, and the driver
picks splits from sums whose size the layout gives. Only left children are counted: a right child has what its parent has beyond them. A last pass per round counts residuals per leaf in fine classes, and
the leaf takes their quantile; the same rule holds at every size.

A forest is flat arrays: per tree the nodes in breadth order with an item and a bit mask of the bins that go left, and the leaf
values. It is broadcast once and all models are evaluated by one vectorised function.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalemetrics.spec import ScaleSpec
from scalemetrics.workspace import settle

# The quantiles of the three models of a domain.
QUANTILES = {"q05": 0.05, "q50": 0.5, "q95": 0.95}
ADD_AT_ONCE = 32
CLASSES = 1024  # residual classes of a leaf
ROWS_AT_ONCE = 32768  # rows of a block: plain operations on bytes cost more to call than to do below that
COUNTED_AT_ONCE = 2048  # rows of one matrix product; its sums stay exact in single precision
ABOVE_BITS = 12  # a row above its prediction weighs 1 + 2^12 in a matrix product, so that a sum holds two counts of at most COUNTED_AT_ONCE
COLUMNS_AT_ONCE = 512  # groups of rows counted by one matrix product
CUT_EVERY = 10  # rounds after which the predictions so far are written to the shared folder
EVERY_FOLD = -1


@dataclass(frozen=True)
class Growth:
    """Settings of a model's trees."""

    rounds: int = 200
    depth: int = 4
    rate: float = 0.3
    patience: int = 25
    min_leaf: int = 20


@dataclass(frozen=True)
class Job:
    """One model: what it predicts, which fold it never sees, and how it grows."""

    domain: str
    quantile: str
    growth: Growth = Growth()
    fold: int = EVERY_FOLD
    candidate: int = 0


def jobs_of(domains: Sequence[str], growth: Growth = Growth(), fold: int = EVERY_FOLD, candidate: int = 0) -> list[Job]:
    return [Job(d, q, growth, fold, candidate) for d in domains for q in QUANTILES]


@dataclass
class Forest:
    """``items``, ``masks``: models x trees x nodes; ``leaves``: models x trees x leaves; ``base``: per model."""

    base: np.ndarray
    items: np.ndarray
    masks: np.ndarray
    leaves: np.ndarray

    @property
    def depth(self) -> int:
        return int(np.log2(self.leaves.shape[2]))

    def places(self, bins: np.ndarray, model: int, trees: slice, depth: int) -> np.ndarray:
        """Node of every row at a depth of some trees of a model, numbered inside the level: rows x trees."""
        by_item = np.ascontiguousarray(bins.T)
        return np.stack([descend(by_item, i, m, depth) for i, m in zip(self.items[model, trees], self.masks[model, trees])], axis=1)

    def added(self, by_item: np.ndarray, model: int, trees: slice) -> np.ndarray:
        """Sum of the leaf values that some trees of a model give each row; ``by_item``: items x rows."""
        n = by_item.shape[1]
        total, value, place = np.zeros(n), np.empty(n), np.empty(n, np.intp)
        for items, masks, leaves in zip(self.items[model, trees], self.masks[model, trees], self.leaves[model, trees]):
            if leaves.any():  # trees beyond a model's best round give nothing
                place[:] = descend(by_item, items, masks, self.depth)
                total += leaves.take(place, out=value, mode="clip")
        return total

    def predict(self, bins: np.ndarray) -> np.ndarray:
        """Rows x models."""
        out = np.empty((len(bins), len(self.base)))
        for a in range(0, len(bins), ROWS_AT_ONCE):
            part = np.ascontiguousarray(bins[a : a + ROWS_AT_ONCE].T)
            for m in range(len(self.base)):
                out[a : a + ROWS_AT_ONCE, m] = self.base[m] + self.added(part, m, slice(None))
        return out


def goes_right(by_item: np.ndarray, item: int, mask: int) -> np.ndarray:
    """Rows whose bin of an item is not in the mask: the answers up to the first gap are one comparison."""
    column, run = by_item[item], 0
    while mask >> run & 1:
        run += 1
    right = column >= run
    for b in range(run + 1, mask.bit_length()):
        if mask >> b & 1:
            right &= column != b
    return right


def descend(by_item: np.ndarray, items: np.ndarray, masks: np.ndarray, depth: int) -> np.ndarray:
    """Node of every row (``by_item``: items x rows) at a depth of a tree, numbered inside the level.

    The nodes of a level are compared for all rows and a row's own one is picked by its turns so far: plain
    operations on bytes, about ten times as fast as looking up node, item and bin row by row.
    """
    n, kind = by_item.shape[1], np.uint8 if depth <= 8 else np.int64
    items, masks, turns = items.tolist(), masks.tolist(), []
    for level in range(depth):
        first = (1 << level) - 1
        rules = masks[first : 2 * first + 1]
        if all(r == -1 for r in rules):
            turn = np.zeros(n, bool)
        else:
            sides = [np.zeros(n, bool) if r == -1 else goes_right(by_item, i, r) for i, r in zip(items[first : 2 * first + 1], rules)]
            for earlier in reversed(turns):
                sides = [a ^ (earlier & (a ^ b)) for a, b in zip(sides[::2], sides[1::2])]
            turn = sides[0]
        turns.append(turn)
    at = np.zeros(n, kind)
    for turn in turns:
        at += at
        at |= turn.view(np.uint8)
    return at


@dataclass
class Fitted:
    jobs: list[Job]
    forest: Forest
    history: list[tuple[int, int, float, float | None]] = field(default_factory=list)  # model, round, loss, held-out loss
    rounds: list[int] = field(default_factory=list)  # trees kept per model
    stopped: list[bool] = field(default_factory=list)  # by patience
    passes: int = 0

    def only(self, keep: Sequence[int]) -> Fitted:
        """Some of the models."""
        keep = list(keep)
        f = self.forest
        picked = Forest(f.base[keep], f.items[keep], f.masks[keep], f.leaves[keep])
        history = [(keep.index(m), *rest) for m, *rest in self.history if m in keep]
        return replace(self, jobs=[self.jobs[k] for k in keep], forest=picked, history=history, rounds=[self.rounds[k] for k in keep], stopped=[self.stopped[k] for k in keep])


def binned(spec: ScaleSpec) -> Column:
    """Answers as bytes from 0; missing answers are one bin more than the answers have."""
    cells = [F.coalesce(F.col(i).cast("int") - spec.lo, F.lit(spec.hi - spec.lo + 1)).cast("tinyint") for i in spec.items]
    return F.array(*cells)


def n_bins(spec: ScaleSpec) -> int:
    return spec.hi - spec.lo + 2


def matrix(column: pa.Array, width: int, dtype: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, width)


Counts = tuple[bytes, int, bytes, bytes]  # losses, number of counts, places of the counts given (empty: all), counts


def packed_counts(losses: np.ndarray, counts: np.ndarray) -> Counts:
    """Losses and counts as bytes: counts in the narrowest integers, with their places where most are 0."""
    counts = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))
    places = np.flatnonzero(counts).astype(np.uint32)
    sparse = 0 < len(places) * (4 + counts.itemsize) < counts.nbytes
    return losses.astype(np.float64).tobytes(), len(counts), places.tobytes() if sparse else b"", (counts[places] if sparse else counts).tobytes()


def unpacked_counts(losses: bytes, size: int, places: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(places, np.uint32) if places else slice(None)
    out = np.zeros(size, np.int64)
    if size:
        out[at] = np.frombuffer(counts, f"u{len(counts) // (len(at) if places else size)}")
    return np.frombuffer(losses, np.float64), out


def added_up(parts: RDD, n_keys: int) -> dict[int, np.ndarray]:
    """Sums of losses and counts per key: ``parts`` has (key, packed counts) once per task and key.

    Those of more than ADD_AT_ONCE tasks are added per key before the driver sees them.
    """

    def total(rows: Iterable[Counts]) -> tuple[np.ndarray, np.ndarray]:
        losses, counts = zip(*(unpacked_counts(*r) for r in rows))
        return sum(losses), sum(counts)

    if parts.getNumPartitions() > ADD_AT_ONCE:
        parts = parts.reduceByKey(lambda a, b: packed_counts(*total((a, b))), min(n_keys, ADD_AT_ONCE))
    by_key: dict[int, list[Counts]] = {}
    for key, counts in parts.collect():  # ADD_AT_ONCE per key at most
        by_key.setdefault(key, []).append(counts)
    return {key: np.concatenate(total(rows)) for key, rows in by_key.items()}


def whole_blocks(batches: Iterable[pa.RecordBatch], n_rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task in batches of ``n_rows``, the last one shorter."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, n_rows - sum(b.num_rows for b in some))
            some.append(part)
            at += part.num_rows
            if sum(b.num_rows for b in some) == n_rows:
                yield pa.concat_batches(some)
                some = []
    if some:
        yield pa.concat_batches(some)


# Some rows of the table: answers (items x rows), what to predict (domains x rows), held-out flags, folds, and the
# predictions so far (models x rows).
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Grower:
    """Rounds of a fit: the rows with their predictions so far, and the trees.

    The rows are settled once and then kept as blocks, in memory as far as it goes and on disk beyond; the blocks of a round
    come from those of the round before, and every CUT_EVERY rounds they are written to the shared folder.
    """

    def __init__(self, rows: DataFrame, spec: ScaleSpec, jobs: list[Job]) -> None:
        self.spec, self.jobs = spec, jobs
        self.depth = max(j.growth.depth for j in jobs)
        models, trees = len(jobs), max(j.growth.rounds for j in jobs)
        shape = (models, trees, (1 << self.depth) - 1)
        self.forest = Forest(np.zeros(models), np.zeros(shape, np.int16), np.full(shape, -1, np.int64), np.zeros((models, trees, 1 << self.depth)))
        n_items, n_domains = spec.n_items, len(spec.domains)

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in whole_blocks(batches, ROWS_AT_ONCE):
                bins, y = matrix(part.column("bins"), n_items, np.uint8), matrix(part.column("y"), n_domains, np.float64)
                held, fold = part.column("held").to_numpy(zero_copy_only=False), part.column("fold").to_numpy()
                block = (np.ascontiguousarray(bins.T), np.ascontiguousarray(y.T), held.astype(bool), fold.copy(), np.zeros((models, len(bins))))
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

        settled = settle(rows.select("bins", "y", "held", "fold"))
        self.blocks = settled.mapInArrow(blocks, "block binary").rdd.map(lambda r: pickle.loads(r["block"])).persist(StorageLevel.MEMORY_AND_DISK)
        self.before: RDD | None = None  # the blocks of the round before, until those of this one are there
        self.passes = 0

    def counted(self, count, active: list[int], tree: int) -> dict[int, np.ndarray]:
        """One pass: ``count(by_item, models, residuals, nodes)`` gives losses and counts per model and block, summed over the table.

        ``residuals(model)`` gives residuals, training rows and held-out rows; ``nodes(model, depth)`` the node of every row
        in the tree that grows.
        """
        domain_no = {d: n for n, d in enumerate(self.spec.domains)}
        domains, folds = [domain_no[j.domain] for j in self.jobs], [j.fold for j in self.jobs]
        # only the tree that grows travels with the pass
        items, masks = self.forest.items[:, tree : tree + 1].copy(), self.forest.masks[:, tree : tree + 1].copy()

        def run(blocks: Iterator[Block]) -> Iterator[tuple[int, Counts]]:
            total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for by_item, y, held, fold, scores in blocks:
                sides = {f: (seen & ~held, seen & held) for f in {folds[m] for m in active} for seen in (fold != f,)}

                def residuals(m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                    return y[domains[m]] - scores[m], *sides[folds[m]]

                def nodes(m: int, depth: int) -> np.ndarray:
                    return descend(by_item, items[m, 0], masks[m, 0], depth) if depth else np.zeros(by_item.shape[1], np.uint8)

                for m, losses, counts in count(by_item, active, residuals, nodes):
                    total[m] = (total[m][0] + losses, total[m][1] + counts) if m in total else (losses, counts)
            for m, found in total.items():
                yield m, packed_counts(*found)

        self.passes += 1
        found = added_up(self.blocks.mapPartitions(run), len(active))
        if self.before is not None:
            self.before.unpersist()
            self.before = None
        return found

    def add(self, change: Callable[[np.ndarray, np.ndarray], np.ndarray], cut: bool) -> None:
        """Let the blocks carry new predictions (models x rows) from the next pass on."""
        self.before = self.blocks
        self.blocks = self.blocks.map(lambda b: (*b[:4], change(b[0], b[4]))).persist(StorageLevel.MEMORY_AND_DISK)
        if cut:
            self.blocks.checkpoint()

    def add_bases(self) -> None:
        base = self.forest.base.copy()
        self.add(lambda by_item, scores: np.repeat(base[:, None], by_item.shape[1], axis=1), False)

    def add_tree(self, tree: int, active: list[int]) -> None:
        items, masks, leaves, depth = (self.forest.items[:, tree].copy(), self.forest.masks[:, tree].copy(), self.forest.leaves[:, tree].copy(), self.depth)

        def change(by_item: np.ndarray, scores: np.ndarray) -> np.ndarray:
            scores, n = scores.copy(), by_item.shape[1]
            value, place = np.empty(n), np.empty(n, np.intp)
            for m in active:
                place[:] = descend(by_item, items[m], masks[m], depth)
                scores[m] += leaves[m].take(place, out=value, mode="clip")
            return scores

        self.add(change, (tree + 1) % CUT_EVERY == 0)

    def done(self) -> None:
        for blocks in (self.before, self.blocks):
            if blocks is not None:
                blocks.unpersist()


def fit(rows: DataFrame, spec: ScaleSpec, jobs: list[Job]) -> Fitted:
    """Grow all models. ``rows`` has bins (``binned``), y (one score per domain), held (true: decides when to stop) and fold.

    A model trains on the rows outside its fold that are not held out. A model stops when its held-out loss has not improved for
    ``patience`` rounds, and keeps the trees up to its best round; without held-out rows it uses all its rounds. Rows must
    have a score for every domain. Without training rows a model predicts 0.
    """
    g = Grower(rows, spec, jobs)
    quantiles = np.array([QUANTILES[j.quantile] for j in jobs])
    span = float(spec.hi - spec.lo)
    g.forest.base[:] = first_values(g, quantiles, span)
    g.add_bases()
    best, best_round = np.full(len(jobs), np.inf), np.zeros(len(jobs), int)
    fitted = Fitted(jobs, g.forest, rounds=[0] * len(jobs), stopped=[False] * len(jobs))
    active = list(range(len(jobs)))
    for n in range(max(j.growth.rounds for j in jobs) + 1):
        # the root's counts of round n + 1 and the losses after round n come from one pass
        counts = g.counted(with_losses(g, quantiles, 0), active, n)
        for m in list(active):
            n_fit, loss, n_held, held_loss = counts[m][:4] if m in counts else np.zeros(4)
            if not n_fit:  # nothing to learn from
                active.remove(m)
                continue
            held = float(held_loss / n_held) if n_held else None
            fitted.history.append((m, n, float(loss / n_fit), held))
            better = held is None or held < best[m]
            if better:
                best[m], best_round[m] = np.inf if held is None else held, n
            fitted.stopped[m] = not better and n - best_round[m] >= jobs[m].growth.patience
            if fitted.stopped[m] or n >= jobs[m].growth.rounds:
                active.remove(m)
        if not active:
            break
        grow_tree(g, n, active, quantiles, counts, span)
        g.add_tree(n, active)
    g.done()
    for m in range(len(jobs)):
        fitted.rounds[m] = int(best_round[m])
        g.forest.leaves[m, best_round[m] :] = 0.0
    kept = max(fitted.rounds, default=0)
    fitted.forest = Forest(g.forest.base, g.forest.items[:, :kept], g.forest.masks[:, :kept], g.forest.leaves[:, :kept])
    fitted.passes = g.passes
    return fitted


def residual_classes(residual: np.ndarray, span: float) -> np.ndarray:
    """Class of each residual: CLASSES equal ones over [-span - 1, span + 1]; predictions leave the scale by less than 1."""
    return np.clip(((residual + span + 1) * (CLASSES / (2 * span + 2))).astype(np.int64), 0, CLASSES - 1)


def class_quantile(counts: np.ndarray, quantile: float, span: float) -> float:
    """Quantile of classed residuals, linear inside its class."""
    total = counts.sum()
    if not total:
        return 0.0
    sums = np.cumsum(counts)
    k = int(np.searchsorted(sums, quantile * total))
    inside = (quantile * total - (sums[k] - counts[k])) / counts[k] if counts[k] else 0.5
    return (k + inside) * (2 * span + 2) / CLASSES - span - 1


def first_values(g: Grower, quantiles: np.ndarray, span: float) -> np.ndarray:
    """Quantile of each model's training scores."""

    # residuals against 0 reach from 0 to the highest score, so the classes are shifted by the scale's middle
    middle = (g.spec.lo + g.spec.hi) / 2

    def count(by_item, models, residuals, nodes):
        for m in models:
            residual, train, _ = residuals(m)
            yield m, np.zeros(0), np.bincount(residual_classes(residual[train] - middle, span), minlength=CLASSES)

    counts = g.counted(count, list(range(len(quantiles))), 0)
    return np.array([middle + class_quantile(counts[m], q, span) if m in counts and counts[m].sum() else 0.0 for m, q in enumerate(quantiles)])


def weighed_answers(by_item: np.ndarray, n_answers: int, columns: Iterable[Callable[[slice], np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """Sums of weights per (group, item, bin), for COUNTED_AT_ONCE rows at a time; the bin after the answers is "missing".

    ``columns`` give the weights of some groups for a range of rows (groups x rows); their number comes with the sums. Answers as flags times
    weights: one matrix product counts all groups, where counting cell by cell takes some nanoseconds for every row, item and
    group. A row of ones gives the groups' totals.
    """
    n_items, bins, columns = len(by_item), np.arange(n_answers, dtype=by_item.dtype)[:, None], list(columns)
    cells = n_items * n_answers
    is_given, all_given = np.empty((n_items, n_answers, COUNTED_AT_ONCE), bool), np.ones((cells + 1, COUNTED_AT_ONCE), np.float32)
    for at in range(0, by_item.shape[1], COUNTED_AT_ONCE):
        part = by_item[:, at : at + COUNTED_AT_ONCE]
        n = part.shape[1]
        np.equal(part[:, None, :], bins, out=is_given[:, :, :n])
        given = all_given[:, :n]
        given[:-1] = is_given[:, :, :n].reshape(cells, n)
        for k, weights in enumerate(columns):
            sums = (given @ weights(slice(at, at + n)).T).T
            found = np.empty((len(sums), n_items, n_answers + 1), np.int64)
            found[:, :, :-1] = sums[:, :-1].reshape(-1, n_items, n_answers)
            found[:, :, -1] = sums[:, -1:] - found[:, :, :-1].sum(axis=2)
            yield k, found


def answer_counts(by_item: np.ndarray, groups: np.ndarray, n_answers: int) -> np.ndarray:
    """Counts of (group, item, bin) for groups of rows given as flags (groups x rows)."""
    parts = [groups[first : first + COLUMNS_AT_ONCE] for first in range(0, len(groups), COLUMNS_AT_ONCE)]
    out = [np.zeros((len(p), len(by_item), n_answers + 1), np.int64) for p in parts]
    for k, found in weighed_answers(by_item, n_answers, [lambda rows, p=p: p[:, rows].astype(np.float32) for p in parts]):
        out[k] += found
    return np.concatenate(out)


def sums_over(values: np.ndarray, rows: np.ndarray, flags: np.ndarray) -> float:
    """Sum over some rows, given as numbers and as flags: a product, unless what other rows hold is no number."""
    total = float(values @ rows)
    return total if np.isfinite(total) else float(values[flags].sum())


def all_losses(quantiles: np.ndarray, models: list[int], residuals) -> list[np.ndarray]:
    """Training rows, their loss, held-out rows and their loss, per model."""
    out, numbers = [], {}
    for m in models:
        residual, train, held = residuals(m)
        loss = quantiles[m] * residual
        np.maximum(loss, (quantiles[m] - 1) * residual, out=loss)
        found = []
        for side in (train, held):
            if id(side) not in numbers:  # models of a fold share their flags
                numbers[id(side)] = side.sum(), side.astype(np.float64), side
            n, rows, _ = numbers[id(side)]
            found += [n, sums_over(loss, rows, side)]
        out.append(np.array(found))
    return out


def with_losses(g: Grower, quantiles: np.ndarray, depth: int):
    """Counting function: losses (at the root only), then counts of (left child, item, bin, above) of a level; the root counts as one."""
    n_answers, n_items, lefts = n_bins(g.spec) - 1, g.spec.n_items, max(1, (1 << depth) // 2)
    at_once = max(1, COLUMNS_AT_ONCE // lefts)

    def count(by_item, models, residuals, nodes_of):
        nodes, weight = [], np.empty((len(models), by_item.shape[1]), np.float32)
        for k, m in enumerate(models):
            residual, train, _ = residuals(m)
            nodes.append(nodes_of(m, depth) | (~train).view(np.uint8))  # left children are even, other rows are made odd
            np.multiply(residual > 0, np.float32(1 << ABOVE_BITS), out=weight[k])
        weight += 1
        node = np.stack(nodes)
        even = np.arange(0, 2 * lefts, 2, dtype=node.dtype)[:, None]

        def columns(first: int) -> Callable[[slice], np.ndarray]:
            some = slice(first, first + at_once)
            return lambda rows: ((node[some, None, rows] == even) * weight[some, None, rows]).reshape(-1, rows.stop - rows.start)

        starts = range(0, len(models), at_once)
        counts = [np.zeros((2, len(models[first : first + at_once]) * lefts, n_items, n_answers + 1), np.int64) for first in starts]
        for k, found in weighed_answers(by_item, n_answers, [columns(first) for first in starts]):
            counts[k][0] += found & ((1 << ABOVE_BITS) - 1)
            counts[k][1] += found >> ABOVE_BITS
        losses = all_losses(quantiles, models, residuals) if depth == 0 else [np.zeros(0)] * len(models)
        for k, m in enumerate(models):
            rows, above = counts[k // at_once].reshape(2, -1, lefts, n_items, n_answers + 1)[:, k % at_once]
            yield m, losses[k], np.stack([rows - above, above], axis=-1).ravel()

    return count


def grow_tree(g: Grower, tree: int, active: list[int], quantiles: np.ndarray, root: dict[int, np.ndarray], span: float) -> None:
    """Grow one tree per active model, a level per pass, and set its leaves."""
    f, width = g.forest, n_bins(g.spec)
    parents: dict[int, np.ndarray] = {}
    for depth in range(g.depth):
        deep = [m for m in active if depth < g.jobs[m].growth.depth]
        counts = root if depth == 0 else g.counted(with_losses(g, quantiles, depth), deep, tree)
        for m in deep:
            if m not in counts:
                continue
            lefts = counts[m][0 if depth else 4 :].reshape(-1, 1, g.spec.n_items, width, 2)
            levels = np.concatenate([lefts, parents[m][:, None] - lefts], axis=1).reshape(1 << depth, *lefts.shape[2:]) if depth else lefts[:, 0]
            parents[m] = levels
            first = (1 << depth) - 1
            for k, (item, mask) in enumerate(best_splits(levels, quantiles[m], g.jobs[m].growth.min_leaf)):
                f.items[m, tree, first + k], f.masks[m, tree, first + k] = item, mask
    leaves, depth = 1 << g.depth, g.depth

    def count(by_item, models, residuals, nodes):
        for m in models:
            residual, train, _ = residuals(m)
            cell = nodes(m, depth).astype(np.int64)
            cell[~train] = leaves  # counted aside
            cell *= CLASSES
            cell += residual_classes(residual, span)
            yield m, np.zeros(0), np.bincount(cell, minlength=(leaves + 1) * CLASSES)[: leaves * CLASSES]

    found = g.counted(count, active, tree)
    for m in active:
        if m in found:
            by_leaf = found[m].reshape(leaves, CLASSES)
            f.leaves[m, tree] = [g.jobs[m].growth.rate * class_quantile(c, quantiles[m], span) for c in by_leaf]


def best_splits(levels: np.ndarray, quantile: float, min_leaf: int) -> list[tuple[int, int]]:
    """(item, mask of the bins that go left) per node; (0, all bins) where no split is worth it.

    ``levels``: node x item x bin x (below, above). The gain is that of squared error on the loss's gradient, which is ``quantile``
    above the prediction and ``quantile`` - 1 below. Missing answers, the last bin, go to the better side.
    """
    rows = levels.sum(axis=3)
    gradient = quantile * levels[..., 1] + (quantile - 1) * levels[..., 0]
    answered_n, answered_g = np.cumsum(rows[..., :-1], axis=2), np.cumsum(gradient[..., :-1], axis=2)
    total_n, total_g = rows.sum(axis=2), gradient.sum(axis=2)
    width = rows.shape[2]
    options = []  # last answer that goes left, whether missing goes left
    for missing_left in (False, True):
        left_n = answered_n + (rows[..., -1:] if missing_left else 0)
        left_g = answered_g + (gradient[..., -1:] if missing_left else 0)
        right_n, right_g = total_n[..., None] - left_n, total_g[..., None] - left_g
        fair = (left_n >= min_leaf) & (right_n >= min_leaf)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_g**2 / left_n + right_g**2 / right_n - (total_g**2 / total_n)[..., None]
        options.append(np.where(fair, gain, -1.0))
    gains = np.stack(options, axis=-1)
    flat = gains.reshape(len(gains), -1)
    pick = flat.argmax(axis=1)
    out = []
    for node, at in enumerate(pick.tolist()):
        if flat[node, at] <= 1e-9:
            out.append((0, (1 << width) - 1))
            continue
        item, last, missing_left = np.unravel_index(at, gains.shape[1:])
        out.append((int(item), (1 << (int(last) + 1)) - 1 | (int(missing_left) << (width - 1))))
    return out


def predictions(df: DataFrame, fitted: Fitted, spec: ScaleSpec) -> Column:
    """Array of all models' predictions, clipped to the scale: one function over a broadcast forest."""
    shared = df.sparkSession.sparkContext.broadcast(fitted.forest)
    n_items, lo, hi = spec.n_items, spec.lo, spec.hi

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forest = shared.value
        for batch in batches:
            out = np.clip(forest.predict(matrix(batch, n_items, np.uint8)), lo, hi)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))

    return F.arrow_udf(run, "array<double>")(binned(spec))


def predicted(df: DataFrame, fitted: Fitted, spec: ScaleSpec, column: str = "__raw") -> tuple[DataFrame, dict[tuple[str, str], Column]]:
    """The table with all predictions, and the expression of each (domain, quantile)."""
    return df.withColumn(column, predictions(df, fitted, spec)), {(j.domain, j.quantile): F.get(column, F.lit(n)) for n, j in enumerate(fitted.jobs)}


def history_rows(fitted: Fitted) -> list[tuple[str, str, int, float, float | None]]:
    return [(fitted.jobs[m].domain, fitted.jobs[m].quantile, n, loss, held) for m, n, loss, held in fitted.history]


def masked_predictions(df: DataFrame, fitted: Fitted, spec: ScaleSpec, draw, hashes: Sequence[Column], ordered: bool = True) -> Column:
    """Array (one per mask) of arrays (one per model) of predictions under masks drawn in the same task.

    ``draw`` gives the kept answers (rows x items) of a batch of row hashes; ``hashes`` has a column per mask. No copy of the table is made.
    """
    shared = df.sparkSession.sparkContext.broadcast(fitted.forest)
    n_items, lo, hi, missing, passes = spec.n_items, spec.lo, spec.hi, n_bins(spec) - 1, len(hashes)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        forest = shared.value
        for answers, seeds in batches:
            bins, seed = matrix(answers, n_items, np.uint8), matrix(seeds, passes, np.int64)
            found = [np.clip(forest.predict(np.where(draw(seed[:, p]), bins, missing).astype(np.uint8)), lo, hi) for p in range(passes)]
            out = np.stack(found, axis=1)  # rows x masks x models
            inner = pa.ListArray.from_arrays(pa.array(np.arange(len(bins) * passes + 1) * out.shape[2], pa.int32()), pa.array(out.ravel()))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(bins) + 1) * passes, pa.int32()), inner)

    return F.arrow_udf(run, "array<array<double>>")(binned(spec), F.array(*hashes))


SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "se", "see", "w5", "w10", "inside")


def cell_sums(df: DataFrame, fitted: Fitted, spec: ScaleSpec, selections: dict[tuple[str, int], Sequence[str]], norms: dict[str, tuple[float, float]], spread: float) -> DataFrame:
    """Sums per (method, k, domain, scoring) of how models and plain averages score each selection of items.

    ``selections``: (method, k) -> items that stay answered, each a bit mask over the answers; ``df`` has complete answers. The models see the other
    answers as missing; averages take the mean of a domain's selected items (the 50th percentile without any) and
    ``spread`` to both sides. All selections are scored in one pass over the rows; a task hands on the sums only, centred on 50.
    """
    from scalemetrics.functions.normal import normal_cdf_array

    names = list(selections)
    keep = np.array([[i in set(selections[c]) for i in spec.items] for c in names], bool).reshape(len(names), spec.n_items)
    home = np.array([[spec.domain_of[i] == d for i in spec.items] for d in spec.domains], bool)
    mean, sd = (np.array([norms[d][k] for d in spec.domains]) for k in (0, 1))
    models = {(j.domain, j.quantile): n for n, j in enumerate(fitted.jobs)}
    columns = np.array([[models[d, q] for d in spec.domains] for q in QUANTILES])
    shared = df.sparkSession.sparkContext.broadcast(fitted.forest)
    n_items, lo, hi, missing, domains = spec.n_items, spec.lo, spec.hi, n_bins(spec) - 1, list(spec.domains)

    def percentile(raw: np.ndarray) -> np.ndarray:
        return np.clip(100 * normal_cdf_array((raw - mean) / sd), 0, 100)

    def sums(true: np.ndarray, low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Domains x SUMS."""
        low, mid, high = np.sort(np.stack([low, mid, high]), axis=0)
        x, y, e = true - 50, mid - 50, np.abs(true - mid)
        one = np.ones_like(x)
        return np.stack([v.sum(axis=0) for v in (one, x, y, x * x, y * y, x * y, e, e * e, e <= 5, e <= 10, (true >= low) & (true <= high))], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        total = np.zeros((len(names), 2, len(domains), len(SUMS)))
        for batch in batches:
            bins = matrix(batch.column("bins"), n_items, np.uint8)
            if (bins == missing).any():
                raise ValueError("selections are scored on complete answers")
            true = matrix(batch.column("true"), len(domains), np.float64)
            for c in range(len(names)):
                raw = np.clip(forest.predict(np.where(keep[c], bins, missing).astype(np.uint8)), lo, hi)
                total[c, 0] += sums(true, *(percentile(raw[:, columns[q]]) for q in range(3)))
                picked = (home & keep[c]).astype(np.float64)
                count = picked.sum(axis=1)
                average = (bins.astype(np.float64) + lo) @ picked.T / np.maximum(count, 1)
                total[c, 1] += sums(true, *(np.where(count > 0, percentile(average + s * spread), 50.0) for s in (-1, 0, 1)))
        where = [(c, s, d) for c in range(len(names)) for s in range(2) for d in range(len(domains))]
        key = {"method": [names[c][0] for c, _, _ in where], "k": [names[c][1] for c, _, _ in where], "domain": [domains[d] for _, _, d in where]}
        arrays = [pa.array(key["method"], pa.string()), pa.array(key["k"], pa.int32()), pa.array(key["domain"], pa.string()), pa.array([("model", "average")[s] for _, s, _ in where])]
        yield pa.RecordBatch.from_arrays(arrays + [pa.array(total[..., k].ravel()) for k in range(len(SUMS))], names=["method", "k", "domain", "scoring", *SUMS])

    true = F.array(*[F.col(f"{d}_percentile") for d in spec.domains])
    schema = "method string, k int, domain string, scoring string, " + ", ".join(f"{s} double" for s in SUMS)
    parts = df.select(binned(spec).alias("bins"), true.alias("true")).mapInArrow(run, schema)
    return parts.groupBy("method", "k", "domain", "scoring").agg(*[F.sum(s).alias(s) for s in SUMS])


def cell_metrics(sums: DataFrame, overall: bool = True) -> DataFrame:
    """(method, k, scoring, domain) with n, r, MAE, RMSE, within-5, within-10 and coverage; domain ``overall`` over all of them.

    A constant prediction has no r.
    """
    keys = [F.col(c) for c in ("method", "k", "scoring")]
    sets = [[*keys, F.col("domain")], keys] if overall else [[*keys, F.col("domain")]]
    g = sums.groupingSets(sets, *keys, F.col("domain")).agg(*[F.sum(s).alias(s) for s in SUMS])
    n, x, y = F.col("n"), F.col("sx"), F.col("sy")
    vx, vy = n * F.col("sxx") - x * x, n * F.col("syy") - y * y
    # rounding leaves a constant column with a variance next to 0
    flat = (vx <= 1e-9 * n * n) | (vy <= 1e-9 * n * n)
    share = lambda c: F.try_divide(F.col(c), n)
    return g.select(
        "method", "k", "scoring", F.coalesce("domain", F.lit("overall")).alias("domain"), n.cast("long").alias("n"),
        F.when(~flat, (n * F.col("sxy") - x * y) / F.sqrt(vx * vy)).alias("pearson_r"), share("se").alias("mae"), F.sqrt(share("see")).alias("rmse"),
        share("w5").alias("within_5_pct"), share("w10").alias("within_10_pct"), share("inside").alias("coverage_90"),
    )


def scoring_deltas(metrics: DataFrame) -> DataFrame:
    """Models next to averages: r, MAE and within-5 of both and their differences, per (method, k, domain)."""
    names = {"r": "pearson_r", "mae": "mae", "within_5": "within_5_pct"}
    of = lambda c, s: F.max(F.when(F.col("scoring") == s, F.col(c)))
    out = metrics.groupBy("method", "k", "domain").agg(*[of(c, s).alias(f"{n}_{s}") for n, c in names.items() for s in ("model", "average")])
    return out.withColumns({f"delta_{n}": F.col(f"{n}_model") - F.col(f"{n}_average") for n in names})
