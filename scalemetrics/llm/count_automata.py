"""Counts of word n-grams as weighted acyclic automata.

An automaton accepts n-grams word by word. States with equal continuations are shared, so it is minimal; each arc weighs
the number of accepted n-grams that come before it from its state, so the weights along an n-gram add up to its rank
in sorted order, and the counts stand in an array by rank. Words are ordered by their bytes, n-grams word by
word, a beginning before its continuations.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np

ORDER = 4  # longest n-gram; shorter ones are filled up with NONE
NONE = -1

# What a row holds of an automaton; the weights follow from it.
STORED = ("words", "sizes", "accepts", "labels", "targets", "counts")


def packed_words(words: list[bytes]) -> bytes:
    """Words (of one byte at least and without white space) as compressed bytes: sorted ones share much with their neighbours."""
    return zlib.compress(b" ".join(words), 1)


def unpacked_words(data: bytes) -> list[bytes]:
    return zlib.decompress(data).split()


def narrow(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on as bytes: the width of one, then all in the narrowest width."""
    kind = np.min_scalar_type(int(numbers.max(initial=0))) if numbers.dtype != bool else np.dtype("u1")
    return bytes([kind.itemsize]) + numbers.astype(kind.newbyteorder("<")).tobytes()


def wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


@dataclass(frozen=True)
class Automaton:
    """``words``: sorted labels. State s has the arcs ``offsets[s]`` to ``offsets[s + 1]``; the last state is the start."""

    words: list[bytes]
    offsets: np.ndarray
    accepts: np.ndarray
    labels: np.ndarray
    targets: np.ndarray
    weights: np.ndarray
    counts: np.ndarray

    def columns(self) -> dict[str, bytes]:
        """As values of a row."""
        arrays = {"sizes": np.diff(self.offsets)} | {n: getattr(self, n) for n in STORED[2:]}
        return {"words": packed_words(self.words)} | {n: narrow(a) for n, a in arrays.items()}

    @classmethod
    def of(cls, row: dict[str, object]) -> Automaton:
        sizes, accepts, labels, targets, counts = (wide(row[n]) for n in STORED[1:])
        offsets, accepts = np.concatenate([[0], np.cumsum(sizes)]), accepts > 0
        return cls(unpacked_words(row["words"]), offsets, accepts, labels, targets, arc_weights(offsets, accepts, targets), counts)

    @property
    def start(self) -> int:
        return len(self.offsets) - 2

    def paths(self) -> np.ndarray:
        """All accepted n-grams in order, as label rows of width ORDER; states are expanded level by level."""
        out = np.full((len(self.counts), ORDER), NONE, np.int32)
        states, ranks = np.array([self.start]), np.zeros(1, np.int64)
        rows = np.full((1, ORDER), NONE, np.int32)
        for depth in range(ORDER + 1):
            done = self.accepts[states]
            out[ranks[done]] = rows[done]
            sizes = self.offsets[states + 1] - self.offsets[states]
            if depth == ORDER or not sizes.sum():
                break
            arcs = places(self.offsets[states], sizes)
            rows = np.repeat(rows, sizes, axis=0)
            rows[:, depth] = self.labels[arcs]
            ranks = np.repeat(ranks, sizes) + self.weights[arcs]
            states = self.targets[arcs]
        return out

    def ranks_of(self, rows: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Ranks of n-grams given by labels over other ``words``; -1 for those it does not accept.

        This is the composition of the two: both walk the same words, arc by arc, for all n-grams at once.
        """
        own = {w: i for i, w in enumerate(self.words)}
        known = np.array([own.get(w, NONE) for w in words] + [NONE], np.int64)  # NONE maps to NONE
        base = len(self.words) + 1
        keys = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets)) * base + self.labels
        state, rank = np.full(len(rows), self.start), np.zeros(len(rows), np.int64)
        alive = np.ones(len(rows), bool)
        for depth in range(ORDER):
            go = rows[:, depth] != NONE
            label = known[rows[:, depth]]
            key = state * base + label
            arc = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            found = (label != NONE) & (keys[arc] == key) if len(keys) else np.zeros(len(rows), bool)
            alive &= ~go | found
            step = go & found & alive
            rank[step] += self.weights[arc[step]]
            state[step] = self.targets[arc[step]]
        return np.where(alive & self.accepts[state], rank, -1)


def built(rows: np.ndarray, counts: np.ndarray, words: list[bytes]) -> Automaton:
    """Minimal automaton of sorted, distinct n-grams over sorted ``words``.

    The rows that share a beginning are one run of the sorted rows. Runs are closed from the longest beginnings to the
    shortest, in order; a closed run becomes a state, or the equal one that the register already holds. Runs of a level are
    closed together and found by hash; each is compared with its state, and if hashes ever met by chance, others are taken.
    """
    used = np.flatnonzero(np.bincount(rows[rows != NONE]))
    new = np.full(len(words) + 1, NONE, np.int64)
    new[used] = np.arange(len(used))
    rows = new[rows]
    seed = 0
    while (states := minimal_states(rows, seed)) is None:
        seed += 1
    offsets, accepts, labels, targets = states
    return Automaton([words[i] for i in used], offsets, accepts, labels, targets, arc_weights(offsets, accepts, targets), counts)


def run_hashes(labels: np.ndarray, states: np.ndarray, starts: np.ndarray, accepts: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each run of arcs; the labels of a run are distinct and in order, so a sum tells runs apart."""
    factors = np.random.default_rng(seed).integers(0, 1 << 64, 3, np.uint64, endpoint=False) | np.uint64(1)
    x = (labels.astype(np.uint64) + np.uint64(1)) * factors[0] + states.astype(np.uint64) * factors[1]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return np.add.reduceat(x * factors[2], starts) + accepts.astype(np.uint64)


def minimal_states(rows: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(offsets, accepts, labels, targets) of the states of sorted, distinct rows; None if two different runs have one hash."""
    lengths = (rows != NONE).sum(axis=1)
    n = len(rows)
    differs = np.ones((n, ORDER + 1), bool)  # row differs from the one before within its first d labels
    differs[:, 0] = np.arange(n) == 0
    for d in range(1, ORDER + 1):
        differs[1:, d] = differs[1:, d - 1] | (rows[1:, d - 1] != rows[:-1, d - 1])
    offsets, accepts = np.zeros(2, np.int64), np.array([n > 0])  # the first state: without continuations
    kept_labels, kept_targets = np.empty(0, np.int64), np.empty(0, np.int64)
    register, registered = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted hashes and their states
    below_first, below_state = np.empty(0, np.int64), np.empty(0, np.int64)
    for depth in range(ORDER, -1, -1):
        first = np.flatnonzero(differs[:, depth] & (lengths >= depth))
        states = np.zeros(len(first), np.int64)
        if len(below_first):
            labels = rows[below_first, depth]
            cuts = np.searchsorted(below_first, np.append(first, n))
            inner = np.flatnonzero(cuts[1:] > cuts[:-1])  # their runs of arcs follow each other without gaps
            starts, sizes, ends = cuts[inner], np.diff(cuts)[inner], lengths[first[inner]] == depth
            found, example, which = np.unique(run_hashes(labels, below_state, starts, ends, seed), return_index=True, return_inverse=True)
            place = np.minimum(np.searchsorted(register, found), max(len(register) - 1, 0))
            held = register[place] == found if len(register) else np.zeros(len(found), bool)
            state_of = np.empty(len(found), np.int64)
            state_of[held] = registered[place[held]]
            fresh = np.flatnonzero(~held)
            fresh = fresh[np.argsort(example[fresh])]
            state_of[fresh] = len(accepts) + np.arange(len(fresh))
            run = example[fresh]
            arcs = places(starts[run], sizes[run])
            offsets = np.concatenate([offsets, offsets[-1] + np.cumsum(sizes[run])])
            accepts = np.concatenate([accepts, ends[run]])
            kept_labels, kept_targets = np.concatenate([kept_labels, labels[arcs]]), np.concatenate([kept_targets, below_state[arcs]])
            register, registered = np.concatenate([register, found[fresh]]), np.concatenate([registered, state_of[fresh]])
            order = np.argsort(register)
            register, registered = register[order], registered[order]
            of_run = state_of[which]
            if (offsets[of_run + 1] - offsets[of_run] != sizes).any() or (accepts[of_run] != ends).any():
                return None
            same = places(offsets[of_run], sizes)
            if (kept_labels[same] != labels).any() or (kept_targets[same] != below_state).any():
                return None
            states[inner] = of_run
        below_first, below_state = first, states
    return offsets, accepts, kept_labels, kept_targets


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of runs given by their starts and sizes, run after run."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def arc_weights(offsets: np.ndarray, accepts: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Number of accepted n-grams before each arc of its state, found for states with longer and longer continuations."""
    below = np.zeros(len(accepts), np.int64)
    while True:
        sums = np.concatenate([[0], np.cumsum(below[targets])])
        more = accepts + sums[offsets[1:]] - sums[offsets[:-1]]
        if (more == below).all():
            return sums[:-1] + np.repeat(accepts - sums[offsets[:-1]], np.diff(offsets))
        below = more


def united(parts: list[tuple[np.ndarray, np.ndarray, list[bytes]]], floor: int) -> Automaton:
    """Union of sorted n-grams with counts (rows, counts, words): counts of equal ones added, those below ``floor`` dropped.

    Of all n-grams only one copy of their labels is made, column by column; rows are formed for those that stay.
    """
    words = sorted(set(chain.from_iterable(p[2] for p in parts)))
    place = {w: i for i, w in enumerate(words)}
    labels = np.empty((ORDER, sum(len(p[0]) for p in parts)), np.int32)
    at = 0
    for rows, _, own in parts:
        new = np.array([place[w] for w in own] + [NONE], np.int32)
        for d in range(ORDER):
            np.take(new, rows[:, d], out=labels[d, at : at + len(rows)], mode="wrap")  # NONE is the last
        at += len(rows)
    return built(*summed(labels.T, np.concatenate([p[1] for p in parts]), floor), words)


def summed(rows: np.ndarray, counts: np.ndarray, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows and the sums of their counts; only rows that stay are copied."""
    if not len(rows):
        return rows, counts
    order = np.lexsort(rows.T[::-1])
    new = np.zeros(len(rows), bool)
    new[0] = True
    for column in rows.T:
        column = column[order]
        new[1:] |= column[1:] != column[:-1]
    first = np.flatnonzero(new)
    sums = np.add.reduceat(counts[order], first)
    keep = sums >= floor
    return rows[order[first[keep]]], sums[keep]


def grams(a: np.ndarray, orders: tuple[int, int], passes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams (label rows of width ORDER) of two consecutive ``orders`` and their counts in a run of labels.

    In the run 0 ends a piece and labels count from 1; rows hold labels from 0. An n-gram of three words or more counts only where
    each pair of its neighbours ``passes``. Each order is found from the one before: the number of an n-gram and the label behind
    its place are one key, which also sorts an n-gram before its continuations.
    """
    wide = np.int64(a.max(initial=0) + 1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, counts, keys
    index, rows, counts, distinct = a - 1, np.arange(1, wide, dtype=np.int32)[:, None], np.bincount(a, minlength=wide)[1:], None
    for order in range(1, orders[1] + 1):
        if order > 1:
            fits = (index[:-1] >= 0) & (a[order - 1 :] > 0)
            if order > 2:
                fits &= pair_passes[order - 2 : order - 2 + len(fits)]
            places = np.flatnonzero(fits)
            if order == 2 and orders[1] > 2:
                places = places[passes(np.stack([a[places], a[places + 1]], axis=1) - 1)]
                pair_passes = np.zeros(len(fits), bool)
                pair_passes[places] = True
            distinct, inverse, counts = np.unique(index[places] * wide + a[places + order - 1], return_inverse=True, return_counts=True)
            index = np.full(len(fits), -1)
            index[places] = inverse
            rows = np.concatenate([rows[distinct // wide], (distinct % wide).astype(np.int32)[:, None]], axis=1)
        if order == orders[0]:
            found.append((rows, counts, np.arange(len(rows)) * wide))
        elif order == orders[1]:
            found.append((rows, counts, distinct))
    order = np.argsort(np.concatenate([k for *_, k in found]), kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    out, at = np.full((len(order), ORDER), NONE, np.int32), 0
    for r, *_ in found:
        out[place[at : at + len(r)], : r.shape[1]] = r - 1
        at += len(r)
    return out, np.concatenate([c for _, c, _ in found])[order]
