"""Missing-answer masks: which items of a row stay answered.

A mask depends only on the row's hash, so there is no shuffle and a retried task
draws the same mask.  One Arrow function takes the 8-byte hash of each row and
returns the kept items as a few words of flags, vectorised over the batch: sorting some
hundred draws per row with array expressions costs about twenty times as much.
Answers never leave the JVM; they are blanked by comparing flags.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scalemetrics.functions.draws import expand, row_hash
from scalemetrics.operators.strata import take_share
from scalemetrics.spec import ScaleSpec

# Shares of (short balanced, short form, medium balanced, long balanced, imbalanced).
SHARES = (0.50, 0.10, 0.25, 0.15, 0.0)
SHARES_IMBALANCED = (0.40, 0.10, 0.20, 0.15, 0.15)
# Fixed values: (items per domain, fewest, most) of the three balanced buckets.
BUCKETS = ((2, 10, 20), (4, 21, 35), (4, 36, 50))
# Draws 1..5 of a row decide counts and kinds; then come one per domain for the order of
# the domains, one per domain for the items inside it, and two per item.
N_SCALAR = 5
FLAGS = 62  # per word of a row's flags


def bucket_shares(short_form: bool, with_imbalanced: bool) -> tuple[float, ...]:
    """Bucket probabilities; without the short form its share goes to the balanced buckets."""
    shares = SHARES_IMBALANCED if with_imbalanced else SHARES
    if short_form:
        return shares
    rest = shares[0] + shares[2] + shares[3]
    grow = (1.0 - shares[4]) / rest
    return (shares[0] * grow, 0.0, shares[2] * grow, shares[3] * grow, shares[4])


@dataclass(frozen=True)
class MaskPlan:
    """Which mask to draw: bucketed wins over balanced, balanced over weighted."""

    focused: bool = False
    balanced: bool = True
    per_domain: int = 4
    lo: int | None = None  # 20, or 8 for a weighted mask
    hi: int | None = None  # 40
    short_form: bool = True
    with_imbalanced: bool = False
    only_imbalanced: bool = False


def _place(values: np.ndarray) -> np.ndarray:
    """0-based place of every entry in the ascending order of its row (last axis)."""
    return values.argsort(axis=-1, kind="stable").argsort(axis=-1, kind="stable")


def _between(u: np.ndarray, lo, hi) -> np.ndarray:
    return lo + np.floor(u * (np.asarray(hi) - lo + 1)).astype(np.int64)


class MaskDraws:
    """The draws of a batch of rows and the masks made from them (rows x items)."""

    def __init__(self, hashes: np.ndarray, ranks: np.ndarray, n_domains: int):
        n_items = len(ranks)
        u = expand(hashes[:, None], np.arange(1, N_SCALAR + 2 * n_domains + 2 * n_items + 1)[None, :])
        cut = np.cumsum([N_SCALAR, n_domains, n_domains, n_items])
        scalars, by_domain, self.inside, uniform, fill = np.split(u, cut, axis=1)
        self.count, self.bucket, self.kind, self.hit, self.other = scalars.T
        self.ranks, self.n_domains, self.width = ranks, n_domains, n_items // n_domains
        self.uniform = uniform
        # an exponential race: the smallest k are k draws without replacement, weight 1 / (rank + 1)
        self.race = -np.log(fill) * (ranks + 1)
        self.domain_place = _place(by_domain)
        self.place_in_domain = _place(uniform.reshape(len(u), n_domains, self.width)).reshape(uniform.shape)

    def _per_item(self, by_domain: np.ndarray) -> np.ndarray:
        return np.repeat(by_domain, self.width, axis=1)

    def weighted(self, lo: int = 8, hi: int = 40) -> np.ndarray:
        """K items drawn with weights 1 / (rank + 1)."""
        return _place(self.race) < _between(self.count, lo, min(hi, len(self.ranks)))[:, None]

    def balanced(self, per_domain, lo, hi) -> np.ndarray:
        """Some random items of every domain, then a weighted fill up to K."""
        per_domain = np.broadcast_to(per_domain, self.count.shape)
        first = self.place_in_domain < per_domain[:, None]
        spare = np.maximum(0, _between(self.count, lo, hi) - per_domain * self.n_domains)
        return first | (_place(np.where(first, np.inf, self.race)) < spare[:, None])

    def imbalanced(self) -> np.ndarray:
        """Patterns that may leave a domain empty: top of the ranking, dropped domains, loaded domains."""
        top = self.ranks[None, :] <= _between(self.other, 5, 25)[:, None]
        dropped = self._per_item(self.domain_place < np.where(self.hit < 0.6, 1, 2)[:, None])
        skewed = ~dropped & (_place(np.where(dropped, np.inf, self.uniform)) < _between(self.other, 5, 20)[:, None])
        heavy = self.domain_place < np.where(self.hit < 0.4, 1, 2)[:, None]
        amount = np.where(heavy, _between(self.inside, 6, 8), _between(self.inside, 0, 1))
        loaded = self.place_in_domain < self._per_item(amount)
        kind = self.kind[:, None]
        return np.where(kind < 0.5, top, np.where(kind < 0.8, skewed, loaded))

    def bucketed(self, shares: tuple[float, ...], short: np.ndarray) -> np.ndarray:
        """Mixture of balanced masks of three lengths, the short form and imbalanced patterns."""
        edges = [sum(shares[: n + 1]) for n in range(len(shares))]
        length = np.where(self.bucket < edges[0], 0, np.where(self.bucket < edges[2], 1, 2))
        settings = np.array(BUCKETS)[length]
        out = self.balanced(settings[:, 0], settings[:, 1], settings[:, 2])
        if shares[1]:
            out[(self.bucket >= edges[0]) & (self.bucket < edges[1])] = short
        if shares[4]:
            odd = self.bucket >= edges[3]
            out[odd] = self.imbalanced()[odd]
        return out


def drawn_by(spec: ScaleSpec, ranks: Mapping[str, int], plan: MaskPlan) -> Callable[[np.ndarray], np.ndarray]:
    """Function from the hashes of some rows to their masks (rows x items, true: stays answered)."""
    rank_of = np.array([ranks[i] for i in spec.items], dtype=np.int64)
    short = np.array([i in spec.short_items for i in spec.items])
    n_domains = len(spec.domains)
    shares = bucket_shares(plan.short_form and bool(spec.short_items), plan.with_imbalanced)
    lo = plan.lo if plan.lo is not None else 20 if plan.balanced else 8
    hi = plan.hi if plan.hi is not None else 40

    def draw(hashes: np.ndarray) -> np.ndarray:
        d = MaskDraws(hashes, rank_of, n_domains)
        if plan.only_imbalanced:
            return d.imbalanced()
        if plan.focused:
            return d.bucketed(shares, short)
        return d.balanced(plan.per_domain, lo, min(hi, len(rank_of))) if plan.balanced else d.weighted(lo, hi)

    return draw


def kept_flags(hashes: Column, spec: ScaleSpec, ranks: Mapping[str, int], plan: MaskPlan) -> Column:
    """Words of FLAGS flags each: bit b of word w tells whether item number w * FLAGS + b + 1 stays answered."""
    draw, n_words = drawn_by(spec, ranks, plan), -(-spec.n_items // FLAGS)
    bits = np.zeros((spec.n_items, n_words), np.int64)
    number = np.arange(spec.n_items)
    bits[number, number // FLAGS] = np.left_shift(np.int64(1), number % FLAGS)

    def flags(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for h in batches:
            words = draw(h.to_numpy()).astype(np.int64) @ bits
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * n_words, pa.int32()), pa.array(words.ravel()))

    return F.arrow_udf(flags, "array<bigint>")(hashes)


def with_mask(df: DataFrame, spec: ScaleSpec, ranks: Mapping[str, int], plan: MaskPlan, key: str = "respondent_id", seed: int | Column = 42) -> DataFrame:
    """Add ``kept``: flags of the items that stay answered."""
    return df.withColumn("kept", kept_flags(row_hash(seed, F.col(key)), spec, ranks, plan))


def is_kept(spec: ScaleSpec, item: str) -> Column:
    word, bit = divmod(spec.item_no[item] - 1, FLAGS)
    return F.get("kept", F.lit(word)).bitwiseAND(F.lit(1 << bit)) != 0


def apply_mask(df: DataFrame, spec: ScaleSpec) -> DataFrame:
    """Set the items outside ``kept`` missing."""
    return df.withColumns({i: F.when(is_kept(spec, i), F.col(i)) for i in spec.items})


def multi_pass(df: DataFrame, spec: ScaleSpec, ranks: Mapping[str, int], plan: MaskPlan, passes: int = 3, key: str = "respondent_id", seed: int = 42) -> DataFrame:
    """Every row once per pass, each with its own mask; targets travel with the row."""
    repeated = df.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    return with_mask(repeated, spec, ranks, plan, key, F.col("pass") + seed)


def hold_out_then_mask(
    df: DataFrame, spec: ScaleSpec, ranks: Mapping[str, int], plan: MaskPlan, passes: int = 3, share: float = 0.15,
    stratum: str = "split_stratum", key: str = "respondent_id", seed: int = 42,
) -> DataFrame:
    """Choose the early-stopping rows first, then mask both sides: no respondent is on both.

    The held-out rows are masked once, the others once per pass.
    """
    marked = take_share(df, stratum, key, share, seed, "held_out")
    n = F.when(F.col("held_out"), 0).otherwise(passes - 1)
    repeated = marked.withColumn("pass", F.explode(F.sequence(F.lit(0), n)))
    return with_mask(repeated, spec, ranks, plan, key, F.col("pass") + seed)


def kept_names(spec: ScaleSpec) -> Column:
    """Names of the kept items, comma-separated in layout order."""
    return F.concat_ws(",", *[F.when(is_kept(spec, i), F.lit(i)) for i in spec.items])


def n_kept() -> Column:
    return F.aggregate("kept", F.lit(0), lambda n, word: n + F.bit_count(word))
