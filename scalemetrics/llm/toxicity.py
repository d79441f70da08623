"""Toxicity by a classifier chain.

Categories are predicted one after the other by sparse linear models over hashed words and word beginnings, the
latter with the number of different words that share one.
The label table knows one category. Two kinds before it come from the labelled texts themselves: the features that weigh most
in a first model are parted into two groups by the toxic texts they share, and a toxic text with a feature of a group is of its kind.
Each model also sees the probabilities of the categories before it; in training these come from models that
have not seen the document (out-of-fold), so later models learn from predictions as good as they will get.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalemetrics.llm.common import draw, few_rows, of_worker, table, text_bytes, whole_texts
from scalemetrics.llm.pretokens import Memo
from scalemetrics.llm.registry import query

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6)
LEVELS = 3
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"
TRAIN_DOCS = 8_000
FOLDS = 3
THRESHOLD = 0.3

CATEGORIES = ("kind_1", "kind_2", "toxic")
TELLING = 128  # strongest features that are parted into the two kinds


def word_features(chunk: bytes) -> tuple[int, ...]:
    """A lower-cased word without signs: its hash as identity, then its features (the hash again and those of its
    beginnings). Signs alone give nothing."""
    word = chunk.strip(SIGNS)
    if not word:
        return ()
    text = word.decode("utf-8", "replace")
    own = zlib.crc32(word)
    return (own, own, *(zlib.crc32(b"^" + text[:n].encode()) for n in PREFIXES if len(text) > n))


def bag(words: set[tuple[int, ...]]) -> np.ndarray:
    """Features of a document from the features of its different words.

    A beginning shared by k words counts as k features, LEVELS at most, one per level.
    """
    seen = Counter(f for w in words for f in w[1:])
    return np.unique(np.fromiter((level_of(f, k) for f, n in seen.items() for k in range(min(n, LEVELS))), np.int32))


def level_of(feature: int, level: int) -> int:
    return (feature + 40_503 * level) % BUCKETS


@dataclass(frozen=True)
class Bags:
    """Distinct features of documents, one after the other, out of ``width`` different ones."""

    features: np.ndarray
    lengths: np.ndarray
    width: int = BUCKETS

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(self.lengths))
        full = np.flatnonzero(self.lengths)
        if len(full):
            sums[full] = np.add.reduceat(w[self.features], (np.cumsum(self.lengths) - self.lengths)[full])
        return sums

    def gradient(self, residual: np.ndarray) -> np.ndarray:
        return np.bincount(self.features, np.repeat(residual, self.lengths), self.width)

    def rows(self, keep: np.ndarray) -> Bags:
        return Bags(self.features[np.repeat(keep, self.lengths)], self.lengths[keep], self.width)

    def telling(self, least: int) -> tuple[Bags, np.ndarray]:
        """Without features of fewer than ``least`` documents, the others numbered from 0, and their old numbers; rows stay.
        Frequent ones stay, since a third of all rows may be copies of one toxic text: the L1 penalty drops those that tell nothing."""
        often = np.bincount(self.features, minlength=self.width) >= least
        used = np.flatnonzero(often)
        numbers = np.cumsum(often, dtype=np.int32) - 1
        keep = often[self.features]
        owner = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)[keep]
        return Bags(numbers[self.features[keep]], np.bincount(owner, minlength=len(self.lengths)), len(used)), used


@dataclass(frozen=True)
class Linear:
    words: np.ndarray
    earlier: np.ndarray
    bias: float

    def probability(self, bags: Bags, earlier: np.ndarray) -> np.ndarray:
        return sigmoid(bags.dot(self.words) + earlier @ self.earlier + self.bias)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(bags: Bags, earlier: np.ndarray, label: np.ndarray, rounds: int = 60, rate: float = 0.5, sparsity: float = 5e-4) -> Linear:
    """Logistic regression by proximal AdaGrad; the L1 penalty leaves weight only on words that matter, so the many
    ordinary words of a very long document do not add up. A word's steps are relative to its share of documents, so the
    frequent words, which move together, do not overshoot in the first rounds."""
    n = max(len(label), 1)
    share = np.clip(label.mean() if len(label) else 0.0, 1e-4, 1 - 1e-4)
    w, e, bias = np.zeros(bags.width), np.zeros(earlier.shape[1]), float(np.log(share / (1 - share)))
    sw, se, sb = 1e-8 + (np.bincount(bags.features, minlength=bags.width) / n) ** 2, np.full(earlier.shape[1], 1e-8), 1e-8
    for _ in range(rounds):
        r = (sigmoid(bags.dot(w) + earlier @ e + bias) - label) / n
        gw, ge, gb = bags.gradient(r), r @ earlier, float(r.sum())
        sw += gw * gw
        se += ge * ge
        sb += gb * gb
        step = rate / np.sqrt(sw)
        w -= step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparsity, 0)
        e -= rate / np.sqrt(se) * ge
        bias -= rate / np.sqrt(sb) * gb
    return Linear(w, e, bias)


def fit_chain(bags: Bags, labels: np.ndarray, fold: np.ndarray) -> list[Linear]:
    """One model per column of ``labels``, in order; ``fold`` numbers the part of each row for out-of-fold predictions."""
    chain: list[Linear] = []
    earlier = np.zeros((len(labels), 0))
    for k in range(labels.shape[1]):
        chain.append(fit_linear(bags, earlier, labels[:, k]))
        if k + 1 < labels.shape[1]:
            column = np.zeros(len(labels))
            for f in np.unique(fold):
                out = fold == f
                model = fit_linear(bags.rows(~out), earlier[~out], labels[~out, k])
                column[out] = model.probability(bags.rows(out), earlier[out])
            earlier = np.column_stack([earlier, column])
    return chain


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int, seed: str) -> DataFrame:
    """(key, text bytes, label) of at most ``most`` labelled documents, drawn by a hash of the id.

    The drawn ids are at most ``most`` rows, so they may be broadcast.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").alias("__id"), F.col(label).cast("double").alias("__label"))
    drawn = usable.withColumn("__draw", draw(seed, F.col("__id"))).orderBy("__draw", "__id", "__label").limit(most)
    return whole_texts(docs).join(F.broadcast(drawn), F.col("doc_id") == F.col("__id")).select("__draw", text_bytes().alias("__text"), "__label")


def kinds_of(bags: Bags, toxic: np.ndarray) -> np.ndarray:
    """Two columns of 0 and 1: which toxic texts are of which kind.

    The strongest features of a first model fall to one of two seeds, the strongest of all and, among those as frequent as the
    median, the one that shares the fewest texts with it; each other feature goes with the seed whose texts it shares more of. Without toxic texts
    or telling features nothing is of a kind, and the kinds' models know their bias only.
    """
    out = np.zeros((len(toxic), 2))
    weights = fit_linear(bags, np.zeros((len(toxic), 0)), toxic).words
    rows = np.flatnonzero(toxic)
    inside = bags.rows(toxic > 0)
    often = np.bincount(inside.features, minlength=bags.width)
    strength = np.maximum(weights, 0) * often
    strongest = np.argsort(-strength, kind="stable")[:TELLING]
    strongest = strongest[strength[strongest] > 0]
    if len(strongest) < 2:
        return out
    place = np.full(bags.width, -1, np.int32)
    place[strongest] = np.arange(len(strongest))
    owner = np.repeat(np.arange(len(rows)), inside.lengths)
    held = place[inside.features]
    texts = np.zeros((len(rows), len(strongest)), np.float32)
    texts[owner[held >= 0], held[held >= 0]] = 1
    alike = texts.T @ texts
    alike /= np.sqrt(np.outer(alike.diagonal(), alike.diagonal()))
    frequent = often[strongest] >= np.median(often[strongest])
    frequent[0] = False
    other = int(np.where(frequent, alike[0], np.inf).argmin()) if frequent.any() else 1
    second = alike[other] > alike[0]
    for k, group in enumerate((~second, second)):
        out[rows[texts[:, group].any(axis=1)], k] = 1
    return out


MODELS = "category int, bias double, earlier array<double>, used array<int>, weights array<double>"


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, folds: int = FOLDS) -> list[Linear]:
    """Chain kind_1 -> kind_2 -> toxic from at most ``train_docs`` labelled documents.

    The features of these texts, bounded in number, meet in one task, which fits the chain; only its weights come to the
    driver. A document with two label rows counts twice; null labels and ids are left out. Without labelled documents, or
    without positives of a category, its model is a small bias.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(word_features, 200_000)
        for batch in few_rows(batches):
            lists = [bag({memo[x] for x in t.as_py().lower().split()}) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lists, pa.list_(pa.int32()))], names=["draw", "label", "features"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        rows = pa.Table.from_batches(got).sort_by([("draw", "ascending"), ("label", "ascending")])
        lists = rows.column("features").combine_chunks()
        bags = Bags(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64))
        toxic, fold = rows.column("label").to_numpy(), rows.column("draw").to_numpy() % folds
        del got, rows, lists
        bags, used = bags.telling(3)
        chain = fit_chain(bags, np.column_stack([kinds_of(bags, toxic), toxic]), fold)
        out = {"category": list(range(len(chain))), "bias": [m.bias for m in chain], "earlier": [m.earlier for m in chain]}
        kept = [np.flatnonzero(m.words) for m in chain]
        out |= {"used": [used[k] for k in kept], "weights": [m.words[k] for m, k in zip(chain, kept)]}
        types = [pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    texts = labelled_texts(docs, labels, "toxic", train_docs, "toxicity")
    bags = texts.mapInArrow(features, "draw long, label double, features array<int>")
    fitted = bags.repartition(1).mapInArrow(fit, MODELS).collect()
    chain = [Linear(np.zeros(BUCKETS), np.zeros(k), -9.2) for k in range(len(CATEGORIES))]
    for r in fitted:
        chain[r.category].words[r.used] = r.weights
        chain[r.category] = Linear(chain[r.category].words, np.array(r.earlier), r.bias)
    return chain


def with_probabilities(docs: DataFrame, chain: Sequence[Linear], names: Sequence[str]) -> DataFrame:
    """Add a struct ``__p`` of p_<category> for each category to the documents."""
    used = np.flatnonzero(np.any([m.words != 0 for m in chain], axis=0))
    weights = np.array([m.words[used] for m in chain])
    dense = [(m.earlier, m.bias) for m in chain]
    shared = docs.sparkSession.sparkContext.broadcast({"place": {int(f): n for n, f in enumerate(used)}, "weights": weights})
    columns = [f"p_{n}" for n in names]
    key = uuid.uuid4().hex

    def memo() -> Memo:
        known = shared.value["place"]
        has_weight = lambda f: any(level_of(f, k) in known for k in range(LEVELS))

        def weighty(chunk: bytes) -> tuple[int, ...]:
            own = word_features(chunk)
            features = tuple(filter(has_weight, own[1:]))
            return own[:1] + features if features else ()

        return Memo(weighty, 400_000)

    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lookup, w, place = of_worker(key, memo).__getitem__, shared.value["weights"], shared.value["place"]
        for batch in texts:
            out = np.empty((len(batch), len(dense)))
            for row, t in enumerate(batch.to_pylist()):
                features = bag(set(map(lookup, t.lower().split())))
                found = [i for f in features.tolist() if (i := place.get(f)) is not None]
                sums = w[:, found].sum(axis=1)
                for k, (earlier, bias) in enumerate(dense):
                    out[row, k] = sigmoid(sums[k] + out[row, :k] @ earlier + bias)
            yield pa.StructArray.from_arrays([pa.array(out[:, k]) for k in range(len(dense))], names=columns)

    predicted = F.arrow_udf(predict, ", ".join(f"{c} double" for c in columns))
    return whole_texts(docs).withColumn("__p", predicted(text_bytes()))


def score(docs: DataFrame, chain: Sequence[Linear], names: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """Add p_<category> for each category and ``toxic`` (last probability >= threshold) to the documents.

    Whole texts are read. Null and blank texts have no words, so the bias alone decides. Existing columns of these
    names are replaced; repeated rows are scored each.
    """
    columns = [f"p_{n}" for n in names]
    added = {c: F.col(f"__p.{c}") for c in columns} | {"toxic": F.col(f"__p.{columns[-1]}") >= threshold}
    return with_probabilities(docs, chain, names).withColumns(added).drop("__p")


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the chain does not call toxic, with their own columns."""
    scored = with_probabilities(docs, train(docs, labels), CATEGORIES)
    return scored.filter(F.col(f"__p.p_{CATEGORIES[-1]}") < threshold).drop("__p")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), chain, CATEGORIES).drop("text")
