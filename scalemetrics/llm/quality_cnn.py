"""Quality of whole texts by a byte-level convolutional network in numpy.

Every text is cut into overlapping chunks that cover it to the end. Each byte of a chunk is embedded, next to a
few repetition channels (whether the byte equals the one a given distance before it), learned filters read the
chunk, the largest response of each filter over all chunks is kept, and a logistic unit turns these maxima into
one probability. Training uses a bounded number of labelled texts, scoring reads every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scalemetrics.llm.common import ROWS_PER_BATCH, draw, table, text_bytes, whole_texts
from scalemetrics.llm.registry import query

GROUP, GROUPS = 8, 3  # a chunk is three groups of eight bytes; the next chunk starts one group later
WIDTH, DIMS, FILTERS = GROUP * GROUPS, 4, 16
#: Distances of the repetition channels; each channel counts, in a chunk, the bytes equal to those so far before.
LAGS = tuple(range(3, 25))
AHEAD = -(-max(LAGS) // GROUP)
TRAIN_PER_LABEL = 1_000
STEPS, BATCH, RATE = 480, 32, 0.006
THRESHOLD = 0.3
GROUPS_AT_ONCE = 1 << 17


@dataclass
class Network:
    embedding: np.ndarray  # bytes x DIMS
    kernel: np.ndarray  # GROUPS x (GROUP * DIMS) x FILTERS
    repeats: np.ndarray  # lags x FILTERS
    shift: np.ndarray  # FILTERS
    out: np.ndarray  # FILTERS
    bias: np.ndarray  # 1

    @staticmethod
    def start(seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        n = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return Network(
            n(256, DIMS, scale=0.5), n(GROUPS, GROUP * DIMS, FILTERS, scale=(WIDTH * DIMS) ** -0.5), n(len(LAGS), FILTERS, scale=0.2),
            np.zeros(FILTERS, np.float32), n(FILTERS, scale=0.1), np.zeros(1, np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]


@dataclass(frozen=True)
class Chunks:
    """Bytes of some texts, one after the other, each padded to whole chunks and after ``AHEAD`` empty groups, so that the
    longest lag stays inside; ``starts`` is the first of each text's empty groups."""

    data: np.ndarray  # room for the longest lag, then the texts
    starts: np.ndarray
    groups: int

    @staticmethod
    def of(texts: list[bytes]) -> Chunks:
        counts = [max(GROUPS, -(-len(t) // GROUP)) for t in texts]
        padded = b"".join(bytes(AHEAD * GROUP) + t.ljust(c * GROUP, b"\0") for t, c in zip(texts, counts))
        ends = np.cumsum([0, *(c + AHEAD for c in counts)])
        return Chunks(np.frombuffer(bytes(max(LAGS)) + padded, np.uint8), ends[:-1], int(ends[-1]))

    def bytes_from(self, first: int, last: int, lag: int = 0) -> np.ndarray:
        """Bytes of the groups first .. last - 1, or those ``lag`` bytes before."""
        return self.data[first * GROUP + max(LAGS) - lag : last * GROUP + max(LAGS) - lag]

    def blocks(self, net: Network) -> Iterator[tuple[int, np.ndarray]]:
        """(first chunk, responses) of all chunks in blocks; chunks that reach into the next text or begin before their own respond with -inf."""
        ends = np.append(self.starts[1:], self.groups)[:, None] - np.arange(1, GROUPS)
        across = np.setdiff1d(np.append(ends, self.starts[:, None] + np.arange(AHEAD)), -1)
        kernel = np.concatenate(list(net.kernel), axis=1)
        for first in range(0, self.groups, GROUPS_AT_ONCE):
            last = min(first + GROUPS_AT_ONCE, self.groups)
            end = min(last + GROUPS - 1, self.groups)
            own = self.bytes_from(first, end)
            parts = np.take(net.embedding, own, axis=0).reshape(-1, GROUP * DIMS) @ kernel
            same = np.stack([np.bitwise_count((own == self.bytes_from(first, end, lag)).view(np.uint64)) for lag in LAGS], axis=1)
            repeats = same.astype(np.float32) @ (net.repeats * (2 / WIDTH))
            h = np.full((last - first, FILTERS), -np.inf, np.float32)
            rows = len(own) // GROUP - GROUPS + 1
            if rows > 0:
                h[:rows] = sum(parts[g : g + rows, g * FILTERS : (g + 1) * FILTERS] + repeats[g : g + rows] for g in range(GROUPS))
            h[across[(across >= first) & (across < last)] - first] = -np.inf
            yield first, h

    def inputs(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of some chunks (rows x WIDTH) and their repetition channels (rows x lags)."""
        at = rows[:, None] * GROUP + max(LAGS) + np.arange(WIDTH)
        own = self.data[at]
        return own, np.stack([(own == self.data[at - lag]).sum(axis=1) for lag in LAGS], axis=1).astype(np.float32) * (2 / WIDTH)


def strongest(net: Network, chunks: Chunks, with_places: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter in each text and, if asked for, the chunk that gives it."""
    top = np.full((len(chunks.starts), FILTERS), -np.inf, np.float32)
    winner = np.zeros((len(chunks.starts), FILTERS), np.int64)
    for first, h in chunks.blocks(net):
        inside = (chunks.starts > first) & (chunks.starts < first + len(h))
        edges = np.append(first, chunks.starts[inside]) - first
        texts = np.searchsorted(chunks.starts, edges + first, side="right") - 1
        if with_places:
            for n, a, b in zip(texts, edges, np.append(edges[1:], len(h))):
                k = h[a:b].argmax(axis=0)
                value = h[a:b][k, np.arange(FILTERS)]
                better = value > top[n]
                top[n, better], winner[n, better] = value[better], (k + a + first)[better]
        else:
            top[texts] = np.maximum(top[texts], np.maximum.reduceat(h, edges, axis=0))
    return top + net.shift, winner


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    z = np.maximum(strongest(net, Chunks.of(texts))[0], 0) @ net.out + net.bias
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def gradients(net: Network, texts: list[bytes], label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    chunks = Chunks.of(texts)
    top, winner = strongest(net, chunks, with_places=True)
    m = np.maximum(top, 0)
    p = 1 / (1 + np.exp(-np.clip(m @ net.out + net.bias, -30, 30)))
    r = ((p - label) * weight / len(texts)).astype(np.float32)
    g = r[:, None] * net.out * (m > 0)
    rows, place = np.unique(winner, return_inverse=True)
    share = np.zeros((len(rows), FILTERS), np.float32)
    np.add.at(share, (place.reshape(winner.shape), np.arange(FILTERS)), g)
    own, repeats = chunks.inputs(rows)
    back = np.einsum("rf,gif->rgi", share, net.kernel).reshape(-1, DIMS)
    d_embedding = np.stack([np.bincount(own.ravel(), back[:, d], 256) for d in range(DIMS)], axis=1).astype(np.float32)
    x = net.embedding[own].reshape(len(rows), -1)
    return [d_embedding, (x.T @ share).reshape(net.kernel.shape), repeats.T @ share, g.sum(axis=0), m.T @ r, np.array([r.sum()], np.float32)]


def fit(texts: list[bytes], label: np.ndarray, weight: np.ndarray, steps: int = STEPS, seed: int = 5) -> Network:
    """Adam over shuffled batches of whole texts; few texts are seen more often."""
    net, rng = Network.start(seed), np.random.default_rng(seed)
    first, second = [[np.zeros_like(p) for p in net.parameters()] for _ in range(2)]
    batches: list[np.ndarray] = []
    for step in range(1, steps + 1):
        if not batches:
            batches = np.array_split(rng.permutation(len(texts)), -(-len(texts) // BATCH))
        pick = batches.pop()
        rate = RATE * (1 - 0.9 * step / steps)
        for p, g, m, v in zip(net.parameters(), gradients(net, [texts[i] for i in pick], label[pick], weight[pick]), first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL, steps: int = STEPS) -> Network:
    """Network from at most ``per_label`` labelled texts of each label, never from a held-out one.

    Both labels are drawn alike and weighted back to their shares, so scores are probabilities. Without labelled
    texts the network is the untrained start. The drawn ids are bounded, so they may be broadcast.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__label"))
    usable = usable.filter(~held_out(F.col("__id")))
    shares = {r["__label"]: r["count"] for r in usable.groupBy("__label").count().collect()}
    ordered = usable.withColumn("__draw", draw("quality", F.col("__id")))
    drawn = [ordered.filter(F.col("__label") == k).orderBy("__draw", "__id").limit(per_label) for k in (0, 1)]
    chosen = F.broadcast(drawn[0].union(drawn[1]))
    found = docs.select("doc_id", text_bytes().alias("__text")).join(chosen, F.col("doc_id") == F.col("__id")).select("__draw", "__text", "__label")
    got = found.toArrow().sort_by([("__draw", "ascending"), ("__label", "ascending")])
    texts, label = got.column("__text").to_pylist(), got.column("__label").to_numpy().astype(np.float32)
    if not texts:
        return Network.start()
    total = sum(shares.values())
    weight = np.array([shares[k] / total * len(label) / max((label == k).sum(), 1) for k in label.astype(int)], np.float32)
    return fit(texts, label, weight, steps)


def held_out(doc_id: Column) -> Column:
    """Whether the id is one of the fifth of all ids that no training sees; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """Add held_out, score (0 to 1, higher is better) and predicted (score >= threshold).

    Whole texts are read; null and empty texts are one chunk of padding. Existing columns of these names are
    replaced; repeated rows are scored each. Memory follows the longest text of a batch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net.parameters())

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trained = Network(*shared.value)
        for batch in batches:
            parts = [probabilities(trained, batch.slice(at, ROWS_PER_BATCH).to_pylist()) for at in range(0, len(batch), ROWS_PER_BATCH)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    scored = whole_texts(docs).withColumn("score", F.arrow_udf(predict, "double")(text_bytes()))
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= threshold).cast("int")})


@query("op6_quality_cnn")
def op6_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, net).select("doc_id", "held_out", "score", "predicted")
