"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector o is turned by random rotations and only the signs are kept. The first rotation's signs, read as a
unit vector c, come with the correction factor <c, o>: for any unit q, <c, q> / <c, o> estimates <o, q> without
bias, and its error stays within EPSILON * sqrt((1 - <c, o>^2) / <c, o>^2 / (D - 1)) except with probability 1e-6 or less.
A pair whose upper bound lies below the threshold is dropped; every other pair is computed exactly in doubles.

Candidates come from the codes too: vectors that share a run of sign bits (a band) of any rotation. The number
of bits follows the number of vectors, the number of bands the wanted recall at the threshold itself. Equal
vectors are one node. Pairs of a band are compared in blocks inside a task, which returns link counts and
connecting edges, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scalemetrics.llm.common import table
from scalemetrics.llm.components import connected_components
from scalemetrics.llm.registry import query
from scalemetrics.workspace import settle

COSINE = 0.98
EPSILON = 5.0
MISS = 1e-5
BLOCK = 1024
ROWS_PER_TASK = 8_192


def padded(dims: int) -> int:
    return 64 * max(1, -(-dims // 64))


def rotation(size: int, number: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same for the same arguments."""
    q, r = np.linalg.qr(np.random.default_rng([seed, size, number]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def band_plan(vectors: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits per band and number of bands: a pair at the threshold shares no band with probability ``miss`` at most."""
    bits = max(8, min(32, math.ceil(math.log2(max(vectors, 2)))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def band_keys(units: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Keys of all bands (vectors x bands): the band's number and its sign bits."""
    size = padded(units.shape[1])
    wide = np.pad(units, ((0, 0), (0, size - units.shape[1])))
    per_rotation, weights = size // bits, 1 << np.arange(bits, dtype=np.int64)
    keys = []
    for number in range(-(-bands // per_rotation)):
        signs = wide @ rotation(size, number + 1).T > 0
        cut = signs[:, : per_rotation * bits].reshape(len(units), per_rotation, bits)
        keys.append((cut * weights).sum(axis=2))
    return np.concatenate(keys, axis=1)[:, :bands] + (np.arange(bands, dtype=np.int64) << 40)


def codes(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, sign vectors (+-1) and correction factors."""
    size = padded(units.shape[1])
    turned = np.pad(units, ((0, 0), (0, size - units.shape[1]))) @ rotation(size, 0).T
    signs = np.where(turned > 0, 1.0, -1.0)
    return turned, signs, np.abs(turned).sum(axis=1) / math.sqrt(size)


def upper_bounds(signs: np.ndarray, factors: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Upper confidence bounds of all inner products of coded with turned vectors."""
    size = signs.shape[1]
    estimate = (signs @ turned.T) / math.sqrt(size) / factors[:, None]
    error = EPSILON * np.sqrt((1 - factors**2).clip(0) / factors**2 / (size - 1))
    return estimate + error[:, None]


def usable(embedding: Column, label: Column) -> Column:
    """Whether a vector can link: it has a label, components that are all finite numbers, and one that is not zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def with_codes(nodes: DataFrame, bits: int, bands: int) -> DataFrame:
    """Nodes with their band keys, sign code and correction factor."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v.values, np.float64) for v in batch.column(1)]
            lengths = np.array([len(v) for v in vectors], np.int64)
            keys, code, factor = np.zeros((len(vectors), bands), np.int64), [b""] * len(vectors), np.zeros(len(vectors))
            for dims in np.unique(lengths):
                rows = np.flatnonzero(lengths == dims)
                x = np.stack([vectors[i] for i in rows])
                units = x / np.linalg.norm(x, axis=1, keepdims=True)
                keys[rows] = band_keys(units, bits, bands)
                _, signs, factor[rows] = codes(units)
                for i, s in zip(rows, np.packbits(signs > 0, axis=1)):
                    code[i] = s.tobytes()
            flat = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), bands).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), batch.column(4), flat, pa.array(code, pa.binary()), pa.array(factor)],
                names=["node", "embedding", "label", "copies", "least_id", "keys", "code", "factor"],
            )

    kind = nodes.schema["embedding"].dataType.simpleString()
    columns = nodes.select("node", "embedding", F.col("label").cast("string").alias("label"), "copies", "least_id")
    return columns.mapInArrow(encode, f"node long, embedding {kind}, label string, copies long, least_id long, keys array<long>, code binary, factor double")


def compare(group: dict[str, np.ndarray], cosine: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Link counts and connecting edges of the pairs of one band and block pair, counted in their first common band."""
    counts: dict[int, int] = {}
    edges: list[tuple[int, int]] = []
    left, right = np.flatnonzero(group["block"] == group["i"]), np.flatnonzero(group["block"] == group["j"])
    same_block = bool(group["i"][0] == group["j"][0])
    x = group["vector"]
    norms = np.linalg.norm(x, axis=1)
    turned = codes(x[right] / norms[right, None])[0]
    signs = np.unpackbits(group["code"][left], axis=1).astype(np.float64) * 2 - 1
    near = upper_bounds(signs, group["factor"][left], turned) >= cosine
    root = np.arange(len(x))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    add = np.zeros(len(x), np.int64)
    for row, a in enumerate(left):
        others = right[near[row]]
        others = others[others > a] if same_block else others
        if not len(others):
            continue
        exact = x[others] @ x[a] / (norms[others] * norms[a])
        linked = others[(exact >= cosine) & (group["label"][others] == group["label"][a])]
        first = group["keys"][linked, (group["keys"][linked] == group["keys"][a]).argmax(axis=1)] == group["key"][a]
        linked = linked[first]
        add[a] += group["copies"][linked].sum()
        add[linked] += group["copies"][a]
        for b in linked:
            if root[b] != root[a]:
                ra, rb = find(a), find(b)
                if ra != rb:
                    root[rb] = ra
                    edges.append((int(group["node"][a]), int(group["node"][b])))
    for k in np.flatnonzero(add):
        counts[int(group["node"][k])] = int(add[k])
    return counts, edges


def linked_nodes(coded: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n): link counts n of node a where b is null, connecting edges otherwise."""
    keys = coded.select("node", "label", F.size("embedding").alias("dims"), F.explode("keys").alias("key"))
    shared = keys.groupBy("label", "dims", "key").agg(F.count("*").alias("size")).filter("size > 1")
    members = keys.join(shared, ["label", "dims", "key"])
    members = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = members.select("node", "label", "dims", "key", "block", other)
    met = met.select("node", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.xxhash64("label", "dims", "key", F.least("block", "other"), F.greatest("block", "other")).alias("pair"))
    met = settle(met)
    tasks = max(1, -(-met.count() // ROWS_PER_TASK))
    dealt = met.join(coded.drop("least_id"), "node").withColumn("task", F.pmod("pair", F.lit(tasks)))

    def links(batch: pa.Table) -> pa.Table:
        batch = batch.combine_chunks().sort_by([("pair", "ascending"), ("node", "ascending")])
        pair = batch.column("pair").to_numpy()
        a, b, n = [], [], []
        edges = np.flatnonzero(np.diff(pair, prepend=~pair[:1], append=~pair[-1:]))
        for lo, hi in zip(edges[:-1], edges[1:]):
            part = batch.slice(lo, hi - lo)
            vectors = [np.asarray(v.values, np.float64) for v in part.column("embedding").combine_chunks()]
            if len({len(v) for v in vectors}) > 1:
                raise ValueError("two pair keys have the same hash")
            group = {c: part.column(c).to_numpy() for c in ("node", "key", "block", "i", "j", "copies", "factor", "label")}
            group |= {
                "vector": np.stack(vectors),
                "keys": np.stack([np.asarray(v.values) for v in part.column("keys").combine_chunks()]),
                "code": np.stack([np.frombuffer(v.as_buffer(), np.uint8) for v in part.column("code").combine_chunks()]),
            }
            counts, found = compare(group, cosine)
            a += [*counts, *(e[0] for e in found)]
            b += [*[None] * len(counts), *(e[1] for e in found)]
            n += [*counts.values(), *[0] * len(found)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return settle(dealt.groupBy("task").applyInArrow(links, "a long, b long, n long"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest id reachable by links), kept.

    Vectors link when their labels are equal and their cosine is at least ``cosine``. Vectors that are null, empty,
    zero or hold null or non-finite components, and vectors without label, link with nothing. Equal vectors and
    repeated rows link with each other; a null id is never the name of a component unless it stands alone.
    """
    rows = settle(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"), usable(F.col(embedding), F.col(label)).alias("usable")).withColumn("row", F.monotonically_increasing_id()))
    classes = rows.filter("usable").groupBy("label", "embedding").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    classes = settle(classes)
    bits, bands = band_plan(classes.count(), cosine)
    coded = settle(with_codes(classes, bits, bands))
    found = linked_nodes(coded, cosine)
    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    parts = connected_components(found.filter("b is not null").select("a", "b"))
    placed = classes.join(counts, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = settle(placed.join(ids, "component").select("label", "embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    linked = rows.filter("usable").join(named, ["label", "embedding"]).select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query("op2_rotation_codes")
def op2_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
