"""Near-duplicate documents by b-bit MinHash.

1. One pass over the texts: distinct five-word shingles as 64-bit hashes, their number, a 128-bit key of the
   set, the keys of 40 bands of four minima, and the two low bits of 1,024 minima packed into 32 longs.
2. Documents with equal sets are one node from here on.
3. A candidate pair (one that shares a band) is dropped when its set sizes rule the similarity out, or when the
   collision-corrected estimate from the packed bits lies 4.5 standard deviations below the threshold; all others are
   confirmed on the full sets.
4. Rounds in which a node takes part with one pair of its own: first the smallest node that it shares a band with, then, for
   nodes of large bands that are still apart, the best estimate among the others of a large band. After each round the
   confirmed links merge components. A large group of copies costs about as many confirmed pairs as it has members.
5. What is still apart: bands of few nodes give their plausible pairs; in large bands tasks compare block with block, first the
   bits, then the full sets of the nodes that have a plausible partner, and return connecting links only.

A pair at the threshold misses all bands with probability 3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scalemetrics.llm.common import few_rows, of_worker, table, text_bytes, whole_texts
from scalemetrics.llm.components import connected_components
from scalemetrics.llm.pretokens import Memo
from scalemetrics.llm.registry import query
from scalemetrics.workspace import settle

WIDTH = 5
PERCENT = 75
ROWS, BANDS, BITS = 4, 40, 2
HASHES = 1024  # the first ROWS * BANDS of them make the bands
DEVIATIONS = 4.5
LONGS = HASHES * BITS // 64
SMALL_BAND = 64
BEST_BLOCK, BEST_ROUNDS = 4096, 2
BLOCK, ROWS_AT_ONCE = 1024, 16
FILTER_BITS = 1 << 26
MASK = 0x5555555555555555


def odd_numbers(n: int, seed: int, dtype: type = np.uint64) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, np.iinfo(dtype).max, n, dtype) | dtype(1)


@dataclass(frozen=True)
class Sets:
    """Shingle sets of a batch of texts: sorted distinct 64-bit hashes of each, one after the other."""

    hashes: np.ndarray
    ends: np.ndarray

    def __iter__(self) -> Iterator[np.ndarray]:
        at = 0
        for end in self.ends:
            yield self.hashes[at:end]
            at = end


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes], lookup) -> Sets:
    """Five-word shingles of lower-cased texts; fewer words are one shingle, none are none."""
    factors = odd_numbers(WIDTH + 1, 11)
    found, ends, at = [], [], 0
    for text in texts:
        tokens = text.lower().split()  # bytes: lower-cases A-Z alone and splits at the ASCII white space
        n = len(tokens)
        if n:
            w = np.fromiter(map(lookup, tokens), np.uint64, n)
            width = min(n, WIDTH)
            h = w[: n - width + 1] * factors[0]
            for j in range(1, width):
                h += w[j : n - width + 1 + j] * factors[j]
            if n < WIDTH:
                h += factors[WIDTH : WIDTH + 1] * np.uint64(n)
            h = mixed(h)
            h.sort()
            if len(h) > 1:
                h = h[np.concatenate(([True], h[1:] != h[:-1]))]
            found.append(h)
            at += len(h)
        ends.append(at)
    return Sets(np.concatenate(found) if found else np.empty(0, np.uint64), np.array(ends, np.int64))


def minima(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the sets that are not empty, and their minima (rows x hashes)."""
    sizes = np.diff(sets.ends, prepend=0)
    full = np.flatnonzero(sizes)
    starts = (sets.ends - sizes)[full]
    x = (sets.hashes >> np.uint64(32)).astype(np.uint32)
    factors, shifts = odd_numbers(HASHES, 12, np.uint32), odd_numbers(HASHES, 13, np.uint32)
    out = np.empty((HASHES, len(full)), np.uint32)
    if len(full):
        for i in range(HASHES):
            np.minimum.reduceat(x * factors[i] + shifts[i], starts, out=out[i])
    return full, out.T


def band_keys(m: np.ndarray) -> np.ndarray:
    """64-bit key per band; the same minima in another band give another key."""
    factors, offsets = odd_numbers(ROWS, 14), odd_numbers(BANDS, 15)
    groups = m[:, : BANDS * ROWS].reshape(len(m), BANDS, ROWS).astype(np.uint64)
    return mixed(mixed((groups * factors).sum(axis=2, dtype=np.uint64)) + offsets).view(np.int64)


def packed_bits(m: np.ndarray) -> np.ndarray:
    """The low bits of all minima in LONGS longs per row."""
    low = ((m ^ (m >> np.uint32(16))) & np.uint32(3)).astype(np.uint64).reshape(len(m), LONGS, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2).view(np.int64)


def word_hashes():
    """Memo of word hashes: one per Python worker, for all passes over the texts."""
    import xxhash

    return of_worker("word hashes", lambda: Memo(xxhash.xxh3_64_intdigest, 250_000)).__getitem__


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, key_hi, key_lo, bands and bits of every document (no bands for empty sets)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        lookup = word_hashes()
        for batch in few_rows(batches):
            sets = shingle_sets(batch.column(2).to_pylist(), lookup)
            full, m = minima(sets)
            size = batch.num_rows
            keys = [divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets]
            filled = np.zeros(size + 1, np.int32)
            filled[full + 1] = 1
            offsets = np.cumsum(filled, dtype=np.int32)
            lists = lambda a: pa.ListArray.from_arrays(pa.array(offsets * a.shape[1], pa.int32()), pa.array(a.ravel(), pa.int64()))
            signed = lambda xs: pa.array(np.array(xs, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(sets.ends, prepend=0), pa.int64()), signed([k[0] for k in keys]),
                 signed([k[1] for k in keys]), lists(band_keys(m)), lists(packed_bits(m))],
                names=["doc_id", "text_hash", "n_shingles", "key_hi", "key_lo", "bands", "bits"],
            )

    source = whole_texts(docs).select(F.col(doc_id).cast("long").alias("doc_id"), text_hash(text), text_bytes(text).alias("t"))
    return source.mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, key_hi long, key_lo long, bands array<long>, bits array<long>")


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.col(text)).alias("text_hash")


def least_matches() -> int:
    """Equal low bits that a pair at the threshold has, less DEVIATIONS standard deviations."""
    k, chance, s = HASHES, 0.5**BITS, PERCENT / 100
    p = chance + (1 - chance) * s
    return int(k * p - DEVIATIONS * (k * p * (1 - p)) ** 0.5)


def plausible(a: str, b: str) -> Column:
    """Whether set sizes and packed bits leave the threshold possible for the pair of structs ``a`` and ``b``."""
    n_a, n_b = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    sizes = 100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)
    equal = F.lit(0)
    for i in range(LONGS):
        x = F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])
        differs = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(MASK))
        equal = equal + (64 // BITS - F.bit_count(differs))
    return sizes & (equal >= least_matches())


def id_filter(ids: DataFrame, column: str) -> bytes:
    """Bitmap of hashed ids: FILTER_BITS bits at most, whatever the number of ids."""
    bit = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)) + 1  # Spark's bitmaps count from 1
    marked = ids.select(bit.alias("bit"))
    maps = marked.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    whole = bytearray(FILTER_BITS // 8 + 4096)
    for r in maps.collect():  # FILTER_BITS / 32768 rows of 4 KB at most
        whole[(r.bucket - 1) * 4096 : r.bucket * 4096] = r.map
    return bytes(whole)


def full_sets(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, set) of the given nodes (node, doc_id, key_hi, key_lo), from the documents' texts.

    Texts are not shuffled: a bitmap of the wanted ids lets other documents go where they are read. Those that it lets
    through by chance fall out in the join; a bitmap too full to help only costs time.
    """
    wanted_bits = docs.sparkSession.sparkContext.broadcast(id_filter(nodes, "doc_id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        lookup, bits = word_hashes(), np.frombuffer(wanted_bits.value, np.uint8)
        for batch in few_rows(batches):
            at = batch.column(1).to_numpy()
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            raw = [s.tobytes() for s in shingle_sets(batch.column(2).to_pylist(), lookup)]
            keys = np.array([divmod(xxhash.xxh3_128_intdigest(r), 1 << 64) for r in raw], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(raw, pa.binary())], names=["doc_id", "key_hi", "key_lo", "set"])

    key = F.col(doc_id).cast("long")
    texts = whole_texts(docs).filter(key.isNotNull()).select(key.alias("doc_id"), F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)).alias("bit"), text_bytes(text).alias("t"))
    found = texts.mapInArrow(sets, "doc_id long, key_hi long, key_lo long, set binary")
    # a repeated id may bring other texts along, or the same one twice
    read = settle(found.join(nodes.select("doc_id", "key_hi", "key_lo", "node"), ["doc_id", "key_hi", "key_lo"]).select("node", "set").dropDuplicates(["node"]))
    wanted_bits.destroy()
    return read


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(a) + len(b) - len(np.union1d(a, b))
                keep.append(100 * common >= PERCENT * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return settle(both.select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id (smallest id reachable by links), kept.

    Documents without words, null texts and rows without id link with nothing: they are their own component and
    are kept (component_id null for a null id). Repeated rows are one node and share its component.
    """
    rows = settle(signatures(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    linked = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = settle(linked.groupBy("key_hi", "key_lo").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id")))
    nodes = linked.withColumnRenamed("row", "node").join(classes.select("node"), "node", "left_semi")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    bands = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    members = settle(keys.join(bands, "key"))
    # from here on only nodes that share a band matter
    near = settle(nodes.join(members.select("node").distinct(), "node", "left_semi"))
    state = Links(docs, near, doc_id, text)
    state.confirm(state.judged(nearest_hub(members)))
    for place in range(BEST_ROUNDS):
        state.confirm(best_partners(apart(members, state.parts).filter(F.col("n") > SMALL_BAND), near, place))
    state.confirm(small_band_pairs(apart(members.filter(F.col("n") <= SMALL_BAND), state.parts), near))
    blocks = settle(plausible_blocks(apart(members, state.parts).filter(F.col("n") > SMALL_BAND), near))
    if not blocks.isEmpty():
        state.merge(settle(links_of_blocks(blocks, state.sets_of(blocks.select("node")))))
    return labelled(rows, classes, state.parts)


class Links:
    """What the rounds have found: full sets read so far, pairs tested, components (node, component)."""

    def __init__(self, docs: DataFrame, near: DataFrame, doc_id: str, text: str) -> None:
        self.docs, self.near, self.doc_id, self.text = docs, near, doc_id, text
        self.sets: DataFrame | None = None
        self.tested: DataFrame | None = None
        self.parts: DataFrame | None = None

    def judged(self, pairs: DataFrame) -> DataFrame:
        marks = self.near.select("node", F.struct("n_shingles", "bits").alias("m"))
        side = lambda c: marks.select(F.col("node").alias(c), F.col("m").alias(f"m{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").filter(plausible("ma", "mb")).select("a", "b")

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """(node, set) of the wanted nodes at least; those read before are not read again."""
        ends = wanted.select("node").distinct()
        if self.sets is not None:
            ends = ends.join(self.sets, "node", "left_anti")
        missing = settle(self.near.select("node", "doc_id", "key_hi", "key_lo").join(ends, "node"))
        if not missing.isEmpty():
            found = full_sets(self.docs, missing, self.doc_id, self.text)
            self.sets = found if self.sets is None else self.sets.union(found)
        return self.sets

    def confirm(self, pairs: DataFrame) -> None:
        """Test the pairs that have not been tested yet on their full sets, and merge the components that they link."""
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = settle(pairs)
        if pairs.isEmpty():
            return
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
        sets = self.sets_of(ends)
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        self.merge(confirmed(pairs, sets))

    def merge(self, links: DataFrame) -> None:
        if links.isEmpty():
            return
        # components so far are stars, so each round only merges what its links connect
        stars = None if self.parts is None else self.parts.select(F.col("component").alias("a"), F.col("node").alias("b"))
        self.parts = settle(connected_components(links if stars is None else links.union(stars)))


def nearest_hub(members: DataFrame) -> DataFrame:
    """Each node with the smallest node that it shares a band with."""
    return members.filter("node <> hub").groupBy(F.col("node").alias("b")).agg(F.min("hub").alias("a")).select("a", "b")


def apart(members: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Members of the bands that hold several components: key, node, n, c (component) and main (the key's most frequent one)."""
    if parts is None:
        own = members.withColumn("c", F.col("node"))
    else:
        own = members.join(parts.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    counts = own.groupBy("key", "c").agg(F.count("*").alias("k"))
    several = counts.groupBy("key").agg(F.max(F.struct("k", "c")).alias("most"), F.count("*").alias("parts")).filter("parts > 1")
    return settle(own.join(several.select("key", F.col("most.c").alias("main")), "key").select("key", "node", "n", "c", "main"))


def with_marks(memberships: DataFrame, near: DataFrame, *marks: str) -> DataFrame:
    """Memberships (with key and node) and the marks of their nodes.

    The join has one row per node, whatever the number of its bands; a node's memberships (BANDS at most) wait in an array meanwhile.
    """
    places = [c for c in memberships.columns if c != "node"]
    by_node = memberships.groupBy("node").agg(F.collect_list(F.struct(*places)).alias("places"))
    return by_node.join(near.select("node", *marks), "node").select("node", *marks, F.inline("places"))


def equal_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of equal minima bits of all rows of ``a`` with all rows of ``b``."""
    x = a[:, None, :] ^ b[None, :, :]
    return HASHES - np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(MASK)).sum(axis=2, dtype=np.int32)


def bits_of(rows: pa.Table) -> np.ndarray:
    return rows.column("bits").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, LONGS).view(np.uint64)


def possible(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix) for some rows of ``x`` at a time: equal bits with the rows of ``y``, 0 where the components are the
    same or the similarity is ruled out."""
    for at in range(0, len(x["node"]), ROWS_AT_ONCE):
        part = {n: v[at : at + ROWS_AT_ONCE] for n, v in x.items()}
        small, large = np.minimum(part["n"][:, None], y["n"]), np.maximum(part["n"][:, None], y["n"])
        equal = equal_bits(part["bits"], y["bits"])
        equal[(part["c"][:, None] == y["c"]) | (100 * small < PERCENT * large) | (equal < least_matches())] = 0
        yield at, equal


def columns_of(rows: pa.Table) -> dict[str, np.ndarray]:
    return {n: rows.column(n).to_numpy() for n in ("node", "c")} | {"n": rows.column("n_shingles").to_numpy(), "bits": bits_of(rows)}


def best_partners(open_members: DataFrame, near: DataFrame, place: int) -> DataFrame:
    """Pairs (a, b) of nodes outside their band's main component with the best estimate among the others of one band.

    Each such node asks in its largest band (``place`` 0) or a smaller one, so it has one pair at most. A band is cut into
    blocks by hash, and a node sees its own block only: this round only saves work, later ones find what it misses.
    """
    by_size = Window.partitionBy("node").orderBy(F.desc("n"), "key")
    asks = open_members.filter("c <> main").withColumn("place", F.row_number().over(by_size)).filter(F.col("place") == place + 1)
    asks = settle(asks.select("key", "node", F.lit(True).alias("asks")))
    asked = open_members.join(asks.select("key").distinct(), "key").join(asks, ["key", "node"], "left")
    rows = with_marks(asked, near, "n_shingles", "bits")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BEST_BLOCK)))

    def best(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        asking = group.filter(group.column("asks"))  # null: does not ask
        x, y = columns_of(asking), columns_of(group)
        pairs = []
        for at, equal in possible(x, y):
            partner = equal.argmax(axis=1)
            found = equal[np.arange(len(partner)), partner] > 0
            pairs.append(np.stack([x["node"][at : at + len(partner)][found], y["node"][partner[found]]], axis=1))
        pairs = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
        return pa.table({"a": pairs.min(axis=1, initial=1 << 62), "b": pairs.max(axis=1, initial=-1)})

    return rows.select("key", "block", "node", "c", "asks", "n_shingles", "bits").groupBy("key", "block").applyInArrow(best, "a long, b long").distinct()


def small_band_pairs(open_members: DataFrame, near: DataFrame) -> DataFrame:
    """Plausible pairs of different components in bands of at most SMALL_BAND nodes.

    Such a pair has a node outside the band's main component, so only those nodes meet the band's others.
    """
    rows = with_marks(open_members, near, "n_shingles", "bits", "bands")
    one = F.struct("node", "c", "n_shingles", "bits", "bands")
    left = rows.filter("c <> main").select("key", one.alias("x"))
    right = rows.select("key", (F.col("c") == F.col("main")).alias("is_main"), one.alias("y"))
    different = (F.col("x.c") != F.col("y.c")) & (F.col("is_main") | (F.col("x.node") < F.col("y.node")))
    first = F.array_min(F.array_intersect("x.bands", "y.bands")) == left.key  # a pair counts in one of its bands
    met = left.join(right, (left.key == right.key) & different & plausible("x", "y") & first)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def plausible_blocks(open_members: DataFrame, near: DataFrame) -> DataFrame:
    """(key, i, j, side, node, c): nodes of two blocks of a band that have a plausible partner in the other block."""
    rows = with_marks(open_members, near, "n_shingles", "bits")
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    what = ["node", "c", "n_shingles", "bits"]
    left = rows.filter("c <> main").select("key", F.col("block").alias("i"), every.alias("j"), F.lit(True).alias("side"), *what)
    right = rows.select("key", every.alias("i"), F.col("block").alias("j"), F.lit(False).alias("side"), *what)

    def meet(group: pa.Table) -> pa.Table:
        sides = [group.filter(group.column("side")), group.filter(pc.invert(group.column("side")))]
        x, y = map(columns_of, sides)
        keep = [np.zeros(len(x["node"]), bool), np.zeros(len(y["node"]), bool)]
        for at, equal in possible(x, y) if len(y["node"]) else ():
            keep[0][at : at + len(equal)] = (equal > 0).any(axis=1)
            keep[1] |= (equal > 0).any(axis=0)
        return pa.concat_tables([t.filter(pa.array(k)) for t, k in zip(sides, keep)]).select(["key", "i", "j", "side", "node", "c"])

    return left.union(right).groupBy("key", "i", "j").applyInArrow(meet, "key long, i int, j int, side boolean, node long, c long")


def links_of_blocks(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links (a, b) that connect the components of two blocks, as few as do so."""

    def connect(group: pa.Table) -> pa.Table:
        x, y = group.filter(group.column("side")), group.filter(pc.invert(group.column("side")))
        return pa.table(dict(zip("ab", connecting(*(side_of(t) for t in (x, y))))), schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    with_sets = blocks.join(sets.select("node", "set"), "node")
    return with_sets.select("key", "i", "j", "side", "node", "c", "set").groupBy("key", "i", "j").applyInArrow(connect, "a long, b long")


def side_of(rows: pa.Table) -> tuple[list[int], list[int], list[np.ndarray]]:
    return rows.column("node").to_pylist(), rows.column("c").to_pylist(), [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.column("set")]


def connecting(x: tuple, y: tuple) -> tuple[list[int], list[int]]:
    """Links between nodes of both sides by their full sets, leaving out those between components linked already."""
    a, b, parent = [], [], {}

    def root(c: int) -> int:
        while parent.setdefault(c, c) != c:
            parent[c] = c = parent[parent[c]]
        return c

    sizes = np.array([len(s) for s in y[2]], np.int64)
    if not len(sizes) or not x[0]:
        return a, b
    known, numbers = np.unique(np.concatenate(y[2]), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    for node, c, own in zip(*x):
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        held = np.zeros(len(known), np.int32)
        held[at[known[at] == own]] = 1
        common = np.add.reduceat(held[numbers], starts)
        for k in np.flatnonzero(100 * common >= PERCENT * (sizes + len(own) - common)).tolist():
            one, other = root(c), root(y[1][k])
            if one != other:
                parent[one] = other
                a.append(min(node, y[0][k]))
                b.append(max(node, y[0][k]))
    return a, b


def labelled(rows: DataFrame, classes: DataFrame, parts: DataFrame | None) -> DataFrame:
    if parts is None:
        named = classes.select("key_hi", "key_lo", F.col("least_id").alias("component_id"))
    else:
        placed = classes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        ids = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
        named = placed.join(ids, "component").select("key_hi", "key_lo", "component_id")
    free = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    joined = rows.select("doc_id", "text_hash", "n_shingles", "key_hi", "key_lo").join(settle(named), ["key_hi", "key_lo"], "left")
    component = F.when(free, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), (free | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near duplicates of an earlier id, with their own columns.

    Of rows that repeat an id of a group, one stays. Documents without words or id all stay.
    """
    groups = settle(near_duplicates(docs, doc_id, text))
    chosen = groups.filter("kept and n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"), F.count("*").alias("__rows"))
    chosen = settle(chosen.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"}))
    blank = F.length(F.translate(F.coalesce(F.col(text), F.lit("")), " \t\n\x0b\x0c\r", "")) == 0
    free = docs.filter(blank | F.col(doc_id).isNull())
    kept = docs.join(chosen, (F.col(doc_id) == F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__hash")))
    single = kept.filter("__rows = 1").select(docs.columns)
    if chosen.filter("__rows > 1").isEmpty():
        return single.union(free)
    return single.union(kept.filter("__rows > 1").dropDuplicates(["__id"]).select(docs.columns)).union(free)


@query("op8_minhash")
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")
