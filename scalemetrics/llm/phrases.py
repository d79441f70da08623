"""Phrases of two to four words that stand together more often than their parts do elsewhere, per language.

1. One pass counts words; a bitmap of hashes tells later passes which words can be part of a phrase.
2. Shards count their words and pairs, a second pass their triples and quadruples of which all pairs are frequent
   (bitmaps again: a false hit costs time, no result depends on it). A shard's sorted n-grams become minimal count automata, cut into bricks.
3. Cut points in the sorted n-grams divide all bricks into ranges; per range the automata are united, counts added and
   rare n-grams dropped. A common word or beginning spreads over as many ranges as it has n-grams.
4. Each candidate asks for the counts of its parts: requests are sorted by the range they fall into and composed with its
   automaton; the answers are narrow rows of numbers. The same requests tell a part which longer phrase holds it.
5. Score, drop and rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scalemetrics.llm.common import table, text_bytes, whole_texts
from scalemetrics.llm.count_automata import NONE, ORDER, STORED, Automaton, built, grams, narrow, packed_words, united, unpacked_words, wide
from scalemetrics.llm.registry import query
from scalemetrics.workspace import settle

LEAST, TOP, SCALE, INSIDE_PERCENT = 30, 2000, 2_000_000, 80
UNKNOWN_LANGUAGE = "und"

# What ends a piece, what separates words, upper case.
BREAKS, CAPITALS = b".,;:!?\n\x0b\x0c\r", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BREAK = b"."
PLAIN = bytes.maketrans(CAPITALS + BREAKS + b"\t", CAPITALS.lower() + BREAK * len(BREAKS) + b" ")

SHARD_WORDS, SHARD_VOCABULARY = 1_500_000, 250_000
BRICK, RANGE_BRICKS, MOST_RANGES = 1 << 16, 16, 1 << 16
PROBES = 16  # of a full brick
FILTER_BITS = 1 << 26
KEY_BYTES = 64
REQUESTS_PER_TASK = 1 << 21

Key = tuple[str, tuple[bytes, ...]]

AUTOMATON = ", ".join(f"{n} binary" for n in STORED)
BRICKS = f"lang string, lo array<binary>, hi array<binary>, probes array<array<binary>>, {AUTOMATON}"
RANGED = f"lang string, part int, {AUTOMATON}"


TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<array<binary>>": pa.list_(pa.list_(pa.binary()))}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, TYPES[kind]) for name, kind in (column.split() for column in ddl.split(", "))])


def rows_out(rows: Iterable[dict], ddl: str, at_once: int = 16) -> Iterator[pa.RecordBatch]:
    schema, rows = arrow_schema(ddl), iter(rows)
    while some := list(islice(rows, at_once)):
        yield pa.RecordBatch.from_pylist(some, schema=schema)


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words of a text, BREAK where a piece ends; no word holds a BREAK."""
    return text.translate(PLAIN).replace(BREAK, b" . ").split()


def key_of(words: Iterable[bytes]) -> tuple[bytes, ...]:
    """Beginning of an n-gram of bounded length, ordered as n-grams are: nothing follows a word that was cut."""
    out = []
    for w in words:
        out.append(w[:KEY_BYTES])
        if len(w) > KEY_BYTES:
            break
    return tuple(out)


def text_rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return whole_texts(docs).select(F.coalesce(F.col(lang), F.lit(UNKNOWN_LANGUAGE)).alias("lang"), text_bytes(text).alias("t"))


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, f) of all words."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter[bytes]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for language, counter in seen.items():
                counter.pop(BREAK, None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(counter), pa.string()), pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())], names=["lang", "word", "f"]
                )
            seen.clear()

        for batch in batches:
            for language, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen.setdefault(language, Counter()).update(words_of(t.as_py()))
            if sum(map(len, seen.values())) > SHARD_VOCABULARY:
                yield from flushed()
        yield from flushed()

    found = text_rows(docs, text, lang).mapInArrow(count, "lang string, word binary, f long")
    return settle(found.groupBy("lang", "word").agg(F.sum("f").alias("f")))


def language_seed(language: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(language.encode())


def word_hash(language: str, words: list[bytes]) -> np.ndarray:
    import xxhash

    seed = language_seed(language)
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_bits(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Place of each pair of words in the bitmap of pairs."""
    x = hashes[rows[:, 0]] * np.uint64(0x9E3779B97F4A7C15) + hashes[rows[:, 1]]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(33)) % np.uint64(FILTER_BITS)


def bitmap(places: DataFrame, column: str) -> bytes:
    """Bitmap of the given places: FILTER_BITS bits, whatever their number."""
    one = F.col(column) + 1  # Spark's bitmaps count from 1
    maps = places.groupBy(F.bitmap_bucket_number(one).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("map"))
    whole = bytearray(FILTER_BITS // 8 + 4096)
    for r in maps.collect():  # FILTER_BITS / 32768 rows of 4 KB at most
        whole[(r.bucket - 1) * 4096 : r.bucket * 4096] = r.map
    return bytes(whole)


def marked(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    places = places.astype(np.int64)
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def word_bitmap(frequent: DataFrame) -> bytes:
    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            places = [int(word_hash(language, [w])[0] % np.uint64(FILTER_BITS)) for language, w in zip(languages, words)]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64())], names=["place"])

    return bitmap(frequent.select("lang", "word").mapInArrow(place, "place long"), "place")


def pair_bitmap(ranges: DataFrame) -> bytes:
    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                automaton = Automaton.of(row)
                rows = automaton.paths()
                rows = rows[rows[:, 1] != NONE]
                yield pa.RecordBatch.from_arrays([pa.array(pair_bits(word_hash(row["lang"], automaton.words), rows).astype(np.int64))], names=["place"])

    return bitmap(ranges.mapInArrow(place, "place long"), "place")


class Vocabulary(dict):
    """Labels of words from 1, in the order of their coming; 0 for breaks and for words that are too rare."""

    def __init__(self, language: str, bits: bytes) -> None:
        import xxhash

        super().__init__({BREAK: 0})
        self.seed, self.hash, self.bits, self.words = language_seed(language), xxhash.xxh3_64_intdigest, bits, []

    def __missing__(self, word: bytes) -> int:
        place, label = self.hash(word, self.seed) % FILTER_BITS, 0
        if self.bits[place >> 3] >> (place & 7) & 1:
            self.words.append(word)
            label = len(self.words)
        self[word] = label
        return label


def shard_bricks(docs: DataFrame, orders: tuple[int, int], word_bits: Broadcast, pairs: Broadcast | None, text: str, lang: str) -> DataFrame:
    """Bricks of the n-grams of the given orders: each is the automaton of at most BRICK consecutive n-grams of a shard."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = word_bits.value
        held: dict[str, tuple[Vocabulary, list[np.ndarray]]] = {}
        size = 0

        def bricks() -> Iterator[dict]:
            for language in list(held):
                vocabulary, runs = held.pop(language)
                yield from shard(language, vocabulary.words, np.concatenate([*runs, np.zeros(1, np.int64)]))

        def shard(language: str, words: list[bytes], a: np.ndarray) -> Iterator[dict]:
            order = sorted(range(len(words)), key=words.__getitem__)
            ranks = np.zeros(len(words) + 1, np.int64)
            ranks[np.array(order, np.int64) + 1] = np.arange(1, len(words) + 1)
            words = [words[i] for i in order]
            hashes = word_hash(language, words)

            def passes(rows: np.ndarray) -> np.ndarray:
                return marked(np.frombuffer(pairs.value, np.uint8), pair_bits(hashes, rows))

            rows, counts = grams(ranks[a], orders, passes)
            for at in range(0, len(rows), BRICK):
                yield brick(language, rows[at : at + BRICK], counts[at : at + BRICK], words)

        for batch in batches:
            for language, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if language not in held:
                    held[language] = Vocabulary(language, bits), []
                vocabulary, runs = held[language]
                tokens = words_of(t.as_py())
                tokens.append(BREAK)
                runs.append(np.fromiter(map(vocabulary.__getitem__, tokens), np.int64, len(tokens)))
                size += len(tokens)
                if size >= SHARD_WORDS or len(vocabulary) > SHARD_VOCABULARY:
                    yield from rows_out(bricks(), BRICKS, 1)
                    size = 0
            if sum(len(v) for v, _ in held.values()) > SHARD_VOCABULARY:
                yield from rows_out(bricks(), BRICKS, 1)
                size = 0
        yield from rows_out(bricks(), BRICKS, 1)

    return settle(text_rows(docs, text, lang).mapInArrow(count, BRICKS))


def brick(language: str, rows: np.ndarray, counts: np.ndarray, words: list[bytes]) -> dict:
    """A brick as a row. ``probes``: every so manyth of its n-grams, from a place of its own, so that probes of many shards spread."""
    step = BRICK // PROBES
    probes = range(zlib.crc32(counts.tobytes() + rows[-1].tobytes()) % step, len(rows), step)
    ends, keys = ([list(key_of(words[i] for i in rows[k] if i != NONE)) for k in at] for at in ((0, -1), probes))
    return {"lang": language, "lo": ends[0], "hi": ends[1], "probes": keys} | built(rows, counts, words).columns()


def cut_points(bricks: DataFrame) -> list[Key]:
    """Sorted beginnings of the ranges: at most MOST_RANGES keys of at most ORDER * KEY_BYTES bytes.

    Spark's range partitioning of the bricks' probes chooses them; no result depends on the choice. Probes stand for equal numbers of
    n-grams: the bricks' first n-grams would not do, since the k-th bricks of all shards begin at about the same place.
    """
    n_probes = bricks.agg(F.sum(F.size("probes"))).first()[0] or 0
    ranges = min(MOST_RANGES, n_probes // (RANGE_BRICKS * PROBES) + 1)
    if ranges == 1:
        return []
    keys = bricks.select("lang", F.explode("probes").alias("probe")).select(F.struct("lang", "probe").alias("key")).repartitionByRange(ranges, "key")
    firsts = keys.withColumn("range", F.spark_partition_id()).groupBy("range").agg(F.min("key").alias("key")).collect()
    return sorted({(r.key.lang, tuple(bytes(w) for w in r.key.probe)) for r in firsts})[1:]


def range_edges(cuts: list[Key], language: str, automaton_words: list[bytes], rows: np.ndarray) -> list[tuple[int, int, int]]:
    """(range, first row, end row) of the sorted n-grams ``rows`` of a language."""
    first = bisect_right(cuts, (language, key_of(automaton_words[i] for i in rows[0] if i != NONE)))
    out, at = [], 0
    for part in range(first, len(cuts) + 1):
        end = len(rows)
        if part < len(cuts):
            low, high = at, len(rows)
            while low < high:
                middle = (low + high) // 2
                if (language, key_of(automaton_words[i] for i in rows[middle] if i != NONE)) < cuts[part]:
                    low = middle + 1
                else:
                    high = middle
            end = low
        if end > at:
            out.append((part, at, end))
        at = end
        if at == len(rows):
            break
    return out


def unite(bricks: DataFrame, floor: int) -> tuple[DataFrame, list[Key]]:
    """Automaton of each language and range (lang, part, automaton) with counts of at least ``floor``, and the cut points."""
    cuts = cut_points(bricks)
    shared = bricks.sparkSession.sparkContext.broadcast(cuts)

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value

        def parts() -> Iterator[dict]:
            for batch in batches:
                for row in batch.to_pylist():
                    ends = [bisect_right(cuts, (row["lang"], tuple(row[e]))) for e in ("lo", "hi")]
                    if ends[0] == ends[1]:
                        yield {c: v for c, v in row.items() if c not in ("lo", "hi", "probes")} | {"part": ends[0]}
                        continue
                    automaton = Automaton.of(row)
                    rows = automaton.paths()
                    for part, a, b in range_edges(cuts, row["lang"], automaton.words, rows):
                        yield {"lang": row["lang"], "part": part} | built(rows[a:b], automaton.counts[a:b], automaton.words).columns()

        yield from rows_out(parts(), RANGED, 1)

    def union(group: pa.Table) -> pa.Table:
        one_by_one = (group.slice(i, 1).to_pylist()[0] for i in range(group.num_rows))
        parts = [(a.paths(), a.counts, a.words) for a in map(Automaton.of, one_by_one)]
        key = {c: group.column(c)[0].as_py() for c in ("lang", "part")}
        return pa.Table.from_pylist([key | united(parts, floor).columns()], schema=arrow_schema(RANGED))

    return settle(bricks.mapInArrow(split, RANGED).groupBy("lang", "part").applyInArrow(union, RANGED)), cuts


def as_bricks(ranges: DataFrame) -> DataFrame:
    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for row in batch.to_pylist():
                    automaton = Automaton.of(row)
                    paths = automaton.paths()
                    for at in range(0, len(paths), BRICK):
                        yield brick(row["lang"], paths[at : at + BRICK], automaton.counts[at : at + BRICK], automaton.words)

        yield from rows_out(rows(), BRICKS, 1)

    return ranges.mapInArrow(ends, BRICKS)


# What a candidate asks for: first parts and rests by the number of words cut off, and the middle pair of four words.
FIRST, REST, MIDDLE = (0, 2, 4), (1, 3, 5), 6
REQUESTS = "lang string, part int, source int, n long, words binary, rows binary, ranks binary, slots binary, counts binary"
NUMBERS = "lang string, part int, rank long, slot int, value long"


def part_requests(ranges: DataFrame, cuts: list[Key]) -> DataFrame:
    """Parts of the candidates of each range, by the range that holds the part."""
    shared = ranges.sparkSession.sparkContext.broadcast(cuts)

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def requests() -> Iterator[dict]:
            for batch in batches:
                for row in batch.to_pylist():
                    automaton = Automaton.of(row)
                    rows, ranks, slots = parts_of(automaton.paths())
                    order = np.lexsort(rows.T[::-1])
                    rows, ranks, slots = rows[order], ranks[order], slots[order]
                    for part, a, b in range_edges(shared.value, row["lang"], automaton.words, rows) if len(rows) else ():
                        used = np.unique(rows[a:b][rows[a:b] != NONE])
                        labels = np.searchsorted(used, rows[a:b])
                        labels[rows[a:b] == NONE] = NONE
                        yield {
                            "lang": row["lang"], "part": part, "source": row["part"], "n": b - a, "words": packed_words([automaton.words[i] for i in used]), "rows": narrow(labels - NONE),
                            "ranks": narrow(ranks[a:b]), "slots": narrow(slots[a:b]), "counts": narrow(automaton.counts[ranks[a:b]]),
                        }

        yield from rows_out(requests(), REQUESTS, 1)

    return settle(ranges.mapInArrow(ask, REQUESTS))


def parts_of(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parts, rank of the candidate, slot) of all candidates among sorted n-grams."""
    lengths = (paths != NONE).sum(axis=1)
    out = []
    for n in range(2, ORDER + 1):
        ranks = np.flatnonzero(lengths == n)
        whole = paths[ranks]
        cuts = [(FIRST[k - 1], 0, k) for k in range(1, n)] + [(REST[k - 1], k, n) for k in range(1, n)] + ([(MIDDLE, 1, 3)] if n == 4 else [])
        for slot, a, b in cuts:
            part = np.full((len(ranks), ORDER), NONE, np.int64)
            part[:, : b - a] = whole[:, a:b]
            out.append((part, ranks, np.full(len(ranks), slot)))
    return tuple(np.concatenate(x) for x in zip(*out))


def answers(ranges: DataFrame, requests: DataFrame) -> DataFrame:
    """NUMBERS of candidates: the count of each part (slots of the parts), and the largest count of a longer phrase around them (slot -1)."""
    sizes = settle(requests.groupBy("lang", "part").agg(F.sum("n").alias("asked"))).withColumn("salts", F.ceil(F.col("asked") / REQUESTS_PER_TASK).cast("int"))
    asked = requests.join(sizes, ["lang", "part"]).withColumn("salt", F.pmod(F.xxhash64("source"), F.col("salts")).cast("int")).drop("asked", "salts")
    # a range that many ask is copied once per REQUESTS_PER_TASK requests
    held = ranges.join(sizes, ["lang", "part"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("asked", "salts")

    def compose(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = {n: [] for n in ("part", "rank", "slot", "value")}
        schema = arrow_schema(NUMBERS)
        if not asked.num_rows:
            return schema.empty_table()
        (row,) = held.to_pylist()
        automaton = Automaton.of(row)
        around = np.zeros(len(automaton.counts), np.int64)
        for r in asked.to_pylist():
            ranks = automaton.ranks_of(wide(r["rows"]).reshape(-1, ORDER) + NONE, unpacked_words(r["words"]))
            if (ranks < 0).any():
                raise ValueError("a part of a frequent phrase has no count")
            np.maximum.at(around, ranks, wide(r["counts"]))
            slots = wide(r["slots"])
            keep = slots != MIDDLE
            values = {"part": np.full(keep.sum(), r["source"]), "rank": wide(r["ranks"])[keep], "slot": slots[keep], "value": automaton.counts[ranks][keep]}
            for n, v in values.items():
                out[n].append(v)
        inside = np.flatnonzero(around)
        for n, v in {"part": np.full(len(inside), row["part"]), "rank": inside, "slot": np.full(len(inside), -1), "value": around[inside]}.items():
            out[n].append(v)
        columns = [pa.array([row["lang"]] * sum(map(len, out["rank"])), pa.string())]
        columns += [pa.array(np.concatenate(out[f.name]).astype(np.int64)).cast(f.type) for f in list(schema)[1:]]
        return pa.Table.from_arrays(columns, schema=schema)

    keys = ["lang", "part", "salt"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(compose, NUMBERS)


CANDIDATES = "lang string, part int, rank long, phrase string, size int, a long"


def candidates(ranges: DataFrame) -> DataFrame:
    """The n-grams of two words or more: place in their automaton, phrase (joined by spaces), number of words and count."""

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                automaton = Automaton.of(row)
                paths = automaton.paths()
                ranks = np.flatnonzero(paths[:, 1] != NONE)
                sizes = (paths[ranks] != NONE).sum(axis=1)
                words = [w.decode("utf-8", "replace") for w in automaton.words]
                phrases = [" ".join([words[i] for i in p[:n]]) for p, n in zip(paths[ranks].tolist(), sizes.tolist())]
                columns = [[row["lang"]] * len(ranks), [row["part"]] * len(ranks), ranks, phrases, sizes, automaton.counts[ranks]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow_schema(CANDIDATES))], schema=arrow_schema(CANDIDATES))

    return ranges.mapInArrow(spell, CANDIDATES)


def lexicon(docs: DataFrame, words: DataFrame, least: int, text: str, lang: str) -> tuple[DataFrame, list[Key]]:
    """Automata (lang, part, ...) of all n-grams of up to ORDER words that occur ``least`` times, and the ranges' cut points."""
    sc = docs.sparkSession.sparkContext
    word_bits = sc.broadcast(word_bitmap(words.filter(F.col("f") >= least)))
    short, _ = unite(shard_bricks(docs, (1, 2), word_bits, None, text, lang), least)
    pairs = sc.broadcast(pair_bitmap(short))
    long = shard_bricks(docs, (3, ORDER), word_bits, pairs, text, lang)
    return unite(settle(long.union(as_bricks(short))), least)


def phrases(docs: DataFrame, least: int = LEAST, top: int | None = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language (None: all), best first.

    ``a`` is the phrase's count (``least`` at least), ``l`` and ``r`` those of its parts at the cut with the lowest score,
    ``score`` = 2,000,000 a / (l + r) rounded down, ``n`` the language's words. A phrase inside a longer one that occurs at least
    0.8 times as often is dropped. Equal scores are ordered by count, then by the phrase's bytes. Null texts have no words,
    a null language is ``und``; ids play no part, so repeated rows count each. An empty table gives no rows.
    """
    words = word_counts(docs, text, lang)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    ranges, cuts = lexicon(docs, words, least, text, lang)
    numbers = answers(ranges, part_requests(ranges, cuts))
    slots = [F.max(F.when(F.col("slot") == s, F.col("value"))).alias(f"s{s}") for s in range(MIDDLE)]
    known = numbers.groupBy("lang", "part", "rank").agg(*slots, F.max(F.when(F.col("slot") == -1, F.col("value"))).alias("around"))
    found = settle(candidates(ranges)).join(known, ["lang", "part", "rank"])
    found = found.filter(F.col("around").isNull() | (100 * F.col("around").cast("decimal(20,0)") < INSIDE_PERCENT * F.col("a").cast("decimal(20,0)")))
    best = F.array_min(F.array_compact(F.array(*(cut_score(k) for k in range(1, ORDER)))))
    scored = settle(found.withColumn("best", best).select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        # the best of each slice of a language first, so that a language's phrases never meet in one task
        slices = scored.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(256)))
        scored = slices.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("rank") <= top).drop("slice", "rank")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def cut_score(k: int):
    """Struct (score, k, l, r) of the cut after ``k`` words, null where the phrase is too short; decimals hold the product."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    left, right = f"s{FIRST[k - 1]}", f"s{REST[k - 1]}"
    whole = F.lit(SCALE).cast("decimal(8,0)") * wide("a")
    total = wide(left) + wide(right)
    # the remainder is exact, so that the quotient is a whole number
    score = ((whole - whole % total) / total).cast("long")
    return F.when(F.col(left).isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")))


def sql(least: int = LEAST, top: int = TOP) -> str:
    grams_sql = "\n  UNION ALL ".join(
        f"SELECT lang, {n} AS size, words[i:i + {n - 1}] AS g FROM (SELECT lang, words, unnest(range(1, len(words) - {n - 2})) AS i FROM pieces WHERE len(words) >= {n})"
        for n in range(1, ORDER + 1)
    )
    return f"""
WITH split AS (
  SELECT coalesce(lang, '{UNKNOWN_LANGUAGE}') AS lang,
         unnest(string_split(regexp_replace(translate(coalesce(text, ''), '{CAPITALS.decode()}', '{CAPITALS.decode().lower()}'), '[.,;:!?\\x0A-\\x0D]', chr(10), 'g'), chr(10))) AS piece
  FROM documents
), pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS words FROM split
), totals AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang
), grams AS (
  {grams_sql}
), f AS (
  SELECT lang, size, g, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {least}
), cuts AS (
  SELECT lang, size, g, a, unnest(range(1, size)) AS k FROM f WHERE size >= 2
), scored AS (
  SELECT c.lang, c.size, c.g, c.a, c.k, l.a AS l, r.a AS r, ({SCALE}::HUGEINT * c.a // (l.a::HUGEINT + r.a))::BIGINT AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:c.k] JOIN f r ON r.lang = c.lang AND r.g = c.g[c.k + 1:c.size]
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inside AS (
  SELECT lang, g[s:s + m - 1] AS g, max(a) AS around
  FROM (SELECT lang, size, g, a, m, unnest(range(1, size - m + 2)) AS s FROM (SELECT *, unnest(range(2, size)) AS m FROM f WHERE size > 2)) GROUP BY ALL
), ranked AS (
  SELECT o.lang, array_to_string(o.g, ' ') AS phrase, o.a, o.l, o.r, o.score
  FROM lowest o LEFT JOIN inside i ON i.lang = o.lang AND i.g = o.g
  WHERE i.around IS NULL OR 100::HUGEINT * i.around < {INSIDE_PERCENT} * o.a
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked
)
SELECT p.lang, p.rank, p.phrase, p.a, p.l, p.r, t.n, p.score FROM placed p JOIN totals t ON t.lang = p.lang WHERE p.rank <= {top}
"""


@query("op12_phrases", sql())
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))
