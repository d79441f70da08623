"""Pack documents into sequences of a fixed number of tokens by the sum-of-squares rule.

A piece goes where the sum over gaps g of (open sequences with gap g)^2 becomes smallest: into an open
sequence or a new one. The rule keeps the gaps of open sequences spread out, so that later pieces find a gap
of their own length.

Pieces are dealt evenly into groups of a bounded number of rows, each packed by one task; lengths are dealt at
random, so every group sees the same mix of lengths and wastes at most a few sequences.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalemetrics.llm.common import few_rows, of_worker, table, text_bytes, whole_texts
from scalemetrics.llm.pretokens import ChunkEncoder, Memo, is_unusual
from scalemetrics.llm.registry import query
from scalemetrics.workspace import settle

CAPACITY = 2048
END_ID = 0
PIECES_PER_GROUP = 200_000


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def token_pieces(
    docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text",
    memo: int = 500_000, with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every document's ids followed by ``end_id``.

    Returns doc_id, piece (from 0), start (ids before the piece), length, ids_crc32 and, if asked for, ids. Only
    documents longer than a sequence are cut. Null and empty texts give one piece that holds ``end_id`` alone.
    ``tokenizer_json`` is the content of a lower-case word-end BPE tokenizer file; ids equal the library's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    worker_key = ("packing", hashlib.sha256(tokenizer_json.encode()).digest(), memo)

    def tools() -> tuple[ChunkEncoder, Memo]:
        made = ChunkEncoder(shared.value, cased=False)
        return made, Memo(lambda c: pack_ids(made.chunk(c)), memo)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = of_worker(worker_key, tools)
        lookup = known.__getitem__
        end = np.array([end_id], "<u4").tobytes()
        for batch in few_rows(batches):
            out: list[list] = [[], [], [], [], [], []]
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if is_unusual(raw):
                    ids = np.array(encoder.whole(raw), "<u4").tobytes() + end
                else:
                    ids = b"".join(map(lookup, raw.lower().split())) + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    values = (key, n, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype("<i4") if with_ids else None)
                    for column, value in zip(out, values):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 + with_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return whole_texts(docs).select(F.col(doc_id).cast("long"), text_bytes(text)).mapInArrow(cut, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, the longest first, equal lengths in the order given.

    With N(g) open sequences of gap g > 0, moving one from gap g to g - s changes the sum of squares by
    2 * (N(g - s) - N(g)) + 2, closing it (g = s) by 1 - 2 * N(g), and a new sequence adds 2 * N(capacity - s) + 1.
    Ties prefer an open sequence, then the smallest gap. A new sequence is a choice only while the tokens left to
    place exceed the room of the open ones, that is, while one must be opened anyway, or where no gap is large enough.
    """
    count = np.zeros(capacity + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened, left, room = 0, int(lengths.sum()), 0
    for at in np.argsort(-lengths, kind="stable"):
        s = int(lengths[at])
        best, gap = (2 * int(count[capacity - s]) + 1 if s < capacity else 0), capacity
        open_now = count[s:capacity]
        if s < capacity and open_now.any():
            change = 2 * (count[: capacity - s] - open_now) + 2
            change[0] = 1 - 2 * open_now[0]
            change[open_now == 0] = np.iinfo(np.int64).max
            k = int(change.argmin())
            if change[k] <= best or left <= room:
                gap = s + k
        if gap == capacity:
            number, opened = opened, opened + 1
        else:
            number = waiting[gap].pop()
            count[gap] -= 1
        bins[at], offsets[at] = number, capacity - gap
        left -= s
        room += (capacity if gap == capacity else 0) - s
        if gap > s:
            count[gap - s] += 1
            waiting[gap - s].append(number)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """Add sequence_id and offset to pieces with lengths of 1 to ``capacity``.

    Offsets of a sequence are gapless from 0. Rows are dealt by their place in the written table, so repeated rows
    and a single hot document spread over all groups; a group never exceeds about ``per_group`` rows.
    """
    placed = settle(pieces.withColumn("__row", F.monotonically_increasing_id()))
    groups = max(1, -(-placed.count() // per_group))
    columns = pieces.columns

    def assign(batch: pa.Table) -> pa.Table:
        group = batch.column("__group")[0].as_py()
        batch = batch.sort_by("__row")
        bins, offsets = sum_of_squares(batch.column("length").to_numpy(), capacity)
        out = batch.select(columns)
        return out.append_column("sequence_id", pa.array(bins + (group << 32))).append_column("offset", pa.array(offsets))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    dealt = placed.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)))
    return dealt.groupBy("__group").applyInArrow(assign, f"{fields}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """Every document's pieces with their place in a sequence; repeated rows are packed each."""
    return pack(token_pieces(docs, tokenizer_json))


def word_tokenizer() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), word_tokenizer())
