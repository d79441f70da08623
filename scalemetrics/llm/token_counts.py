"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast table of frequent chunks (a word with the space before it and the signs on it)
and their numbers of tokens; tier two is a bounded memo of each Python worker, filled by the library.
No chunk is shuffled: the counting is one pass over the documents.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalemetrics.llm.common import few_rows, of_worker, table, text_bytes, whole_texts
from scalemetrics.llm.pretokens import UNUSUAL, ChunkEncoder, Memo
from scalemetrics.llm.registry import query

# Spaces that stand alone at a place where plain splitting would cut a run of white space
RUNS = re.compile(rb"^[ \t-\r]|[ \t-\r]$| [ \t-\r]|[\t-\r] |[\t-\r][\t-\r]")
PIECES = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def chunks(text: bytes) -> list[bytes]:
    """Chunks of a text whose token counts add up to the text's.

    A chunk is a word with the single space before it; where white space runs are longer, the whole run
    stays with the word that follows.
    """
    if not text:
        return []
    if RUNS.search(text):
        return PIECES.findall(text)
    first, *rest = text.split(b" ")
    return [first, *[b" " + r for r in rest]]


def frequent_chunks(docs: DataFrame, tokenizer_json: str, size: int, text: str = "text") -> dict[bytes, int]:
    """Numbers of tokens of the ``size`` most frequent chunks of at most 64 bytes in all documents.

    Each task counts the chunks of all its texts in a bounded table (a full one keeps its most frequent half) and hands on its
    ``2 * size`` most frequent ones. The table only saves time; no count depends on it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in few_rows(batches):
            for t in batch.column(0):
                seen.update(chunks(t.as_py()))
            if len(seen) > 16 * size:
                seen = Counter(dict(seen.most_common(8 * size)))
        top = [(c, n) for c, n in seen.most_common(2 * size) if len(c) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["chunk", "n"])

    counted = whole_texts(docs).select(text_bytes(text).alias("t")).mapInArrow(count, "chunk binary, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    encoder = ChunkEncoder(tokenizer_json, cased=True)
    top = (bytes(r.chunk) for r in counted.orderBy(F.desc("n"), "chunk").limit(size).collect())
    return {c: len(encoder.whole(c) if UNUSUAL.search(c) else encoder.chunk(c)) for c in top}


def count_tokens(
    docs: DataFrame, tokenizer_json: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text", frequent: int = 32_768, memo: int = 300_000,
) -> DataFrame:
    """One row per document: its id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``tokenizer_json`` is the content of a byte-level BPE tokenizer file with the usual word pattern. Null texts
    count as empty: 0 bytes, 0 tokens. Null ids stay null; repeated rows are counted each. Memory per worker is
    bounded by ``frequent`` + ``memo`` chunks of at most 64 bytes and one batch of texts.
    """
    first = frequent_chunks(docs, tokenizer_json, frequent, text)
    shared = docs.sparkSession.sparkContext.broadcast({"json": tokenizer_json, "keys": list(first), "lengths": bytes(min(n, 255) for n in first.values())})
    key = uuid.uuid4().hex

    def tools() -> tuple[ChunkEncoder, Memo]:
        made = ChunkEncoder(shared.value["json"], cased=True)
        known = {c: n for c, n in zip(shared.value["keys"], shared.value["lengths"]) if n < 255}
        return made, Memo(lambda c: len(made.chunk(c)), memo, known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = of_worker(key, tools)
        lookup = known.__getitem__
        for batch in few_rows(batches):
            n_bytes, n_tokens = [], []
            for t in batch.column(1).to_pylist():
                n_bytes.append(len(t))
                n_tokens.append(len(encoder.whole(t)) if UNUSUAL.search(t) else sum(map(lookup, chunks(t))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    source = whole_texts(docs).select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("t"))
    return source.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer_json = f.read()
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_json)
