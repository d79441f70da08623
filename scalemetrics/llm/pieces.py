"""SentencePiece encoding and decoding with a table of prefixes.

Merging symbols by score has two properties. Every prefix of a text ends in one certain token when it is
encoded alone; and a row of tokens is what merging gives if and only if each pair of neighbours is, alone. So one
walk over the text fills a table: an automaton finds all pieces that end at a place, and the prefix's last token is
the only one of them whose pair with the last token of the prefix before it stands the test. The ids are read
off the table backwards. The time is proportional to the text, whatever its merges.

Pieces never hold a space after another character, and a character outside the vocabulary joins nothing, so a
text falls into chunks at these places; a bounded memo keeps the ids of chunks seen before.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalemetrics.llm.common import of_worker, table, text_bytes, whole_texts
from scalemetrics.llm.pretokens import Memo
from scalemetrics.llm.registry import query

# Fixed values of the model file: field numbers, piece types, the kind of model, the sign for a space.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
SPACE = "▁"
REPLACEMENT = "�"

NOT_IN_VOCABULARY = -1
NEVER = float("-inf")
MEMO_CHUNKS, MEMO_PAIRS = 300_000, 1_000_000


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised message; nested ones as bytes, floats as their four bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class Vocabulary:
    """What a model file says: pieces, scores and types by id, and how texts are prepared."""

    pieces: list[str]
    scores: list[float]
    types: list[int]
    dummy_prefix: bool

    @classmethod
    def read(cls, model: bytes) -> Vocabulary:
        pieces, scores, types, trainer, normalizer = [], [], [], {}, {}
        for number, value in fields(model):
            if number == PIECES:
                one = dict(fields(value))
                pieces.append(one[1].decode())
                scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
                types.append(one.get(3, NORMAL))
            elif number == TRAINER:
                trainer = dict(fields(value))
            elif number == NORMALIZER:
                normalizer = dict(fields(value))
        if trainer.get(3) != BPE or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only merge-type models that leave characters and white space as they are can be read")
        if {USER_DEFINED, UNUSED} & set(types) or sum(t == BYTE for t in types) != 256:
            raise ValueError("only models with all byte pieces and without user-defined or unused ones can be read")
        return cls(pieces, scores, types, bool(normalizer.get(3, 1)))

    def id_of(self, piece: str) -> int:
        return self.pieces.index(piece)

    @cached_property
    def byte_ids(self) -> list[int]:
        known = {p: i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        return [known[f"<0x{b:02X}>"] for b in range(256)]

    @cached_property
    def normal(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}


class Encoder:
    """Token ids of texts, without begin and end."""

    def __init__(self, vocabulary: Vocabulary, memo: int = MEMO_CHUNKS) -> None:
        import ahocorasick

        self.v, self.ids = vocabulary, vocabulary.normal
        self.score_of = {p: vocabulary.scores[i] for p, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.memo = Memo(self.packed_chunk, memo)
        spaces_inside = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        breaks = rb"\n" if not any("\n" in p for p in self.ids) else rb""
        # the places where no piece can reach across; without them a text is one chunk
        self.chunks = re.compile(rb"(?s).+" if spaces_inside else rb" *[^ " + breaks + rb"]+| +" + (rb"|\n" if breaks else rb""))

    def merged(self, text: str) -> list[int]:
        """Ids by merging the best neighbours again and again, the leftmost of equals; for short texts of known characters."""
        parts, ids, scores = list(text), self.ids, self.v.scores
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ids[p] for p in parts]

    def fits(self, before: int, piece: int) -> bool:
        """Whether merging the two pieces' text gives these two again; ``before`` is NOT_IN_VOCABULARY at a beginning."""
        key = (before + 1) * len(self.v.pieces) + piece
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            left = "" if before == NOT_IN_VOCABULARY else self.v.pieces[before]
            known = self.pairs[key] = self.stays_apart(left, self.v.pieces[piece])
        return known

    def stays_apart(self, left: str, right: str) -> bool:
        """Whether no merge crosses from ``left`` to ``right`` and both become one piece; ends at the first merge that does."""
        parts, score = list(left + right), self.score_of.get
        gains = [score(x + y, NEVER) for x, y in zip(parts, parts[1:])]
        border = len(left)
        while gains and (best := max(gains)) > NEVER:
            at = gains.index(best)
            if at == border - 1:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]
            if at:
                gains[at - 1] = score(parts[at - 1] + parts[at], NEVER)
            if at < len(gains):
                gains[at] = score(parts[at] + parts[at + 1], NEVER)
            border -= at < border
        return parts == ([left, right] if left else [right])

    def last_tokens(self, chunk: str) -> tuple[list[int], list[int]]:
        """For every prefix of the chunk its last token and where that begins; index 0 is the empty prefix.

        A prefix that no piece ends keeps NOT_IN_VOCABULARY and begins nowhere (-1): its last character joins nothing.
        """
        last, begins = [NOT_IN_VOCABULARY] * (len(chunk) + 1), [-1] * (len(chunk) + 1)
        known, size = self.pairs.get, len(self.v.pieces)
        for end, (piece, length) in self.automaton.iter(chunk):
            end += 1
            if begins[end] < 0:  # else the one token has been found
                start = end - length
                before = last[start]
                fits = known((before + 1) * size + piece)
                if fits or (fits is None and self.fits(before, piece)):
                    last[end], begins[end] = piece, start
        return last, begins

    def chunk(self, chunk: str) -> list[int]:
        last, begins = self.last_tokens(chunk)
        out, at = [], len(chunk)
        while at:
            if begins[at] < 0:
                out.extend(self.v.byte_ids[b] for b in reversed(chunk[at - 1].encode()))
                at -= 1
            else:
                out.append(last[at])
                at = begins[at]
        out.reverse()
        return out

    def packed_chunk(self, chunk: bytes) -> bytes:
        ids = self.chunk(chunk.decode("utf-8", "replace").replace(" ", SPACE))
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, text: bytes) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        spaced = text.replace(SPACE.encode(), b" ")
        return b"".join(map(self.memo.__getitem__, self.chunks.findall(b" " + spaced if self.v.dummy_prefix else spaced)))


class Decoder:
    """Texts of token ids: control pieces vanish, byte pieces join to characters, the first space goes if one was added."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        shown = [self.surface(i) for i in range(len(vocabulary.pieces))]
        self.surfaces = np.frombuffer(b"".join(shown), np.uint8)
        self.lengths = np.array([len(s) for s in shown], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.is_byte = np.array([t == BYTE for t in vocabulary.types])
        self.silent = np.array([t == CONTROL for t in vocabulary.types])
        self.spaced = np.array([p.startswith(SPACE) for p in vocabulary.pieces])

    def surface(self, i: int) -> bytes:
        kind, piece = self.v.types[i], self.v.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return b" \xe2\x81\x87 "  # fixed value: how the library shows unknown pieces
        return b"" if kind == CONTROL else piece.replace(SPACE, " ").encode()

    def joined(self, ids: np.ndarray) -> bytes:
        """Bytes of the pieces, one after the other, in one gather."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids) or not ends[-1]:
            return b""
        return self.surfaces[np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - lengths), lengths)].tobytes()

    def text(self, ids: np.ndarray) -> str:
        heard = np.flatnonzero(~self.silent[ids])
        if not len(heard):
            return ""
        ids = ids[heard[0] : heard[-1] + 1]
        raw = self.joined(ids)
        if len(heard) == len(ids):  # a control piece between two byte pieces parts them
            try:
                return self.without_prefix(raw, ids).decode()
            except UnicodeDecodeError:
                pass
        return self.mended(ids)

    def without_prefix(self, text: bytes, ids: np.ndarray) -> bytes:
        return text[1:] if self.v.dummy_prefix and self.spaced[ids[0]] else text

    def mended(self, ids: np.ndarray) -> str:
        """With byte pieces that are no characters: each stray byte becomes a replacement character."""
        out = []
        for run in np.split(ids, np.flatnonzero(np.diff(self.is_byte[ids])) + 1):
            raw = self.joined(run)
            out.append(valid_characters(raw) if self.is_byte[run[0]] else raw)
        return self.without_prefix(b"".join(out), ids).decode()


def valid_characters(raw: bytes) -> bytes:
    """The characters of a run of bytes, each byte that belongs to none replaced."""
    out, at = [], 0
    while at < len(raw):
        size = next((n for n in (1, 2, 3, 4) if is_character(raw[at : at + n])), 0)
        out.append(raw[at : at + size] if size else REPLACEMENT.encode())
        at += size or 1
    return b"".join(out)


def is_character(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def tools_of(model: bytes) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of a model, one pair per Python worker and model."""

    def make() -> tuple[Encoder, Decoder]:
        vocabulary = Vocabulary.read(model)
        return Encoder(vocabulary), Decoder(vocabulary)

    return of_worker(("pieces", hashlib.sha256(model).digest()), make)


def encoded(docs: DataFrame, model: bytes, begin: str | None = "<s>", end: str | None = "</s>", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) per document: token ids of the whole text, packed as little-endian unsigned 32-bit integers.

    ``model`` is the content of a model file; ``begin`` and ``end`` are control pieces to put around every text (None:
    none). Null texts count as empty, and an empty text has no other ids. Null and repeated doc_ids stay as they
    are, each row is encoded for itself. One pass, no shuffle; memory per worker is bounded by the memos and one text.
    """
    vocabulary = Vocabulary.read(model)
    around = [b"" if p is None else np.array([vocabulary.id_of(p)], "<u4").tobytes() for p in (begin, end)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = tools_of(shared.value)
        for batch in batches:
            ids = [around[0] + encoder.packed(t.as_py()) + around[1] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    source = whole_texts(docs).select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("t"))
    return source.mapInArrow(encode, "doc_id long, ids binary")


def decoded(rows: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """``rows`` (doc_id and packed ids, see ``encoded``) with a column ``decoded``: the text of the ids; null ids are empty."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = tools_of(shared.value)
        for batch in batches:
            texts = [decoder.text(np.frombuffer(i.as_py() or b"", "<u4")) for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return rows.select("doc_id", F.col(ids).alias("ids")).mapInArrow(decode, "doc_id long, ids binary, decoded string")


@query("op13_pieces")
def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    rows = decoded(encoded(table(spark, sf_dir, "documents"), model), model)
    digests = {"ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256)}
    return rows.select("doc_id", F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"), *(c.alias(n) for n, c in digests.items()))
