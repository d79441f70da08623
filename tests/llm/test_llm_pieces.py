"""Encoding and decoding with prefix tables, against the library."""

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

sys.path.insert(0, str(Path(__file__).parent))

from helpers import documents, odd_rows  # noqa: E402

from scalemetrics.llm import pieces  # noqa: E402

PARTS = ["a", "b", "The", " ", "  ", "\n", "\t", "é", "▁", "<s>", "</s>", "<0x0A>", "<unk>", "漢字", "😀", "ﬁ", "\x00", "hello", " world", "ing", "tion", " " * 20,
         "=", "====", "--", "1", "2023", "а", " ", "́", "�", "\r\n"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def model():
    return Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


def texts(n, seed=1):
    rng = random.Random(seed)
    strange = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n)]
    return strange + ["".join(rng.choice("abcdehilnorst \n") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_and_texts_equal_the_library(spark, library, model):
    rows = [(n, t, "en", "a") for n, t in enumerate(texts(1000))] + [(10_000 + n, *r[1:]) for n, r in enumerate(odd_rows())]
    rows += [(20_000, "x" * 50_000, "en", "a"), (20_001, " " * 5_000, "en", "a"), (20_002, "nospaceatall" * 3_000, "en", "a")]
    got = {r.doc_id: r for r in pieces.decoded(pieces.encoded(documents(spark, rows), model), model).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids, repr(text)[:200]
        assert got[i].decoded == library.decode(ids), repr(text)[:200]


def test_any_ids_decode_as_the_library_does(library, model):
    _, decoder = pieces.tools_of(model)
    rng = random.Random(2)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(3, 259), rng.randrange(3), rng.randrange(259, 275)]) for _ in range(rng.randint(0, 12))]
        assert decoder.text(np.array(ids, "<u4")) == library.decode(ids), ids


def test_the_table_equals_merging_step_by_step(model):
    encoder, _ = pieces.tools_of(model)
    rng = random.Random(3)
    for _ in range(500):
        chunk = "".join(rng.choice("▁aeinorst") for _ in range(rng.randint(1, 18)))
        assert encoder.chunk(chunk) == encoder.merged(chunk), chunk


def test_a_full_memo_changes_nothing(library, model):
    small = pieces.Encoder(pieces.Vocabulary.read(model), memo=3)
    for text in texts(200, seed=4):
        assert np.frombuffer(small.packed(text.encode()), "<u4").tolist() == library.encode(text)


def test_null_and_repeated_ids_and_the_empty_table(spark, library, model):
    rows = [(None, "one two", "en", "a"), (1, "one two", "en", "a"), (1, "one two", "en", "a"), (2, None, None, None)]
    got = sorted(((r.doc_id is None, r.doc_id or 0, bytes(r.ids)) for r in pieces.encoded(documents(spark, rows), model).collect()))
    one = np.array(library.encode("one two", add_bos=True, add_eos=True), "<u4").tobytes()
    assert got == [(False, 1, one), (False, 1, one), (False, 2, np.array([1, 2], "<u4").tobytes()), (True, 0, one)]
    empty = documents(spark, rows).limit(0)
    assert pieces.decoded(pieces.encoded(empty, model), model).collect() == []


def test_other_kinds_of_models_are_refused(model):
    with pytest.raises(ValueError):
        pieces.Vocabulary.read(model.replace(b"\x08identity\x12\x00\x18\x01 \x00", b"\x08identity\x12\x00\x18\x01 \x01"))


def test_query_on_whole_texts(spark, sf, library):
    got = {r.doc_id: r for r in pieces.op13_pieces(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == want
