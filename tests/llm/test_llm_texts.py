"""Token counts, packing, near duplicates, toxicity and quality of texts, against the libraries and brute force."""

import math
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

from helpers import documents, gapless, near_duplicates, odd_rows, shingles  # noqa: E402

from scalemetrics.llm import minhash, packing, pretokens, quality_cnn, token_counts, toxicity  # noqa: E402

PIECES = ["a", "b", "The", " ", "  ", "\n", "\t", "\r\n", "'s", "'", "don't", "é", "É", "ß", "İ", "ſ", "1", "23", "²", "٣", "%", "!!", "<|endoftext|>",
          "<|", " ", " ", "　", "\x1c", "\x85", "é", "漢字", "😀", "‍", "-", "_", "\x00", "﻿", "ﬁ", "ΑΣ ", "\x7f", "«"]


def json_of(name):
    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


@pytest.fixture(scope="module")
def strange():
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    return [(n, t, "en", "a") for n, t in enumerate(texts)] + [(10_000 + n, *r[1:]) for n, r in enumerate(odd_rows())]


def test_token_counts_equal_the_library(spark, strange):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in token_counts.count_tokens(documents(spark, strange), json_of("byte_bpe_50k.json"), memo=50, frequent=20).collect()}
    assert len(rows) == len(strange)
    for i, text, *_ in strange:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len((text or "").encode()), n > 1024), repr(text)[:200]


def test_pieces_and_places_round_trip(spark, strange):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.token_pieces(documents(spark, strange), json_of("word_bpe_49k.json"), memo=100, with_ids=True)
    rows = packing.pack(pieces, per_group=400).collect()
    ids = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(ids[r.doc_id]) and r.length == len(r.ids) <= 2048
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        ids[r.doc_id] += r.ids
    for i, text, *_ in strange:
        assert ids[i] == [*library.encode(text or "", add_special_tokens=False).ids, 0], repr(text)[:200]
    assert max(gapless(rows, "sequence_id", "offset", "length").values()) <= 2048
    assert len({r.sequence_id >> 32 for r in rows}) > 1


def test_packing_is_close_to_the_least_number_of_sequences():
    lengths = np.clip(np.random.default_rng(2).lognormal(6, 1, 5000).astype(int), 1, 2048)
    bins, offsets = packing.sum_of_squares(lengths, 2048)
    fill = np.bincount(bins, lengths)
    assert fill.max() <= 2048 and (offsets + lengths <= 2048).all()
    assert len(fill) <= 1.01 * lengths.sum() / 2048 + 2


def test_first_choices_make_squares_smallest():
    # 6 opens; 4 may close it (1 - 2) or open another (+1); 3 and 3 find no gap and open
    bins, offsets = packing.sum_of_squares(np.array([6, 4, 3]), 10)
    assert bins.tolist() == [0, 0, 1] and offsets.tolist() == [0, 6, 0]


def test_repeated_rows_are_packed_each(spark):
    rows = packing.packed_documents(documents(spark, odd_rows()), json_of("word_bpe_49k.json")).collect()
    assert sum(r.doc_id == 6 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 2


def near_rows():
    rng = random.Random(4)
    vocabulary = [f"word{n}" for n in range(4000)]
    rows = []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 120, 400]))]
        for copy in range(rng.choice([1, 2, 5, 14])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 3, 8, 20]) * len(w) // 400):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((7 * len(rows) + group, " ".join(w).title() if copy % 2 else "\n ".join(w), "en", "a"))
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    expected = near_duplicates({r[0]: r[1] for r in rows})
    assert 1 < len(set(expected.values())) < len(rows)
    for got in (minhash.near_duplicates(documents(spark, rows)).collect(),):
        assert {r.doc_id: r.component_id for r in got} == expected
        assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(shingles(dict((x[0], x[1]) for x in rows)[r.doc_id])) for r in got)


def hot_group(n, edits, centre):
    """Copies of one text, each with its own edits: all near the text, few near each other."""
    rng = random.Random(n + edits)
    base = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(base), "en", "a")] if centre else []
    for k in range(1, n + 1):
        w = list(base)
        for at in rng.sample(range(5, 195), edits):
            w[at] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(w), "en", "a"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("edits, centre", [(3, True), (3, False), (2, False), (4, False)])
def test_pairs_of_a_hot_group_grow_with_its_members(spark, monkeypatch, edits, centre):
    n, tested, confirm = 600, [], minhash.confirmed

    def counting(pairs, sets):
        tested.append(pairs.count())
        return confirm(pairs, sets)

    monkeypatch.setattr(minhash, "confirmed", counting)
    monkeypatch.setattr(minhash, "BLOCK", 200)
    rows = hot_group(n, edits, centre) + [(1000 + r[0], *r[1:]) for r in near_rows()]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows, 5)).collect()}
    assert got == near_duplicates({r[0]: r[1] for r in rows})
    # bands of few nodes give their plausible pairs, a few per node
    assert sum(tested) <= 6 * len(rows), tested


def test_blocks_link_as_pairs_do():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60)).astype(np.uint64)) for _ in range(60)]
    for _ in range(3):
        c = rng.integers(0, 40, 60)
        side = lambda ids: ([int(i) for i in ids], [int(c[i]) for i in ids], [sets[i] for i in ids])  # noqa: B023, E731
        x, y = range(30), range(20, 60)
        links = list(zip(*minhash.connecting(side(x), side(y))))
        near = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))
        assert all(near(i, j) and c[i] != c[j] for i, j in links)
        groups = lambda pairs: {k: min(v for v in parts if parts[v] == parts[k]) for parts in [components_of(pairs)] for k in parts}

        def components_of(pairs):
            parent = {int(k): int(k) for k in set(c.tolist())}

            def root(k):
                while parent[k] != k:
                    k = parent[k]
                return k

            for i, j in pairs:
                parent[root(int(c[i]))] = root(int(c[j]))
            return {k: root(k) for k in parent}

        assert groups(links) == groups([(i, j) for i in x for j in y if c[i] != c[j] and near(i, j)])
        assert len(links) < len(set(c.tolist()))


def test_near_duplicates_of_odd_rows(spark):
    docs = documents(spark, odd_rows())
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(odd_rows())
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert by[1, 0].kept and by[2, 0].kept and by[3, 0].kept and by[3, 0].component_id == 3
    assert by[6, 1].component_id == 5 and not by[6, 1].kept and by[5, 1].kept
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    kept = minhash.one_of_each_group(docs)
    assert kept.columns == docs.columns and kept.count() == len(odd_rows()) - 2
    twice = documents(spark, [(9, "a b c d e f g", "en", "s")] * 3 + [(8, None, "en", "s")])
    assert sorted(r.doc_id for r in minhash.one_of_each_group(twice).collect()) == [8, 9]


def rows_of_joins(df):
    """Rows that each join of a collected table made."""
    found, open_plans = [], [df._jdf.queryExecution().executedPlan()]
    while open_plans:
        plan = open_plans.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            open_plans.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            open_plans.append(plan.plan())
        else:
            children = plan.children()
            open_plans += [children.apply(k) for k in range(children.size())]
            if "Join" in name:
                found.append(plan.metrics().apply("numOutputRows").value())
    return found


def test_joins_for_marks_do_not_grow_with_the_bands_of_a_node(spark):
    n, bands = 20, 40
    members = spark.createDataFrame([(b, k, 100, 0, k % 2) for k in range(n) for b in range(bands)] + [(7, 3, 100, 0, 1)], "key long, node long, n long, c long, main long")
    near = spark.createDataFrame([(k, 10 + k, [k] * minhash.LONGS) for k in range(n + 5)], "node long, n_shingles long, bits array<long>")
    got = minhash.with_marks(members, near, "n_shingles", "bits")
    assert Counter(tuple(r[c] for c in members.columns) for r in got.collect()) == Counter(tuple(r) for r in members.collect())
    assert all(r.n_shingles == 10 + r.node and r.bits[0] == r.node for r in got.collect())
    assert rows_of_joins(got) == [n]


def test_bits_estimate_the_similarity():
    texts = [" ".join(f"w{n}" for n in range(a, a + 1000)).encode() for a in (0, 100, 400)]
    _, m = minhash.minima(minhash.shingle_sets(texts, minhash.word_hashes()))
    low = (m ^ (m >> 16)) & 3
    for other, true in ((1, 896 / 1096), (2, 596 / 1396)):
        estimate = ((low[0] == low[other]).mean() - 0.25) / 0.75
        assert abs(estimate - true) < 0.08


def labelled(spark, rows, name):
    return spark.createDataFrame([(r[0], k) for r, k in rows], f"doc_id long, {name} int")


def test_chain_catches_toxic_words_and_leaves_others(spark):
    rng = random.Random(5)
    vocabulary = [f"term{n}" for n in range(300)]
    rows = []
    for n in range(400):
        bad = n % 4 == 0
        w = [rng.choice(vocabulary) for _ in range(60)] + (["idiot,", "scum"] if bad and n % 8 == 0 else ["vilen" + rng.choice("abcde"), "vilen" + rng.choice("fgh")] if bad else [])
        rng.shuffle(w)
        rows.append(((n, " ".join(w), "en", "a"), int(bad)))
    docs = documents(spark, [r for r, _ in rows] + [(1000 + n, *r[1:]) for n, r in enumerate(odd_rows())])
    labels = labelled(spark, rows[:300], "toxic").union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    chain = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, chain, toxicity.CATEGORIES).collect() if r.doc_id is not None}
    assert all(got[r[0]].toxic == bool(k) for r, k in rows[300:])
    assert not any(got[1000 + n].toxic for n, r in enumerate(odd_rows()))
    kinds = np.array([[got[n].p_kind_1, got[n].p_kind_2] for n in range(0, 80, 4)]) > 0.5
    assert kinds.any(axis=1).all() and len({tuple(k) for k in kinds[0::2]} & {tuple(k) for k in kinds[1::2]}) == 0
    kept = toxicity.clean_documents(docs, labels)
    assert kept.columns == docs.columns and kept.filter("toxic = 'y'").count() == kept.count()
    assert toxicity.clean_documents(docs, labels.filter("false")).count() == docs.count()


def test_words_of_a_large_toxic_copy_group_keep_their_weight(spark):
    # a third of the labelled rows are copies of one toxic text; other toxic documents hold one word of it each
    rng = random.Random(8)
    vocabulary = [f"term{n}" for n in range(300)]
    markers = ["vilenax", "grobusk"]
    copy = " ".join([rng.choice(vocabulary) for _ in range(40)] + markers)
    rows = []
    for n in range(450):
        bad = n % 3 == 0 or n % 30 == 1
        text = copy if n % 3 == 0 else " ".join([rng.choice(vocabulary) for _ in range(60)] + [markers[n % 2]] * bad)
        rows.append(((n, text, "en", "a"), int(bad)))
    docs = documents(spark, [r for r, _ in rows])
    chain = toxicity.train(docs, labelled(spark, rows[:300], "toxic"))
    got = {r.doc_id: r.toxic for r in toxicity.score(docs, chain, toxicity.CATEGORIES).collect()}
    assert [got[r[0]] for r, _ in rows[300:]] == [bool(k) for _, k in rows[300:]]


def plain_probabilities(chain, text):
    """The chain's probabilities of one text: words, beginnings and levels in plain loops."""
    found = {}
    for chunk in {x.strip(toxicity.SIGNS) for x in text.encode().lower().split()} - {b""}:
        word = chunk.decode("utf-8", "replace")
        for feature in [zlib.crc32(chunk)] + [zlib.crc32(b"^" + word[:n].encode()) for n in (4, 5, 6) if len(word) > n]:
            found[feature] = found.get(feature, 0) + 1
    places = {(f + 40_503 * level) % (1 << 18) for f, n in found.items() for level in range(min(n, 3))}
    out = []
    for model in chain:
        z = model.bias + sum(model.words[p] for p in sorted(places)) + sum(w * p for w, p in zip(model.earlier, out))
        out.append(1 / (1 + math.exp(-z)))
    return out


def test_scores_equal_plain_loops(spark):
    rng = np.random.default_rng(9)
    chain = []
    for k in range(3):
        words = np.where(rng.random(toxicity.BUCKETS) < 0.2, rng.normal(0, 0.3, toxicity.BUCKETS), 0.0)
        chain.append(toxicity.Linear(words, rng.normal(0, 2, k), float(rng.normal())))
    texts = ["", "Plain words, plain WORDS!", "running runner runs runnable run", "é漢字 «quoted» ... 12 !!", "x" * 5_000, " ".join(f"prefix{n}" for n in range(300))]
    got = {r.doc_id: r for r in toxicity.score(documents(spark, [(n, t, "en", "a") for n, t in enumerate(texts)]), chain, toxicity.CATEGORIES).collect()}
    for n, t in enumerate(texts):
        want = plain_probabilities(chain, t)
        assert [got[n][f"p_{c}"] for c in toxicity.CATEGORIES] == pytest.approx(want, abs=1e-9) and got[n].toxic == (want[-1] >= toxicity.THRESHOLD)


def test_kinds_part_the_toxic_texts_by_their_words():
    # texts of one kind share two words, those of the other two others; clean texts have none of them
    features, lengths, toxic = [], [], []
    for n in range(300):
        own = [100 + n % 7, 110 + n % 5] + ([1, 2] if n % 3 == 0 else [3, 4] if n % 3 == 1 else [])
        features += own
        lengths.append(len(own))
        toxic.append(float(n % 3 < 2))
    kinds = toxicity.kinds_of(toxicity.Bags(np.array(features), np.array(lengths), 200), np.array(toxic))
    first = kinds[0].argmax()
    assert all(kinds[n].tolist() == ([0, 0] if n % 3 == 2 else [1, 0] if (n % 3 == 0) == (first == 0) else [0, 1]) for n in range(300))
    assert not toxicity.kinds_of(toxicity.Bags(np.array(features), np.array(lengths), 200), np.zeros(300)).any()


def test_later_models_learn_from_out_of_fold_predictions():
    # the word of the first category tells nothing about rows outside its fold, so the second must not trust it
    rng = np.random.default_rng(1)
    n = 300
    features = np.arange(n) + 1000  # one word per document: memorised by a model that has seen it
    bags = toxicity.Bags(features, np.ones(n, np.int64))
    label = rng.integers(0, 2, n).astype(float)
    chain = toxicity.fit_chain(bags, np.column_stack([label, label]), np.arange(n) % 3)
    assert abs(chain[1].earlier[0]) < 2


def test_network_tells_held_out_junk(spark):
    rng = random.Random(6)
    rows = []
    for n in range(260):
        w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(80)]
        good = n % 2
        rows.append(((n, " ".join(w if good else [x.upper() + "!!" for x in w]), "en", "a"), good))
    docs = documents(spark, [r for r, _ in rows] + [(1000 + n, *r[1:]) for n, r in enumerate(odd_rows())])
    net = quality_cnn.train(docs, labelled(spark, rows, "quality"), per_label=80, steps=200)
    got = quality_cnn.score(docs, net).collect()
    truth = {r[0]: k for r, k in rows}
    out = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in out) and sum(r.predicted == truth[r.doc_id] for r in out) >= 0.95 * len(out)
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)


def plain_probability(net, text):
    """Forward pass byte by byte, chunk by chunk."""
    padded = text.ljust(max(quality_cnn.GROUPS, -(-len(text) // quality_cnn.GROUP)) * quality_cnn.GROUP, b"\0")
    before = bytes(64) + padded
    best = [-math.inf] * quality_cnn.FILTERS
    for at in range(0, len(padded) - quality_cnn.WIDTH + 1, quality_cnn.GROUP):
        response = np.zeros(quality_cnn.FILTERS)
        for k in range(quality_cnn.WIDTH):
            for d in range(quality_cnn.DIMS):
                response += net.embedding[padded[at + k]][d] * net.kernel[k // quality_cnn.GROUP][k % quality_cnn.GROUP * quality_cnn.DIMS + d]
        for n, lag in enumerate(quality_cnn.LAGS):
            same = sum(before[64 + at + k] == before[64 + at + k - lag] for k in range(quality_cnn.WIDTH))
            response += same * 2 / quality_cnn.WIDTH * net.repeats[n]
        best = [max(a, b) for a, b in zip(best, response)]
    z = sum(max(b + shift, 0) * w for b, shift, w in zip(best, net.shift, net.out)) + net.bias[0]
    return 1 / (1 + math.exp(-z))


def test_forward_pass_equals_plain_loops():
    net = quality_cnn.Network.start()
    net.shift[:] = np.random.default_rng(3).normal(0, 0.2, quality_cnn.FILTERS)
    texts = [b"", b"x", b"some plain text of more than one chunk", b"abab" * 20, bytes(range(256)), b"\0" * 30]
    assert quality_cnn.probabilities(net, texts) == pytest.approx([plain_probability(net, t) for t in texts], abs=1e-5)


def test_the_whole_text_counts_and_blocks_do_not_matter(monkeypatch):
    net = quality_cnn.Network.start()
    texts = [b"", b"x", b"abc " * 3000 + b"!!###!!", bytes(range(256)) * 30, b"plain words " * 9]
    whole = quality_cnn.probabilities(net, texts)
    alone = np.concatenate([quality_cnn.probabilities(net, [t]) for t in texts])
    monkeypatch.setattr(quality_cnn, "GROUPS_AT_ONCE", 37)
    assert np.allclose(whole, quality_cnn.probabilities(net, texts), atol=1e-5)
    # the bytes before a text only touch its repetition channels at the very start
    assert np.allclose(whole[[1, 2]], alone[[1, 2]], atol=0.2)
    assert whole[2] != quality_cnn.probabilities(net, [texts[2][:-7]])[0]


def test_a_text_scores_the_same_beside_any_neighbour():
    net = quality_cnn.Network.start()
    net.out[:] = np.abs(net.out) * 5
    texts = [b"", b"x", b"ab" * 40, b"", b"\0" * 30, b"x", bytes(range(256)) * 3, b"ab" * 40, b"plain words " * 9, b""]
    alone = np.concatenate([quality_cnn.probabilities(net, [t]) for t in texts])
    assert np.allclose(quality_cnn.probabilities(net, texts), alone, atol=1e-5)
    assert np.allclose(quality_cnn.probabilities(net, texts[::-1])[::-1], alone, atol=1e-5)


def test_gradients_equal_differences():
    net = quality_cnn.Network.start()
    texts, label, weight = [b"some text to read, some text", b"ANOTHER ONE!! " * 4], np.array([1, 0], np.float32), np.ones(2, np.float32)

    def loss():
        p = quality_cnn.probabilities(net, texts)
        return float(-(label * np.log(p) + (1 - label) * np.log(1 - p)).mean())

    for parameter, gradient in zip(net.parameters(), quality_cnn.gradients(net, texts, label, weight)):
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        old = parameter[at]
        values = []
        for step in (1e-2, -1e-2):
            parameter[at] = old + step
            values.append(loss())
        parameter[at] = old
        assert abs((values[0] - values[1]) / 2e-2 - gradient[at]) < 0.05 * abs(gradient[at]) + 1e-3


def test_a_word_with_and_without_signs_is_tokenized_once():
    """Chunks of a word and one sign share the word's ids, which equal the library's."""
    encoder = pretokens.ChunkEncoder(json_of("word_bpe_49k.json"), cased=False)
    library, seen, found = Tokenizer.from_str(json_of("word_bpe_49k.json")), [], encoder.memo.fill
    encoder.memo.fill = lambda part: seen.append(part) or found(part)
    chunks = [w + s for w in ("heat", "reonnt", "zqxv" * 30, "a", "ünder", "İx", "x1") for s in ("", *".,;:!?)'\"-_~1é", "..", "\x7f", "\x00")]
    for c in chunks + ["'s", "don't", "1", "-", "(a"]:
        assert encoder.chunk(c.encode()) == library.encode(c, add_special_tokens=False).ids, c
    assert seen.count("heat") == 1 and seen.count("reonnt") == 1


def test_texts_without_suspicious_bytes_are_plain():
    for text in (*PIECES, "<", "<|", "a<b", "\u2019", "\u200b", "\u1680", "\ufeff", "\x1b", "\x1c", "\xa0", "", "plain"):
        raw = text.encode()
        assert pretokens.is_unusual(raw) == bool(pretokens.UNUSUAL.search(raw)), text
