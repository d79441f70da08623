"""Phrases and count automata, against plain counting and SQL."""

import random
import re
import sys
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from helpers import documents, odd_rows  # noqa: E402

from scalemetrics.llm import phrases  # noqa: E402
from scalemetrics.llm.count_automata import NONE, ORDER, Automaton, built, grams, summed, united  # noqa: E402


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def counted(texts, langs):
    """(lang -> n-gram -> count, lang -> words)."""
    f, n = {}, Counter()
    for text, lang in zip(texts, langs):
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return f, n


def plain(texts, langs, least, top):
    f, n = counted(texts, langs)
    out = []
    for lang, counts in f.items():
        found = {g: a for g, a in counts.items() if len(g) >= 2 and a >= least}
        inside = Counter()
        for g, a in found.items():
            for size in range(2, len(g)):
                for i in range(len(g) - size + 1):
                    inside[g[i : i + size]] = max(inside[g[i : i + size]], a)
        rows = []
        for g, a in found.items():
            if 100 * inside[g] >= 80 * a:
                continue
            score, k = min((2000000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), " ".join(g), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i, phrase, -a, l, r, n[lang], -s) for i, (s, a, _, phrase, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def random_texts(n, seed=1):
    rng = random.Random(seed)
    words = ["a", "b", "A", "c\x01", "c", "d\x00", "dé", "漢", "e'f", "x" * 100 + "1", "x" * 100 + "2", "\x1c", "\x0e"]
    gaps = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\x0b", "!", " "]
    return ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture
def small(monkeypatch):
    for name, value in {"SHARD_WORDS": 700, "BRICK": 150, "RANGE_BRICKS": 8, "REQUESTS_PER_TASK": 20_000}.items():
        monkeypatch.setattr(phrases, name, value)


@pytest.mark.parametrize("least, top", [(1, 100_000), (3, 50)])
def test_phrases_equal_plain_counting(spark, small, least, top):
    texts = random_texts(60)
    rows = [(n, t, ["en", "fr", None, "und"][n % 4], "a") for n, t in enumerate(texts)] + [(1000 + n, *r[1:]) for n, r in enumerate(odd_rows()) if least > 1]
    got = phrases.phrases(documents(spark, rows, 5), least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain([r[1] for r in rows], [r[2] for r in rows], least, top)


def test_an_empty_table_and_texts_without_words(spark):
    assert phrases.phrases(documents(spark, [(1, "a b", "en", "a")]).limit(0)).collect() == []
    assert phrases.phrases(documents(spark, [(1, None, None, None), (2, " .\n", "en", "a")])).collect() == []


def test_query_equals_sql(spark, tmp_path):
    rng = random.Random(4)
    texts = random_texts(120, 2) + ["One two three four. " * rng.randint(0, 9) + "one two THREE five" for _ in range(60)]
    rows = [(n, t, ["en", None, "fr"][n % 3], "a") for n, t in enumerate(texts)] + odd_rows()
    documents(spark, rows).select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, phrases.op12_phrases(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got and got == sorted(con.execute(phrases.sql()).fetchall())


def random_grams(n, seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(0, 6, (n, ORDER))
    lengths = rng.integers(1, ORDER + 1, n)
    rows[np.arange(ORDER) >= lengths[:, None]] = NONE
    return summed(rows, rng.integers(1, 50, n))


WORDS = [b"a", b"ab", b"b", b"c", b"d", b"e"]


def spelled(rows, words):
    return [tuple(words[i] for i in r if i != NONE) for r in rows]


def test_automata_hold_what_they_were_built_from():
    for seed in range(20):
        rows, counts = random_grams(300, seed)
        automaton = built(rows, counts, WORDS)
        again = Automaton.of(automaton.columns())
        assert spelled(again.paths(), again.words) == spelled(rows, WORDS) and (again.counts == counts).all()
        assert spelled(rows, WORDS) == sorted(spelled(rows, WORDS))
        # ranks of n-grams over another vocabulary, one of whose words is unknown
        other = [b"a", b"c", b"zz", b"e", b"b"]
        asked = np.array([[0, NONE, NONE, NONE], [1, 3, NONE, NONE], [2, 0, NONE, NONE], [4, 4, 1, NONE], [3, 3, 3, 3]])
        want = {g: i for i, g in enumerate(spelled(rows, WORDS))}
        assert automaton.ranks_of(asked, other).tolist() == [want.get(g, -1) for g in spelled(asked, other)]


def test_automata_are_minimal():
    for seed in range(5):
        rows, counts = random_grams(200, seed)
        automaton = built(rows, counts, WORDS)
        continuations = {s: set() for s in range(len(automaton.accepts))}
        for s in continuations:  # targets come before their state
            if automaton.accepts[s]:
                continuations[s].add(())
            for arc in range(automaton.offsets[s], automaton.offsets[s + 1]):
                continuations[s] |= {(automaton.labels[arc], *rest) for rest in continuations[automaton.targets[arc]]}
        assert len(set(map(frozenset, continuations.values()))) == len(continuations)


def test_union_adds_counts_and_drops_rare_ones():
    total, parts = Counter(), []
    for seed in range(4):
        rows, counts = random_grams(100, seed)
        one = built(rows, counts, WORDS)
        parts.append((one.paths(), one.counts, one.words))
        total.update(dict(zip(spelled(rows, WORDS), counts.tolist())))
    whole = united(parts, 40)
    assert dict(zip(spelled(whole.paths(), whole.words), whole.counts.tolist())) == {g: n for g, n in total.items() if n >= 40}


def test_ngrams_of_a_run():
    rng = np.random.default_rng(3)
    a = np.append(rng.integers(0, 5, 400), 0)
    good = lambda rows: (rows.sum(axis=1) % 3) > 0
    for orders in ((1, 2), (3, 4)):
        rows, counts = grams(a, orders, good)
        want = {}
        for size in orders:
            found = Counter(tuple((a[i : i + size] - 1).tolist()) for i in range(len(a) - size + 1))
            want |= {g: n for g, n in found.items() if -1 not in g and (size < 3 or all(sum(g[k : k + 2]) % 3 for k in range(size - 1)))}
        got = [tuple(x for x in r if x != NONE) for r in rows.tolist()]
        assert dict(zip(got, counts.tolist())) == want and got == sorted(got) and len(got) == len(want)
    assert [len(x) for x in grams(np.zeros(1, np.int64), (3, 4), good)] == [0, 0]


def test_uniting_many_ngrams_stays_within_a_hundred_bytes_each():
    import tracemalloc

    import numpy as np

    from scalemetrics.llm.count_automata import ORDER, united

    words = [b"%05d" % i for i in range(20_000)]
    rng = np.random.default_rng(1)
    parts = []
    for _ in range(4):
        rows = np.unique(rng.integers(0, len(words), (100_000, ORDER), dtype=np.int32), axis=0)
        parts.append((rows, np.ones(len(rows), np.int64), words))
    shared = parts[0][0][:1000]
    parts.append((shared, np.full(len(shared), 29), words))
    tracemalloc.start()
    found = united(parts, 30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found.counts == 30).all() and [[found.words[i] for i in r] for r in found.paths()] == [[words[i] for i in r] for r in shared]
    assert peak < 100 * sum(len(p[0]) for p in parts), peak


def test_stored_automata_are_narrow():
    rng = np.random.default_rng(5)
    rows = np.unique(np.concatenate([rng.integers(0, 300, (20_000, 2)), np.full((20_000, 2), NONE)], axis=1).astype(np.int32), axis=0)
    counts = rng.integers(1, 200, len(rows))
    automaton = built(rows, counts, [b"%03d" % i for i in range(300)])
    row = automaton.columns()
    assert sum(len(v) for v in row.values() if isinstance(v, bytes)) < 6 * len(rows)  # labels, targets and counts; 20 bytes each before
    again = Automaton.of(row)
    assert np.array_equal(again.paths(), rows) and np.array_equal(again.counts, counts) and np.array_equal(again.weights, automaton.weights)
    assert len(row["words"]) < 3 * 300 and again.words == automaton.words  # an array of them takes 16 bytes each and more


def test_runs_with_one_hash_stay_apart(monkeypatch):
    from scalemetrics.llm import count_automata

    rows = np.array([[0, 1, NONE, NONE], [0, 2, NONE, NONE], [1, 2, NONE, NONE], [2, 1, NONE, NONE], [2, 2, NONE, NONE]], np.int32)
    words, counts, honest, seeds = [b"a", b"b", b"c"], np.arange(1, 6), count_automata.run_hashes, []

    def meeting(labels, states, starts, accepts, seed):
        seeds.append(seed)
        return honest(labels, states, starts, accepts, seed) * np.uint64(seed > 1)

    plain = built(rows, counts, words)
    monkeypatch.setattr(count_automata, "run_hashes", meeting)
    again = built(rows, counts, words)
    assert max(seeds) == 2 and len(plain.accepts) == 4  # equal continuations are one state
    assert np.array_equal(again.paths(), rows) and np.array_equal(again.offsets, plain.offsets) and np.array_equal(again.targets, plain.targets)


def test_ranges_hold_like_numbers_of_n_grams(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BRICK", 256)
    monkeypatch.setattr(phrases, "RANGE_BRICKS", 4)
    rng, words = np.random.default_rng(8), [b"%04d" % i for i in range(4000)]
    shards = [np.sort(rng.choice(4000, 1024, replace=False)) for _ in range(40)]
    rows = [np.concatenate([s[:, None], np.full((1024, 3), NONE)], axis=1).astype(np.int32) for s in shards]
    bricks = [phrases.brick("en", r[at : at + 256], np.ones(256, np.int64) + k, words) for k, r in enumerate(rows) for at in range(0, 1024, 256)]
    cuts = phrases.cut_points(spark.createDataFrame(bricks, phrases.BRICKS).repartition(4))
    sizes = Counter()
    for r in rows:
        for part, a, b in phrases.range_edges(cuts, "en", words, r):
            sizes[part] += b - a
    assert 30 < len(sizes) < 50 and sum(sizes.values()) == 40 * 1024
    assert max(sizes.values()) < 3 * 4 * 256  # by the bricks' first n-grams: about 40 * 256
