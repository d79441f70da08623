"""Mixing, sharding, quality rules, vectors, chats and the pipeline, against brute force and SQL."""

import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from helpers import base_counts, components, documents, gapless, near_duplicates, odd_rows, words  # noqa: E402

import corpus_pipeline  # noqa: E402
from scalemetrics.llm import chat_repair, minhash, mixing, packing, quality_cnn, quality_rules, rotation_codes, sharding, token_counts, toxicity  # noqa: E402
from scalemetrics.llm.components import _state, connected_components  # noqa: E402
from scalemetrics.llm.queries import ORACLES, QUERIES  # noqa: E402

TABLES = "documents embeddings benchmark labels conversations"


def many(n, hot=0.4):
    rng = random.Random(3)
    return [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 200))), "en", "hot" if rng.random() < hot else f"s{i % 7}") for i in range(n)]


def test_all_operators_and_the_pipeline_are_registered():
    numbers = {int(m[1]) for m in (re.match(r"op(\d+)_", n) for n in QUERIES) if m}
    assert numbers == set(range(1, 14)) and "pipeline" in QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    got = QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(result.fetchall())


def test_mix_comes_near_every_target(spark):
    rows = many(3000)
    got = mixing.mix(documents(spark, rows)).collect()
    source = {r[0]: r[3] for r in rows}
    size = {r[0]: len(words(r[1])) for r in rows}
    total = defaultdict(int)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.taken in (0, r["size"], 2 * r["size"])
        total[source[r.doc_id]] += r.taken
    sources = {source[r.doc_id]: (r.source_size, r.target) for r in got}
    for s, (own, target) in sources.items():
        assert own == sum(v for k, v in size.items() if source[k] == s) and target <= 2 * own
        assert abs(total[s] - target) <= 200
    assert abs(sum(t for _, t in sources.values()) - 1.5 * sum(size.values())) < 1e-3
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sorted(sources))}
    levels = {round(t / weight[s], 6) for s, (own, t) in sources.items() if t < 2 * own}
    assert len(levels) == 1
    again = mixing.mix(documents(spark, rows[::-1], parts=7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_sampling_is_unequal_by_class_and_random_inside(spark):
    rows = [(i, " ".join(["w"] * (20 if i % 2 else 100)), "en", "a") for i in range(4000)] + [(9000 + i, "w " * 300, "en", "b") for i in range(4000)]
    got = {r.doc_id: r for r in mixing.mix(documents(spark, rows)).collect()}
    share = lambda ids: np.mean([got[i].copies for i in ids])
    short, usual = share(range(1, 4000, 2)), share(range(0, 4000, 2))
    assert usual == 2.0 or abs(short / usual - 0.5) < 0.05
    b = [got[9000 + i].copies for i in range(4000)]
    assert set(b) <= {0, 1, 2} and abs(np.mean(b[::2]) - np.mean(b[1::2])) < 0.06


def test_mix_of_odd_rows(spark):
    docs = documents(spark, odd_rows())
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(r.taken == 0 for r in got if r["size"] == 0)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.text for r in mixed.collect()) == Counter(t for r in got for t in [next(x[1] for x in odd_rows() if x[0] == r.doc_id and len(words(x[1])) == r["size"])] * r.copies)


def test_shards_carry_the_mixture(spark):
    rows = many(1603)
    got = sharding.interleave(documents(spark, rows)).collect()
    text, source = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    assert all(r["size"] == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None for r in got)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    for s in set(source.values()):
        each = [sum(1 for r in got if r.shard == k and source[r.doc_id] == s) for k in range(16)]
        assert max(each) - min(each) <= 2
    again = sharding.interleave(documents(spark, rows[::-1], parts=5)).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == {r.doc_id: (r.shard, r.slot) for r in again}


def draw_of(seed, *values):
    """The seeded draw, recomputed: the first 52 bits of a checksum of the marked values."""
    import hashlib

    text = "|".join([seed, *("-" if v is None else f"={v}" for v in values)])
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def test_the_order_of_shards_recomputed(spark):
    rows = many(700) + odd_rows()
    ranked = defaultdict(list)
    for i, text, _, source in rows:
        size, crc, key = len((text or "").encode()) + 1, zlib.crc32((text or "").encode()), "-" if source is None else f"={source}"
        ranked[key].append((draw_of("shards", i, crc, size, key), i is not None, i or 0, crc, size, i))
    order = []
    for key, members in ranked.items():
        for rank, m in enumerate(sorted(members)):
            order.append(((2 * rank + 1) / (2 * len(members)), key, rank, m[-1], m[3]))
    order.sort(key=lambda x: x[:3])
    got = sorted(sharding.interleave(documents(spark, rows), n_shards=7).collect(), key=lambda r: (r.shard, r.slot))
    assert [(r.doc_id, r.text_crc32) for r in got] == [x[3:] for x in order]
    assert [r.shard for r in got] == [n * 7 // len(rows) for n in range(len(rows))]


def test_shards_of_odd_rows(spark):
    got = sharding.interleave(documents(spark, odd_rows()), n_shards=4).collect()
    assert len(got) == len(odd_rows()) and all(r["size"] == 1 for r in got if r.doc_id in (1, 2))
    assert all(v == Counter(r.shard for r in got)[s] for s, v in gapless([{"s": r.shard, "o": r.slot, "n": 1} for r in got], "s", "o", "n").items())


def test_a_text_of_thousands_of_equal_lines_has_its_share(spark):
    rows = [(1, "the same line\n" * 3000, "en", "a"), (2, "one line", "en", "a")]
    docs = documents(spark, rows)
    got = {r.doc_id: r.q for r in quality_rules.quality_rules(docs).collect()}
    assert got[1].n_dup_lines == 2999 and got[1].dup_line_share == 2999 * 1_000_000 // 3000
    assert got[2].n_dup_lines == 0 and got[2].dup_line_share == 0
    assert quality_rules.filter_documents(docs).collect() == []


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(n, "".join(rng.choice(["a ", "b ", "a b c ", "x\n", "\n", "#", "%%% ", "Ä", "\t", "a b c d e f g h\n"]) for _ in range(rng.randint(0, 120))), "en", "s") for n in range(150)]
    rows += [(1000 + n, *r[1:]) for n, r in enumerate(odd_rows())]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, text, *_ in rows:
        expected = base_counts(text)
        q = got[i].q
        assert {k: q[k] for k in expected} == expected, repr(text)[:200]
        failed = expected["n_words"] < 50 or 100 * expected["n_repeat_words"] > 50 * expected["n_words"]
        assert q.base_failed == failed and not (failed and got[i].kept)
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_fences_follow_the_group(spark):
    normal = lambda n, mark: " ".join(f"w{n}k{k}" + mark * (k % 7 == 0) for k in range(80))
    rows = [(n, normal(n, "#"), "en", "code") for n in range(60)] + [(100 + n, normal(n, ""), "en", "prose") for n in range(60)]
    rows += [(500, " ".join(f"v{k}###" for k in range(80)), "en", "prose"), (501, normal(501, "#"), "en", "code")]
    kept = {r.doc_id for r in quality_rules.quality_rules(documents(spark, rows)).filter("kept").collect()}
    assert kept == {r[0] for r in rows} - {500}


def test_sketches_of_parts_add_up(spark):
    docs = documents(spark, many(400))
    stats = quality_rules.text_stats(docs)
    count = lambda s: {(r.lang_key, r.source_key, r.measure, r.counter): r.n for r in s.collect()}
    whole = count(quality_rules.sketches(stats, quality_rules.SPREADS))
    parts = [count(quality_rules.sketches(stats.filter(f"doc_id % 2 = {k}"), quality_rules.SPREADS)) for k in (0, 1)]
    assert whole == dict(sum((Counter(p) for p in parts), Counter()))


def vectors(spark, rows, parts=3):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(parts)


def test_vectors_link_as_by_brute_force(spark):
    rng = np.random.default_rng(9)
    rows, n = [], 0
    for _ in range(30):
        base = rng.standard_normal(64)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((n, [float(x) for x in np.float32(base + rng.standard_normal(64) * rng.choice([0.0, 0.05, 0.15, 0.22]))], int(rng.integers(0, 2))))
            n += 1
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = (x @ x.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    np.fill_diagonal(linked, False)
    part = components(range(n), [(a, b) for a, b in zip(*np.nonzero(linked)) if a < b])
    got = rotation_codes.near_vectors(vectors(spark, rows)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (int(linked[i].sum()), part[i], part[i] == i) for i in range(n)}
    assert linked.sum() > 40


def test_a_large_group_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(rotation_codes, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(64)
    rows = [(n, [float(v) for v in np.float32(base + 0.02 * rng.standard_normal(64))], 1) for n in range(90)]
    got = rotation_codes.near_vectors(vectors(spark, rows)).collect()
    assert all(r.n_links == 89 and r.component_id == 0 for r in got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, 0.0], None),
            (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (9, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1)]
    got = rotation_codes.near_vectors(vectors(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r.n_links == 0 and r.kept for r in got if r.vec_id in (1, 2, 3, 4, 5, 6, 7, 10))
    assert all(r.n_links == 3 and r.component_id == 8 for r in got if r.vec_id in (8, 9, None))


def test_code_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(12)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = 0.7 * x + 0.7 * rng.standard_normal((400, 64)) / 8
    y /= np.linalg.norm(y, axis=1)[:, None]
    _, signs, factors = rotation_codes.codes(x)
    turned = rotation_codes.codes(y)[0]
    estimate = (signs * turned).sum(axis=1) / 8 / factors
    true = (x * y).sum(axis=1)
    assert abs((estimate - true).mean()) < 0.02
    assert (rotation_codes.upper_bounds(signs, factors, turned) >= x @ y.T).all()


def test_components_of_chains_and_stars(spark):
    edges = [(n, n + 1) for n in range(40)] + [(100, 100 + n) for n in range(1, 60)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 0 for n in range(41)} | {100 + n: 100 for n in range(60)}


def test_component_state_of_more_edges_than_a_long_holds(spark):
    # 40-bit hashes of 2^24 edges add up to about 2^63
    count, total = _state(spark.range(18_000_000).select(F.col("id").alias("v"), (F.col("id") + 1).alias("u")))
    assert count == 18_000_000 and total > 1 << 63


@pytest.mark.parametrize("bits", [12, 2])
def test_chats_are_repaired_at_least_cost(spark, monkeypatch, bits):
    monkeypatch.setattr(chat_repair, "BLOCK_BITS", bits)
    rng = random.Random(3)
    rows = []
    for c in range(25):
        for t in range(rng.choice([1, 2, 3, 9, 60])):
            rows.append((c if c != 7 else None, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", "tool", "human", "weird", None]), rng.choice(["hi", None, "", "a <|user|> b"]), "x"))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, action string").repartition(4)
    by = defaultdict(list)
    for r in chat_repair.rendered(chat_repair.repaired_turns(turns)).collect():
        by[r.conv_id].append(r)
    code = {r: n for n, r in enumerate(chat_repair.ROLES)} | {a: chat_repair.ROLES.index(r) for a, r in chat_repair.ALIASES.items()}
    assert sum(map(len, by.values())) == len(rows)
    for conv in by.values():
        conv.sort(key=lambda r: r.place)
        costs = {0: 0}
        for r in conv:
            moves = [(v + m[0], t) for s, v in costs.items() for t in range(1, 5) if (m := chat_repair.MOVES.get((code.get(r.role, 4), s, t)))]
            costs = {t: min(v for v, k in moves if k == t) for _, t in moves}
        assert sum(r.cost for r in conv) == min(v + chat_repair.INSERT * len(chat_repair.ending(chat_repair.STATES[s])) for s, v in costs.items())
        text = "".join(r.piece for r in conv)
        roles = re.findall(r"<\|(system|user|assistant|tool)\|>\n", text)
        assert all(b in chat_repair.NEXT[a] for a, b in zip(["", *roles], roles)) and roles[-1] == "assistant" and text.count("<|end|>") == len(roles)


def test_a_conversation_of_many_millions_of_costs_is_repaired(spark):
    # 2^21 merges composed, then a walk over several such parts
    user = chat_repair.ROLES.index("user") + 1
    m = chat_repair.COSTS[user - 1]
    for _ in range(21):
        m = chat_repair.composed(np.stack([m, m]))
    assert m[user, user] == 1 << 21 and m[0, user] == (1 << 21) - 1
    assert chat_repair.walk([m] * 5, 0, chat_repair.END_COSTS)[1:] == [user] * 4 + [chat_repair.STATES.index(chat_repair.LAST)]
    # one conversation of user turns in one range: those between the first and the last are merged, the last one answers
    n = 1_060_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = chat_repair.repaired_turns(turns).groupBy("action", "new_role").agg(F.count("*").alias("n"), F.sum("cost").alias("cost")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert sorted(map(tuple, got)) == [("keep", "user", 1, 0), ("merge", "user", n - 2, n - 2), ("relabel", "assistant", 1, chat_repair.RELABEL)]


def test_legal_chats_stay_as_they_are(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")], "conv_id long, turn long, role string, text string")
    got = sorted(chat_repair.rendered(chat_repair.repaired_turns(turns)).collect(), key=lambda r: r.place)
    assert [r.action for r in got] == ["keep"] * 3 and sum(r.cost for r in got) == 0
    assert "".join(r.piece for r in got) == "<|system|>\ns\n<|end|>\n<|user|>\nu\n<|end|>\n<|assistant|>\na\n<|end|>\n"


def test_empty_tables(spark):
    docs = documents(spark, odd_rows()).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    tokenizer = packing.word_tokenizer()
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for df in (
        chat_repair.rendered(chat_repair.repaired_turns(chats)), rotation_codes.near_vectors(vectors(spark, [])), packing.packed_documents(docs, tokenizer),
        toxicity.clean_documents(docs, labels), mixing.mix(docs), mixing.mixed_documents(docs), quality_cnn.score(docs, quality_cnn.train(docs, labels)),
        minhash.near_duplicates(docs), minhash.one_of_each_group(docs), sharding.interleave(docs), quality_rules.quality_rules(docs), quality_rules.filter_documents(docs),
        token_counts.count_tokens(docs, tokenizer),
    ):
        assert df.count() == 0


def test_pipeline_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, sf))
        out[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    chain = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    scored = toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), chain, toxicity.CATEGORIES).collect()
    assert {r.doc_id for r in out["toxicity"]} == {r.doc_id for r in scored if not r.toxic}
    for r in out["quality_rules"]:
        counts = base_counts(r.text)
        assert counts["n_words"] >= 50 and 100 * counts["n_repeat_words"] <= 50 * counts["n_words"]
    part = near_duplicates({r.doc_id: r.text for r in out["quality_rules"]})
    assert sorted(r.doc_id for r in out["minhash"]) == sorted(set(part.values()))
    size = {r.doc_id: len(words(r.text)) for r in out["minhash"]}
    times = Counter(r.doc_id for r in out["mixing"])
    assert set(times) <= set(size) and max(times.values()) <= 2
    taken = sum(size[i] * n for i, n in times.items())
    assert abs(taken - 1.5 * sum(size.values())) < 0.05 * sum(size.values())
    pieces = Counter(r.doc_id for r in out["packing"] if r.piece == 0)
    assert pieces == times and max(gapless(out["packing"], "sequence_id", "offset", "length").values()) <= 2048
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in out["packing"])


def pipeline_over(spark, path, rows, labels):
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars", "q", "kept", "size", "target", "score", "toxic", "component_id").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return corpus_pipeline.run(spark, str(path)).collect()


def test_pipeline_on_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    plain = [(100 + n, " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(rng.randint(60, 200))), rng.choice(["en", None]), rng.choice(["a", "b", None])) for n in range(60)]
    rows = odd_rows() + plain + plain[:3] + [(None, plain[0][1], "en", "a"), (300, plain[5][1].upper(), "en", "b")]
    got = pipeline_over(spark, tmp_path, rows, [(100 + n, 1, int(n % 9 == 0)) for n in range(60)] + [(None, 1, 1), (101, None, None)])
    ids = {r.doc_id for r in got}
    assert ids <= {r[0] for r in rows} and 300 not in ids  # a copy of 105 in capitals
    assert not ids & {1, 2, 3, 5, 6} and max(gapless(got, "sequence_id", "offset", "length").values()) <= 2048


def test_pipeline_on_an_empty_table(spark, tmp_path):
    documents(spark, odd_rows()).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
