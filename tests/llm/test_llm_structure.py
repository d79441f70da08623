"""Repair of conversation structure, against least (cost, audit) pairs by recursion and against SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import duckdb
import pytest

from scalemetrics.llm import structure_repair as repair
from scalemetrics.llm.structure_sql import SQL

SCHEMA = "conv_id long, turn long, role string, text string, block string, cost string, letter string, audit string"
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "ufo", "", None]
TEXTS = ["Yes.", "No!", "cut off", " \n", "", None, "Why?  ", "A.B", "Yes."]


def table(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "b", "c", "l", "a") for r in rows], SCHEMA).repartition(parts)


def random_rows(n, longest, seed=1):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for _ in range(rng.randint(1, longest)):
            rows.append((conv, rng.choice([None, *range(longest)]), rng.choice(ROLES), rng.choice(TEXTS)))
    return rows


def in_order(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2].encode())) for c, r in by.items()}


def plain(rows):
    """Digest of one conversation's ordered (turn, role, text) by trying every edit from the end; costs written out."""
    seen, faults = set(), []
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0d]", "", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    legal_next = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, ""), "s": (6, "II"), "u": (3, "I"), "a": (0, "")}
    for (_, role, _), fault in zip(reversed(rows), reversed(faults)):
        before = {}
        for state in best:
            options = [(best[state][0] + 4, "D" + best[state][1])]
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                new = legal_next[state]
                options.append((best[new][0] + 3 + extra, "R" + best[new][1]))
                if role[:1] == new or (role[:1] == "s" and state == ""):
                    options.append((best[role[0]][0] + extra, "K" + best[role[0]][1]))
            before[state] = min(options)
        for _ in range(3):
            before = {s: min(v, (before[legal_next[s]][0] + 3, "I" + before[legal_next[s]][1])) for s, v in before.items()}
        best = before
    cost, audit = best[""]
    lines, k, state = [], 0, ""
    for edit in audit:
        if edit == "D":
            k += 1
            continue
        name = {"u": "user", "a": "assistant"}[legal_next[state]]
        if edit == "I":
            lines.append(f"{name}:")
        else:
            lines.append(f"{rows[k][1] if edit == 'K' else name}:{rows[k][2]}")
            k += 1
        state = lines[-1][0]
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    turns = [t for t, *_ in rows if t is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
        out += [] if fate == 0 else [row, row] if fate == 3 else [row]
    return out


def digests(blocks):
    rows = [r.asDict() for r in repair.summaries(blocks).collect()]
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r.pop("conv_id"): r for r in rows}


@pytest.mark.parametrize("block_rows", [1, 2, 5, None])
def test_edits_are_the_least_of_the_cheapest(spark, block_rows):
    rows = random_rows(60, 14)
    got = digests(repair.repaired_blocks(table(spark, rows), block_rows=block_rows))
    assert got == {c: plain(r) for c, r in in_order(rows).items()}


def test_one_conversation_over_many_ranges(spark):
    rng = random.Random(5)
    rows = [(7, n // 2, rng.choice(ROLES), f"Text {n}." if n % 3 else rng.choice(TEXTS)) for n in range(3000)] + [(8, 0, "user", "Hi.")] * 300
    blocks = repair.repaired_blocks(table(spark, rows, 8))
    assert blocks.filter("conv_id = 7").count() > 20
    assert digests(blocks) == {c: plain(r) for c, r in in_order(rows).items()}
    turns = repair.repaired_turns(blocks).filter("conv_id = 7").orderBy("place").collect()
    text = "\n".join(f"{t.role}:{t.text}" for t in turns)
    assert hashlib.sha256(text.encode()).hexdigest() == plain(in_order(rows)[7])["repaired_sha256"]


def test_matrices_of_blocks_compose():
    rng = random.Random(6)
    for _ in range(50):
        letters = bytes(rng.randrange(16) for _ in range(rng.randint(2, 30)))
        k = rng.randrange(1, len(letters))
        assert (repair.composed(letters) == repair.least_sum(repair.composed(letters[:k]), repair.composed(letters[k:]))).all()
        togo = repair.vectors(letters, repair.ENDS)
        assert togo[0] == (repair.composed(letters) + repair.ENDS).min(axis=1).tolist()


def test_long_texts_empty_table_and_dropped_conversations(spark, tmp_path):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "y" * 3_000_000), (2, None, None, None)]
    assert digests(repair.repaired_blocks(table(spark, rows))) == {c: plain(r) for c, r in in_order(rows).items()}
    empty = repair.repaired_blocks(table(spark, rows).limit(0))
    assert repair.summaries(empty).collect() == [] and repair.repaired_turns(empty).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table(spark, [(gone, 0, "user", "Hi.")]).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = repair.op11_structure_repair(spark, str(tmp_path)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@cache
def connection():
    return duckdb.connect()


def test_query_equals_recursion_and_sql(spark, tmp_path):
    rows = random_rows(120, 9, seed=9)
    rows = list(dict.fromkeys(rows))
    table(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.asDict() for r in repair.op11_structure_repair(spark, str(tmp_path)).collect()}
    want = {c: plain(r) for c, r in in_order(damage(rows)).items()}
    nothing = plain([])
    assert {c: {k: v for k, v in r.items() if k != "conv_id"} for c, r in got.items()} == {c: want.get(c, nothing) for c, *_ in rows}
    con = connection()
    con.execute(f"create or replace view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    cursor = con.execute(SQL)
    names = [d[0] for d in cursor.description]
    sql = {r["conv_id"]: r for r in (dict(zip(names, row)) for row in cursor.fetchall())}
    assert sql == got
