"""Repair of conversation structure: the cheapest edits that leave (system)? (user assistant)+, or nothing.

Rows may be kept, given another role or deleted, and empty turns inserted. Cost-to-go vectors over four states run
backwards over a conversation; walking forward from its beginning, the least letter among the edits that stay
cheapest (the tight ones) gives the ASCII-least of the cheapest edit strings.

Vectors are not kept for every row. A conversation is cut into blocks of about the square root of the longest
conversation's rows, and only the vector behind each block is stored:

1. Rows are sorted by ranges of (conversation, turn, role, text), so a long conversation spans many tasks; each task cuts
   its rows into blocks with the least-sum matrix of the block.
2. The matrices of a conversation, last block first, give the checkpoint vectors.
3. Every block recomputes its inner vectors from its checkpoint and finds where each of four states would leave it;
   these maps, first block first, give the state that enters each block.
4. Every block recomputes its vectors once more and emits its edits.

Blocks that hold a whole conversation skip steps 2 and 3. Steps 2 and the maps of 3 take one narrow row per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalemetrics.llm.common import source_key, table
from scalemetrics.llm.registry import query
from scalemetrics.llm.structure_sql import SQL
from scalemetrics.workspace import settle

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ASSISTANT, USER = "assistant", "user"
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = STATES = range(4)
OTHER = 3  # role code behind system, user, assistant
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)  # first fault of a row
NEVER = 1 << 50
ENDS = np.array([0, 2 * INSERT, INSERT, 0], np.int64)  # cost to end a conversation, by state
EXPECTED = {START: AFTER_USER, AFTER_SYSTEM: AFTER_USER, AFTER_USER: AFTER_ASSISTANT, AFTER_ASSISTANT: AFTER_USER}
SPACES = " \t\n\x0b\x0c\r"
LEAST_BLOCK, BLOCK_BYTES = 16, 1 << 20
LEGAL_PAIRS = {(0, 1), (1, 2), (2, 1)}  # system user, user assistant, assistant user


def kept_state(code: int, state: int) -> int | None:
    """State after keeping a row's role."""
    if code == 0:
        return AFTER_SYSTEM if state == START else None
    return EXPECTED[state] if code == EXPECTED[state] - 1 else None


def moves(letter: int) -> list[list[tuple[str, int, int]]]:
    """Per state the (edit, cost, state after) of a row, in the order of the edits' letters; ``letter`` is code + 4 * fault."""
    code, fault = letter & 3, letter >> 2
    extra = TRUNCATED if fault == CUT_OFF else 0
    out = []
    for state in STATES:
        options = [("D", DELETE, state)]
        if fault not in (BLANK, DUPLICATE):
            after = kept_state(code, state)
            if after is not None:
                options.append(("K", KEEP + extra, after))
            options.append(("R", REROLE + extra, EXPECTED[state]))
        out.append(options)
    return out


def least_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., :, :, None] + b[..., None, :, :]).min(axis=-2).clip(max=NEVER)


def steps() -> np.ndarray:
    """Least-sum matrix of every letter: inserted turns, then the row."""
    inserts = np.full((4, 4), NEVER, np.int64)
    for s in STATES:
        inserts[s, s] = 0
        inserts[s, EXPECTED[s]] = INSERT
    inserts = least_sum(inserts, inserts)
    rows = np.full((16, 4, 4), NEVER, np.int64)
    for letter in range(16):
        for s, options in enumerate(moves(letter)):
            for _, cost, after in options:
                rows[letter, s, after] = min(cost, rows[letter, s, after])
    return least_sum(np.broadcast_to(inserts, rows.shape), rows)


MOVES = [moves(letter) for letter in range(16)]
STEPS = steps()


def composed(letters: bytes) -> np.ndarray:
    """Matrix of a block, neighbours combined pair by pair."""
    m = STEPS[np.frombuffer(letters, np.uint8)]
    while len(m) > 1:
        odd = m[len(m) // 2 * 2 :]
        m = np.concatenate([least_sum(m[: len(m) // 2 * 2 : 2], m[1 : len(m) // 2 * 2 : 2]), odd])
    return m[0]


def vectors(letters: bytes, behind: np.ndarray) -> list[list[int]]:
    """Cost-to-go before each row of a block and behind the last one."""
    out = [behind]
    for letter in reversed(letters):
        out.append((STEPS[letter] + out[-1]).min(axis=1))
    return [v.tolist() for v in reversed(out)]


def walk(letters: bytes, togo: list[list[int]], state: int) -> tuple[str, int, int]:
    """Least tight edits of a block entered in ``state``, the state after it and their cost."""
    out, spent = [], 0
    for k, letter in enumerate(letters):
        here, ahead, options = togo[k], togo[k + 1], MOVES[letter]
        while True:
            need = here[state]
            edit, cost, after = options[state][0]  # deleting has the least letter
            if cost + ahead[after] == need:
                break
            inserted = EXPECTED[state]
            if INSERT + here[inserted] == need:
                out.append("I")
                spent += INSERT
                state = inserted
                continue
            edit, cost, after = next(o for o in options[state][1:] if o[1] + ahead[o[2]] == need)
            break
        out.append(edit)
        spent += cost
        state = after
    return "".join(out), state, spent


def closing(state: int) -> str:
    """Edits that end a conversation."""
    return "I" * (int(ENDS[state]) // INSERT)


@dataclass
class Block:
    """Rows of one conversation in order, and what its neighbours need to know."""

    starts: bool
    conv: str | None = None
    conv_id: object = None
    letters: bytearray = field(default_factory=bytearray)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    turns: list[int] = field(default_factory=list)
    size: int = 0

    def add(self, conv: str, conv_id: object, turn: int | None, role: str, text: str, letter: int) -> None:
        self.conv, self.conv_id = conv, conv_id
        self.letters.append(letter)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)
        if turn is not None:
            self.turns.append(turn)

    def row(self, number: int, ends: bool) -> dict:
        faults = [letter >> 2 for letter in self.letters]
        codes = [letter & 3 for letter in self.letters]
        turns = self.turns
        return {
            "conv": self.conv, "conv_id": self.conv_id, "block": number, "whole": self.starts and ends, "letters": bytes(self.letters),
            "roles": self.roles, "texts": self.texts, "m": composed(bytes(self.letters)).ravel().tolist(),
            "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
            "turns": len(set(turns)), "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT_OFF),
            "illegal": sum(pair not in LEGAL_PAIRS for pair in zip(codes, codes[1:])),
        }


COUNTS = "first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long"


def arrow_type(simple: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(simple))


def emitted(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def judged(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with ``conv`` (never null), ``at`` (turn, nulls first), ``row`` (breaks ties) and ``letter`` (role code and first fault)."""
    t, r = F.coalesce(F.col(text), F.lit(" ")), F.coalesce(F.col(role), F.lit(" "))
    rows = settle(
        turns.select(
            source_key(F.col(conv_id)).alias("conv"), F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), r.alias("role"), t.alias("text"),
            F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t)).alias("key"), F.monotonically_increasing_id().alias("row"),
        ).withColumn("at", F.coalesce("turn", F.lit(-(1 << 63))))
    )
    # (at, row) as one number, so that its minimum is kept by hash aggregation; equal rows differ in row
    place = F.col("at").cast("decimal(19,0)") * F.lit(str(1 << 63)).cast("decimal(19,0)") + F.col("row")
    rows = rows.withColumn("place", place.cast("decimal(38,0)"))
    total = rows.count()
    firsts = settle(rows.groupBy("conv", "key").agg(F.count("*").alias("n"), F.min("place").alias("first")).filter("n > 1"))
    # keys of more than a thousandth of all rows: a thousand at most
    heavy = F.broadcast(firsts.filter(F.col("n") * 1000 > total).select("conv", "key", F.col("first").alias("first_heavy")))
    light = firsts.filter(F.col("n") * 1000 <= total).select("conv", "key", "first")
    rows = rows.join(heavy, ["conv", "key"], "left")
    known = F.col("first_heavy").isNotNull()
    rows = rows.filter(known).withColumn("first", F.col("first_heavy")).unionByName(rows.filter(~known).join(light, ["conv", "key"], "left"))
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = (
        F.when(F.ltrim(end, F.lit(SPACES)) == "", BLANK)
        .when(F.col("place") > F.col("first"), DUPLICATE)
        .when(~F.right(end, F.lit(1)).isin(".", "!", "?"), CUT_OFF)
        .otherwise(SOUND)
    )
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    return rows.select("conv", "conv_id", "turn", "role", "text", "at", "row", (code + 4 * fault).cast("int").alias("letter"))


def blocks_of(turns: DataFrame, conv_id: str, turn: str, role: str, text: str, block_rows: int | None) -> DataFrame:
    rows = judged(turns, conv_id, turn, role, text)
    if block_rows is None:
        longest = turns.groupBy(conv_id).count().agg(F.max("count")).first()[0] or 0
        block_rows = max(LEAST_BLOCK, isqrt(longest))
    kind = turns.schema[conv_id].dataType.simpleString()
    ddl = f"conv string, conv_id {kind}, block long, whole boolean, letters binary, roles array<string>, texts array<string>, m array<long>, {COUNTS}"
    schema = arrow_type(ddl)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        block = Block(starts=False)  # the range before may hold the conversation's beginning
        for batch in batches:
            done = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                other = bool(block.letters) and values[0] != block.conv
                if other or len(block.letters) >= block_rows or block.size >= BLOCK_BYTES:
                    done.append(block.row(number, ends=other))
                    number += 1
                    block = Block(starts=other)
                block.add(*values)
            yield from emitted(done, schema)
        if block.letters:
            yield from emitted([block.row(number, ends=False)], schema)

    keys = ["conv", "at", "role", "text", "row"]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return settle(ranged.select("conv", "conv_id", "turn", "role", "text", "letter").mapInArrow(cut, ddl))


def checkpoints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks by conversation, last one first: the vector behind each, and whether it is the last."""
    schema = pa.schema([("block", pa.int64()), ("behind", pa.list_(pa.int64())), ("final", pa.bool_())])
    conv, vector = None, ENDS
    for batch in batches:
        out = []
        for c, block, m in zip(*(x.to_pylist() for x in batch.columns)):
            final = c != conv
            if final:
                conv, vector = c, ENDS
            out.append({"block": block, "behind": vector.tolist(), "final": final})
            vector = (np.array(m, np.int64).reshape(4, 4) + vector).min(axis=1)
        yield from emitted(out, schema)


def leaving(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block the state behind it, by the state before it."""
    schema = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("exits", pa.list_(pa.int32()))])
    for batch in batches:
        out = []
        for conv, block, letters, behind in zip(*(x.to_pylist() for x in batch.columns)):
            togo = vectors(letters, np.array(behind, np.int64))
            out.append({"conv": conv, "block": block, "exits": [walk(letters, togo, s)[1] for s in STATES]})
        yield from emitted(out, schema)


def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks by conversation, first one first: the state before each."""
    schema = pa.schema([("block", pa.int64()), ("entry", pa.int32())])
    conv, state = None, START
    for batch in batches:
        out = []
        for c, block, exits in zip(*(x.to_pylist() for x in batch.columns)):
            if c != conv:
                conv, state = c, START
            out.append({"block": block, "entry": state})
            state = exits[state]
        yield from emitted(out, schema)


def repaired_blocks(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_rows: int | None = None) -> DataFrame:
    """Blocks of conversations in order (``block``): conv_id, audit, lines and cost of each, and counts of its faults.

    ``lines`` are the repaired (role, text) of the block, ``audit`` the initials of its edits (D, I, K, R), where ``whole``
    says that the block is its whole conversation. Rows are ordered by turn (nulls first), role, text; rows equal in full
    may stand in any order among each other. Null roles and texts are one space (the role is illegal, the text
    blank). Rows with null conv_id are one conversation. An empty table has no blocks. A block closes at ``block_rows``
    rows (default: the square root of the longest conversation) or 1 MB of text, so that a block with a very long text
    holds little else.
    """
    blocks = blocks_of(turns, conv_id, turn, role, text, block_rows)
    parted = blocks.filter("not whole")
    narrow = parted.select("conv", "block", "m").repartition("conv").sortWithinPartitions("conv", F.desc("block"))
    behind = settle(narrow.mapInArrow(checkpoints, "block long, behind array<long>, final boolean"))
    exits = parted.select("conv", "block", "letters").join(behind.select("block", "behind"), "block").select("conv", "block", "letters", "behind")
    maps = settle(exits.mapInArrow(leaving, "conv string, block long, exits array<int>"))
    placed = maps.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(entries, "block long, entry int")
    marks = settle(behind.join(placed, "block"))
    alone = {"behind": F.array(*(F.lit(int(e)).cast("long") for e in ENDS)), "final": F.lit(True), "entry": F.lit(START)}
    ready = blocks.filter("whole").withColumns(alone).unionByName(parted.join(marks, "block"))
    kind = turns.schema[conv_id].dataType.simpleString()
    ddl = f"conv string, conv_id {kind}, block long, whole boolean, audit string, cost long, lines array<struct<role:string,text:string>>, first_code int, last_code int, {COUNTS}"
    schema, counts = arrow_type(ddl), [c.split()[0] for c in COUNTS.split(", ")]

    def edit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                audit, state, cost = walk(b["letters"], vectors(b["letters"], np.array(b["behind"], np.int64)), b["entry"])
                if b["final"]:
                    audit, cost = audit + closing(state), cost + int(ENDS[state])
                ends = {"first_code": b["letters"][0] & 3, "last_code": b["letters"][-1] & 3}
                lines = repaired_lines(audit, b["entry"], b["roles"], b["texts"])
                out.append({c: b[c] for c in ("conv", "conv_id", "block", "whole", *counts)} | ends | {"audit": audit, "cost": cost, "lines": lines})
            yield from emitted(out, schema)

    return ready.select("conv", "conv_id", "block", "whole", "letters", "roles", "texts", "behind", "final", "entry", *counts).mapInArrow(edit, ddl)


def repaired_lines(audit: str, state: int, roles: list[str], texts: list[str]) -> list[dict[str, str]]:
    """Roles and texts that the edits leave, from the state before them."""
    lines, at = [], 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        after = AFTER_SYSTEM if edit == "K" and roles[at].startswith("s") else EXPECTED[state]
        named = USER if after == AFTER_USER else ASSISTANT
        if edit == "I":
            lines.append({"role": named, "text": ""})
        else:
            lines.append({"role": roles[at] if edit == "K" else named, "text": texts[at]})
            at += 1
        state = after
    return lines


def repaired_turns(blocks: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place (orders a conversation's turns), role, text."""
    rows = blocks.select("conv_id", "block", F.posexplode("lines").alias("line", "l"))
    return rows.select("conv_id", F.struct("block", "line").alias("place"), "l.role", "l.text")


@dataclass
class Summary:
    """Digest of a conversation, block after block."""

    conv_id: object
    audits: list[str] = field(default_factory=list)
    sha: object = field(default_factory=hashlib.sha256)
    begun: bool = False
    last_code: int | None = None
    least_turn: int | None = None
    last_turn: int | None = None
    turns: int = 0
    sums: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0))

    def add(self, b: dict) -> None:
        self.audits.append(b["audit"])
        for line in b["lines"]:
            if self.begun:
                self.sha.update(b"\n")
            self.begun = True
            self.sha.update(f"{line['role']}:{line['text']}".encode("utf-8", "surrogatepass"))
        for name in self.sums:
            self.sums[name] += b[name]
        if self.last_code is not None and (self.last_code, b["first_code"]) not in LEGAL_PAIRS:
            self.sums["illegal"] += 1
        self.last_code = b["last_code"]
        if b["turns"]:
            self.turns += b["turns"] - (self.last_turn == b["first_turn"])
            self.least_turn = b["first_turn"] if self.least_turn is None else self.least_turn
            self.last_turn = b["last_turn"]

    def row(self) -> dict:
        gaps = self.last_turn - self.least_turn + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, **self.sums, "audit": "".join(self.audits), "repaired_sha256": self.sha.hexdigest()}


def summaries(blocks: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Whole conversations are digested where they are. The blocks of the others pass through a task one after the other,
    since the digest of a text cannot be put together from its parts; the task holds one batch of blocks and the audit.
    """
    kind = blocks.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    schema = arrow_type(ddl)

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now = None, None
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                if now is None or b["conv"] != conv:
                    if now is not None:
                        out.append(now.row())
                    conv, now = b["conv"], Summary(b["conv_id"])
                now.add(b)
            yield from emitted(out, schema)
        if now is not None:
            yield from emitted([now.row()], schema)

    parted = blocks.filter("not whole").repartition("conv").sortWithinPartitions("conv", "block")
    return blocks.filter("whole").mapInArrow(digest, ddl).union(parted.mapInArrow(digest, ddl))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults, chosen by a checksum of conversation and turn."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), fate.alias("fate")).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("fate") == 4, USER).otherwise(F.col("role"))})
    return rows.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "fate")


@query("op11_structure_repair", SQL)
def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = settle(summaries(settle(repaired_blocks(damaged(turns)))).withColumn("__conv", source_key(F.col("conv_id"))).drop("conv_id"))
    every = turns.select("conv_id").distinct()
    joined = every.join(found, source_key(F.col("conv_id")) == F.col("__conv"), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce(F.col("repaired_sha256"), nothing).alias("repaired_sha256"))
