"""Repair of chat roles at least cost, and rendering of the repaired turns.

An automaton says which role may follow which. For every turn the repair may keep its role, give it another one,
merge it with the turn before, or put empty turns in front; dynamic programming finds the cheapest legal sequence.

The costs of a turn are a small matrix over the automaton's states, and such matrices compose (least sum), so a
conversation of any length is cut into blocks: blocks are composed upwards, the states at their borders are
fixed downwards, and only then the turns inside each block. No task ever holds more than one block of turns
or BLOCK blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scalemetrics.llm.common import table
from scalemetrics.llm.registry import query
from scalemetrics.workspace import settle

# The roles, their other names, and what may follow what ("" is the beginning).
ROLES = ("system", "user", "assistant", "tool")
ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "developer": "system", "function": "tool"}
NEXT = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant", "tool")}
LAST = "assistant"
STATES = ("", *ROLES)
UNKNOWN = len(ROLES)

MERGE, RELABEL, GUESS, INSERT = 1, 2, 1, 3
# Far above the cost of any conversation (three a turn at most), and 2^12 of them still fit a long.
NEVER = 1 << 50
BLOCK_BITS = 12


def path(a: str, b: str) -> tuple[str, ...] | None:
    """Fewest roles to put between ``a`` and ``b``; the first in the order of NEXT among equals."""
    for n in range(len(STATES)):
        for between in product(ROLES, repeat=n):
            steps = (a, *between, b)
            if all(y in NEXT[x] for x, y in zip(steps, steps[1:])):
                return between
    return None


def best_moves() -> dict[tuple[int, int, int], tuple[int, str, tuple[str, ...]]]:
    """(role code, state before, state after) -> (cost, action, inserted roles); the action says what happens to the turn."""
    moves = {}
    for code, s, t in product(range(UNKNOWN + 1), range(len(STATES)), range(1, len(STATES))):
        named = 0 if code == t - 1 else GUESS if code == UNKNOWN else RELABEL
        label = "keep" if code == t - 1 else "relabel"
        options = []
        if s == t:
            options.append((named + MERGE, "merge" if label == "keep" else "relabel and merge", ()))
        between = path(STATES[s], STATES[t])
        if between is not None:
            options.append((named + INSERT * len(between), label, between))
        if options:
            moves[code, s, t] = min(options, key=lambda o: o[0])
    return moves


def matrices() -> np.ndarray:
    """Cost of each turn by role code: state before x state after."""
    out = np.full((UNKNOWN + 1, len(STATES), len(STATES)), NEVER, np.int64)
    for (code, s, t), (cost, *_) in MOVES.items():
        out[code, s, t] = cost
    return out


def end_costs() -> np.ndarray:
    """Cost of the empty turns that end a conversation legally, by its last state."""
    return np.array([0] + [INSERT * len(ending(s)) for s in ROLES], np.int64)


def ending(state: str) -> tuple[str, ...]:
    return () if state in ("", LAST) else (*(path(state, LAST) or ()), LAST)


MOVES = best_moves()
COSTS = matrices()
END_COSTS = end_costs()


def composed(steps: np.ndarray) -> np.ndarray:
    """Least-sum product of matrices in order, pair by pair."""
    while len(steps) > 1:
        odd = steps[-1:] if len(steps) % 2 else steps[:0]
        a, b = steps[: len(steps) // 2 * 2 : 2], steps[1 : len(steps) // 2 * 2 : 2]
        steps = np.concatenate([(a[:, :, :, None] + b[:, None, :, :]).min(axis=2).clip(max=NEVER), odd])
    return steps[0]


def walk(steps: Sequence[np.ndarray], state: int, rest: np.ndarray) -> list[int]:
    """States before, between and after the steps of a cheapest way; ``rest`` is the cost to go by the state after them."""
    ahead = [rest]
    for m in reversed(steps):
        ahead.append((m + ahead[-1]).min(axis=1).clip(max=NEVER))
    ahead.reverse()
    states = [state]
    for m, g in zip(steps, ahead[1:]):
        states.append(int((m[states[-1]] + g).argmin()))
    return states


def only(state: int) -> np.ndarray:
    """Cost to go that leaves one state to end in: several ways may be cheapest, and the next block starts from one."""
    return np.where(np.arange(len(STATES)) == state, 0, NEVER)


def role_code(role: Column) -> Column:
    name = F.lower(F.trim(role))
    out = F.lit(UNKNOWN)
    for alias, code in [*((r, i) for i, r in enumerate(ROLES)), *((a, ROLES.index(r)) for a, r in ALIASES.items())]:
        out = F.when(name == alias, code).otherwise(out)
    return out


def runs_of(conv: list) -> list[tuple[int, int]]:
    edges = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
    return list(zip(edges, edges[1:]))


def flat(m: pa.ChunkedArray) -> np.ndarray:
    n = len(STATES)
    return np.stack([np.asarray(v.values) for v in m.combine_chunks()]).reshape(-1, n, n)


def borders(parts: DataFrame, order: str, given: DataFrame | None) -> DataFrame:
    """State before and after each part of a group, the parts being in order inside their group.

    ``parts``: group, order, m. ``given`` has the states of each group; without it groups are whole conversations.
    Columns returned: order, state, after.
    """

    def place(rows: pa.Table, state: int, rest: np.ndarray) -> pa.Table:
        rows = rows.sort_by(order)
        states = walk(list(flat(rows.column("m"))), state, rest)
        return pa.table({"order": rows.column(order).cast(pa.int64()), "state": pa.array(states[:-1], pa.int32()), "after": pa.array(states[1:], pa.int32())})

    schema = "order long, state int, after int"
    if given is None:
        return settle(parts.groupBy("group").applyInArrow(lambda rows: place(rows, 0, END_COSTS), schema))

    def under(rows: pa.Table, above: pa.Table) -> pa.Table:
        return place(rows, above.column("state")[0].as_py(), only(above.column("after")[0].as_py()))

    return settle(parts.groupBy("group").cogroup(given.groupBy("order")).applyInArrow(under, schema))


def repaired_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, place, role, text, action, new_role, inserted, closing, cost, is_first, is_last.

    ``inserted`` are empty turns put before the turn, ``closing`` those after a conversation's last one; ``place``
    orders the turns of a conversation. Equal turn numbers are ordered by role and text; null numbers come first, and
    turns without conv_id are one conversation. Null and unknown roles are given the cheapest role; null
    texts are empty. Turns repeated in full are merged like any others.
    """
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), F.xxhash64(role, text).alias("h"))
    # a long conversation spans several ranges, since the turn is part of what is ranged
    ranged = rows.repartitionByRange("conv_id", "turn", "h").sortWithinPartitions("conv_id", "turn", "h", "role", "text")
    placed = settle(ranged.drop("h").withColumn("place", F.monotonically_increasing_id()))
    narrow = placed.select("conv_id", "place", role_code(F.col("role")).alias("code"), F.shiftright("place", BLOCK_BITS).alias("block"))
    kind = turns.schema[conv_id].dataType.simpleString()

    def summarised(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        conv, codes = rows.column("conv_id").to_pylist(), rows.column("code").to_numpy()
        out = [(a, composed(COSTS[codes[a:b]])) for a, b in runs_of(conv)]
        first = [a for a, _ in out]
        return pa.table({
            "conv_id": rows.column("conv_id").take(pa.array(first, pa.int64())), "run": rows.column("place").take(pa.array(first, pa.int64())),
            "m": pa.array([list(m.ravel()) for _, m in out], pa.list_(pa.int64())),
        })

    runs = settle(narrow.groupBy("block").applyInArrow(summarised, f"conv_id {kind}, run long, m array<long>"))
    # only conversations that cross a border of blocks need their states fixed from above
    crossing = runs.join(runs.groupBy("conv_id").count().filter("count > 1").select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    low = crossing.select("conv_id", "run", "m", F.xxhash64("conv_id", F.shiftright("run", 2 * BLOCK_BITS)).alias("group"))

    def summed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("run")
        return pa.table({"conv_id": rows.column("conv_id").slice(0, 1), "order": rows.column("group").slice(0, 1), "first": rows.column("run").slice(0, 1), "m": pa.array([list(composed(flat(rows.column("m"))).ravel())], pa.list_(pa.int64()))})

    supers = settle(low.groupBy("group").applyInArrow(summed, f"conv_id {kind}, order long, first long, m array<long>"))
    tops = borders(supers.select(F.xxhash64("conv_id").alias("group"), "first", "order", "m").withColumnsRenamed({"first": "run"}), "run", None)
    given = settle(supers.select("order", F.col("first").alias("f")).join(tops.withColumnRenamed("order", "f"), "f").drop("f"))
    entries = borders(low.drop("conv_id"), "run", given).withColumn("block", F.shiftright("order", BLOCK_BITS))

    def decided(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        conv, codes, places = rows.column("conv_id").to_pylist(), rows.column("code").to_numpy(), rows.column("place").to_numpy()
        known = {o: (s, only(e)) for o, s, e in zip(*(above.column(c).to_pylist() for c in ("order", "state", "after")))}
        out: dict[str, list] = {"place": [], "action": [], "new_role": [], "inserted": [], "closing": [], "cost": []}
        for a, b in runs_of(conv) if len(conv) else []:
            state, rest = known.get(int(places[a]), (0, END_COSTS))
            states = walk(list(COSTS[codes[a:b]]), state, rest)
            for k in range(b - a):
                cost, action, inserted = MOVES[int(codes[a + k]), states[k], states[k + 1]]
                # kept for a conversation's last turn alone, which is found later
                for name, value in zip(out, (int(places[a + k]), action, STATES[states[k + 1]], list(inserted), list(ending(STATES[states[k + 1]])), cost)):
                    out[name].append(value)
        types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32()]
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), types)})

    schema = "place long, action string, new_role string, inserted array<string>, closing array<string>, cost int"
    decisions = narrow.groupBy("block").cogroup(entries.groupBy("block")).applyInArrow(decided, schema)
    ends = placed.groupBy("conv_id").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    marks = ends.select(F.explode(F.array("first", "last")).alias("place"), "first", "last").distinct()
    done = placed.join(decisions, "place").join(marks, "place", "left")
    done = done.withColumns({"is_first": F.coalesce(F.col("place") == F.col("first"), F.lit(False)), "is_last": F.coalesce(F.col("place") == F.col("last"), F.lit(False))})
    none = F.array().cast("array<string>")
    done = done.withColumn("closing", F.when(F.col("is_last"), F.col("closing")).otherwise(none))
    return done.withColumn("cost", (F.col("cost") + INSERT * F.size("closing")).cast("int")).drop("first", "last")


def rendered(repaired: DataFrame) -> DataFrame:
    """Add ``piece``: what the turn adds to its conversation's rendered text.

    The pieces of a conversation in the order of ``place`` are the text: ``<|role|>``, the turn, ``<|end|>``, each turn closed
    where the next one opens. Markers inside a turn's text are broken by a backslash.
    """
    empty = lambda roles: F.array_join(F.transform(roles, lambda r: F.concat(F.lit("<|"), r, F.lit("|>\n<|end|>\n"))), "")
    merged = F.col("action").isin("merge", "relabel and merge")
    body = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("<\\|"))
    opened = F.concat(F.when(F.col("is_first"), "").otherwise("\n<|end|>\n"), empty(F.col("inserted")), F.lit("<|"), F.col("new_role"), F.lit("|>\n"))
    closed = F.when(F.col("is_last"), F.concat(F.lit("\n<|end|>\n"), empty(F.col("closing")))).otherwise("")
    return repaired.withColumn("piece", F.concat(F.when(merged, F.lit("\n")).otherwise(opened), body, closed))


@query("op1_chat_repair")
def op1_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = rendered(repaired_turns(table(spark, sf_dir, "conversations")))
    return turns.select("conv_id", "turn", "place", "role", "action", "new_role", "inserted", "closing", "cost", "piece")
