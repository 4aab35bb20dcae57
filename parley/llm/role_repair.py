"""Chat formatting with minimum-cost role repair.

A legal conversation is at most one system turn, then user and assistant turns
in alternation from a user turn on. Every source turn is given a role (keeping
its own is free, another costs ``RELABEL``, a role that is none of the three
costs ``UNKNOWN``); a turn whose role equals the one before joins it
(``MERGE``); between turns that may not follow each other the missing turn is
inserted empty (``INSERT``). Dynamic programming over the automaton's states
finds the cheapest repair, with fewest turns among equals, then the least sum of
hashes of (turn, role, text, given role), so the layout has no say in it.

The result is one row for each piece: a source turn, or an inserted empty one.
A conversation's ``rendered`` pieces in order (``piece_turn``, ``piece``) are its
chat text, so not even a giant conversation needs to fit one row.

Rows are range-partitioned by conversation and turn, so a conversation that
holds a third of all rows is many tasks. Each partition gives the transfer
matrix (least cost and turns from every state to every state) of the runs at its
two ends; the driver chains these, at most two for each partition, and every
task then repairs its runs between known border states. Both passes read the
same checkpointed layout.

Defined results: turns are taken by turn number (null last), then role, then
text; repeated rows are turns of their own; a null conv_id is a conversation of
its own; a null or unknown role is relabelled; a null text is an empty one; an
empty table gives an empty result. Only ``conv_id``, ``turn``, ``role`` and
``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.session import cut_lineage

ROLES = ("system", "user", "assistant")
RELABEL, UNKNOWN, MERGE, INSERT = 4, 1, 1, 3

START, SYSTEM, USER, ASSISTANT = range(4)
#: state -> roles that may come next
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
BIG = (1 << 60, 0, 0)
#: odd multipliers: a row's hash times a role's multiplier orders repairs of equal cost and turns
_TIES = (0, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def _steps() -> dict[tuple[int, int], tuple[int, int, str, list[int]]]:
    """(state, role) -> cost, new turns, action, inserted roles."""
    out = {}
    for p in range(4):
        for f in (SYSTEM, USER, ASSISTANT):
            if p == f:
                out[p, f] = (MERGE, 0, "merge", [])
            elif f in LEGAL[p]:
                out[p, f] = (0, 1, "keep", [])
            else:
                between = [x for x in LEGAL[p] if f in LEGAL[x]]
                if between and f != SYSTEM:
                    out[p, f] = (INSERT, 2, "insert", between[:1])
    return out


STEPS = _steps()


def role_cost(role: str | None, given: int) -> int:
    name = role.strip().lower() if role else ""
    if name not in ROLES:
        return UNKNOWN
    return 0 if ROLES[given - 1] == name else RELABEL


def advance(best: list, role: str | None, tie: int = 0) -> tuple[list, list]:
    """(best, previous states) after one more turn; ``best``: (cost, turns, ties) of every state."""
    new, came = [BIG] * 4, [-1] * 4
    for f in (SYSTEM, USER, ASSISTANT):
        own, tied = role_cost(role, f), (tie * _TIES[f] >> 3) & 0xFFFFFFFF
        for p in range(4):
            if best[p] is not BIG and (p, f) in STEPS:
                cost, turns, _, _ = STEPS[p, f]
                value = (best[p][0] + cost + own, best[p][1] + turns, best[p][2] + tied)
                if new[f] is BIG or value < new[f]:
                    new[f], came[f] = value, p
    return new, came


def closing(state: int) -> tuple[int, int]:
    """Cost and turns of ending: a conversation of only a system turn gets an empty user turn."""
    return (INSERT, 1) if state == SYSTEM else (0, 0)


def transfer(roles: list[str | None], ties: list[int] | None = None) -> list[list]:
    """(cost, turns, ties) from every state to every state over a run of turns."""
    rows = [[(0, 0, 0) if i == j else BIG for j in range(4)] for i in range(4)]
    for role, tie in zip(roles, ties or [0] * len(roles)):
        rows = [advance(r, role, tie)[0] for r in rows]
    return rows


def chain(matrices: list[list[list]]) -> list[tuple[int, int, int]]:
    """(state before, state after, turns before) of each run of one conversation, on its cheapest path."""
    best, came = [(0, 0, 0), BIG, BIG, BIG], []
    for m in matrices:
        new, back = [BIG] * 4, [-1] * 4
        for q in range(4):
            for p in range(4):
                if best[p] is not BIG and m[p][q] is not BIG:
                    value = tuple(x + y for x, y in zip(best[p], m[p][q]))
                    if new[q] is BIG or value < new[q]:
                        new[q], back[q] = value, p
        best = new
        came.append((back, best))
    end = _end(best)
    out = []
    for i in range(len(matrices) - 1, -1, -1):
        p = came[i][0][end]
        out.append((p, end, came[i - 1][1][p][1] if i else 0))
        end = p
    return out[::-1]


def _end(best: list) -> int:
    return min((s for s in range(4) if best[s] is not BIG), key=lambda s: (best[s][0] + closing(s)[0], best[s][1] + closing(s)[1], best[s][2], s))


def repair(roles: list[str | None], start: int = START, end: int | None = None, ties: list[int] | None = None) -> list[int]:
    """The role given to each turn of a run, from a state before it to a state after it (None: the cheapest ending)."""
    best, steps = [BIG] * 4, []
    best[start] = (0, 0, 0)
    for role, tie in zip(roles, ties or [0] * len(roles)):
        best, came = advance(best, role, tie)
        steps.append(came)
    state = _end(best) if end is None else end
    out = []
    for came in reversed(steps):
        out.append(state)
        state = came[state]
    return out[::-1]


def escape(text: str | None) -> str:
    """Texts cannot forge a turn header."""
    return (text or "").replace("<|", "<\\|")


def header(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


PIECE = T.StructType([
    T.StructField("piece_turn", T.LongType()), T.StructField("piece", T.LongType()), T.StructField("source_turn", T.LongType()), T.StructField("source_role", T.StringType()),
    T.StructField("role", T.StringType()), T.StructField("action", T.StringType()), T.StructField("rendered", T.StringType()),
])


def pieces(rows: list[tuple], start: int, end: int | None, turns: int, opens: bool, closes: bool) -> Iterator[tuple]:
    """The pieces of one run of (turn, role, text, place, tie) rows; ``place`` numbers rows within the run's partition."""
    given = repair([r[1] for r in rows], start, end, [r[4] for r in rows])
    state, first = start, opens
    last = rows[-1][3]
    for (turn, role, text, place, _), f in zip(rows, given):
        _, _, action, inserted = STEPS[state, f]
        for x in inserted:
            turns += 1
            yield turns, 2 * place, None, None, ROLES[x - 1], "insert", ("" if first else "\n") + header(x)
            first = False
        if action == "merge":
            rendered = "\n" + escape(text)
        else:
            turns += 1
            rendered = ("" if first else "\n") + header(f) + escape(text)
        first = False
        kept = "merge" if action == "merge" else "keep"
        changed = role_cost(role, f) > 0
        done = "<|end|>" if closes and place == last and f != SYSTEM else ""
        yield turns, 2 * place + 1, turn, role, ROLES[f - 1], "relabel" if changed and kept == "keep" else "relabel+merge" if changed else kept, rendered + ("\n" + done if done else "")
        state = f
    if closes and state == SYSTEM:
        yield turns + 1, 2 * rows[-1][3] + 2, None, None, ROLES[USER - 1], "insert", "\n" + header(USER) + "\n<|end|>"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, list[tuple]]]:
    """(partition, conversation, rows) of each run of a sorted partition."""
    key, rows, place = None, [], 0
    for b in batches:
        for pid, conv, turn, role, text, tie in zip(*(b.column(c).to_pylist() for c in ("pid", "conv_id", "turn", "role", "text", "tie"))):
            if key != (pid, conv) and rows:
                yield *key, rows
                rows = []
            key = (pid, conv)
            rows.append((turn, role, text, place, tie))
            place += 1
    if rows:
        yield *key, rows


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last run of a partition, with their transfer matrices."""
    key, first, matrix = None, None, []
    for b in batches:
        for pid, conv, role, tie in zip(*(b.column(c).to_pylist() for c in ("pid", "conv_id", "role", "tie"))):
            if key != (pid, conv):
                if key is not None and first is None:
                    first = (*key, matrix)
                key, matrix = (pid, conv), transfer([])
            matrix = [advance(r, role, tie)[0] for r in matrix]
    kept = [x for x in (first, (*key, matrix) if key else None) if x]
    if kept:
        flat = [[v for row in m for x in row for v in ((-1, -1, -1) if x is BIG else x)] for _, _, m in kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in kept], pa.int32()), pa.array(range(len(kept)), pa.int32()), pa.array([_name(k[1]) for k in kept]), pa.array(flat, pa.list_(pa.int64()))],
            ["pid", "place", "conv", "matrix"],
        )


def _matrix(values: list[int]) -> list[list]:
    pairs = [BIG if values[i] < 0 else tuple(values[i : i + 3]) for i in range(0, 48, 3)]
    return [pairs[i : i + 4] for i in range(0, 16, 4)]


def _name(conv: object) -> str:
    """A conversation's name among a partition's two border runs."""
    return "null" if conv is None else f"id {conv}"


def format_chats(turns: DataFrame, parts: int | None = None) -> DataFrame:
    """conv_id and the pieces of every repaired conversation."""
    spark = turns.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), "role", "text"]
    laid = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    laid = laid.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id())
    laid = laid.withColumn("tie", F.xxhash64("turn", "role", "text"))
    laid = cut_lineage(laid)
    ends = laid.select("pid", "conv_id", "role", "tie").mapInArrow(_borders, "pid int, place int, conv string, matrix array<long>").collect()
    ends = sorted(ends, key=lambda r: (r.pid, r.place))  # two for each partition at most
    border: dict[int, dict[str, tuple]] = {}
    i = 0
    while i < len(ends):
        j = i + 1  # runs of one conversation: each but the first opens its partition
        while j < len(ends) and ends[j].conv == ends[i].conv and ends[j].pid != ends[j - 1].pid and ends[j].place == 0:
            j += 1
        path = chain([_matrix(ends[k].matrix) for k in range(i, j)])
        for k in range(i, j):
            border.setdefault(ends[k].pid, {})[ends[k].conv] = (*path[k - i][:2], path[k - i][2], k == i, k == j - 1)
        i = j
    schema = T.StructType([turns.schema["conv_id"], *PIECE.fields])
    arrow = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    sent = spark.sparkContext.broadcast(border)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, kind = [], 0, None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, t) for c, t in zip(columns[1:], arrow))], schema.fieldNames())

        def typed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in it:
                kind = b.column("conv_id").type
                yield b

        for pid, conv, rows in _runs(typed(batches)):
            start, end, before, opens, closes = sent.value.get(pid, {}).get(_name(conv), (START, None, 0, True, True))
            for piece in pieces(rows, start, end, before, opens, closes):
                # places count within a partition: the partition's number goes in front
                out.append((conv, piece[0], (pid << 36) | piece[1], *piece[2:]))
                size += len(piece[-1])
                if size > 1 << 22:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    return laid.mapInArrow(run, schema)


def op6_role_repair(spark, sf_dir: str) -> DataFrame:
    """Query: the pieces of every conversation."""
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
