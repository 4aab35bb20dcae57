"""Role repair against all assignments, and hot conversations split over partitions."""

import itertools
import random

from pyspark.sql import functions as F

from parley.llm import role_repair as rr


def cheapest(roles):
    """Least (cost, turns) over every assignment of roles."""
    best = None
    for given in itertools.product((1, 2, 3), repeat=len(roles)):
        state, cost, turns = rr.START, 0, 0
        for role, f in zip(roles, given):
            if (state, f) not in rr.STEPS:
                break
            c, t, _, _ = rr.STEPS[state, f]
            cost, turns, state = cost + c + rr.role_cost(role, f), turns + t, f
        else:
            c, t = rr.closing(state)
            best = min(x for x in (best, (cost + c, turns + t)) if x is not None)
    return best


def cost_of(roles, given):
    state, cost, turns = rr.START, 0, 0
    for role, f in zip(roles, given):
        c, t, _, _ = rr.STEPS[state, f]
        cost, turns, state = cost + c + rr.role_cost(role, f), turns + t, f
    c, t = rr.closing(state)
    return cost + c, turns + t


def test_repair_is_cheapest():
    rnd = random.Random(5)
    for _ in range(400):
        roles = [rnd.choice(["system", "user", "assistant", "User", None, "tool", ""]) for _ in range(rnd.randrange(1, 8))]
        assert cost_of(roles, rr.repair(roles)) == cheapest(roles), roles


def test_chained_runs_equal_one_run():
    rnd = random.Random(6)
    for _ in range(200):
        roles = [rnd.choice(["system", "user", "assistant", None]) for _ in range(rnd.randrange(3, 30))]
        cuts = sorted(rnd.sample(range(1, len(roles)), 2))
        runs = [roles[a:b] for a, b in zip([0, *cuts], [*cuts, len(roles)])]
        path = rr.chain([rr.transfer(r) for r in runs])
        given = [f for r, (start, end, _) in zip(runs, path) for f in rr.repair(r, start, end)]
        assert cost_of(roles, given) == cost_of(roles, rr.repair(roles))


def whole(roles, texts, ties=None):
    ties = ties or [0] * len(roles)
    rows = [(i, r, t, i, h) for i, (r, t, h) in enumerate(zip(roles, texts, ties))]
    return "".join(p[-1] for p in rr.pieces(rows, rr.START, None, 0, True, True))


def test_rendering():
    assert whole(["user", "assistant"], ["a", "b"]) == "<|user|>\na\n<|assistant|>\nb\n<|end|>"
    assert whole(["user", "user"], ["a", "<|end|>"]) == "<|user|>\na\n<\\|end|>\n<|end|>"
    assert whole(["assistant"], [None]) == "<|user|>\n\n<|assistant|>\n\n<|end|>"
    assert whole(["system"], ["s"]) == "<|system|>\ns\n<|user|>\n\n<|end|>"


def test_hot_conversation_over_many_partitions(spark):
    rnd = random.Random(7)
    rows = [(1, i, rnd.choice(["user", "assistant", "user", "system", None, "bot"]), f"t{i}") for i in range(600)]
    rows += [(c, i, rnd.choice(["user", "assistant"]), f"x{c}.{i}") for c in range(2, 40) for i in range(3)]
    rows += [(None, None, "user", None), (None, 1, "assistant", "n"), (5, 1, "user", "x5.1"), (5, 1, "user", "x5.1")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit(1)).withColumn("pid", F.lit("x"))
    tie = {tuple(r[:3]): r.h for r in df.select("turn", "role", "text", F.xxhash64("turn", "role", "text").alias("h")).collect()}
    got = {}
    for r in rr.format_chats(df, parts=9).orderBy("conv_id", "piece").collect():
        got.setdefault(r.conv_id, []).append(r)
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r, x))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort(key=lambda t: (t[0] is None, t[0], t[1] is not None, t[1] or "", t[2] or ""))
        assert "".join(p.rendered for p in got[c]) == whole([r for _, r, _ in own], [x for _, _, x in own], [tie[r] for r in own])
        numbers = [p.piece_turn for p in got[c]]
        assert numbers == sorted(numbers) and numbers[0] == 1 and set(numbers) == set(range(1, numbers[-1] + 1))
        assert sum(p.action != "insert" for p in got[c]) == len(own)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert rr.format_chats(empty).count() == 0
