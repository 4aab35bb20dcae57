"""Keyed streams in any order of arrival equal the batch plans."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parley.operators import conversation
from parley.operators import triage as tri
from parley.streaming import exchange, ordered
from streams import run_to_memory, stream_of

START = dt.datetime(2024, 1, 1, 12)
TRIAGED = "message_id long, conv_id long, turn long, ts timestamp, redacted_message string, response string, intent string, sentiment_score double, escalated boolean, cost double"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Every partition of every stateful step is a state store of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(ordered.STATE_STORE, None)
    spark.conf.set(ordered.STATE_STORE, ordered.ROCKSDB)
    yield
    if before:
        spark.conf.set(ordered.STATE_STORE, before)
    else:
        spark.conf.unset(ordered.STATE_STORE)


@pytest.fixture
def only_data(spark):
    """With state that expires by the clock, a stream that takes what is there would never run out of empty batches."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def triaged_rows(n=80, convs=3):
    rnd = random.Random(3)
    intents = ["complaint", "order_status", "refund_request", "general_inquiry"]
    rows = []
    for i in range(n):
        c = rnd.choice([*range(convs), None])
        rows.append((i, c, i, at(10 * i), f"asked {i}", f"answered {i}" if i % 11 else None, rnd.choice(intents), rnd.randrange(0, 100) / 100, i % 7 == 0, rnd.randrange(0, 9) / 1000))
    return rows


def shuffled(rows, batches=3, far=9):
    """Rows in an order of arrival that is up to ``far`` places off, in batches, and a last batch that closes all times."""
    rnd = random.Random(1)
    moved = sorted(rows, key=lambda r: r[0] + rnd.uniform(0, far))
    size = -(-len(moved) // batches)
    out = [moved[i : i + size] for i in range(0, len(moved), size)]
    last = at(1_000_000)
    return [*out, [(10**6, 10**6, 0, last, "close", "close", "complaint", 0.5, False, 0.0)]]


def own(df):
    return df.where("coalesce(conv_id, 0) < 1000000")


def test_memory_in_any_order_equals_batch(spark, rocksdb):
    rows = triaged_rows()
    stream = stream_of(spark, shuffled(rows), TRIAGED)
    got, progress = run_to_memory(spark, ordered.memory(stream, "3 minutes"), "ordered_memory")
    want = conversation.context_per_turn(spark.createDataFrame(rows, TRIAGED), ["message_id"])
    assert own(got).count() == want.count() > 60
    assert own(got).select("conv_id", "turn", "message_id", "context").exceptAll(want).count() == 0
    counts = {r.message_id: r.turn_count for r in got.collect()}
    running = {}
    for m, c, _, _, _, _, _, _, escalated, _ in rows:
        if not escalated:
            running[c] = running.get(c, 0) + 2
            assert counts[m] == running[c]
    assert sum(p["numInputRows"] > 0 for p in progress) == 4


def test_idle_conversations_go(spark, rocksdb):
    """A conversation's memory ends after ``idle``; state rows are those of open conversations only."""
    early = [(i, 1, i, at(i), f"q{i}", "a", "complaint", 0.5, False, 0.0) for i in range(5)]
    late = [(10 + i, 1, 10 + i, at(100_000 + i), f"q{10 + i}", "a", "complaint", 0.5, False, 0.0) for i in range(3)]
    close = [[(99, 2, 0, at(t), "x", "x", "complaint", 0.5, False, 0.0)] for t in (50_000, 200_000, 400_000)]
    stream = stream_of(spark, [early, close[0], late, close[1], close[2]], TRIAGED)
    got, progress = run_to_memory(spark, ordered.memory(stream, "1 minute", idle="1 hour"), "idle_memory")
    context = {r.message_id: r.context for r in got.collect()}
    assert "q4" in context[4] and "q0" in context[4]
    assert "q0" not in context[10] and "q10" in context[12]


def test_arrival_order_keeps_bounded_lines(spark, rocksdb, only_data):
    rows = [(i, 1, i, at(i), f"q{i}", f"a{i}", "complaint", 0.5, False, 0.0) for i in range(3000)]
    stream = stream_of(spark, [rows[:2500], rows[2500:]], TRIAGED)
    got, _ = run_to_memory(spark, ordered.memory(stream, ordered=False), "arrival_memory")
    want = conversation.context_per_turn(spark.createDataFrame(rows, TRIAGED), ["message_id"])
    assert got.count() == 3000 and got.select("conv_id", "turn", "message_id", "context").exceptAll(want).count() == 0


def test_summary_equals_batch(spark, rocksdb, only_data):
    rows = [r for r in triaged_rows()]
    stream = stream_of(spark, shuffled(rows), TRIAGED)
    got, _ = run_to_memory(spark, ordered.summaries(stream), "summary_stream", "update")
    # the last row of a conversation: most turns, then latest
    last = {}
    for r in got.collect():
        last[r.conv_id] = r
    want = {r.conv_id: r for r in conversation.summary(spark.createDataFrame(rows, TRIAGED)).collect()}
    last.pop(10**6)
    assert got.count() > len(want) and {k: tuple(v) for k, v in last.items()} == {k: tuple(v) for k, v in want.items()}


def exchange_streams(spark, n=16):
    """Messages and their replies on four streams; some replies never come, some come too late."""
    msgs, given = [], {"i": [], "s": [], "r": []}
    for i in range(n):
        msgs.append((i, i % 3, i, at(60 * i), "customer", f"call 555-010-{1000 + i} order AB12{i:04d}"))
        for kind, skip, late, text in (("i", 5, 7, f'{{"intent": "order_status", "confidence": 0.{50 + i}}}'), ("s", 6, 99, f'{{"sentiment": "neutral", "score": 0.{55 + i}}}'), ("r", 4, 7, f"Reply number {i}.")):
            if i % skip:
                given[kind].append((i, at(60 * i + (3000 if i % late == late - 1 else 30)), text, 100 + i, 20))
    return msgs, given


MESSAGES = "message_id long, conv_id long, turn long, ts timestamp, role string, content string"


def in_batches(rows, time, batches=4):
    rows = sorted(rows, key=lambda r: r[time])
    size = -(-len(rows) // batches)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def test_replies_on_streams_equal_batch(spark):
    msgs, given = exchange_streams(spark)
    far = at(1_000_000)
    m = stream_of(spark, [*in_batches(msgs, 2), [(10**6, 10**6, 0, far, "customer", "close")], [(10**6 + 1, 10**6, 1, far + dt.timedelta(days=9), "customer", "close")]], MESSAGES)
    sides = [stream_of(spark, [*in_batches(given[k], 1), [(10**6 + 2, far, "x", 1, 1)], [(10**6 + 3, far + dt.timedelta(days=9), "x", 1, 1)]], exchange.REPLY_SCHEMA) for k in ("i", "s", "r")]
    rows = exchange.labelled_exchange(m, *sides, wait="10 minutes", delay="1 minute")
    out, progress = run_to_memory(spark, rows, "exchange_out")
    got = exchange.triaged(out)  # the batch steps behind the match
    assert exchange.triage_exchange(m, *sides).isStreaming
    # the batch chain over the replies that came in time
    asked = {r[0]: r[3] for r in msgs}
    near = {k: [g for g in v if g[1] - asked[g[0]] <= dt.timedelta(minutes=10)] for k, v in given.items()}
    assert all(0 < len(near[k]) < len(msgs) for k in near) and len(near["r"]) < len(given["r"])
    raw = [spark.createDataFrame(near[k], exchange.REPLY_SCHEMA) for k in ("i", "s", "r")]
    replies = raw[2].select("message_id", F.col("raw_response").alias("reply"), "input_tokens", "output_tokens")
    batch = tri.triage_from_raw(spark.createDataFrame(msgs, MESSAGES), raw[0], raw[1], replies.select("message_id", "reply"), replies.select("message_id", "input_tokens", "output_tokens"))
    same = [c for c in batch.columns if c != "cost"]
    mine = sorted(tuple(map(str, r)) for r in got.where("message_id < 1000000").select(same).collect())
    assert mine == sorted(tuple(map(str, r)) for r in batch.select(same).collect()) and len(mine) == len(msgs)
    assert any("I apologize" in str(r) for r in mine) and sum(p["numInputRows"] > 0 for p in progress) >= 4


def test_session_cost_in_any_order_equals_batch(spark, rocksdb):
    rows = triaged_rows()
    stream = stream_of(spark, shuffled(rows), TRIAGED)
    got, _ = run_to_memory(spark, ordered.running_cost(stream, "3 minutes"), "ordered_cost")
    total, want = {}, {}
    for r in rows:
        total[r[1]] = round(total.get(r[1], 0) + r[9], 9)
        want[r[0]] = 0.0 if r[8] else total[r[1]]
    mine = own(got).collect()
    assert {r.message_id: round(r.cost, 9) for r in mine} == want
    back = {tuple(r)[:9] for r in mine}
    assert back == {r[:9] for r in rows}


def test_repeated_replies_and_null_ids(spark):
    far = at(10**6)
    q = [[(1, 1, 1, at(0), "customer", "a"), (None, 1, 2, at(1), "customer", "b"), (3, 1, 3, at(2), "customer", "c")], [(9, 1, 9, far, "customer", "z")], [(9, 1, 9, far + dt.timedelta(days=9), "customer", "z")]]
    a = [[(1, at(5), "first", 1, 1)], [(1, at(6), "second", 1, 1), (None, at(6), "none", 1, 1), (3, at(4000), "late", 1, 1), (8, far, "z", 1, 1)], [(8, far + dt.timedelta(days=9), "z", 1, 1)]]
    joined = exchange.match_replies(stream_of(spark, q, MESSAGES), stream_of(spark, a, exchange.REPLY_SCHEMA))
    got, _ = run_to_memory(spark, joined, "repeated_replies")
    assert {(r.message_id, r.turn): r.raw_response for r in got.where("turn < 9").collect()} == {(1, 1): "first", (None, 2): None, (3, 3): None}


def test_needs_rocksdb(spark):
    with pytest.raises(RuntimeError, match="RocksDB"):
        ordered.memory(spark.readStream.format("rate").load().selectExpr("value message_id", "value conv_id", "value turn", "timestamp ts", "'' redacted_message", "'' response", "false escalated"))
