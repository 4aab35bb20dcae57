"""Conversation memory, health monitor and cost ledger."""

import datetime as dt
import random

from pyspark.sql import functions as F

from parley.operators import conversation as conv
from parley.operators import cost as cost_ops
from parley.operators import monitor


def _triaged(spark, rows):
    base = dt.datetime(2024, 1, 1)
    data = [
        (i, 1, t, base + dt.timedelta(minutes=5 * t), f"m{t}", f"r{t}", intent, score, esc)
        for i, (t, intent, score, esc) in enumerate(rows)
    ]
    return spark.createDataFrame(
        data,
        "message_id long, conv_id long, turn long, ts timestamp, redacted_message string, response string, "
        "intent string, sentiment_score double, escalated boolean",
    )


def test_summary_primary_intent_tie_and_counts(spark):
    t = _triaged(spark, [(0, "b", 0.6, False), (1, "a", 0.7, False), (2, "a", 0.5, False), (3, "b", 0.1, True), (4, "b", 0.4, False)])
    s = conv.summary(t).first()
    assert s.turn_count == 8  # 4 kept customer turns, each with a reply
    assert s.primary_intent == "b"  # b, a, a, b -> first seen wins the tie
    assert s.avg_sentiment == 0.55
    assert s.escalated and s.duration_minutes == 20.0


def test_summary_without_kept_turns(spark):
    s = conv.summary(_triaged(spark, [(0, "x", 0.1, True)])).first()
    assert (s.turn_count, s.duration_minutes, s.primary_intent, s.avg_sentiment) == (0, 0.0, "unknown", 0.5)


def test_last_n_zero_means_all_and_context_text(spark):
    m = spark.createDataFrame([(1, 0, "customer", "hi"), (1, 1, "agent", "hello")], "conv_id long, turn long, role string, content string")
    assert conv.last_n(m, 0).count() == 2
    ctx = conv.conversation_context(m, redact=False).first().context
    assert ctx == "## Conversation History\n\n**Customer:** hi\n\n**Agent:** hello\n"


def _interactions(spark, rows):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(i, base + dt.timedelta(seconds=i), 1, p, e, s, 2000, c) for i, (p, e, s, c) in enumerate(rows)],
        "event_id long, ts timestamp, monitor_key long, pii_filter_success boolean, escalated boolean, "
        "sentiment_score double, response_time_ms long, cost double",
    )


def test_monitor_reference_case(spark):
    rows = [(True, False, 0.6, 0.008)] * 10 + [(False, False, 0.6, 0.008)]
    df = _interactions(spark, rows)
    a = monitor.alerts(monitor.rolling(df, plan="naive"))
    d = monitor.dashboard(df).first()
    failed = a.filter(F.col("severity") == "CRITICAL").collect()
    assert [(r.event_id, r.details, r.ts) for r in failed] == [(10, '{"pii_filter_success":false,"escalated":false,"sentiment_score":0.6,"response_time_ms":2000,"cost":0.008}', dt.datetime(2024, 1, 1, 0, 0, 10))]
    assert monitor.row_alerts(df, monitor.pii_alert()).select(*a.drop("alert_no").columns).exceptAll(a.filter(F.col("severity") == "CRITICAL").drop("alert_no")).count() == 0
    assert d.total_interactions == 11 and abs(d.pii_success_rate - 10 / 11) < 1e-12 and d.recent_alerts == 1


def test_first_escalation_alerts_and_window_cap(spark):
    df = _interactions(spark, [(True, True, 0.6, 0.001)] + [(True, False, 0.6, 0.001)] * 149)
    a = monitor.alerts(monitor.rolling(df, plan="naive"))
    assert a.filter((F.col("event_id") == 0) & (F.col("title") == monitor.TITLE_ESCALATION)).count() == 1
    assert monitor.dashboard(df).first().total_interactions == 100


def test_halo_equals_naive(spark):
    rnd = random.Random(7)
    rows = [(rnd.random() > 0.05, rnd.random() > 0.7, rnd.randint(0, 100) / 100, rnd.randint(0, 100) / 10000) for _ in range(1500)]
    df = _interactions(spark, rows)
    cols = ["event_id", "window_n", "escalation_rate", "pii_success_rate", "avg_sentiment", "avg_cost", "recent_sentiment"]
    naive = monitor.rolling(df, plan="naive").select(*cols)
    halo = monitor.rolling(df, plan="halo", block=128).select(*cols)
    assert halo.count() == 1500
    assert halo.exceptAll(naive).count() == 0


def test_displayed_cost_triangle(spark):
    calls = spark.createDataFrame(
        [(1, i, "support_agent", 0, 250000) for i in (1, 2, 3)] + [(1, 4, "intent_classifier", 1000, 10)],
        "session_id long, seq long, agent string, input_tokens long, output_tokens long",
    )
    r = cost_ops.running_session_cost(calls).orderBy("seq").collect()
    assert [x.session_cost for x in r] == [1.0, 2.0, 3.0]
    d = cost_ops.displayed_cost(calls).first()
    assert (d.displayed_cost, d.true_cost) == (6.0, 3.0)
    c = cost_ops.call_cost(calls).filter("seq = 4").first().total_cost
    assert abs(float(c) - (1000 / 1e6 * 0.8 + 10 / 1e6 * 4.0)) < 1e-15


def test_keyed_halo_hot_key_equals_plain_window(spark):
    from pyspark.sql import Window

    from parley.plans.windows import rolling_global

    rnd = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    # key 0 holds most rows (a hot key spanning many blocks)
    rows = [(i, base + dt.timedelta(seconds=i), 0 if rnd.random() < 0.7 else rnd.randint(1, 5), rnd.randint(0, 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, k long, v long")
    halo = rolling_global(
        df, ["ts", "event_id"], {"s": (7, F.sum("v")), "l": (3, F.collect_list("v"))}, block=64, keys=["k"]
    ).select("event_id", "s", "l", "_rn")
    w = Window.partitionBy("k").orderBy("ts", "event_id")
    plain = df.select(
        "event_id",
        F.sum("v").over(w.rowsBetween(-6, 0)).alias("s"),
        F.collect_list("v").over(w.rowsBetween(-2, 0)).alias("l"),
        F.row_number().over(w).alias("_rn"),
    )
    assert halo.count() == 900
    assert halo.exceptAll(plain).count() == 0
    chunked = rolling_global(
        df, ["event_id", "ts"], {"s": (7, F.sum("v")), "l": (3, F.collect_list("v"))}, block=64, keys=["k"], numbering="chunked"
    ).select("event_id", "s", "l", "_rn")
    assert chunked.exceptAll(plain).count() == 0


def test_primary_intent_matches_python_model(spark):
    from collections import Counter

    rnd = random.Random(5)
    rows, expected = [], {}
    for c in range(40):
        intents = [rnd.choice("abcd") for _ in range(rnd.randint(1, 9))]
        esc = [rnd.random() < 0.2 for _ in intents]
        kept = [i for i, e in zip(intents, esc) if not e]
        # the reference's Counter.most_common keeps first-seen order on ties
        expected[c] = Counter(kept).most_common(1)[0][0] if kept else "unknown"
        for t, (i, e) in enumerate(zip(intents, esc)):
            rows.append((c * 100 + t, c, t, dt.datetime(2024, 1, 1), "m", "r", i, 0.5, e))
    df = spark.createDataFrame(
        rows,
        "message_id long, conv_id long, turn long, ts timestamp, redacted_message string, response string, "
        "intent string, sentiment_score double, escalated boolean",
    )
    got = {r.conv_id: r.primary_intent for r in conv.summary(df).collect()}
    assert got == expected


def test_large_costs_do_not_overflow(spark):
    df = _interactions(spark, [(True, False, 0.5, 500_000.0)] * 300)
    assert {r.avg_cost for r in monitor.rolling(df, block=128).select("avg_cost").collect()} == {500_000.0}


def test_running_total_of_null_and_repeated_keys(spark):
    from parley.plans.windows import running_total

    rows = [(None, 1, 5), (None, 2, 7), (1, None, 2), (1, 1, 3), (1, 70_000, 4), (2, 5, 1)]
    df = spark.createDataFrame(rows, "k long, t long, v long")
    got = {(r.k, r.t): r.s for r in running_total(df, ["k"], "t", F.col("v"), "s", chunk=2).collect()}
    assert got == {(None, 1): 5, (None, 2): 12, (1, None): 2, (1, 1): 5, (1, 70_000): 9, (2, 5): 1}


def test_positions_and_review_events(spark):
    log = spark.createDataFrame([(1, t, "order_status", 0.9, False) for t in (0, 5, 9)] + [(None, 3, "complaint", 0.5, True)],
                                "conv_id long, turn long, intent string, confidence double, needs_review boolean")
    got = {(r.conv_id, r.turn): r.label for r in conv.analysis_log_recent(log).collect()}
    assert got == {(1, 0): "#1 Order Status", (1, 5): "#2 Order Status", (1, 9): "#3 Order Status", (None, 3): "#1 Complaint"}
    triaged = spark.createDataFrame([(7, 1, True), (8, 1, False)], "message_id long, conv_id long, needs_human_review boolean")
    events = spark.createDataFrame([(7, "reject", "2024-01-01"), (7, "send", "2024-01-02")], "message_id long, action string, day string").select(
        "message_id", "action", F.to_timestamp("day").alias("ts"))
    row = conv.session_stats(triaged, events).first()
    assert (row.messages, row.auto_sent, row.reviewed) == (2, 1, 1)


def test_positions_by_time_whatever_the_times_and_ids(spark):
    """Coarse and fine times, a hot time, null times and ids, dense and hashed ids, with and without keys."""
    import datetime as dt
    import random

    from parley.plans import windows

    rnd = random.Random(8)
    start = dt.datetime(1969, 12, 31, 23, 59, 50)
    rows = []
    for i in range(400):
        kind = i % 4
        ts = [start, start + dt.timedelta(microseconds=rnd.randrange(10**8)), start + dt.timedelta(seconds=rnd.randrange(200)), None][kind]
        rows.append((rnd.choice(["a", "b", None]), ts, rnd.choice([i, i - 200, rnd.randrange(-(2**62), 2**62), (1 << 48) + i, -(1 << 48) - i]) if i % 50 else None, i))
    df = spark.createDataFrame(rows, "k string, ts timestamp, id long, i long").repartition(5)

    def order(r):
        return (r[1] is not None, r[1] or start, r[2] is not None, r[2] or 0)

    for keys in ([], ["k"]):
        for chunk in (3, 1 << 16):
            got = {r.i: r.rn for r in windows.time_positions(df, "ts", "id", keys=keys, chunk=chunk).collect()}
            for k in ({"a", "b", None} if keys else {0}):
                own = sorted((r for r in rows if not keys or r[0] == k), key=order)
                assert sorted(got[r[3]] for r in own) == list(range(1, len(own) + 1))
                for a, b in zip(own, own[1:]):
                    assert got[a[3]] < got[b[3]] or order(a) == order(b)


def test_alert_details(spark):
    """A rule of the row alone hands on the interaction as it came, fields that it lacks left out; a rule of the window hands on the mean."""
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, base, None, True, None, 0.05), (2, base, False, None, 0.1, None)], "event_id long, ts timestamp, pii_filter_success boolean, escalated boolean, sentiment_score double, cost double")
    got = {(r.event_id, r.title): r.details for r in monitor.alerts(monitor.rolling(df, plan="naive")).collect()}
    assert got[1, monitor.TITLE_COST] == '{"escalated":true,"cost":0.05}'
    assert got[2, monitor.TITLE_PII] == '{"pii_filter_success":false,"sentiment_score":0.1}'
    assert got[1, monitor.TITLE_ESCALATION] == '{"current_rate":1.0}' and got[2, monitor.TITLE_ESCALATION] == '{"current_rate":0.5}'
    assert {r.details for r in monitor.row_alerts(df, monitor.pii_alert()).collect()} == {got[2, monitor.TITLE_PII]}
