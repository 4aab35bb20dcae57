"""Triage chain goldens with canned scores and replies."""

import datetime as dt

from parley.functions import guardrails as G
from parley.operators import conversation as conv
from parley.operators import triage as tri


def _inputs(spark, rows):
    base = dt.datetime(2024, 1, 1)
    msgs = spark.createDataFrame(
        [(i, 7, t, base + dt.timedelta(minutes=t), "customer", m) for i, (t, m, *_rest) in enumerate(rows)],
        "message_id long, conv_id long, turn long, ts timestamp, role string, content string",
    )
    scored = spark.createDataFrame(
        [(i, intent, conf, score) for i, (_t, _m, intent, conf, score, _r) in enumerate(rows)],
        "message_id long, intent string, confidence double, score double",
    )
    replies = spark.createDataFrame([(i, r) for i, (*_x, r) in enumerate(rows)], "message_id long, reply string")
    usage = spark.createDataFrame([(i, 1000, 100) for i in range(len(rows))], "message_id long, input_tokens long, output_tokens long")
    return msgs, scored, replies, usage


def test_calm_order_status_and_escalation_short_circuit(spark):
    rows = [
        (0, "Where is my order #12345?", "order_status", 0.95, 0.5, "I can help you track your parcel."),
        (1, "My order is late and I want a refund, mail me at a@b.com", "complaint", 0.9, 0.45, "We are on it"),
        (2, "Thanks", "general_inquiry", 0.9, 0.8, "Glad to help you"),
    ]
    t = {r.message_id: r for r in tri.triage(*_inputs(spark, rows)).collect()}
    calm = t[0]
    assert calm.safe and not calm.escalated and calm.guardrail_outcome == "pass" and not calm.needs_human_review
    esc = t[1]
    assert esc.escalated and esc.response == G.ESCALATION_REPLY
    assert esc.pii_in_message and not esc.pii_detected
    assert esc.intent_confidence == 1.0 and esc.cost == 0.0 and esc.sentiment == "negative"
    assert esc.needs_human_review and esc.review_reason == "escalated"
    assert esc.redacted_message.endswith("[EMAIL]")
    # session cost counts reply calls only: turns 0 and 2 made one each
    one = 1000 / 1e6 * 0.8 + 100 / 1e6 * 4.0
    assert abs(calm.cost - one) < 1e-15 and abs(t[2].cost - 2 * one) < 1e-15


def test_two_turns_give_four_memory_messages(spark):
    rows = [
        (0, "Where is my order?", "order_status", 0.95, 0.5, "Let me check."),
        (1, "Thanks!", "general_inquiry", 0.9, 0.9, "You are welcome."),
    ]
    triaged = tri.triage(*_inputs(spark, rows))
    s = conv.summary(triaged).first()
    assert s.turn_count == 4 and s.primary_intent == "order_status" and s.avg_sentiment == 0.7
    ctx = {r.turn: r.context for r in conv.context_per_turn(triaged).collect()}
    # the current message is already in memory when the reply is generated
    assert ctx[0] == "## Conversation History\n\n**Customer:** Where is my order?\n"
    assert ctx[1].count("**Customer:**") == 2 and ctx[1].count("**Agent:**") == 1


def test_label_is_the_models_and_rows_stay_whole(spark):
    """Repeated and null ids, repeated and missing sides: one row out for each row in."""
    base = dt.datetime(2024, 1, 1)
    msgs = spark.createDataFrame(
        [(i, c, t, base + dt.timedelta(minutes=t), "customer", "Thanks") for i, c, t in [(1, 7, 0), (1, 7, 1), (None, 7, 2), (2, None, 0), (2, 7, 3)]],
        "message_id long, conv_id long, turn long, ts timestamp, role string, content string",
    )
    scored = spark.createDataFrame(
        [(1, "greeting", 0.9, "very_negative", 0.9), (1, "greeting", 0.8, "neutral", 0.9), (None, "complaint", 1.0, "negative", 0.0)],
        "message_id long, intent string, confidence double, sentiment string, score double",
    )
    replies = spark.createDataFrame([(1, "Glad to help"), (1, "Glad to help"), (None, "x")], "message_id long, reply string")
    usage = spark.createDataFrame([(1, 1000, 100), (2, 10, 10)], "message_id long, input_tokens long, output_tokens long")
    rows = tri.triage(msgs, scored, replies, usage).collect()
    assert len(rows) == 5
    by = {(r.conv_id, r.turn): r for r in rows}
    assert by[7, 0].sentiment == "very_negative" and by[7, 0].intent_confidence == 0.9
    assert by[7, 2].sentiment == "neutral" and by[7, 2].intent == "general_inquiry" and by[7, 2].intent_confidence == 0.0
    one = 1000 / 1e6 * 0.8 + 100 / 1e6 * 4.0
    assert [round(by[7, t].cost / one) for t in range(4)] == [1, 2, 2, 2] and by[None, 0].cost == 0


def test_triage_of_raw_replies(spark):
    rows = [(0, "Hi", "greeting", 0.9, 0.9, "Hello"), (1, "Bad", "complaint", 0.9, 0.1, "Sorry"), (2, "Hm", "x", 0.1, 0.5, "Yes")]
    msgs, _, replies, usage = _inputs(spark, rows)
    intents = spark.createDataFrame([(0, '{"intent":"greeting","confidence":0.9}'), (1, '```json\n{"intent":"complaint","confidence":0.9}\n```')], "message_id long, raw_response string")
    moods = spark.createDataFrame([(0, '{"sentiment":"negative","score":0.9}'), (1, '{"sentiment":"positive","score":0.4}'), (2, "no json")], "message_id long, raw_response string")
    got = {r.message_id: r for r in tri.triage_from_raw(msgs, intents, moods, replies, usage).collect()}
    assert got[0].sentiment == "negative" and not got[0].escalated
    assert got[1].escalated and got[1].sentiment == "negative"
    assert (got[2].intent, got[2].intent_confidence, got[2].sentiment, got[2].sentiment_score) == ("general_inquiry", 0.0, "neutral", 0.5)


def test_triage_without_models(spark):
    """The keyword scorers give the table that the triage joins."""
    from pyspark.sql import functions as F

    from parley.functions import lexicon

    rows = [(1, 1, 1, "I want a refund, worst service"), (2, 1, 2, "where is my parcel"), (3, 1, 3, None), (4, 1, 4, "thanks, great")]
    msgs = spark.createDataFrame(rows, "message_id long, conv_id long, turn long, content string").withColumn("ts", F.lit(None).cast("timestamp"))
    got = {r.message_id: r for r in lexicon.scored(msgs).collect()}
    assert [(got[i].intent, got[i].sentiment, got[i].score) for i in (1, 2, 3, 4)] == [
        ("refund_request", "very_negative", 0.1), ("order_status", "neutral", 0.5), ("general_inquiry", "neutral", 0.5), ("general_inquiry", "very_positive", 0.95),
    ]
    assert got[1].confidence == 1.0 and got[3].confidence == 0.0
    out = {r.message_id: r for r in tri.triage(msgs, lexicon.scored(msgs), spark.createDataFrame([(2, "On its way.")], "message_id long, reply string")).collect()}
    assert out[1].escalated and not out[2].escalated and out[2].response == "On its way." and out[2].cost == 0.0
