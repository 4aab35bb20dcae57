"""Knowledge base, orders, tickets, model I/O."""

import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from parley.functions import rules
from parley.operators import kb, orders, tickets
from parley.sources import kb_files
from parley.sources import model_io as mio

from sf_dirs import SF001


def test_kb_scan_search_format(spark):
    d = tempfile.mkdtemp(prefix="parley-kb-")
    with open(os.path.join(d, "faq.txt"), "w") as f:
        f.write("SHOP FAQ\n\nQ: Where is my order?\nA: See tracking.\n\n  \n\nQ: Return policy?\nA: 30 days.\n")
    sections = kb_files.read_kb_files(spark, d)
    assert sections.count() == 3
    q = spark.createDataFrame([(1, "order"), (2, "return policy?"), (3, "nothing here")], "query_id long, query string")
    found = kb.search(q, sections)
    scores = {(r.query_id, r.section_no): r.score for r in found.collect()}
    assert (1, 1) not in scores  # 'order?' is not 'order'
    assert scores[(2, 3)] == 2  # the blank section 2 is dropped, numbering keeps file positions
    fmt = {r.query_id: r.formatted for r in kb.format_results(q, found).collect()}
    assert fmt == {r.query_id: r.formatted for r in kb.format_results(q, kb.topk(q, sections), sections).collect()}
    assert fmt[3] == kb.NO_RESULTS
    assert fmt[2].startswith("## Knowledge Base Results\n\n### Result 1 (Score: 2)\nQ: Return policy?")
    none = kb_files.read_kb_files(spark, os.path.join(d, "missing"))
    assert none.count() == 0 and kb.topk(q, none).count() == 0


def test_kb_sections_keep_their_own_key_and_pairs_stay_put(spark):
    docs = spark.createDataFrame([(1, "\n\n".join(["red"] * 100_002), "a"), (2, "red blue\n\nred", "b"), (3, None, "c")], "doc_id long, text string, source string")
    sections = kb_files.sections_from_table(docs)
    assert sections.select("doc_id", "section_no").distinct().count() == sections.count() == 100_004
    q = spark.createDataFrame([(1, "red BLUE"), (2, "red")], "query_id long, query string")
    top = kb.topk(q, sections)
    got = [(r.query_id, r["rank"], r.doc_id, r.section_no, r.score) for r in top.orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 0, 2), (1, 2, 1, 0, 1), (1, 3, 1, 1, 1), (2, 1, 1, 0, 1), (2, 2, 1, 1, 1), (2, 3, 1, 2, 1)]
    small = kb.topk(spark.read.parquet(f"{SF001}/benchmark.parquet").selectExpr("item_id query_id", "text query"),
                    kb_files.sections_from_table(spark.read.parquet(f"{SF001}/documents.parquet")))
    plan = small._jdf.queryExecution().executedPlan().toString()
    shuffles = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert len(shuffles) == 2 and "WindowGroupLimit" in plan  # the sections, and each task's best of a query


def test_order_lookup_states_and_format(spark):
    dim = spark.createDataFrame(
        [("ORDER12345", "shipped", "2024-02-28", "2024-03-01", "2024-03-05", "TRACK123456789", ["Blue Widget", "Red Gadget"], 49.99)],
        "order_id string, status string, order_date string, ship_date string, expected_delivery string, tracking_number string, items array<string>, total double",
    ).select(
        "order_id", "status", *[F.to_date(c).alias(c) for c in ["order_date", "ship_date", "expected_delivery"]], "tracking_number", "items", "total"
    )
    req = spark.createDataFrame([(1, " order12345 "), (2, "ORDER90000001"), (3, "ORDER12"), (4, "XYZ")], "request_id long, requested_id string")
    out = {r.request_id: r for r in orders.lookup(req, dim).withColumn("txt", orders.format_order(F.col("status").isNotNull())).collect()}
    assert [out[i].state for i in (1, 2, 3, 4)] == ["found", "unverified", "not_found", "not_found"]
    assert out[1].txt == (
        "## Order ORDER12345\n**Status:** SHIPPED\n**Order Date:** 2024-02-28\n**Shipped:** 2024-03-01\n"
        "**Expected Delivery:** 2024-03-05\n**Tracking:** TRACK123456789\n**Items:** Blue Widget, Red Gadget\n**Total:** $49.99"
    )
    assert out[4].txt == orders.NOT_FOUND_TEXT
    ref = spark.createDataFrame([("Where is order #AB00000123?",), ("order #12345 please",)], "t string")
    assert [r.x for r in ref.select(orders.extract_order_ref(F.col("t")).alias("x")).collect()] == ["AB00000123", None]


def test_ticket_priority_message_sla(spark):
    t = spark.createDataFrame([(1, "bogus"), (2, "urgent")], "ticket_id long, priority string").withColumn(
        "ts", F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    )
    rows = {r.ticket_id: r for r in tickets.with_sla(tickets.with_customer_message(t)).collect()}
    assert rows[1].customer_notice == rules.PRIORITY_MESSAGES["medium"] and rows[1].sla_minutes == 60
    assert rows[2].sla_minutes == 5
    norm = t.select(rules.normalise_priority(F.col("priority")).alias("p")).collect()
    assert [r.p for r in norm] == ["medium", "urgent"]


def test_request_and_response_shapes(spark):
    m = spark.createDataFrame([(1, "hi")], "message_id long, redacted_message string")
    req = json.loads(mio.intent_requests(m).first().request)
    assert req["max_tokens"] == 200 and req["temperature"] == 0.0 and req["messages"][0]["content"] == "Classify this message:\n\nhi"
    assert "system" in req
    body = spark.createDataFrame([(1, '{"content":[{"type":"text","text":"ok"}],"usage":{"input_tokens":3,"output_tokens":4}}')], "message_id long, body string")
    r = mio.parse_responses(body).first()
    assert (r.content, r.input_tokens, r.output_tokens, r.stop_reason) == ("ok", 3, 4, "end_turn")


def test_logs_and_instructions(spark):
    from parley.sources import logs
    from parley.operators.tools import ToolRegistry, dispatch

    base = tempfile.mkdtemp(prefix="parley-logs-")
    assert logs.read_tickets(spark, os.path.join(base, "tickets")).count() == 0
    t = spark.createDataFrame(
        [("ESC1", dt.datetime(2024, 1, 1, 10), "2024-01-01 10:00:00", "r", "high", "m", "complaint", 0.1, "{}", "pending", None, 1, 0)], logs.TICKET_SCHEMA
    )
    logs.write_tickets(t, os.path.join(base, "tickets"))
    logs.write_tickets(t, os.path.join(base, "tickets"))
    assert logs.read_tickets(spark, os.path.join(base, "tickets")).count() == 2

    d = tempfile.mkdtemp(prefix="parley-instr-")
    open(os.path.join(d, "base_instructions.md"), "w").write("BASE")
    open(os.path.join(d, "support_agent_instructions.md"), "w").write("AGENT")
    sysprompt = mio.load_instructions(spark, d).first().system
    assert sysprompt == "BASE" + mio.INSTRUCTION_SEPARATOR + "AGENT"
    turns = spark.createDataFrame([(1, "hi", "greeting", 0.5, "No previous conversation.")], "message_id long, redacted_message string, intent string, sentiment_score double, context string")
    request = json.loads(mio.reply_requests(turns, mio.system_prompt(mio.load_instructions(spark, d))).first().request)
    assert request["system"] == sysprompt and request["max_tokens"] == 500

    reg = ToolRegistry()
    reg.register_tools({"order_lookup": orders.lookup, "kb_search": kb.topk})
    tri = spark.createDataFrame(
        [(1, "order_status", 0.5, False), (2, "product_question", 0.5, False), (3, "order_status", 0.1, True)],
        "message_id long, intent string, sentiment_score double, escalated boolean",
    )
    parts = dispatch(tri, reg)
    assert [r.message_id for r in parts["order_lookup"].collect()] == [1]
    assert [r.message_id for r in parts["kb_search"].collect()] == [2]


def _triaged(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, c, t, base + dt.timedelta(minutes=t), m, f"r{t}", intent, 0.9, s, esc, True) for i, c, t, m, intent, s, esc in [
        (1, 1, 0, "Hello", "greeting", 0.8, False), (2, 1, 1, "WHERE  is it", "order_status", 0.4, False), (3, 1, 2, "where is it", "order_status", 0.4, False),
        (4, 1, 3, "Where is it", "order_status", 0.45, True), (5, 2, 3, "Bad", "complaint", 0.1, True), (6, None, 3, "Bad", "complaint", 0.45, True)]]
    return spark.createDataFrame(rows, "message_id long, conv_id long, turn long, ts timestamp, redacted_message string, response string, intent string, "
                                 "intent_confidence double, sentiment_score double, escalated boolean, needs_human_review boolean")


def test_tickets_from_triage_to_pending_and_due_times(spark):
    from parley.operators import conversation
    from parley.sources import logs

    t = _triaged(spark)
    created = tickets.create_from_triage(t, summaries=conversation.summary(t))
    assert created.columns == tickets.TICKET_COLUMNS
    path = os.path.join(tempfile.mkdtemp(prefix="parley-tickets-"), "log")
    logs.write_tickets(created, path)
    back = logs.read_tickets(spark, path)
    rows = {r.conv_id: r for r in back.collect()}
    assert {c: r.priority for c, r in rows.items()} == {1: "low", 2: "high", None: "medium"}
    assert json.loads(rows[1].conversation_summary)["turn_count"] == 6
    assert [r.escalation_id for r in tickets.pending(back).select("escalation_id").collect()] == sorted(r.escalation_id for r in rows.values() if r.escalation_id) or None in rows
    due = {r.conv_id: r.due_at for r in tickets.with_sla(back).collect()}
    assert due[2] == dt.datetime(2024, 1, 1, 0, 18)
    events = spark.createDataFrame([(4, "escalate"), (4, "escalate"), (5, "send")], "message_id long, action string")
    assert [r.conversation_summary for r in tickets.create_from_review(t, events).collect()] == ["{}"]


def test_json_logs(spark):
    from parley.sources import logs

    d = tempfile.mkdtemp(prefix="parley-json-")
    assert logs.read_tickets_json(spark, os.path.join(d, "none.json")).count() == 0
    assert logs.read_calls_json(spark, os.path.join(d, "none.json")).count() == 0
    ticket = {"escalation_id": "ESC1", "timestamp": "2024-01-01T10:00:00.5", "reason": "r", "priority": "high", "customer_message": "m", "intent": "complaint",
              "sentiment_score": 0.1, "conversation_summary": {"turn_count": 2}, "status": "pending", "assigned_agent": None}
    with open(os.path.join(d, "t.json"), "w") as f:
        json.dump([ticket, dict(ticket, escalation_id="ESC2")], f, indent=2)
    rows = logs.read_tickets_json(spark, os.path.join(d, "t.json"))
    assert [r.escalation_id for r in tickets.pending(rows).collect()] == ["ESC1", "ESC2"]
    r = rows.first()
    assert json.loads(r.conversation_summary) == {"turn_count": 2} and r.created_at == "2024-01-01 10:00:00"
    call = {"timestamp": "2024-01-01T10:00:00", "agent": "support_agent", "input_tokens": 10, "output_tokens": 5, "total_cost": 0.1, "description": ""}
    with open(os.path.join(d, "c.json"), "w") as f:
        json.dump([call], f)
    calls = logs.read_calls_json(spark, os.path.join(d, "c.json"))
    assert calls.first().input_tokens == 10
    logs.write_calls(calls, os.path.join(d, "calls"))
    assert logs.read_calls(spark, os.path.join(d, "calls")).count() == 1
