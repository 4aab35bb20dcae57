"""Guardrails, reply parsing, escalation and review rules."""

from pyspark.sql import functions as F

from parley.functions import guardrails as G
from parley.functions import parse, rules


def guard(spark, rows):
    df = spark.createDataFrame(rows, "id long, reply string, score double, intent string")
    return {r.id: r.guard for r in G.with_guardrails(df, "reply", "score", "intent").collect()}


def test_reference_guardrail_goldens(spark):
    g = guard(
        spark,
        [
            (1, "Your email is john@example.com", 0.5, ""),
            (2, "That's a stupid question", 0.5, ""),
            (3, "Your order will arrive when it arrives", 0.2, ""),
            (4, "I understand your frustration. Let me help you track that order.", 0.2, ""),
            (5, "I can help you track your order. Could you provide your order number?", 0.5, ""),
        ],
    )
    assert not g[1].safe and "PII" in g[1].issues[0] and g[1].modified_response == "Your email is [EMAIL]"
    assert not g[2].safe and g[2].issues == [G.ISSUE_UNPROFESSIONAL]
    assert not g[3].safe and g[3].issues == [G.ISSUE_EMPATHY]
    assert g[4].safe
    assert g[5].safe and g[5].issues == []


def test_two_pass_resolution(spark):
    df = spark.createDataFrame(
        [
            (1, "order 4532123456789010", 0.5, "general_inquiry"),
            (2, "We issue a refund now", 0.5, "refund_request"),
            (3, "Mail me at a@b.com", 0.5, "general_inquiry"),
            (4, None, 0.5, "general_inquiry"),
            (5, "It definitely will be fixed", 0.5, "general_inquiry"),
        ],
        "id long, reply string, score double, intent string",
    )
    out = {r.id: r for r in G.with_resolution(df, "reply", "score", "intent").collect()}
    assert out[1].guardrail_outcome == "fallback" and out[1].final_response == G.FALLBACK_REPLY
    assert out[2].guardrail_outcome == "waived" and out[2].final_response == "We issue a refund now"
    assert out[3].guardrail_outcome == "redacted" and out[3].final_response == "Mail me at [EMAIL]"
    assert out[4].guardrail_outcome == "pass" and out[4].final_response == G.FALLBACK_REPLY
    assert out[5].guardrail_outcome == "fallback"
    assert all(r.safe for r in out.values())


def test_intent_parse(spark):
    raw = [
        "```json\n{\"intent\":\"complaint\",\"confidence\":0.88}\n```",
        '  {"intent":"refund_request","confidence":"0.75"}  ',
        "not json",
        "[1]",
        '{"confidence":null}',
        "{}",
        None,
    ]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    rows = df.select(parse.intent_result(F.col("raw")).alias("p")).collect()
    got = [(r.p.intent, r.p.confidence, r.p.reasoning) for r in rows]
    assert got[0] == ("complaint", 0.88, "")
    assert got[1] == ("refund_request", 0.75, "")
    assert got[2] == got[3] == got[4] == ("general_inquiry", 0.5, "Parse error")
    assert got[5] == ("general_inquiry", 0.5, "")
    assert got[6][:2] == ("general_inquiry", 0.0) and got[6][2].startswith("Classification failed")


def test_escalation_and_review(spark):
    df = spark.createDataFrame(
        [(0.45, "complaint", 1.0, True), (0.5, "account_help", 0.69, True), (0.5, "greeting", 0.1, True), (0.29, "general_inquiry", 0.9, True)],
        "score double, intent string, conf double, safe boolean",
    )
    rows = df.select(
        rules.should_escalate(F.col("score"), F.col("intent")).alias("esc"),
        rules.review_reason(F.lit(False), F.col("intent"), F.col("conf"), F.col("score"), F.col("safe")).alias("why"),
        F.array_join(rules.escalation_reasons(F.col("score"), F.col("intent")), "|").alias("reasons"),
        rules.sentiment_band(F.col("score")).alias("band"),
    ).collect()
    assert rows[0].esc and rows[0].reasons == rules.REASON_COMPLAINT
    assert rows[1].why == "low_confidence"
    assert rows[2].why is None
    assert rows[3].esc and rows[3].band == "negative"


def test_resolution_computes_what_is_read(spark):
    """The final reply needs neither suggestions nor the first pass's issue texts."""
    df = spark.createDataFrame([("Call 555-123-4567", 0.9, "greeting")], "reply string, score double, intent string")
    got = G.with_resolution(df, "reply", "score", "intent")
    plan = got.select("final_response", "guardrail_outcome")._jdf.queryExecution().optimizedPlan().toString()
    assert G.SUGGEST_EMPATHY not in plan and G.ISSUE_EMPATHY not in plan
    row = got.first()
    assert (row.final_response, row.guardrail_outcome) == ("Call [PHONE]", "redacted") and row.first_pass_issues == [G.ISSUE_PII_PREFIX + "['PHONE']"]
