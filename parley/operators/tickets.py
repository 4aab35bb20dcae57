"""Escalation tickets: one schema (``TICKET_COLUMNS``) from creation to log, pending list and due times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import rules
from parley.operators.triage import one_per_message
from parley.plans.windows import same

# Initial status, agent-initiated ticket reason and priority.
STATUS_PENDING = "pending"
AGENT_REASON = "Agent-initiated escalation"
AGENT_PRIORITY = "high"
REPEAT_LIMIT = 3

TICKET_COLUMNS = [
    "escalation_id", "ts", "created_at", "reason", "priority", "customer_message", "intent", "sentiment_score",
    "conversation_summary", "status", "assigned_agent", "conv_id", "turn",
]
SUMMARY_FIELDS = ["turn_count", "duration_minutes", "escalated", "primary_intent", "avg_sentiment"]
NO_SUMMARY = "{}"


def _ticket_id(ts, conv_id, turn):
    # second-resolution time alone collides; conv and turn make it unique
    return F.concat(F.lit("ESC"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit("-"), conv_id.cast("string"), F.lit("-"), turn.cast("string"))


def _question(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def repeat_counts(triaged: DataFrame) -> DataFrame:
    """How often each (normalised) message text occurs in its conversation."""
    return triaged.select("conv_id", _question(F.col("redacted_message")).alias("_q")).groupBy("conv_id", "_q").agg(F.count(F.lit(1)).alias("repeats"))


def triage_priority(triaged: DataFrame, order_totals: DataFrame | None = None) -> DataFrame:
    """The escalated rows with their priority from the guideline rules (repeats
    are counted over all turns of the conversation, which needs only the
    redacted texts; the rest of triage runs for escalated rows alone)."""
    t = triaged.filter(F.col("escalated")).withColumn("_q", _question(F.col("redacted_message")))
    t = t.alias("a").join(repeat_counts(triaged).alias("b"), same("a", "b", ["conv_id", "_q"]), "left").select("a.*", "b.repeats")
    if order_totals is not None:
        t = t.join(one_per_message(order_totals, ["order_total"]), "message_id", "left")
    else:
        t = t.withColumn("order_total", F.lit(None).cast("double"))
    pr = rules.ticket_priority_rule(
        F.col("sentiment_score"), F.col("intent"), F.col("order_total"), F.col("intent_confidence"), F.col("repeats")
    )
    return t.withColumn("priority", pr).drop("_q")


def _tickets(rows: DataFrame, reason: Column, priority: Column, summaries: DataFrame | None) -> DataFrame:
    """Pending tickets of triaged rows; ``summaries`` (one row per conversation)
    go along as a JSON object, an empty one without them."""
    summary = F.lit(NO_SUMMARY)
    if summaries is not None:
        own = summaries.select("conv_id", F.to_json(F.struct(*SUMMARY_FIELDS)).alias("_summary"))
        rows = rows.alias("a").join(own.alias("b"), same("a", "b", ["conv_id"]), "left").select("a.*", "b._summary")
        summary = F.coalesce(F.col("_summary"), summary)
    return rows.select(
        _ticket_id(F.col("ts"), F.col("conv_id"), F.col("turn")).alias("escalation_id"),
        "ts",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        reason.alias("reason"),
        priority.alias("priority"),
        F.col("redacted_message").alias("customer_message"),
        "intent",
        "sentiment_score",
        summary.alias("conversation_summary"),
        F.lit(STATUS_PENDING).alias("status"),
        F.lit(None).cast("string").alias("assigned_agent"),
        "conv_id",
        "turn",
    )


def create_from_triage(triaged: DataFrame, order_totals: DataFrame | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """One pending ticket per escalated message (``TICKET_COLUMNS``)."""
    reason = F.format_string("Negative sentiment (%.2f)", F.col("sentiment_score"))
    return _tickets(triage_priority(triaged, order_totals), reason, rules.normalise_priority(F.col("priority")), summaries)


def create_from_review(triaged: DataFrame, review_events: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Tickets for held replies whose latest review event is an escalation."""
    held = triaged.filter(F.col("needs_human_review"))
    ev = one_per_message(review_events, ["action"]).filter(F.col("action") == "escalate").select("message_id")
    return _tickets(held.join(ev, "message_id"), F.lit(AGENT_REASON), F.lit(AGENT_PRIORITY), summaries)


def with_customer_message(tickets: DataFrame) -> DataFrame:
    return tickets.withColumn("customer_notice", rules.priority_message(F.col("priority")))


def pending(tickets: DataFrame, priority: str | None = None) -> DataFrame:
    """Pending tickets, optionally of one priority, newest first (then by id)."""
    p = tickets.filter(F.col("status") == STATUS_PENDING)
    if priority:
        p = p.filter(F.col("priority") == priority)
    return p.orderBy(F.col("ts").desc(), "escalation_id")


def with_sla(tickets: DataFrame) -> DataFrame:
    m = rules.sla_minutes(F.col("priority"))
    return tickets.withColumn("sla_minutes", m.cast("bigint")).withColumn(
        "due_at", F.col("ts") + F.make_interval(mins=m)
    )
