"""Business rules as boolean / label Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The intent taxonomy, in order.
INTENTS = [
    "order_status",
    "refund_request",
    "product_question",
    "shipping_question",
    "account_help",
    "technical_issue",
    "complaint",
    "general_inquiry",
]

# Escalation reasons, in the order they are checked.
REASON_VERY_NEGATIVE = "Very negative sentiment detected"
REASON_REFUND = "Negative sentiment with refund request"
REASON_COMPLAINT = "Complaint with negative sentiment"

# Review routing. Intents that never need review for low
# confidence; risky intents that always do.
REVIEW_SAFE_INTENTS = ["greeting", "general_inquiry", "order_status", "shipping_question", "product_question"]
REVIEW_RISKY_INTENTS = ["refund_request", "complaint"]

# Ticket priorities, the customer message per priority and the
# response-time promise in minutes.
PRIORITY_LEVELS = ["low", "medium", "high", "urgent"]
PRIORITY_MESSAGES = {
    "urgent": "I'm connecting you with a senior specialist right away. They'll be with you in under 5 minutes.",
    "high": "Let me connect you with a specialist. They'll be with you shortly - typically within 15 minutes.",
    "medium": "I'm going to connect you with one of our specialists who can help you better. They'll reach out within the hour.",
    "low": "I'll create a ticket for our specialist team. They'll follow up with you within 4 hours.",
}
SLA_MINUTES = {"urgent": 5, "high": 15, "medium": 60, "low": 240}

# Next step per intent, from the agent's response strategy.
INTENT_STRATEGY = {
    "order_status": "order_lookup",
    "product_question": "kb_search",
    "shipping_question": "kb_search",
    "account_help": "kb_search",
    "refund_request": "escalate",
    "complaint": "empathize",
}
DEFAULT_STRATEGY = "respond"


def _b(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def should_escalate(score: Column, intent: Column) -> Column:
    """score < 0.3, or score < 0.5 for a refund request or a complaint."""
    return _b(score < 0.3) | _b((score < 0.5) & intent.isin("refund_request", "complaint"))


def escalation_reasons(score: Column, intent: Column) -> Column:
    return F.filter(
        F.array(
            F.when(score < 0.3, F.lit(REASON_VERY_NEGATIVE)),
            F.when((score < 0.5) & (intent == "refund_request"), F.lit(REASON_REFUND)),
            F.when((intent == "complaint") & (score < 0.5), F.lit(REASON_COMPLAINT)),
        ),
        lambda x: x.isNotNull(),
    )


def sentiment_band(score: Column) -> Column:
    """Score bands, lower edge inclusive."""
    return (
        F.when(score >= 0.8, "very_positive")
        .when(score >= 0.6, "positive")
        .when(score >= 0.4, "neutral")
        .when(score >= 0.2, "negative")
        .otherwise("very_negative")
    )


def tone_tier(score: Column) -> Column:
    return F.when(score > 0.4, "friendly").when(score >= 0.2, "frustrated").otherwise("angry")


def review_reason(escalated: Column, intent: Column, confidence: Column, score: Column, safe: Column) -> Column:
    """First review rule that fires, or null when the reply may be auto-sent."""
    return (
        F.when(_b(escalated), "escalated")
        .when(_b(intent.isin(*REVIEW_RISKY_INTENTS)), "risky_intent")
        .when(_b(score < 0.4), "negative_sentiment")
        .when(~F.coalesce(safe, F.lit(True)), "unsafe")
        .when(_b(~F.coalesce(intent.isin(*REVIEW_SAFE_INTENTS), F.lit(False)) & (confidence < 0.7)), "low_confidence")
    )


def needs_review(escalated: Column, intent: Column, confidence: Column, score: Column, safe: Column) -> Column:
    return review_reason(escalated, intent, confidence, score, safe).isNotNull()


def session_mood(avg_sentiment: Column) -> Column:
    return F.when(avg_sentiment > 0.6, "Positive").when(avg_sentiment > 0.4, "Neutral").otherwise("Negative")


def sentiment_badge(score: Column) -> Column:
    return F.when(score > 0.6, "positive").when(score > 0.4, "neutral").otherwise("negative")


def review_warning(escalated: Column, score: Column) -> Column:
    return F.when(_b(escalated), "error").when(_b(score < 0.4), "warning")


def normalise_priority(priority: Column) -> Column:
    return F.when(priority.isin(*PRIORITY_LEVELS), priority).otherwise(F.lit("medium"))


def _map_literal(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def priority_message(priority: Column) -> Column:
    m = _map_literal(PRIORITY_MESSAGES)
    return F.coalesce(F.try_element_at(m, priority), F.lit(PRIORITY_MESSAGES["medium"]))


def sla_minutes(priority: Column) -> Column:
    m = _map_literal(SLA_MINUTES)
    return F.coalesce(F.try_element_at(m, normalise_priority(priority)), F.lit(SLA_MINUTES["medium"]))


#: Every step that the strategy can choose.
NEXT_STEPS = sorted({*INTENT_STRATEGY.values(), DEFAULT_STRATEGY, "escalate"})


def intent_next_step(intent: Column, score: Column) -> Column:
    """Strategy per intent; a very negative complaint escalates."""
    m = _map_literal(INTENT_STRATEGY)
    step = F.coalesce(F.try_element_at(m, intent), F.lit(DEFAULT_STRATEGY))
    return F.when((intent == "complaint") & (score < 0.2), "escalate").otherwise(step)


def ticket_priority_rule(score: Column, intent: Column, order_total: Column, confidence: Column, repeats: Column) -> Column:
    """Priority from the escalation guidelines, for the signals we have:
    very angry → high; refund over $100 → medium; low confidence or the same
    question asked 3+ times → low; anything else → medium."""
    return (
        F.when(_b(score < 0.3), "high")
        .when(_b((intent == "refund_request") & (order_total > 100)), "medium")
        .when(_b(confidence < 0.5) | _b(repeats >= 3), "low")
        .otherwise("medium")
    )
