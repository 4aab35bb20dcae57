"""Message triage: redact → label → score → escalate → reply → guard → route.

All steps are DataFrame → DataFrame; the model calls are replaced by joins
with scored tables (``message_id``-keyed), so the whole chain is one Spark plan:
equi-joins on ``message_id`` and one running sum per conversation for the
session cost. ``triage_from_raw`` takes the models' raw reply texts instead of
scored rows.

Every joined side has one row per message (``one_per_message``): of several
rows the one with the latest ``ts`` counts where the side has such a column,
then the one whose values sort last. A null message id never meets a side's
row, and its message keeps the defaults of a failed call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import guardrails, parse, pii, rules
from parley.operators import cost as cost_ops
from parley.plans.windows import running_total

# What a failed or incomplete classifier call gives.
DEFAULT_SENTIMENT, DEFAULT_SCORE = "neutral", 0.5
DEFAULT_INTENT, DEFAULT_CONFIDENCE = "general_inquiry", 0.0

TRIAGE_COLUMNS = [
    "message_id", "conv_id", "turn", "ts", "redacted_message", "response", "intent", "intent_confidence",
    "sentiment", "sentiment_score", "escalated", "pii_detected", "pii_in_message", "safe", "cost",
    "needs_human_review", "review_reason", "guardrail_outcome",
]


def one_per_message(side: DataFrame, columns: list[str], key: str = "message_id") -> DataFrame:
    """``key`` and ``columns`` with one row for each key: the latest by ``ts`` (if there is one), then by the values themselves.

    The row that none follows within its key is kept. The window's exchange and
    sort by key are the ones that a join on the key needs anyway, so the
    reduction adds neither.
    """
    last = ["ts"] if "ts" in side.columns else []
    order = Window.partitionBy(key).orderBy(*last, *columns)
    rows = side.where(F.col(key).isNotNull()).select(key, *columns, F.lead(F.lit(True)).over(order).alias("_follows"))
    return rows.where(F.col("_follows").isNull()).select(key, *columns)


def redact_messages(messages: DataFrame, text_col: str = "content") -> DataFrame:
    """Adds ``redacted_message`` and ``pii_in_message``."""
    return (
        pii.with_pii(messages, text_col, prefix="_m")
        .withColumn("redacted_message", F.col("_mredacted"))
        .withColumn("pii_in_message", F.col("_mpii.pii_detected"))
        .drop("_mentities", "_mredacted", "_mpii")
    )


def attach_scores(messages: DataFrame, scored: DataFrame) -> DataFrame:
    """Left join of (intent, confidence, sentiment, score); a missing row is a
    failed call: intent general_inquiry with confidence 0, sentiment neutral,
    score 0.5. The label is the model's own and is never set right by the score."""
    if "sentiment" not in scored.columns:
        scored = scored.withColumn("sentiment", F.lit(None).cast("string"))
    s = one_per_message(scored, ["intent", "confidence", "sentiment", "score"])
    return (
        messages.join(s, "message_id", "left")
        .withColumn("confidence", F.when(F.col("intent").isNull(), F.lit(DEFAULT_CONFIDENCE)).otherwise(F.col("confidence")))
        .withColumn("intent", F.coalesce(F.col("intent"), F.lit(DEFAULT_INTENT)))
        .withColumn("sentiment", F.coalesce(F.col("sentiment"), F.lit(DEFAULT_SENTIMENT)))
        .withColumn("score", F.coalesce(F.col("score"), F.lit(DEFAULT_SCORE)))
    )


def scores_from_raw(raw_intent: DataFrame, raw_sentiment: DataFrame, text_col: str = "raw_response") -> DataFrame:
    """Scored rows from the two models' raw reply texts: parsed, with the
    failure rows of unreadable and missing replies."""
    i = one_per_message(raw_intent, [text_col]).select("message_id", parse.intent_result(F.col(text_col)).alias("i"))
    s = one_per_message(raw_sentiment, [text_col]).select("message_id", parse.sentiment_result(F.col(text_col)).alias("s"))
    both = i.join(s, "message_id", "full")
    return both.select("message_id", "i.intent", "i.confidence", "s.sentiment", "s.score")


def escalate(df: DataFrame) -> DataFrame:
    return df.withColumn("escalated", rules.should_escalate(F.col("score"), F.col("intent")))


def labelled(messages: DataFrame, scored: DataFrame) -> DataFrame:
    """Messages with intent, sentiment, ``sentiment_score`` and ``escalated``: all that summaries of conversations need of a triage."""
    return escalate(attach_scores(messages, scored)).withColumn("sentiment_score", F.col("score"))


def attach_replies(df: DataFrame, replies: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    out = df.join(one_per_message(replies, ["reply"]), "message_id", "left")
    if usage is not None:
        out = out.join(one_per_message(usage, ["input_tokens", "output_tokens"]), "message_id", "left")
    return out


def reply_cost(with_usage: bool) -> Column:
    """Cost of a row's reply call (decimal): escalated rows and failed calls cost nothing."""
    zero = F.lit(0).cast(cost_ops.COST_TYPE)
    if not with_usage:
        return zero
    called = ~F.col("escalated") & F.col("reply").isNotNull()
    cost = cost_ops.call_cost_expr(F.col("input_tokens"), F.col("output_tokens"))
    return F.when(called, F.coalesce(cost, zero)).otherwise(zero)


def judge(df: DataFrame, carry: list[str]) -> DataFrame:
    """The regex-heavy steps of a labelled row, once each: redaction, two
    guardrail passes, the final response. ``carry`` columns come along. Shared
    by batch and stream."""
    df = redact_messages(df)
    # escalated rows never get a reply call: check an empty text for them
    df = df.withColumn("_reply_in", F.when(F.col("escalated"), F.lit("")).otherwise(F.col("reply")))
    df = guardrails.with_resolution(df, "_reply_in", "score", "intent")
    esc = F.col("escalated")
    return df.select(
        "message_id",
        "conv_id",
        "turn",
        "ts",
        "redacted_message",
        F.when(esc, F.lit(guardrails.ESCALATION_REPLY)).otherwise(F.col("final_response")).alias("response"),
        "intent",
        F.when(esc, F.lit(1.0)).otherwise(F.col("confidence")).alias("intent_confidence"),
        F.when(esc, F.lit("negative")).otherwise(F.col("sentiment")).alias("sentiment"),
        F.col("score").alias("sentiment_score"),
        esc.alias("escalated"),
        (~esc & F.col("pii_in_message")).alias("pii_detected"),
        "pii_in_message",
        F.col("safe"),
        F.when(esc, F.lit("escalated")).otherwise(F.col("guardrail_outcome")).alias("guardrail_outcome"),
        *carry,
    )


def finish(df: DataFrame, session_cost: Column) -> DataFrame:
    """Cost, review reason and the output columns of judged rows."""
    reason = rules.review_reason(
        F.col("escalated"), F.col("intent"), F.col("intent_confidence"), F.col("sentiment_score"), F.col("safe")
    )
    df = df.withColumn("cost", F.when(F.col("escalated"), F.lit(0.0)).otherwise(session_cost.cast("double")))
    return df.withColumn("review_reason", reason).withColumn("needs_human_review", reason.isNotNull()).select(*TRIAGE_COLUMNS)


def triage(
    messages: DataFrame,
    scored: DataFrame,
    replies: DataFrame,
    usage: DataFrame | None = None,
    chunk: int = 1 << 16,
) -> DataFrame:
    """One triage row per message row (``message_id, conv_id, turn, ts, content``).

    Plan shape, the same at every size: equi-joins on ``message_id``, then the
    running session cost (skew-safe chunked running total over exact decimals),
    then the regex-heavy steps, computed once per row. Without ``usage`` no call
    has a cost, and there is nothing to add up.
    """
    df = attach_replies(escalate(attach_scores(messages, scored)), replies, usage)
    if usage is None:
        return finish(judge(df, []), F.lit(0.0))
    df = running_total(df, ["conv_id"], "turn", reply_cost(usage is not None), "_session_cost", chunk=chunk, tiebreak=["message_id"])
    # a wide decimal is taken apart and put together again in every projection it passes
    df = df.withColumn("_session_cost", F.col("_session_cost").cast("double"))
    return finish(judge(df, ["_session_cost"]), F.col("_session_cost"))


def triage_from_raw(
    messages: DataFrame,
    raw_intent: DataFrame,
    raw_sentiment: DataFrame,
    replies: DataFrame,
    usage: DataFrame | None = None,
    chunk: int = 1 << 16,
) -> DataFrame:
    """``triage`` of raw model replies (``message_id, raw_response``): parse, label, escalate and reply in one plan."""
    return triage(messages, scores_from_raw(raw_intent, raw_sentiment), replies, usage, chunk)


def route(triaged: DataFrame) -> DataFrame:
    """``route`` = pending_review or auto_sent."""
    return triaged.withColumn(
        "route", F.when(F.col("needs_human_review"), F.lit("pending_review")).otherwise(F.lit("auto_sent"))
    )


def route_counts(triaged: DataFrame) -> DataFrame:
    return route(triaged).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def analysis_log(triaged: DataFrame) -> DataFrame:
    return triaged.select(
        "message_id",
        "conv_id",
        "turn",
        "intent",
        F.col("intent_confidence").alias("confidence"),
        "sentiment",
        F.col("sentiment_score").alias("score"),
        F.col("pii_detected").alias("pii"),
        "safe",
        F.col("needs_human_review").alias("needs_review"),
        "ts",
    )


def review_resolve(triaged: DataFrame, review_events: DataFrame) -> DataFrame:
    """Disposition of the held replies. send → reviewed; send_edited → the
    edited text; escalate → the high-priority escalation notice; reject →
    nothing is sent (row dropped)."""
    held = triaged.filter(F.col("needs_human_review"))
    ev = one_per_message(review_events, ["action", "edited_text"])
    j = held.join(ev, "message_id", "inner").filter(F.col("action") != "reject")
    sent = (
        F.when(F.col("action") == "send", F.col("response"))
        .when(F.col("action") == "send_edited", F.col("edited_text"))
        .otherwise(F.lit(rules.PRIORITY_MESSAGES["high"]))
    )
    return j.select(
        "message_id",
        "conv_id",
        "turn",
        "action",
        sent.alias("sent_text"),
        F.lit(True).alias("human_reviewed"),
        (F.col("action") == "send_edited").alias("edited"),
        (F.col("action") == "escalate").alias("escalated_by_agent"),
        F.when(F.col("action") == "send", F.col("pii_detected")).alias("pii_detected"),
        F.when(F.col("action") == "send", F.col("safe")).alias("safe"),
    )
