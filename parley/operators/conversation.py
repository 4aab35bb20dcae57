"""Conversation memory as windows and aggregates over a message table.

Input rows are (conv_id, turn, role, content, ...) with ``turn`` the arrival
order inside a conversation. Roles: ``customer`` prints as Customer, every
other role as Agent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import pii, rules
from parley.operators.triage import one_per_message
from parley.plans.windows import rolling_global, running_total, same, top_k

# History bound (messages kept = 2 x turns), texts of the
# context block, summary defaults.
MAX_HISTORY_TURNS = 10
MAX_MESSAGES = 2 * MAX_HISTORY_TURNS
HISTORY_HEADING = "## Conversation History\n"
NO_HISTORY = "No previous conversation."
UNKNOWN_INTENT = "unknown"
DEFAULT_AVG_SENTIMENT = 0.5
ESCALATION_REASON_FMT = "Negative sentiment (%.2f)"


def running_turn_count(msgs: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """``turn_count`` after each message: messages of both roles so far."""
    return running_total(msgs, ["conv_id"], "turn", F.lit(1), "turn_count", chunk=chunk).withColumn(
        "turn_count", F.col("turn_count").cast("bigint")
    )


def last_n(msgs: DataFrame, n: int | None) -> DataFrame:
    """Last ``n`` messages per conversation; ``None`` or 0 → all of them."""
    if not n:
        return msgs
    return top_k(msgs, ["conv_id"], [F.col("turn").desc()], n, "pos_from_end")


def bounded_history(msgs: DataFrame) -> DataFrame:
    """The messages memory still holds at the end: the last 20."""
    return last_n(msgs, MAX_MESSAGES)


def _line(role: Column, content: Column) -> Column:
    label = F.when(role == "customer", F.lit("Customer")).otherwise(F.lit("Agent"))
    return F.concat(F.lit("**"), label, F.lit(":** "), content, F.lit("\n"))


def context_text(lines: Column) -> Column:
    """Heading + one line per message, joined by newlines; empty → fixed text."""
    return F.when(F.size(lines) == 0, F.lit(NO_HISTORY)).otherwise(
        F.concat_ws("\n", F.lit(HISTORY_HEADING), F.array_join(lines, "\n"))
    )


def conversation_context(msgs: DataFrame, redact: bool = True) -> DataFrame:
    """Context block per conversation over the bounded history; memory keeps
    redacted text."""
    hist = bounded_history(msgs)
    content = F.col("content")
    if redact:
        hist = pii.with_pii(hist, "content", prefix="_c").withColumn("content", F.col("_credacted")).drop(
            "_centities", "_credacted", "_cpii"
        )
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("turn"), _line(F.col("role"), content).alias("line")))),
        lambda s: s["line"],
    )
    return hist.groupBy("conv_id").agg(context_text(lines).alias("context"))


def memory_entries(triaged: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Messages the memory stores for triaged turns: the customer message
    (redacted) and the final reply of every non-escalated turn. ``carry``
    columns are kept on the customer entry (null on the agent entry)."""
    carry = carry or []
    kept = triaged.filter(~F.col("escalated"))
    cust = [F.lit(0).alias("sub"), F.lit("customer").alias("role"), F.col("redacted_message").alias("content")]
    agent = [F.lit(1).alias("sub"), F.lit("agent").alias("role"), F.col("response").alias("content")]
    cust += [F.col(c).alias(c) for c in carry]
    agent += [F.lit(None).cast(triaged.schema[c].dataType).alias(c) for c in carry]
    return kept.select(
        "conv_id", "turn", F.explode(F.array(F.struct(*cust), F.struct(*agent))).alias("e")
    ).select("conv_id", "turn", "e.*")


def context_per_turn(triaged: DataFrame, carry: list[str] | None = None, block: int = 1 << 16) -> DataFrame:
    """History text visible when the reply of each non-escalated turn is
    generated: the last 20 stored messages up to and including the current
    customer message. One window over the memory entries; ``carry`` columns
    of the turn come along without a join back."""
    entries = memory_entries(triaged, carry).withColumn("_line", _line(F.col("role"), F.col("content")))
    # bounded frame per conversation on the keyed halo plan: a conversation
    # with a huge number of turns is split into blocks
    with_ctx = rolling_global(
        entries, ["turn", "sub"], {"_lines": (MAX_MESSAGES, F.collect_list("_line"))}, block=block, keys=["conv_id"],
        numbering="chunked",
    )
    return with_ctx.filter(F.col("sub") == 0).select(
        "conv_id", "turn", *(carry or []), context_text(F.col("_lines")).alias("context")
    )


def escalation_state(triaged: DataFrame) -> DataFrame:
    """Sticky escalated flag, last reason and the turn it was set."""
    esc = triaged.filter(F.col("escalated"))
    return esc.groupBy("conv_id").agg(
        F.lit(True).alias("escalated"),
        F.max_by(F.format_string(ESCALATION_REASON_FMT, F.col("sentiment_score")), F.col("turn")).alias(
            "escalation_reason"
        ),
        F.max("turn").alias("escalation_turn"),
    )


def primary_intent(triaged: DataFrame) -> DataFrame:
    """Most frequent intent of the non-escalated customer turns; ties go to
    the intent seen first. Two-level aggregate: counts per (conv, intent),
    then one ``max_by`` per conv (no per-conv list is built)."""
    kept = triaged.filter(~F.col("escalated"))
    per = kept.groupBy("conv_id", "intent").agg(F.count(F.lit(1)).alias("_n"), F.min("turn").alias("_first"))
    return per.groupBy("conv_id").agg(
        F.max_by("intent", F.struct(F.col("_n"), -F.col("_first"))).alias("primary_intent")
    )


def summary(triaged: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One row per conversation: turn_count, duration_minutes, escalated,
    primary_intent, avg_sentiment. ``as_of`` defaults to the conversation's
    last message time.

    One pass, two aggregation levels: per (conversation, intent) partial
    counts and sums (map-side combined), then per conversation. The primary
    intent is the intent with most kept turns, ties to the one seen first;
    averages are exact decimals (order-independent), rounded half-up.
    """
    kept = ~F.col("escalated")
    per = triaged.groupBy("conv_id", "intent").agg(
        F.count_if(kept).alias("_n"),
        F.min(F.when(kept, F.col("turn"))).alias("_first"),
        F.min("ts").alias("_start"),
        F.max("ts").alias("_last"),
        F.max(F.col("escalated").cast("int")).alias("_esc"),
        F.sum(F.when(kept, F.col("sentiment_score").cast("decimal(20,10)"))).alias("_sum"),
    )
    agg = per.groupBy("conv_id").agg(
        (2 * F.sum("_n")).cast("bigint").alias("turn_count"),
        F.sum("_n").alias("_kept"),
        F.min("_start").alias("_start"),
        F.max("_last").alias("_last"),
        F.max("_esc").cast("boolean").alias("escalated"),
        (F.sum("_sum") / F.sum("_n")).alias("_avg"),
        F.max_by(F.col("intent"), F.when(F.col("_n") > 0, F.struct(F.col("_n"), -F.col("_first")))).alias("primary_intent"),
    )
    end = as_of if as_of is not None else F.col("_last")
    duration = F.when(F.col("_kept") == 0, F.lit(0.0)).otherwise(
        F.round((F.unix_micros(end) - F.unix_micros(F.col("_start"))) / 6e7, 2)
    )
    return agg.select(
        "conv_id",
        "turn_count",
        duration.alias("duration_minutes"),
        "escalated",
        F.coalesce(F.col("primary_intent"), F.lit(UNKNOWN_INTENT)).alias("primary_intent"),
        F.coalesce(F.round(F.col("_avg"), 2).cast("double"), F.lit(DEFAULT_AVG_SENTIMENT)).alias("avg_sentiment"),
    )


def duration_minutes(df: DataFrame, key: str, ts_col: str = "ts", as_of: str = "key") -> DataFrame:
    """Minutes from the first event of each key to ``as_of`` (the key's last
    event, or the table's last event with ``as_of='table'``)."""
    per = df.groupBy(key).agg(F.min(ts_col).alias("_start"), F.max(ts_col).alias("_end"))
    if as_of == "table":
        # scalar subquery: evaluated once, inlined as a literal
        per = per.withColumn("_end", df.select(F.max(ts_col)).scalar())
    return per.select(
        key, F.round((F.unix_micros(F.col("_end")) - F.unix_micros(F.col("_start"))) / 6e7, 2).alias("duration_minutes")
    )


def latest_customer_message(msgs: DataFrame) -> DataFrame:
    return (
        msgs.filter(F.col("role") == "customer")
        .groupBy("conv_id")
        .agg(F.max_by("content", "turn").alias("last_customer_message"))
    )


def session_stats(triaged: DataFrame, review_events: DataFrame) -> DataFrame:
    """Counters per conversation: customer messages, auto-sent replies and
    human-reviewed replies (held replies sent, edited or escalated). Of several
    review events of a message the latest counts."""
    ev = one_per_message(review_events, ["action"])
    j = triaged.join(ev, "message_id", "left")
    reviewed = F.col("needs_human_review") & F.col("action").isin("send", "send_edited", "escalate")
    return j.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(~F.col("needs_human_review")).alias("auto_sent"),
        F.count_if(F.coalesce(reviewed, F.lit(False))).alias("reviewed"),
    )


def session_mood(summaries: DataFrame) -> DataFrame:
    return summaries.filter(F.col("turn_count") > 0).select(
        "conv_id", "avg_sentiment", rules.session_mood(F.col("avg_sentiment")).alias("mood")
    )


def _title(c: Column) -> Column:
    return F.initcap(F.regexp_replace(c, "_", " "))


def analysis_log_recent(log: DataFrame, n: int = 10) -> DataFrame:
    """Last ``n`` analysis rows per conversation, newest first, labelled with
    their place in the conversation's log, counted from 1."""
    recent = top_k(log, ["conv_id"], [F.col("turn").desc()], n, "recency")
    sizes = log.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_rows"))
    recent = recent.alias("a").join(sizes.alias("b"), same("a", "b", ["conv_id"])).select("a.*", "b._rows")
    pos = F.col("_rows") - F.col("recency") + 1
    return recent.select(
        "conv_id",
        "turn",
        "recency",
        F.concat(F.lit("#"), pos.cast("string"), F.lit(" "), _title(F.col("intent"))).alias("label"),
        F.format_string("%.0f%%", F.col("confidence") * 100).alias("confidence_pct"),
        F.when(F.col("needs_review"), F.lit("Human")).otherwise(F.lit("Auto-sent")).alias("review"),
    )
