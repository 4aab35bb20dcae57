"""Structured Streaming variants.

* ``triage_stream``: the triage chain on a stream of messages. Redaction,
  labels, escalation and guardrails are the batch steps (``triage.judge``,
  ``triage.finish``) behind stream-static joins; the per-conversation running
  reply cost is keyed state (one decimal total per conversation).
* ``memory_stream``: bounded conversation memory; the state is the last 20
  history lines of a conversation and its message count.
* ``monitor_stream``: one health monitor per key; the state is the bounded
  window of the last 100 interactions of the key (decimals, so frame sums are
  exact and equal the batch plan's). ``alerts_stream`` applies the alert rules.

State is bounded by counts, so no watermark and no expiry is needed. The rows
of one key and one micro-batch are sorted together: the source's admission
limit (``max_files`` of ``read_messages``) bounds them, also for a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.operators import conversation, monitor
from parley.operators import triage as tri

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("message_id", T.LongType()),
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

INTERACTION_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("monitor_key", T.LongType()),
        T.StructField("pii_filter_success", T.BooleanType()),
        T.StructField("escalated", T.BooleanType()),
        T.StructField("sentiment_score", T.DoubleType()),
        T.StructField("response_time_ms", T.LongType()),
        T.StructField("cost", T.DoubleType()),
    ]
)


def read_messages(spark, path: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Message stream from files landing in ``path`` (Kafka etc. by format)."""
    r = spark.readStream.schema(MESSAGE_SCHEMA).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


_MONEY = T.DecimalType(38, 12)
_COST_STATE = T.StructType([T.StructField("total", _MONEY)])


def _running_cost(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Pass the rows of one conversation through, adding the running reply
    cost; the running total is the key's state."""
    total = state.get[0] if state.exists else Decimal(0)
    pdf = pd.concat(list(batches), ignore_index=True).sort_values(["turn", "message_id"])
    pdf["_session_cost"] = list(accumulate(pdf["_reply_cost"], initial=total))[1:]
    state.update((pdf["_session_cost"].iloc[-1],))
    yield pdf


def triage_stream(messages: DataFrame, scored: DataFrame, replies: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """Streaming triage rows (same columns as the batch ``triage``).

    Stream-static joins attach scores, replies and usage; the session cost is
    the running sum of the reply cost per conversation, kept as keyed state
    (messages of a conversation are assumed to arrive in turn order across
    micro-batches; within a batch they are ordered by turn).
    """
    df = tri.attach_replies(tri.escalate(tri.attach_scores(messages, scored)), replies, usage)
    rows = tri.judge(df.withColumn("_reply_cost", tri.reply_cost(usage is not None)), ["_reply_cost"])
    out_schema = T.StructType([*rows.schema.fields, T.StructField("_session_cost", _MONEY)])
    with_cost = rows.groupBy("conv_id").applyInPandasWithState(_running_cost, out_schema, _COST_STATE, "append", GroupStateTimeout.NoTimeout)
    return tri.finish(with_cost, F.col("_session_cost"))


_MEMORY_OUT = T.StructType(
    [
        T.StructField("message_id", T.LongType()),
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("turn_count", T.LongType()),
        T.StructField("context", T.StringType()),
    ]
)
_MEMORY_STATE = T.StructType([T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("stored", T.LongType())])


def _memory(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Store each turn's two messages; a turn sees the history up to its own customer message."""
    lines, stored = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
    keep, out = conversation.MAX_MESSAGES, []
    pdf = pd.concat(list(batches), ignore_index=True).sort_values(["turn", "message_id"])
    for message_id, conv_id, turn, asked, answered in pdf.itertuples(index=False):
        lines = [*lines, f"**Customer:** {asked}\n"][-keep:]
        out.append((message_id, conv_id, turn, stored + 2, conversation.HISTORY_HEADING + "\n" + "\n".join(lines)))
        lines = [*lines, f"**Agent:** {answered}\n"][-keep:]
        stored += 2
    state.update((lines, stored))
    yield pd.DataFrame(out, columns=_MEMORY_OUT.fieldNames())


def memory_stream(triaged: DataFrame) -> DataFrame:
    """History text at each non-escalated turn of a stream of triage rows, and
    the number of messages stored after it."""
    kept = triaged.where(~F.col("escalated")).select("message_id", "conv_id", "turn", "redacted_message", "response")
    return kept.groupBy("conv_id").applyInPandasWithState(_memory, _MEMORY_OUT, _MEMORY_STATE, "append", GroupStateTimeout.NoTimeout)


_VALUE = T.DecimalType(28, 10)
_MON_OUT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("monitor_key", T.LongType()),
        T.StructField("pii_filter_success", T.BooleanType()),
        T.StructField("cost", T.DoubleType()),
        T.StructField("record", T.StringType()),
        T.StructField("window_n", T.LongType()),
        T.StructField("escalation_rate", T.DoubleType()),
        T.StructField("pii_success_rate", T.DoubleType()),
        T.StructField("avg_sentiment", T.DoubleType()),
        T.StructField("avg_cost", T.DoubleType()),
        T.StructField("recent_sentiment", T.DoubleType()),
    ]
)
_MON_STATE = T.StructType(
    [
        T.StructField("esc", T.ArrayType(T.LongType())),
        T.StructField("pii", T.ArrayType(T.LongType())),
        T.StructField("sent", T.ArrayType(_VALUE)),
        T.StructField("cost", T.ArrayType(_VALUE)),
    ]
)


def _frame_means(values: list, known: int, n: int) -> tuple[list[float], list[int]]:
    """Means and sizes of the trailing n-row frames for the rows after the
    first ``known`` (state) values, by differences of exact running sums."""
    sums = list(accumulate(values, initial=0))
    ends = range(known + 1, len(values) + 1)
    sizes = [min(n, i) for i in ends]
    return [float((sums[i] - sums[i - k]) / k) for i, k in zip(ends, sizes)], sizes


def _monitor_state(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state holds the last 100 values of each metric; the batch is appended to them."""
    n, n10 = monitor.WINDOW_SIZE, monitor.SENTIMENT_SPIKE_WINDOW
    prev = [list(x) for x in state.get] if state.exists else [[], [], [], []]
    pdf = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"], ignore_index=True)
    new = [pdf["escalated"].astype(int).tolist(), pdf["pii_filter_success"].astype(int).tolist(), pdf["_sent"].tolist(), pdf["_cost"].tolist()]
    known = len(prev[0])
    full = [p + v for p, v in zip(prev, new)]
    (esc, sizes), (pii_ok, _), (sent, _), (cost, _) = (_frame_means(f, known, n) for f in full)
    recent, _ = _frame_means(full[2], known, n10)
    state.update(tuple(f[-n:] for f in full))
    yield pd.DataFrame(
        {
            **{c: pdf[c] for c in ("event_id", "ts", "monitor_key", "pii_filter_success", "cost", "record")},
            "window_n": np.array(sizes, np.int64),
            "escalation_rate": esc,
            "pii_success_rate": pii_ok,
            "avg_sentiment": sent,
            "avg_cost": cost,
            "recent_sentiment": recent,
        }
    )


def monitor_stream(interactions: DataFrame) -> DataFrame:
    """Rolling metrics per interaction, one monitor per ``monitor_key``; the
    bounded window is the keyed state."""
    df = monitor.with_defaults(interactions).select(
        "event_id", "ts", "monitor_key", "pii_filter_success", "escalated", "cost", "record",
        F.col("sentiment_score").cast(_VALUE).alias("_sent"), F.col("cost").cast(_VALUE).alias("_cost"),
    )
    return df.groupBy("monitor_key").applyInPandasWithState(
        _monitor_state, _MON_OUT, _MON_STATE, "append", GroupStateTimeout.NoTimeout
    )


def alerts_stream(interactions: DataFrame) -> DataFrame:
    """The alerts of every interaction of a stream, one monitor per ``monitor_key``."""
    return monitor.alerts(monitor_stream(interactions))
