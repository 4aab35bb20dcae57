"""Model calls as two streams: requests leave, replies come back when they are ready.

``match_replies`` joins a stream of requests with the stream of their replies:
a left outer stream-stream join on the message id within ``wait`` of the
request, with a watermark on each side, so both sides' state is dropped once no
match is possible any more. A request whose reply is missing or comes later
than ``wait`` leaves the join with a null reply, and gets what a failed call
gets. Repeated replies of a message count once, the first to arrive.

``triage_exchange`` chains the three calls of a message (intent, sentiment,
reply) and the batch steps of the triage. Its rows hold the reply call's own
cost; the running cost of a conversation is ``ordered.running_cost``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import parse
from parley.operators import triage as tri

#: A reply body (``model_io.parse_responses`` gives ``raw_response``), one stream for each kind of call.
REPLY_SCHEMA = T.StructType(
    [
        T.StructField("message_id", T.LongType()),
        T.StructField("replied_at", T.TimestampType()),
        T.StructField("raw_response", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
    ]
)


def match_replies(requests: DataFrame, replies: DataFrame, wait: str = "10 minutes", delay: str = "1 minute", time: str = "ts", name: str = "raw_response", carry: dict[str, str] | None = None) -> DataFrame:
    """``requests`` (with ``message_id`` and the event time ``time``) and their reply texts as ``name``, null where none came within ``wait``.

    ``delay`` is how late rows of either side may arrive; a ``requests`` that has
    a watermark already (from an earlier match) keeps it. ``carry`` names
    further columns of the reply (reply column: new name).
    """
    carry = carry or {}
    asked = requests if _marked(requests, time) else requests.withWatermark(time, delay)
    given = replies.select(F.col("message_id").alias("_of"), F.col("replied_at").alias("_at"), F.col("raw_response").alias(name), *(F.col(c).alias(n) for c, n in carry.items()))
    given = given.where(F.col("_of").isNotNull()).withWatermark("_at", delay).dropDuplicatesWithinWatermark(["_of"])
    near = (F.col("_at") >= F.col(time)) & (F.col("_at") <= F.col(time) + F.expr(f"interval {wait}"))
    return asked.join(given, (F.col("message_id") == F.col("_of")) & near, "left_outer").drop("_of", "_at")


def _marked(df: DataFrame, time: str) -> bool:
    """Whether ``time`` carries a watermark."""
    return "spark.watermarkDelayMs" in (df.schema[time].metadata or {})


def labelled_exchange(messages: DataFrame, intents: DataFrame, sentiments: DataFrame, replies: DataFrame, wait: str = "10 minutes", delay: str = "1 minute") -> DataFrame:
    """A stream of messages with intent, confidence, sentiment, score, ``escalated``, reply and token counts from three reply streams (``REPLY_SCHEMA``).

    Each reply is awaited for ``wait`` after its message and read before the next one is matched.
    """
    df = match_replies(messages, intents, wait, delay, name="_text")
    df = df.withColumn("_i", parse.intent_result(F.col("_text"))).drop("_text")
    df = match_replies(df, sentiments, wait, delay, name="_text")
    df = df.withColumn("_s", parse.sentiment_result(F.col("_text"))).drop("_text")
    df = match_replies(df, replies, wait, delay, name="reply", carry={"input_tokens": "input_tokens", "output_tokens": "output_tokens"})
    df = df.withColumns({"intent": F.col("_i.intent"), "confidence": F.col("_i.confidence"), "sentiment": F.col("_s.sentiment"), "score": F.col("_s.score")})
    return tri.escalate(df.drop("_i", "_s"))


def triaged(labelled: DataFrame) -> DataFrame:
    """Triage rows of labelled messages with their replies; ``cost`` is that of the row's own reply call."""
    return tri.finish(tri.judge(labelled.withColumn("_own_cost", tri.reply_cost(True)), ["_own_cost"]), F.col("_own_cost"))


def triage_exchange(messages: DataFrame, intents: DataFrame, sentiments: DataFrame, replies: DataFrame, wait: str = "10 minutes", delay: str = "1 minute") -> DataFrame:
    """Triage rows of a stream of messages whose model replies arrive on streams of their own."""
    return triaged(labelled_exchange(messages, intents, sentiments, replies, wait, delay))
