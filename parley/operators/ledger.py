"""The cost ledger as stored batches: running totals that read only what is appended.

``append`` prices one batch of calls, adds what earlier batches left of each
session (one stored row a session and batch) to the running totals within the
batch, and writes the rows and the batch's own sums. Rows of earlier batches are
never read again. A batch holds calls that follow those of earlier batches; one
that is run again replaces itself, so batches are repeated from the first
changed one onwards. Null sessions are a session of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators import cost
from parley.plans.windows import running_total, same
from parley.streaming import sinks

_MONEY = T.DecimalType(38, 12)
ROWS = T.StructType(
    [
        T.StructField("session_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("agent", T.StringType()), T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()), T.StructField("total_cost", _MONEY), T.StructField("session_cost", _MONEY),
    ]
)
SUMS = T.StructType(
    [
        T.StructField("session_id", T.LongType()), T.StructField("total_cost", _MONEY), T.StructField("calls", T.LongType()),
        T.StructField("reply_cost", _MONEY), T.StructField("displayed_cost", _MONEY), T.StructField("replies", T.LongType()),
    ]
)


def _sums(spark: SparkSession, root: str, below: int | None = None) -> DataFrame:
    """The sums of each session over all batches (those before ``below``)."""
    stored = sinks.read_table(spark, f"{root}/sums", T.StructType([*SUMS.fields, T.StructField(sinks.BATCH, T.LongType())]))
    stored = stored if below is None else stored.where(F.col(sinks.BATCH) < below)
    return stored.groupBy("session_id").agg(*(F.sum(f.name).cast(f.dataType).alias(f.name) for f in SUMS.fields[1:]))


def append(calls: DataFrame, batch_id: int, root: str, agent: str = cost.AGENT_REPLY) -> None:
    """``calls`` (session_id, seq, agent, input_tokens, output_tokens) as batch ``batch_id`` of the ledger under ``root``.

    ``session_cost`` of the stored rows is the running cost of ``agent``'s calls, null for other agents' rows.
    """
    own = (F.col("agent") == agent) & F.col("agent").isNotNull()
    priced = cost.call_cost(calls.select("session_id", "seq", "agent", "input_tokens", "output_tokens"))
    mine = F.when(own, F.col("total_cost")).otherwise(F.lit(0)).cast(cost.COST_TYPE)
    run = running_total(priced, ["session_id"], "seq", mine, "_run")
    before = _sums(calls.sparkSession, root, batch_id).select("session_id", F.col("reply_cost").alias("_before"))
    rows = run.alias("a").join(before.alias("b"), same("a", "b", ["session_id"]), "left").select("a.*", "b._before")
    total = (F.col("_run") + F.coalesce("_before", F.lit(0).cast(cost.COST_TYPE))).cast(_MONEY)
    rows = rows.withColumn("session_cost", F.when(own, total))
    sinks.write_batch(rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in ROWS.fields)), batch_id, f"{root}/rows", [])
    written = sinks.read_table(calls.sparkSession, f"{root}/rows/{sinks.BATCH}={int(batch_id)}", ROWS)
    reply = F.col("session_cost").isNotNull()
    each = written.groupBy("session_id").agg(
        F.sum("total_cost"), F.count(F.lit(1)), F.sum(F.when(reply, F.col("total_cost")).otherwise(F.lit(0))), F.coalesce(F.sum("session_cost"), F.lit(0)), F.count_if(reply)
    )
    sinks.write_batch(each.toDF(*SUMS.fieldNames()).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in SUMS.fields)), batch_id, f"{root}/sums", [])


def running(spark: SparkSession, root: str) -> DataFrame:
    """The stored reply calls with their running session cost."""
    return sinks.read_table(spark, f"{root}/rows", ROWS).where(F.col("session_cost").isNotNull())


def session_totals(spark: SparkSession, root: str) -> DataFrame:
    """session_id, total_cost and calls, from the stored sums alone."""
    return _sums(spark, root).select("session_id", "total_cost", "calls")


def displayed(spark: SparkSession, root: str) -> DataFrame:
    """session_id, displayed_cost (the running sums added up again) and true_cost of sessions with a reply call, from the stored sums alone."""
    return _sums(spark, root).where("replies > 0").select("session_id", "displayed_cost", F.col("reply_cost").alias("true_cost"))
