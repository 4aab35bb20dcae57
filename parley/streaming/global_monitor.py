"""One health monitor over a whole stream of interactions.

The window of the last ``monitor.WINDOW_SIZE`` interactions has no key, so no
keyed state can hold it without putting the stream in one task. Instead every
micro-batch is a parallel plan of its own: its rows follow the last rows of the
batch before it (a carried table of ``WINDOW_SIZE`` rows), the halo plan
numbers and sums them, and the batch leaves its metrics, its alerts, its own
last rows and the dashboard after it. The order is that of arrival: batches one
after the other, within a batch by (ts, event_id); a row older than what
an earlier batch held follows it.

Every table is written by batch (``sinks.write_batch``), and a batch reads only
what earlier ones left, so a batch that is run again replaces its rows and
changes no later result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from parley.operators import monitor
from parley.streaming import sinks

_CARRY = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("pii_filter_success", T.BooleanType()),
        T.StructField("escalated", T.BooleanType()), T.StructField("sentiment_score", T.DoubleType()), T.StructField("response_time_ms", T.LongType()),
        T.StructField("cost", T.DoubleType()), T.StructField("record", T.StringType()), T.StructField("at", T.TimestampType()),
    ]
)
_STATE = T.StructType([T.StructField("rows", T.LongType()), T.StructField("critical", T.LongType()), T.StructField("latest", T.TimestampType())])


def _before(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """What the last batch before ``batch_id`` left in a table (its folder alone is read)."""
    left = spark.read.schema(T.StructType([*schema.fields, T.StructField(sinks.BATCH, T.LongType())])).option("basePath", path)
    if batch_id <= 0:
        return spark.createDataFrame([], schema)
    return left.parquet(f"{path}/{sinks.BATCH}={batch_id - 1}").select(*schema.fieldNames())


def track(interactions: DataFrame, batch_id: int, root: str) -> None:
    """One micro-batch of interactions (a static DataFrame) into the tables under ``root``: metrics, alerts, carry, state and dashboard."""
    spark = interactions.sparkSession
    carry = _before(spark, f"{root}/carry", _CARRY, batch_id)
    state = _before(spark, f"{root}/state", _STATE, batch_id).first()  # one row
    latest = state.latest if state else None
    own = monitor.with_defaults(interactions).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in _CARRY.fields[:-1]))
    at = F.col("ts") if latest is None else F.greatest(F.col("ts"), F.lit(latest) + F.expr("interval 1 microsecond"))
    own = own.withColumn("at", at)
    both = carry.withColumn("old", F.lit(True)).unionByName(own.withColumn("old", F.lit(False)))
    # the plan orders by time: a row's place in the sequence stands in for it
    rolled = monitor.rolling(both.withColumnsRenamed({"ts": "_ts", "at": "ts"})).where("not old")
    out = rolled.withColumnsRenamed({"ts": "at", "_ts": "ts"}).drop("old")
    sinks.write_batch(out, batch_id, f"{root}/metrics", [])
    if sinks.has_rows(spark, f"{root}/metrics", batch_id):
        sinks.write_batch(monitor.alerts(metrics(spark, root, batch_id)), batch_id, f"{root}/alerts", [])
    last = both.orderBy(F.col("at").desc(), F.col("event_id").desc()).limit(monitor.WINDOW_SIZE)
    sinks.write_batch(last.select(*_CARRY.fieldNames()).coalesce(1), batch_id, f"{root}/carry", [])
    now = own.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("pii_filter_success")).alias("c"), F.max("at").alias("m")).first()
    new = (now.n + (state.rows if state else 0), now.c + (state.critical if state else 0), now.m or latest)
    sinks.write_batch(spark.createDataFrame([new], _STATE).coalesce(1), batch_id, f"{root}/state", [])
    window = spark.read.schema(_CARRY).parquet(f"{root}/carry/{sinks.BATCH}={batch_id}")
    shown = monitor.dashboard(window.withColumnsRenamed({"ts": "_ts", "at": "ts"})).withColumn("recent_alerts", F.lit(new[1]).cast("long"))
    sinks.write_batch(shown.coalesce(1), batch_id, f"{root}/dashboard", [])


_METRICS = T.StructType(
    [
        *_CARRY.fields,
        *(T.StructField(c, T.LongType() if c == "window_n" else T.DoubleType()) for c in ("window_n", "escalation_rate", "pii_success_rate", "avg_sentiment", "avg_cost", "recent_sentiment")),
    ]
)


def metrics(spark: SparkSession, root: str, batch_id: int | None = None) -> DataFrame:
    """The rolling metrics of every interaction, or of one batch's."""
    if batch_id is None:
        return sinks.read_table(spark, f"{root}/metrics", _METRICS)
    return spark.read.schema(_METRICS).parquet(f"{root}/metrics/{sinks.BATCH}={batch_id}")


_ALERTS = T.StructType(
    [
        T.StructField("ts", T.TimestampType()), T.StructField("event_id", T.LongType()), T.StructField("alert_no", T.LongType()), T.StructField("severity", T.StringType()),
        T.StructField("title", T.StringType()), T.StructField("message", T.StringType()), T.StructField("details", T.StringType()),
    ]
)


def alerts(spark: SparkSession, root: str) -> DataFrame:
    return sinks.read_table(spark, f"{root}/alerts", _ALERTS)


_DASHBOARD = T.StructType(
    [
        T.StructField("escalation_rate", T.DoubleType()), T.StructField("pii_success_rate", T.DoubleType()), T.StructField("avg_sentiment", T.DoubleType()),
        T.StructField("total_interactions", T.LongType()), T.StructField("recent_alerts", T.LongType()), T.StructField("avg_cost", T.DoubleType()),
    ]
)


def dashboard(spark: SparkSession, root: str) -> DataFrame:
    """The dashboard after the last batch (no row before the first interaction); ``monitor.health_report`` takes it as it is."""
    every = sinks.read_table(spark, f"{root}/dashboard", T.StructType([*_DASHBOARD.fields, T.StructField(sinks.BATCH, T.LongType())]))
    return every.orderBy(F.col(sinks.BATCH).desc()).limit(1).drop(sinks.BATCH)


def start(interactions: DataFrame, root: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Runs a stream of interactions into ``track``."""
    writer = interactions.writeStream.foreachBatch(lambda df, batch_id: track(df, batch_id, root)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
