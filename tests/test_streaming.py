"""Streaming variants equal the batch plans on the same input."""

import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.operators import conversation, monitor
from parley.plans import catalog
from parley.sources import fixtures as fx
from parley.streaming import live

from sf_dirs import SF001


def _in_batches(spark, df, order, n=3):
    """``df`` as ``n`` files in ``order``, and a stream reading one file a micro-batch."""
    src = tempfile.mkdtemp(prefix="parley-in-")
    rows = df.select("*", F.ntile(n).over(Window.orderBy(*order)).alias("_part")).cache()
    for i in range(1, n + 1):
        rows.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)


def _run_stream(spark, df, name, batches=3):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", tempfile.mkdtemp(prefix="parley-stream-")
    ).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert sum(p["numInputRows"] > 0 for p in q.recentProgress) >= batches
    return spark.table(name)


def test_triage_stream_equals_batch(spark):
    msgs = fx.view(spark, SF001, "v_messages").select([f.name for f in live.MESSAGE_SCHEMA.fields])
    sides = [fx.view(spark, SF001, n) for n in ("v_scored", "v_replies", "v_reply_usage")]
    got = _run_stream(spark, live.triage_stream(_in_batches(spark, msgs, ["turn"]), *sides), "triage_stream_out")
    batch = catalog.triaged(spark, SF001)
    assert got.columns == batch.columns and got.count() == batch.count()
    assert got.exceptAll(batch).count() == 0


def test_memory_stream_equals_batch(spark):
    rows = [(i, i % 3, i, f"q{i}", f"a{i}", i % 7 == 0) for i in range(120)]
    df = spark.createDataFrame(rows, "message_id long, conv_id long, turn long, redacted_message string, response string, escalated boolean")
    got = _run_stream(spark, live.memory_stream(_in_batches(spark, df, ["turn"], 4)), "memory_stream_out", 4)
    want = conversation.context_per_turn(df, ["message_id"])
    assert got.count() == want.count() > 90
    assert got.select("conv_id", "turn", "message_id", "context").exceptAll(want).count() == 0
    counts = got.groupBy("conv_id").agg(F.max("turn_count").alias("n")).collect()
    assert {r.conv_id: r.n for r in counts} == {c: 2 * sum(1 for x in rows if x[1] == c and not x[5]) for c in range(3)}


def test_monitor_stream_equals_keyed_batch(spark):
    ints = fx.view(spark, SF001, "v_interactions").withColumn("monitor_key", F.col("monitor_key") % 5)
    stream = _in_batches(spark, ints, ["ts", "event_id"])
    got = _run_stream(spark, live.monitor_stream(stream), "monitor_stream_out")
    batch = monitor.rolling(ints, plan="keyed", key="monitor_key")
    cols = ["event_id", "monitor_key", "window_n", "escalation_rate", "pii_success_rate", "avg_sentiment", "avg_cost", "recent_sentiment"]
    near = lambda df: df.select(*[F.round(c, 9).alias(c) if c not in cols[:3] else F.col(c) for c in cols])
    assert got.count() == batch.count() and near(got).exceptAll(near(batch)).count() == 0
    alerts = _run_stream(spark, live.alerts_stream(stream), "alerts_stream_out")
    own = ["event_id", "ts", "severity", "title", "message"]
    want = monitor.alerts(batch).select(*own)
    assert alerts.count() == want.count() > 0 and alerts.select(*own).exceptAll(want).count() == 0
