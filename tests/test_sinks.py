"""Sinks and the global monitor: batch results over several micro-batches, and replays that change nothing."""

import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from parley.operators import monitor
from parley.operators import tickets as tk
from parley.operators import triage as tri
from parley.plans import catalog
from parley.sources import logs
from parley.streaming import global_monitor, sinks
from sf_dirs import SF001
from streams import stream_of

START = dt.datetime(2024, 1, 1)
INTERACTIONS = "event_id long, ts timestamp, pii_filter_success boolean, escalated boolean, sentiment_score double, response_time_ms long, cost double"


def interactions(n):
    rnd = random.Random(2)
    return [(i, START + dt.timedelta(seconds=i // 3), rnd.random() > 0.02, rnd.random() < 0.35, rnd.choice([None, 0.1, 0.5, 0.25]), i, rnd.choice([0.001, 0.01, 0.05, None])) for i in range(n)]


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def test_global_window_over_batches_equals_batch(spark):
    rows = interactions(700)
    whole = monitor.rolling(spark.createDataFrame(rows, INTERACTIONS), plan="naive")
    root = tempfile.mkdtemp(prefix="parley-monitor-")
    batches = [rows[:40], rows[40:90], rows[90:600], rows[600:]]
    q = global_monitor.start(stream_of(spark, batches, INTERACTIONS), root, tempfile.mkdtemp(prefix="parley-ckpt-"), available_now=True)
    assert q.awaitTermination(300) and q.exception() is None
    columns = ["event_id", "ts", "window_n", "escalation_rate", "pii_success_rate", "avg_sentiment", "avg_cost", "recent_sentiment"]
    assert same(global_monitor.metrics(spark, root).select(columns), whole.select(columns))
    alerts = monitor.alerts(whole)
    assert alerts.count() > 0 and same(global_monitor.alerts(spark, root).select("event_id", "alert_no", "severity", "title", "message"), alerts.select("event_id", "alert_no", "severity", "title", "message"))
    want = monitor.dashboard(spark.createDataFrame(rows, INTERACTIONS))
    assert same(global_monitor.dashboard(spark, root), want)
    # a batch that is run again replaces its rows; an empty one leaves the dashboard as it was
    global_monitor.track(spark.createDataFrame(rows[600:], INTERACTIONS), 3, root)
    global_monitor.track(spark.createDataFrame([], INTERACTIONS), 4, root)
    assert same(global_monitor.metrics(spark, root).select(columns), whole.select(columns))
    assert same(global_monitor.dashboard(spark, root), want) and monitor.health_report(global_monitor.dashboard(spark, root)).count() == 6


def test_late_rows_follow_in_arrival_order(spark):
    rows = interactions(30)
    root = tempfile.mkdtemp(prefix="parley-monitor-")
    global_monitor.track(spark.createDataFrame(rows[10:], INTERACTIONS), 0, root)
    global_monitor.track(spark.createDataFrame(rows[:10], INTERACTIONS), 1, root)
    seen = {r.event_id: r.window_n for r in global_monitor.metrics(spark, root).collect()}
    assert [seen[i] for i in [*range(10, 30), *range(10)]] == list(range(1, 31))


def triage_files(spark, n=3):
    rows = catalog.triaged(spark, SF001).where("message_id < 300").collect()
    schema = catalog.triaged(spark, SF001).schema
    size = -(-len(rows) // n)
    return [rows[i : i + size] for i in range(0, len(rows), size)], schema


def usage(rows):
    return rows.where("not escalated").select("ts", F.lit("support_agent").alias("agent"), F.lit(10).alias("input_tokens"), F.lit(5).alias("output_tokens"), F.col("cost").alias("total_cost"), F.lit("").alias("description"))


def test_tables_of_a_stream_and_replays(spark):
    batches, schema = triage_files(spark)
    root, ckpt = tempfile.mkdtemp(prefix="parley-sink-"), tempfile.mkdtemp(prefix="parley-ckpt-")
    q = sinks.start(stream_of(spark, batches, schema), root, ckpt, usage, available_now=True)
    assert q.awaitTermination(300) and q.exception() is None
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    routed = tri.route(every).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    tables = {
        "triage": (sinks.triage_schema(every), routed),
        "log": (tri.analysis_log(every).schema, tri.analysis_log(every)),
        "calls": (logs.CALL_SCHEMA, usage(every)),
    }

    def check():
        for name, (fields, want) in tables.items():
            got = sinks.read_table(spark, f"{root}/{name}", fields)
            assert same(got, want.select(*(F.col(f.name).cast(f.dataType) for f in fields.fields)).select(*got.columns)), name
        raised = sinks.read_table(spark, f"{root}/tickets", logs.TICKET_SCHEMA)
        assert same(raised.select("escalation_id", "customer_message"), tk.create_from_triage(every).select("escalation_id", "customer_message"))

    check()
    # the same batches once more, as after a driver was lost before it noted them
    for i in (1, 2):
        sinks.sink(spark.createDataFrame(batches[i], schema), i, root, usage)
    check()
    # a failed first try may have left other partitions behind
    spark.createDataFrame(batches[0], schema).withColumn("route", F.lit("nowhere")).withColumn("day", F.lit("x")).write.mode("append").partitionBy("route", "day").parquet(f"{root}/triage/batch=0")
    sinks.sink(spark.createDataFrame(batches[0], schema), 0, root, usage)
    check()
    # an empty batch, and a stream that goes on with its checkpoint, add nothing
    sinks.sink(spark.createDataFrame([], schema), 3, root, usage)
    check()
    assert {r.route for r in spark.read.parquet(f"{root}/triage").select("route").distinct().collect()} == {"auto_sent", "pending_review"}


def test_missing_table_is_empty(spark):
    assert sinks.read_table(spark, tempfile.mkdtemp() + "/none", logs.CALL_SCHEMA).count() == 0
