"""Ticket and cost-call logs: append-only tables instead of whole-file rewrites.

Writes append new rows partitioned by day (no read-modify-write, so
concurrent writers cannot lose each other's rows); reads take an explicit
schema and return an empty table when nothing has been written yet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

TICKET_SCHEMA = T.StructType(
    [
        T.StructField("escalation_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("priority", T.StringType()),
        T.StructField("customer_message", T.StringType()),
        T.StructField("intent", T.StringType()),
        T.StructField("sentiment_score", T.DoubleType()),
        T.StructField("conversation_summary", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("assigned_agent", T.StringType()),
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
    ]
)

CALL_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("agent", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("total_cost", T.DoubleType()),
        T.StructField("description", T.StringType()),
    ]
)


def _append(df: DataFrame, path: str, day: F.Column) -> None:
    df.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def _or_empty(spark: SparkSession, schema: T.StructType, read: Callable[[], DataFrame]) -> DataFrame:
    """What ``read`` gives, or an empty table where nothing has been written yet."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    stored = T.StructType(schema.fields + [T.StructField("day", T.StringType())])
    return _or_empty(spark, schema, lambda: spark.read.schema(stored).parquet(path).drop("day"))


def _read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A log kept as one JSON array document, its times under ``timestamp`` (ISO text)."""
    stored = T.StructType([f for f in schema.fields if f.name not in ("ts", "created_at")] + [T.StructField("timestamp", T.StringType())])

    def read() -> DataFrame:
        rows = spark.read.schema(stored).option("multiLine", True).json(path).withColumn("ts", F.to_timestamp("timestamp"))
        return rows.withColumn("created_at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).select(*[f.name for f in schema.fields])

    return _or_empty(spark, schema, read)


def write_tickets(tickets: DataFrame, path: str) -> None:
    _append(tickets.select(*[f.name for f in TICKET_SCHEMA.fields]), path, F.substring("created_at", 1, 10))


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, TICKET_SCHEMA)


def read_tickets_json(spark: SparkSession, path: str) -> DataFrame:
    """The ticket log as one JSON array document; empty where there is none."""
    return _read_json(spark, path, TICKET_SCHEMA)


def write_calls(calls: DataFrame, path: str) -> None:
    """``calls`` with a ``ts``; a missing ``description`` is an empty one."""
    if "description" not in calls.columns:
        calls = calls.withColumn("description", F.lit(""))
    _append(calls.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CALL_SCHEMA.fields]), path, F.date_format("ts", "yyyy-MM-dd"))


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, CALL_SCHEMA)


def read_calls_json(spark: SparkSession, path: str) -> DataFrame:
    """The cost history as one JSON array document; empty where there is none."""
    return _read_json(spark, path, CALL_SCHEMA)
