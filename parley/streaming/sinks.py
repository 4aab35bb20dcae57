"""Sinks of the triage stream that a replayed micro-batch cannot fill twice.

A micro-batch is written once, as files under ``batch=<id>/route=.../day=...``.
The batch id is the first partition column and a batch overwrites only its own
folder, so running a batch again (after a lost driver, say) replaces its
rows. Tickets, reply costs and the analysis log of a batch are derived from
the files just written, not from a second run of the stream's plan, and go to
tables of their own in the same way.

Readers drop the batch column; a table that is not there yet is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from parley.operators import tickets as tk
from parley.operators import triage as tri
from parley.sources import logs

BATCH, NO_DAY = "batch", "none"


def _day(time: str) -> Column:
    return F.coalesce(F.date_format(time, "yyyy-MM-dd"), F.lit(NO_DAY))


def write_batch(rows: DataFrame, batch_id: int, path: str, by: list[str], dealt: bool = True, **options) -> None:
    """``rows`` as the whole of batch ``batch_id`` in the table at ``path``, partitioned by ``by`` within the batch; without ``dealt`` every task writes its own rows."""
    if by and dealt:
        rows = rows.repartition(*by, F.pmod(F.xxhash64(*rows.columns), F.lit(_spread(rows))))
    # the batch's own folder is overwritten whole, with what a failed first try may have left in it
    rows.write.mode("overwrite").options(**options).partitionBy(*by).parquet(f"{path}/{BATCH}={int(batch_id)}")


def _spread(rows: DataFrame) -> int:
    """Files that a partition value's rows are dealt to, so that a hot route or day is written by many tasks."""
    return max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches."""
    extra = [] if BATCH in schema.fieldNames() else [T.StructField(BATCH, T.LongType())]
    stored = T.StructType([*schema.fields, *extra])
    try:
        return spark.read.schema(stored).option("basePath", path).parquet(path).select(*schema.fieldNames())
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise


def triage_schema(triaged: DataFrame) -> T.StructType:
    return T.StructType([*(T.StructField(f.name, f.dataType) for f in triaged.schema.fields), T.StructField("route", T.StringType()), T.StructField("day", T.StringType())])


def sink(
    triaged: DataFrame,
    batch_id: int,
    root: str,
    usage: Callable[[DataFrame], DataFrame] | None = None,
    raised: Callable[[DataFrame], DataFrame] = tk.create_from_triage,
) -> None:
    """One micro-batch of triage rows (a static DataFrame) into the tables under ``root``.

    ``triage``: every row, by route and day. ``tickets``: one for each
    escalated row (``raised`` of the batch's rows, so repeated questions are
    counted within the batch), by day. ``log``: the analysis log. ``calls``:
    where ``usage`` gives the cost calls of rows (``logs.CALL_SCHEMA``), these.
    """
    spark = triaged.sparkSession
    routed = tri.route(triaged).withColumn("day", _day("ts"))
    write_batch(routed, batch_id, f"{root}/triage", ["route", "day"])
    if not has_rows(spark, f"{root}/triage", batch_id):  # an empty batch leaves no rows in any table
        return
    own = f"{root}/triage/{BATCH}={int(batch_id)}"
    rows = spark.read.schema(triage_schema(triaged)).option("basePath", own).parquet(own)
    tickets = raised(rows).withColumn("day", _day("ts"))
    write_batch(tickets.select(*logs.TICKET_SCHEMA.fieldNames(), "day"), batch_id, f"{root}/tickets", ["day"])
    write_batch(tri.analysis_log(rows.drop("route", "day")), batch_id, f"{root}/log", [])
    if usage is not None:
        calls = usage(rows).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in logs.CALL_SCHEMA.fields))
        write_batch(calls.withColumn("day", _day("ts")), batch_id, f"{root}/calls", ["day"])


def has_rows(spark: SparkSession, path: str, batch_id: int) -> bool:
    """Whether a batch left any file in the table at ``path``."""
    try:
        return len(spark.read.option("recursiveFileLookup", True).parquet(f"{path}/{BATCH}={int(batch_id)}").columns) > 0
    except AnalysisException as e:
        if any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "does not exist")):
            return False
        raise


def start(triaged: DataFrame, root: str, checkpoint: str, usage: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = False) -> StreamingQuery:
    """Runs a stream of triage rows into ``sink``. ``checkpoint`` is the stream's own folder; with it a restarted stream numbers its batches as before."""
    writer = triaged.writeStream.foreachBatch(lambda df, batch_id: sink(df, batch_id, root, usage)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
