"""Streams from rows dealt into files, one file a micro-batch."""

import tempfile


def stream_of(spark, batches, schema):
    """A stream that reads each of ``batches`` (lists of rows) as a micro-batch."""
    folder = tempfile.mkdtemp(prefix="parley-in-")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run_to_memory(spark, df, name, mode="append"):
    """All rows that the stream gives, and its progress reports."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", tempfile.mkdtemp(prefix="parley-stream-")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    if q.exception():
        raise q.exception()
    return spark.table(name), q.recentProgress
