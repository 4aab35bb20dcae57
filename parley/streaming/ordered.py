"""Keyed state that does not depend on the order or the size of micro-batches.

Conversations arrive with turns out of order. ``by_turn`` holds the rows of a
conversation in map state until the watermark has passed their time, and then
hands them on in turn order, one after the other: whatever the order of arrival
within the watermark's delay, the results are the batch plan's. Rows later
than that are dropped by the watermark. A conversation that was idle for longer
than ``idle`` starts anew, and a timer clears its state. ``by_arrival`` takes rows as they come (for sources that
keep a key's order) and lets state expire by time to live.

State lives in the state store, entry by entry; a task holds one row's texts,
one conversation's last ``conversation.MAX_MESSAGES`` lines and the keys that
are due, whatever a micro-batch brings. Both forms need the RocksDB state store
(``require_rocksdb``); it is the caller's setting. State that lives by the clock
(``by_arrival``, ``summaries``) keeps a stream running empty batches; with
``availableNow`` set ``spark.sql.streaming.noDataMicroBatches.enabled`` to false.

* ``memory``: the history text at each turn (M1, M2, M4).
* ``running_cost``: the session cost of triage rows (C3).
* ``summaries``: the running conversation summary (M5-M9), in update mode.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from parley.operators import conversation
from parley.operators import cost as cost_ops

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT_ROWS = 1_000

_FAR_MS = 1 << 60


def require_rocksdb(spark: SparkSession) -> None:
    if "RocksDB" not in (spark.conf.get(STATE_STORE, "") or ""):
        raise RuntimeError(f"set {STATE_STORE} to {ROCKSDB} before starting keyed-state streams")


class Step:
    """What a conversation remembers and what a row makes of it. ``first`` and ``second`` are a row's two values (texts or null)."""

    fields: list[T.StructField] = []

    def open(self, handle: StatefulProcessorHandle, ttl_ms: int | None) -> None:
        raise NotImplementedError

    def load(self) -> None:
        raise NotImplementedError

    def row(self, first: str | None, second: str | None) -> tuple:
        raise NotImplementedError

    def save(self) -> None:
        raise NotImplementedError

    def clear(self) -> None:
        raise NotImplementedError


class Memory(Step):
    """The last lines of a conversation (list state) and the messages stored so far; a row is a customer message and its reply."""

    fields = [T.StructField("turn_count", T.LongType()), T.StructField("context", T.StringType())]

    def open(self, handle, ttl_ms):
        self.lines = handle.getListState("lines", "line string", ttl_ms)
        self.stored = handle.getValueState("stored", "n long", ttl_ms)

    def load(self):
        self.kept = [r[0] for r in self.lines.get()] if self.lines.exists() else []
        self.n = self.stored.get()[0] if self.stored.exists() else 0

    def row(self, first, second):
        self._keep("Customer", first)
        lines = [x for x in self.kept if x is not None]  # a message without a text holds a place and prints nothing
        out = (self.n + 2, "\n".join([conversation.HISTORY_HEADING, *lines]) if lines else conversation.NO_HISTORY)
        self._keep("Agent", second)
        self.n += 2
        return out

    def _keep(self, role, text):
        line = None if text is None else f"**{role}:** {text}\n"
        self.kept = [*self.kept, line][-conversation.MAX_MESSAGES :]

    def save(self):
        self.lines.put([(x,) for x in self.kept])
        self.stored.update((self.n,))

    def clear(self):
        self.lines.clear()
        self.stored.clear()


class RunningCost(Step):
    """The conversation's cost so far; a row is its own cost and a text that comes along."""

    fields = [T.StructField("total", T.StringType()), T.StructField("row", T.StringType())]

    def open(self, handle, ttl_ms):
        self.total = handle.getValueState("total", "total string", ttl_ms)

    def load(self):
        self.sum = Decimal(self.total.get()[0]) if self.total.exists() else Decimal(0)

    def row(self, first, second):
        self.sum += Decimal(first or 0)
        return str(self.sum), second

    def save(self):
        self.total.update((str(self.sum),))

    def clear(self):
        self.total.clear()


_KEY = [T.StructField("_key", T.StringType()), T.StructField("_turn", T.LongType()), T.StructField("_id", T.LongType())]


#: Columns of the processors' input; frames arrive with these values in this order.
_IN = ["_key", "_at", "_turn", "_id", "_first", "_second"]
_SUMMARY_IN = ["_key", "turn", "at", "escalated", "intent", "score"]


def _frame(rows: list[tuple], step: Step) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.name for f in [*_KEY, *step.fields]])


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(time in ms, turn, id, first, second) of every row, a frame at a time."""
    for frame in frames:
        frame.columns = _IN
        at = frame["_at"].to_numpy().astype("datetime64[ms]").astype("int64")
        missing = frame["_at"].isna().to_numpy()
        for i, (turn, id_, first, second) in enumerate(zip(frame["_turn"], frame["_id"], frame["_first"], frame["_second"])):
            yield 0 if missing[i] else int(at[i]), int(turn), int(id_), None if pd.isna(first) else first, None if pd.isna(second) else second


class _ByTurn(StatefulProcessor):
    def __init__(self, step: Step, idle_ms: int):
        self.step, self.idle_ms = step, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "turn long, id long, at long, no long", "first string, second string")
        self.seen = handle.getValueState("seen", "no long, latest long, done long")
        self.step.open(handle, None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        no, latest, done = self.seen.get() if self.seen.exists() else (0, 0, _FAR_MS)
        newest = 0
        for at, turn, id_, first, second in _rows(rows):
            self.waiting.updateValue((turn, id_, at, no), (first, second))  # equal rows are told apart by their number
            no, newest = no + 1, max(newest, at)
        self.seen.update((no, max(latest, newest), done))
        # everything of this batch is due when the watermark passes its newest row
        self.handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        no, latest, done = self.seen.get() if self.seen.exists() else (0, 0, _FAR_MS)
        due = sorted(tuple(k) for k in self.waiting.keys() if k[2] <= mark)
        if due:
            self.step.load()
            out = []
            for k in due:
                if k[2] - done > self.idle_ms:  # idle so long that it starts anew
                    self.step.clear()
                    self.step.load()
                done = k[2]
                first, second = self.waiting.getValue(k)
                self.waiting.removeKey(k)
                out.append((key[0], k[0], k[1], *self.step.row(first, second)))
                if len(out) == OUT_ROWS:
                    yield _frame(out, self.step)
                    out = []
            self.step.save()
            self.seen.update((no, latest, done))
            if out:
                yield _frame(out, self.step)
        if mark > latest + self.idle_ms:  # no newer row came meanwhile
            self.step.clear()
            self.waiting.clear()
            self.seen.clear()
        elif due:
            self.handle.registerTimer(latest + self.idle_ms + 1)

    def close(self) -> None:
        pass


class _ByArrival(StatefulProcessor):
    def __init__(self, step: Step, idle_ms: int):
        self.step, self.idle_ms = step, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.step.open(handle, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.step.load()
        out = []
        for _, turn, id_, first, second in _rows(rows):
            out.append((key[0], turn, id_, *self.step.row(first, second)))
            if len(out) == OUT_ROWS:
                yield _frame(out, self.step)
                out = []
        self.step.save()
        if out:
            yield _frame(out, self.step)

    def close(self) -> None:
        pass


def _marked(df: DataFrame, time: str) -> bool:
    return "spark.watermarkDelayMs" in (df.schema[time].metadata or {})


def _keyed(rows: DataFrame, first, second, time: str) -> DataFrame:
    """The processors' input; a null conversation is a key of its own, a null turn comes first."""
    lowest = F.lit(-_FAR_MS)
    return rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_key"), F.col(time).alias("_at"),
        F.coalesce(F.col("turn").cast("long"), lowest).alias("_turn"), F.coalesce(F.col("message_id").cast("long"), lowest).alias("_id"),
        first.cast("string").alias("_first"), second.cast("string").alias("_second"),
    )


def _run(rows: DataFrame, step: Step, idle: str, ordered: bool) -> DataFrame:
    require_rocksdb(rows.sparkSession)
    out = T.StructType([*_KEY, *step.fields])
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    how = _ByTurn(step, idle_ms) if ordered else _ByArrival(step, idle_ms)
    found = rows.groupBy("_key").transformWithStateInPandas(statefulProcessor=how, outputStructType=out, outputMode="Append", timeMode="EventTime" if ordered else "ProcessingTime")
    back = lambda c: F.when(F.col(c) != -_FAR_MS, F.col(c))
    return found.select(F.when(F.col("_key") != "", F.col("_key").cast("long")).alias("conv_id"), back("_turn").alias("turn"), back("_id").alias("message_id"), *(f.name for f in step.fields))


def _in_time(rows: DataFrame, time: str, delay: str) -> DataFrame:
    return rows if _marked(rows, time) else rows.withWatermark(time, delay)


def memory(triaged: DataFrame, delay: str = "1 minute", idle: str = "1 day", ordered: bool = True, time: str = "ts") -> DataFrame:
    """message_id, conv_id, turn, turn_count and context at each non-escalated turn of a stream of triage rows.

    ``ordered``: rows may arrive in any order within ``delay`` of event time
    (``by_turn``); otherwise they count as they come. State of a conversation
    goes after ``idle`` without a turn.
    """
    rows = _in_time(triaged, time, delay) if ordered else triaged
    kept = _keyed(rows.where(~F.col("escalated")), F.col("redacted_message"), F.col("response"), time)
    return _run(kept, Memory(), idle, ordered).select("message_id", "conv_id", "turn", "turn_count", "context")


_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def running_cost(triaged: DataFrame, delay: str = "1 minute", idle: str = "1 day", ordered: bool = True, time: str = "ts") -> DataFrame:
    """A stream of triage rows whose ``cost`` is the reply call's own (``exchange.triage_exchange``) with the session cost instead."""
    rows = _in_time(triaged, time, delay) if ordered else triaged
    whole = F.to_json(F.struct(*triaged.columns), _TIMES)
    kept = _keyed(rows, F.col("cost").cast(cost_ops.COST_TYPE), whole, time)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in triaged.schema.fields])
    out = _run(kept, RunningCost(), idle, ordered).select(F.from_json("row", schema, _TIMES).alias("r"), "total").select("r.*", "total")
    return out.withColumn("cost", F.when(F.col("escalated"), F.lit(0.0)).otherwise(F.col("total").cast(cost_ops.COST_TYPE).cast("double"))).select(*triaged.columns)


class _Summary(StatefulProcessor):
    """Intent counts (map state) and the sums of a conversation; the order of rows does not matter."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.intents = handle.getMapState("intents", "intent string", "n long, first long", self.idle_ms)
        self.sums = handle.getValueState("sums", "kept long, score string, start long, last long, escalated boolean", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept, score, start, last, escalated = self.sums.get() if self.sums.exists() else (0, "0", _FAR_MS, -_FAR_MS, False)
        score = Decimal(score)
        for frame in rows:
            frame.columns = _SUMMARY_IN
            escalated = bool(escalated or frame["escalated"].any())
            times = frame["at"][frame["at"] > -_FAR_MS]
            if len(times):
                start, last = min(start, int(times.min())), max(last, int(times.max()))
            own = frame[~frame["escalated"].astype(bool)]
            kept += len(own)
            score = sum((Decimal(s) for s in own["score"] if s is not None), score)
            for intent, turns in own.groupby("intent", sort=False)["turn"]:
                n, first = self.intents.getValue((intent,)) if self.intents.containsKey((intent,)) else (0, _FAR_MS)
                self.intents.updateValue((intent,), (n + len(turns), min(first, int(turns.min()))))
        self.sums.update((kept, str(score), start, last, escalated))
        best = max(((v[0], -v[1], k[0]) for k, v in self.intents.iterator()), default=None)
        yield pd.DataFrame([(key[0], kept, str(score), None if start == _FAR_MS else (last - start), escalated, best[2] if best else None)], columns=[f.name for f in _SUMMARY])

    def close(self) -> None:
        pass


_SUMMARY = [
    T.StructField("_key", T.StringType()), T.StructField("kept", T.LongType()), T.StructField("score", T.StringType()),
    T.StructField("micros", T.LongType()), T.StructField("escalated", T.BooleanType()), T.StructField("intent", T.StringType()),
]


def summaries(triaged: DataFrame, idle: str = "1 day") -> DataFrame:
    """The conversation summary after every micro-batch that brought a turn (update mode), columns as ``conversation.summary``.

    The intent of most kept turns counts, ties go to the one seen first by
    turn; the last row of a conversation is its summary.
    """
    require_rocksdb(triaged.sparkSession)
    lowest = F.lit(-_FAR_MS)
    rows = triaged.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_key"), F.coalesce(F.col("turn").cast("long"), lowest).alias("turn"), F.coalesce(F.unix_micros("ts"), lowest).alias("at"),
        F.coalesce("escalated", F.lit(False)).alias("escalated"), F.coalesce("intent", F.lit("")).alias("intent"), F.col("sentiment_score").cast("decimal(20,10)").cast("string").alias("score"),
    )
    how = _Summary(int(pd.Timedelta(idle).total_seconds() * 1000))
    out = rows.groupBy("_key").transformWithStateInPandas(statefulProcessor=how, outputStructType=T.StructType(_SUMMARY), outputMode="Update", timeMode="ProcessingTime")
    mean = F.round(F.col("score").cast("decimal(38,10)") / F.col("kept"), 2).cast("double")
    return out.select(
        F.when(F.col("_key") != "", F.col("_key").cast("long")).alias("conv_id"),
        (2 * F.col("kept")).alias("turn_count"),
        F.when(F.col("kept") == 0, F.lit(0.0)).otherwise(F.round(F.col("micros") / 6e7, 2)).alias("duration_minutes"),
        "escalated",
        F.coalesce(F.nullif("intent", F.lit("")), F.lit(conversation.UNKNOWN_INTENT)).alias("primary_intent"),
        F.when(F.col("kept") == 0, F.lit(conversation.DEFAULT_AVG_SENTIMENT)).otherwise(mean).alias("avg_sentiment"),
    )
