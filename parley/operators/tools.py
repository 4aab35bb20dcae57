"""Tool registry and dispatch.

A tool is a ``DataFrame -> DataFrame`` callable; the registry maps the
strategy's ``next_step`` to the tool that serves it. ``dispatch`` splits
triaged rows by next step (one filter per tool over the same plan), so each
tool receives only its rows; every tool that is run evaluates the triage.
``dispatch_once`` evaluates it once: rows are written by next step, and each
tool reads its own folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import rules
from parley.streaming import sinks

Tool = Callable[..., DataFrame]


class ToolRegistry:
    def __init__(self) -> None:
        self._tools: dict[str, Tool] = {}

    def register(self, step: str, tool: Tool) -> None:
        self._tools[step] = tool

    def register_tools(self, tools: dict[str, Tool]) -> None:
        """Replace the registry with ``tools`` (step → callable)."""
        self._tools = dict(tools)

    def get(self, step: str) -> Tool | None:
        return self._tools.get(step)

    def names(self) -> list[str]:
        return sorted(self._tools)


def with_next_step(triaged: DataFrame) -> DataFrame:
    return triaged.withColumn("next_step", rules.intent_next_step(F.col("intent"), F.col("sentiment_score")))


def dispatch(triaged: DataFrame, registry: ToolRegistry) -> dict[str, DataFrame]:
    """Rows per registered step (non-escalated turns only: escalated turns
    already went to a human)."""
    staged = with_next_step(triaged).filter(~F.col("escalated"))
    return {step: staged.filter(F.col("next_step") == step) for step in registry.names()}


def dispatch_once(triaged: DataFrame, registry: ToolRegistry, path: str, batch_id: int = 0) -> dict[str, DataFrame]:
    """Each registered tool's result over its rows, from one evaluation of ``triaged``.

    The non-escalated rows are written under ``path`` as batch ``batch_id``,
    partitioned by ``next_step``; running a batch again replaces it. A tool is
    called with the rows of its step (all triage columns) and reads nothing else.
    """
    spark = triaged.sparkSession
    staged = with_next_step(triaged).filter(~F.col("escalated")).withColumn("step", F.col("next_step"))
    sinks.write_batch(staged, batch_id, path, ["step"])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in staged.schema.fields])
    rows = spark.read.schema(schema).parquet(f"{path}/{sinks.BATCH}={int(batch_id)}")
    return {step: registry.get(step)(rows.filter(F.col("step") == step).drop("step")) for step in registry.names()}
