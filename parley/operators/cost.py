"""Model-call cost ledger."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.plans.windows import running_total

# Price in dollars per million tokens; agent names of the calls.
PRICE_INPUT_PER_M = 0.80
PRICE_OUTPUT_PER_M = 4.00
AGENT_INTENT = "intent_classifier"
AGENT_SENTIMENT = "sentiment_analyzer"
AGENT_REPLY = "support_agent"
NO_COSTS_TEXT = "No costs tracked"


# Money is exact: decimals add up to the same total in any order.
COST_TYPE = "decimal(38,12)"


def call_cost_expr(input_tokens: Column, output_tokens: Column, price_in: float = PRICE_INPUT_PER_M,
                   price_out: float = PRICE_OUTPUT_PER_M) -> Column:
    """Dollars of one call, as a decimal of 12 places."""

    def part(tokens: Column, price: float) -> Column:
        per_token = F.lit(Decimal(str(price)) / 1_000_000).cast("decimal(18,12)")
        return (tokens.cast("decimal(18,0)") * per_token).cast(COST_TYPE)

    return (part(input_tokens, price_in) + part(output_tokens, price_out)).cast(COST_TYPE)


def call_cost(calls: DataFrame) -> DataFrame:
    return calls.withColumn("total_cost", call_cost_expr(F.col("input_tokens"), F.col("output_tokens")))


def session_cost(calls: DataFrame, session_col: str = "session_id") -> DataFrame:
    """Total and call count per session, plus the summary line."""
    return (
        call_cost(calls)
        .groupBy(session_col)
        .agg(F.sum("total_cost").alias("total_cost"), F.count(F.lit(1)).alias("calls"))
        .withColumn(
            "summary",
            F.when(F.col("calls") == 0, F.lit(NO_COSTS_TEXT)).otherwise(
                F.format_string("Session Costs: $%.4f, Total calls: %d", F.col("total_cost").cast("double"), F.col("calls"))
            ),
        )
    )


def running_session_cost(calls: DataFrame, session_col: str = "session_id", seq_col: str = "seq",
                         agent: str = AGENT_REPLY, chunk: int = 1 << 16) -> DataFrame:
    """Cost shown on each reply: cumulative cost of the reply tracker only."""
    replies = call_cost(calls.filter(F.col("agent") == agent))
    return running_total(replies, [session_col], seq_col, F.col("total_cost"), "session_cost", chunk=chunk)


def displayed_cost(calls: DataFrame, session_col: str = "session_id", seq_col: str = "seq",
                   agent: str = AGENT_REPLY) -> DataFrame:
    """What the page shows (running sums added up again) beside the true total."""
    r = running_session_cost(calls, session_col, seq_col, agent)
    return r.groupBy(session_col).agg(
        F.sum("session_cost").alias("displayed_cost"), F.sum("total_cost").alias("true_cost")
    )
