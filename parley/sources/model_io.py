"""Model I/O as tables.

Model calls leave the job as request rows (one JSON document per call, ready
for a batch inference service) and come back as response tables; both sides
are plain DataFrame projections, so exporting and ingesting scale with the
message table and never pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.rules import INTENTS

# Request envelope and per-stage settings.
API_VERSION = "bedrock-2023-05-31"
INTENT_MAX_TOKENS, INTENT_TEMPERATURE = 200, 0.0
SENTIMENT_MAX_TOKENS, SENTIMENT_TEMPERATURE = 200, 0.0
REPLY_MAX_TOKENS, REPLY_TEMPERATURE = 500, 0.7
DEFAULT_STOP_REASON = "end_turn"
INSTRUCTION_SEPARATOR = "\n\n---\n\n# SUPPORT AGENT SPECIALIZED INSTRUCTIONS\n\n"

# Classifier prompts.
INTENT_SYSTEM_PROMPT = (
    "You are an intent classification system for customer support.\n\n"
    f"Available intents: {', '.join(INTENTS)}\n\n"
    "Examples:\n\n"
    'Message: "Where is my order #12345?"\nIntent: order_status\nConfidence: 0.95\nReasoning: Customer asking about order location\n\n'
    'Message: "I want a refund!"\nIntent: refund_request\nConfidence: 0.98\nReasoning: Explicit refund request\n\n'
    'Message: "Does this come in blue?"\nIntent: product_question\nConfidence: 0.90\nReasoning: Question about product features\n\n'
    'Message: "How long does shipping take?"\nIntent: shipping_question\nConfidence: 0.95\nReasoning: Question about shipping timeframe\n\n'
    'Message: "I can\'t log in"\nIntent: account_help\nConfidence: 0.92\nReasoning: Account access issue\n\n'
    'Message: "Your service is terrible!"\nIntent: complaint\nConfidence: 0.88\nReasoning: Expressing dissatisfaction\n\n'
    'Respond ONLY with JSON:\n{\n  "intent": "...",\n  "confidence": 0.XX,\n  "reasoning": "..."\n}'
)
INTENT_USER_PREFIX = "Classify this message:\n\n"

SENTIMENT_SYSTEM_PROMPT = (
    "You are a sentiment analysis system for customer support.\n\n"
    "Analyze the emotional tone of customer messages.\n\n"
    "Sentiment scale:\n"
    "- very_positive (0.8-1.0): Happy, grateful, satisfied\n"
    "- positive (0.6-0.8): Pleased, content\n"
    "- neutral (0.4-0.6): Matter-of-fact, informational\n"
    "- negative (0.2-0.4): Frustrated, disappointed\n"
    "- very_negative (0.0-0.2): Angry, upset, threatening\n\n"
    "Examples:\n\n"
    'Message: "Thank you so much for the help!"\nSentiment: very_positive\nScore: 0.95\n\n'
    'Message: "Where is my order?"\nSentiment: neutral\nScore: 0.5\n\n'
    'Message: "This is getting frustrating"\nSentiment: negative\nScore: 0.3\n\n'
    'Message: "Worst service ever! I\'m done!"\nSentiment: very_negative\nScore: 0.1\n\n'
    'Respond ONLY with JSON:\n{\n  "sentiment": "...",\n  "score": 0.XX\n}'
)
SENTIMENT_USER_PREFIX = "Analyze sentiment:\n\n"

# Reply prompt template pieces.
REPLY_TASK = (
    "## Your Task\n"
    "Write a direct response to the customer. Output ONLY the message that will be sent to the customer - "
    "nothing else. No reasoning, no strategy notes, no bullet points, no meta-commentary, no \"Key "
    "considerations\", no explanations of your approach. Just the customer-facing message.\n"
)

RESPONSE_SCHEMA = T.StructType(
    [
        T.StructField("content", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]))),
        T.StructField("usage", T.StructType([T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType())])),
        T.StructField("stop_reason", T.StringType()),
    ]
)


def request_json(user_text: Column, system: Column | None, max_tokens: int, temperature: float) -> Column:
    """Request document; ``system`` is left out when null or empty."""
    msgs = F.array(F.struct(F.lit("user").alias("role"), user_text.alias("content")))
    sys_col = F.when(F.length(system) > 0, system) if system is not None else F.lit(None).cast("string")
    return F.to_json(
        F.struct(
            F.lit(API_VERSION).alias("anthropic_version"),
            F.lit(max_tokens).alias("max_tokens"),
            F.lit(float(temperature)).alias("temperature"),
            msgs.alias("messages"),
            sys_col.alias("system"),
        )
    )


def intent_requests(msgs: DataFrame, text_col: str = "redacted_message") -> DataFrame:
    user = F.concat(F.lit(INTENT_USER_PREFIX), F.col(text_col))
    return msgs.select(
        "message_id", request_json(user, F.lit(INTENT_SYSTEM_PROMPT), INTENT_MAX_TOKENS, INTENT_TEMPERATURE).alias("request")
    )


def sentiment_requests(msgs: DataFrame, text_col: str = "redacted_message") -> DataFrame:
    user = F.concat(F.lit(SENTIMENT_USER_PREFIX), F.col(text_col))
    return msgs.select(
        "message_id",
        request_json(user, F.lit(SENTIMENT_SYSTEM_PROMPT), SENTIMENT_MAX_TOKENS, SENTIMENT_TEMPERATURE).alias("request"),
    )


def reply_prompt(message: Column, intent: Column, score: Column, context: Column) -> Column:
    return F.concat(
        F.lit("## Current Message\n"), message,
        F.lit("\n\n## Context\n- Intent: "), intent,
        F.lit("\n- Sentiment: "), F.format_string("%.2f", score),
        F.lit("\n\n"), context,
        F.lit("\n\n"), F.lit(REPLY_TASK),
    )


def combined_instructions(base: Column, specialised: Column) -> Column:
    return F.concat(base, F.lit(INSTRUCTION_SEPARATOR), specialised)


def system_prompt(instructions: DataFrame) -> Column:
    """The one row of ``instructions`` (column ``system``) as a value beside any table."""
    return instructions.select("system").scalar()


def reply_requests(turns: DataFrame, instructions: Column | None = None) -> DataFrame:
    """Reply request per non-escalated turn; ``turns`` carries
    redacted_message, intent, sentiment_score and context; ``instructions`` is
    the system prompt (``system_prompt``)."""
    prompt = reply_prompt(F.col("redacted_message"), F.col("intent"), F.col("sentiment_score"), F.col("context"))
    return turns.select(
        "message_id",
        prompt.alias("prompt"),
        request_json(prompt, instructions, REPLY_MAX_TOKENS, REPLY_TEMPERATURE).alias("request"),
    )


def parse_responses(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """Response body → content text, token usage, stop reason."""
    r = F.from_json(F.col(body_col), RESPONSE_SCHEMA)
    return bodies.select(
        "message_id",
        F.try_element_at(r["content"], F.lit(1))["text"].alias("content"),
        r["usage"]["input_tokens"].alias("input_tokens"),
        r["usage"]["output_tokens"].alias("output_tokens"),
        F.coalesce(r["stop_reason"], F.lit(DEFAULT_STOP_REASON)).alias("stop_reason"),
    )


def load_instructions(spark: SparkSession, directory: str, base: str = "base_instructions.md",
                      specialised: str = "support_agent_instructions.md") -> DataFrame:
    """One-row DataFrame with the combined system prompt; a missing file fails
    the read (as a missing instruction file must)."""
    d = directory.rstrip("/")
    files = spark.read.text([f"{d}/{base}", f"{d}/{specialised}"], wholetext=True)
    name = F.col("_metadata.file_name")
    return files.agg(
        combined_instructions(
            F.max(F.when(name == base, F.col("value"))), F.max(F.when(name == specialised, F.col("value")))
        ).alias("system")
    )
