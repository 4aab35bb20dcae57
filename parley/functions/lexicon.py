"""Keyword scorers that stand in for the two classifiers where no model is at hand.

A message gets the first label whose pattern its lower-cased text holds.
``scored`` gives the table that the triage joins, so a job runs end to end
without model replies; it follows the classifiers' examples, not the models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values (ours): keyword lexicon standing in for the classifier offline,
# in priority order (first match wins); the weight is the lexicon score.
INTENT_LEXICON = [
    ("refund_request", r"\b(refund|money back|return)\b", 3),
    ("complaint", r"\b(worst|terrible|awful|charged twice)\b", 3),
    ("order_status", r"\b(where|track|tracking|late)\b", 2),
    ("account_help", r"\b(login|log in|password|account|ssn)\b", 2),
    ("shipping_question", r"\b(ship|shipping|delivery|parcel)\b", 2),
    ("technical_issue", r"\b(crash|crashing|error|bug|failed)\b", 2),
    ("product_question", r"\b(come in|colou?r|size|blue|red)\b", 1),
]
SENTIMENT_LEXICON = [
    ("very_negative", r"\b(worst|terrible|awful|done)\b", 0.1),
    ("negative", r"\b(frustrat\w*|late|twice|failed|annoy\w*)\b", 0.3),
    ("very_positive", r"\b(thank|thanks|great|love)\b", 0.95),
]
INTENT_LEXICON_DEFAULT = ("general_inquiry", 0)
SENTIMENT_LEXICON_DEFAULT = ("neutral", 0.5)


def label(text: Column, lexicon: list[tuple], default: tuple) -> Column:
    low = F.lower(text)
    name, score = F.lit(default[0]), F.lit(default[1])
    for own, pattern, weight in reversed(lexicon):
        name = F.when(low.rlike(pattern), F.lit(own)).otherwise(name)
        score = F.when(low.rlike(pattern), F.lit(weight)).otherwise(score)
    return F.struct(name.alias("label"), score.alias("score"))


def scored(messages: DataFrame, text_col: str = "content") -> DataFrame:
    """message_id, intent, confidence, sentiment and score of every message; a null text gets the defaults."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    both = messages.select("message_id", label(text, INTENT_LEXICON, INTENT_LEXICON_DEFAULT).alias("i"), label(text, SENTIMENT_LEXICON, SENTIMENT_LEXICON_DEFAULT).alias("s"))
    top = float(max(w for _, _, w in INTENT_LEXICON))
    return both.select("message_id", F.col("i.label").alias("intent"), (F.col("i.score") / top).cast("double").alias("confidence"), F.col("s.label").alias("sentiment"), F.col("s.score").cast("double").alias("score"))
