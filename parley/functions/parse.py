"""Parsing of classifier replies (JSON text, possibly fenced) into typed fields.

Semantics: strip surrounding whitespace; when the text starts with a code
fence, keep the part between the first two fences and drop a leading ``json``
tag; parse it as JSON. The result must be an object. A missing field takes
its default, a field present with JSON ``null`` stays null for text fields and
is an error for numeric fields, a numeric field must convert to a double
(numeric strings convert). Any error gives the error row.

Built on Spark's variant type: ``try_parse_json`` tells malformed text from a
missing key, which ``from_json`` with a schema cannot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"


@dataclass(frozen=True)
class ReplyField:
    name: str
    kind: str  # "string" or "double"
    default: object


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def unfence(text: Column) -> Column:
    s = strip_ws(text)
    inner = F.try_element_at(F.split(s, FENCE, -1), F.lit(2))
    inner = F.when(inner.startswith("json"), F.substring(inner, 5, 2147483647)).otherwise(inner)
    return F.when(s.startswith(FENCE), inner).otherwise(s)


def parse_reply(text: Column, fields: list[ReplyField], error_values: dict) -> Column:
    """Struct of the fields plus ``parse_ok``; non-null ``text`` only is
    meaningful (a null reply is a failed call, handled by the caller)."""
    body = unfence(text)
    v = F.try_parse_json(body)
    # an object document ends with its closing brace: rejects trailing text,
    # which the variant parser would otherwise ignore
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT") & strip_ws(body).endswith("}"), F.lit(False))
    ok = is_object
    values = {}
    for f in fields:
        raw = F.variant_get(v, f"$.{f.name}", "variant")
        missing = raw.isNull()
        if f.kind == "double":
            num = F.try_variant_get(v, f"$.{f.name}", "double")
            values[f.name] = F.when(missing, F.lit(float(f.default))).otherwise(num)
            ok = ok & (missing | num.isNotNull())
        else:
            values[f.name] = F.when(missing, F.lit(f.default)).otherwise(F.try_variant_get(v, f"$.{f.name}", "string"))
    cols = []
    for f in fields:
        err = F.lit(error_values[f.name])
        if f.kind == "double":
            err = err.cast("double")
        cols.append(F.when(ok, values[f.name]).otherwise(err).alias(f.name))
    return F.struct(*cols, ok.alias("parse_ok"))


# Defaults, error rows and failure rows of the two classifiers.
INTENT_FIELDS = [
    ReplyField("intent", "string", "general_inquiry"),
    ReplyField("confidence", "double", 0.5),
    ReplyField("reasoning", "string", ""),
]
INTENT_ERROR = {"intent": "general_inquiry", "confidence": 0.5, "reasoning": "Parse error"}
INTENT_FAILED = {"intent": "general_inquiry", "confidence": 0.0}
INTENT_FAILED_PREFIX = "Classification failed: "

SENTIMENT_FIELDS = [
    ReplyField("sentiment", "string", "neutral"),
    ReplyField("score", "double", 0.5),
]
SENTIMENT_ERROR = {"sentiment": "neutral", "score": 0.5}
SENTIMENT_FAILED = {"sentiment": "neutral", "score": 0.5}


def parse_intent(text: Column) -> Column:
    return parse_reply(text, INTENT_FIELDS, INTENT_ERROR)


def parse_sentiment(text: Column) -> Column:
    return parse_reply(text, SENTIMENT_FIELDS, SENTIMENT_ERROR)


def intent_result(raw: Column, error: Column | None = None) -> Column:
    """Parsed intent, or the failure row when the call returned nothing."""
    p = parse_intent(raw)
    err = F.coalesce(error, F.lit("no response")) if error is not None else F.lit("no response")
    failed = raw.isNull() | (error.isNotNull() if error is not None else F.lit(False))
    return F.when(
        failed,
        F.struct(
            F.lit(INTENT_FAILED["intent"]).alias("intent"),
            F.lit(INTENT_FAILED["confidence"]).alias("confidence"),
            F.concat(F.lit(INTENT_FAILED_PREFIX), err).alias("reasoning"),
            F.lit(False).alias("parse_ok"),
        ),
    ).otherwise(p)


def sentiment_result(raw: Column) -> Column:
    p = parse_sentiment(raw)
    return F.when(
        raw.isNull(),
        F.struct(
            F.lit(SENTIMENT_FAILED["sentiment"]).alias("sentiment"),
            F.lit(SENTIMENT_FAILED["score"]).alias("score"),
            F.lit(False).alias("parse_ok"),
        ),
    ).otherwise(p)


def reply_source(raw: Column, parsed: Column) -> Column:
    return F.when(raw.isNull(), "call_failed").when(parsed["parse_ok"], "model").otherwise("parse_error")
