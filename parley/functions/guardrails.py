"""Reply guardrails as Column expressions, and the two-pass resolution."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions import pii

# Word lists, phrase lists and texts of the checks.
UNPROFESSIONAL_WORDS = ["crap", "sucks", "dumb", "stupid", "idiot"]
OVERPROMISE_PHRASES = ["definitely will", "guaranteed to", "100% certain", "absolutely will", "promise you", "within minutes"]
EMPATHY_PHRASES = ["understand", "sorry", "apologize", "frustrating", "appreciate", "help you"]
HUMAN_WORDS = ["agent", "representative", "specialist"]
DELIVERY_PROMISE = r"\b(tomorrow|today|by \w+day)\b"

ISSUE_PII_PREFIX = "PII detected in response: "
ISSUE_UNPROFESSIONAL = "Unprofessional language detected"
ISSUE_OVERPROMISE = "Response overpromises"
ISSUE_EMPATHY = "Response not empathetic for angry customer"
ISSUE_REFUND = "Refund requests must mention human agent"
ISSUE_DELIVERY = "Specific delivery promises need verification"
SUGGEST_PII = "Remove PII from response"
SUGGEST_UNPROFESSIONAL = "Use professional language"
SUGGEST_OVERPROMISE = "Be realistic about what we can do"
SUGGEST_EMPATHY = "Show more empathy and understanding"

FALLBACK_REPLY = (
    "I apologize, but I'm having trouble processing your request. Let me connect you with a "
    "specialist who can help you better. Please hold for a moment."
)
ESCALATION_REPLY = (
    "I understand this is important to you. Let me connect you with one of our specialists who "
    "can help you right away. Please hold for just a moment."
)

DEFAULT_SCORE = 0.5
DEFAULT_INTENT = ""


def _any_contains(lower_text: Column, phrases: list[str]) -> Column:
    out = None
    for p in phrases:
        c = lower_text.contains(p)
        out = c if out is None else (out | c)
    return out


def unprofessional(text: Column) -> Column:
    return F.lower(text).rlike(r"\b(" + "|".join(UNPROFESSIONAL_WORDS) + r")\b")


def overpromises(text: Column) -> Column:
    return _any_contains(F.lower(text), OVERPROMISE_PHRASES)


def shows_empathy(text: Column) -> Column:
    return _any_contains(F.lower(text), EMPATHY_PHRASES)


def refund_policy_issue(text: Column, intent: Column) -> Column:
    low = F.lower(text)
    return (intent == "refund_request") & low.contains("refund") & ~_any_contains(low, HUMAN_WORDS)


def delivery_policy_issue(text: Column, intent: Column) -> Column:
    return F.lower(text).rlike("(?i)" + DELIVERY_PROMISE) & (intent == "order_status")


def pii_issue_text(types: Column) -> Column:
    """Issue text with the detected types as a list literal (sorted)."""
    return F.concat(F.lit(ISSUE_PII_PREFIX + "['"), F.array_join(types, "', '"), F.lit("']"))


def _flags(text: Column, low: Column, entities: Column, score: Column, intent: Column) -> dict[str, Column]:
    score = F.coalesce(score, F.lit(DEFAULT_SCORE))
    intent = F.coalesce(intent, F.lit(DEFAULT_INTENT))
    return {
        "has_pii": F.size(entities) > 0,
        "g2": low.rlike(r"\b(" + "|".join(UNPROFESSIONAL_WORDS) + r")\b"),
        "g3": _any_contains(low, OVERPROMISE_PHRASES),
        "g4": (score < 0.3) & ~_any_contains(low, EMPATHY_PHRASES),
        "g5": (intent == "refund_request") & low.contains("refund") & ~_any_contains(low, HUMAN_WORDS),
        "g6": low.rlike("(?i)" + DELIVERY_PROMISE) & (intent == "order_status"),
    }


#: Fields of the guardrail struct.
RESULT_FIELDS = ["safe", "issues", "suggestions", "modified_response", "pii_types"]


def _result(text: Column, entities: Column, f: dict[str, Column]) -> dict[str, Column]:
    types = pii.entity_types(entities)
    issues = F.filter(
        F.array(
            F.when(f["has_pii"], pii_issue_text(types)),
            F.when(f["g2"], F.lit(ISSUE_UNPROFESSIONAL)),
            F.when(f["g3"], F.lit(ISSUE_OVERPROMISE)),
            F.when(f["g4"], F.lit(ISSUE_EMPATHY)),
            F.when(f["g5"], F.lit(ISSUE_REFUND)),
            F.when(f["g6"], F.lit(ISSUE_DELIVERY)),
        ),
        lambda x: x.isNotNull(),
    )
    suggestions = F.filter(
        F.array(
            F.when(f["has_pii"], F.lit(SUGGEST_PII)),
            F.when(f["g2"], F.lit(SUGGEST_UNPROFESSIONAL)),
            F.when(f["g3"], F.lit(SUGGEST_OVERPROMISE)),
            F.when(f["g4"], F.lit(SUGGEST_EMPATHY)),
        ),
        lambda x: x.isNotNull(),
    )
    safe = ~(f["has_pii"] | f["g2"] | f["g3"] | f["g4"] | f["g5"] | f["g6"])
    modified = F.when(f["has_pii"], pii.redact_with(text, entities)).otherwise(text)
    return dict(zip(RESULT_FIELDS, [safe, issues, suggestions, modified, types])) | {"has_pii": f["has_pii"]}


def with_guardrails(df, reply_col: str, score_col: str, intent_col: str, out: str = "guard"):
    """Add the first-pass guardrail struct; entities are projected once."""
    checked = _with_checks(df, reply_col, score_col, intent_col, "_gr_out_")
    guard = F.struct(*(F.col(f"_gr_out_{k}").alias(k) for k in RESULT_FIELDS))
    return checked.withColumn(out, guard).drop("_gr_out_has_pii", *(f"_gr_out_{k}" for k in RESULT_FIELDS))


def _with_checks(df, reply_col: str, score_col: str, intent_col: str, prefix: str):
    """Add each field of the guardrail struct, and ``has_pii``, as a column of
    its own: those that nobody reads are not computed, a struct's are."""
    # inputs go through fixed scratch names so one set of built expressions
    # serves every call (building them costs thousands of Py4J calls)
    low, flag_cols, results = _guard_columns(score_col is not None, intent_col is not None)
    staged = df.withColumn("_gr_text", F.col(reply_col))
    if score_col is not None:
        staged = staged.withColumn("_gr_score", F.col(score_col))
    if intent_col is not None:
        staged = staged.withColumn("_gr_intent", F.col(intent_col))
    staged = pii.with_entities(staged, "_gr_text", "_gr_entities").withColumn("_gr_low", low)
    staged = staged.withColumns(flag_cols)
    return staged.withColumns({prefix + k: c for k, c in results.items()}).drop(
        "_gr_text", "_gr_score", "_gr_intent", "_gr_entities", "_gr_low", *flag_cols
    )


@lru_cache(maxsize=8)
def _guard_columns(has_score: bool, has_intent: bool) -> tuple:
    """Guardrail expressions over the scratch columns, built once."""
    text = F.col("_gr_text")
    score = _col_or_lit("_gr_score" if has_score else None, DEFAULT_SCORE)
    intent = _col_or_lit("_gr_intent" if has_intent else None, DEFAULT_INTENT)
    flags = _flags(text, F.col("_gr_low"), F.col("_gr_entities"), score, intent)
    names = {k: f"_gr_{k}" for k in flags}
    result = _result(text, F.col("_gr_entities"), {k: F.col(v) for k, v in names.items()})
    return F.lower(text), {names[k]: c for k, c in flags.items()}, result


def _col_or_lit(name: str | None, default) -> Column:
    return F.col(name) if name is not None else F.lit(default)


def with_resolution(df, reply_col: str, score_col: str, intent_col: str):
    """Two-pass resolution of a reply (null reply → fallback text first).

    Adds ``final_response``, ``safe`` (always true after resolution),
    ``guardrail_outcome`` in (pass, redacted, waived, fallback) and
    ``first_pass_issues``. Pass 2 re-checks the modified reply with default
    context, so sentiment and policy findings of pass 1 do not carry over.
    """
    reply = F.coalesce(F.col(reply_col), F.lit(FALLBACK_REPLY))
    staged = _with_checks(df.withColumn("_reply", reply), "_reply", score_col, intent_col, "_g1_")
    # pass 2 only matters for rows that failed pass 1; others scan an empty text
    staged = staged.withColumn("_scan2", F.when(F.col("_g1_safe"), F.lit("")).otherwise(F.col("_g1_modified_response")))
    staged = _with_checks(staged, "_scan2", None, None, "_g2_").drop("_scan2")
    safe1, safe2 = F.col("_g1_safe"), F.col("_g2_safe")
    outcome = F.when(safe1, "pass").when(safe2 & F.col("_g1_has_pii"), "redacted").when(safe2, "waived").otherwise("fallback")
    final = F.when(safe1, F.col("_reply")).when(safe2, F.col("_g1_modified_response")).otherwise(F.lit(FALLBACK_REPLY))
    return (
        staged.withColumn("guardrail_outcome", outcome)
        .withColumn("final_response", final)
        .withColumn("safe", F.lit(True))
        .withColumn("first_pass_issues", F.col("_g1_issues"))
        .drop("_reply", *(f"_g{n}_{k}" for n in (1, 2) for k in [*RESULT_FIELDS, "has_pii"]))
    )
