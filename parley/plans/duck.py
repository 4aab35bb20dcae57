"""DuckDB SQL fragments for the oracle queries.

These are independent re-statements of the operator semantics in DuckDB's
dialect (list lambdas, RE2 regexes), used only to cross-check the Spark plans.
RE2 has no lookahead, so ORDER_ID uses a relaxed pattern plus a length filter
on the alphanumeric part, which selects the same spans.
"""

from __future__ import annotations

from parley.functions import guardrails as G
from parley.functions import pii

DUCK_ORDER_ID = r"\b(?:order|tracking)[\s#:]*[A-Z]*[0-9][A-Z0-9]*\b"
DUCK_ORDER_ID_PART = r"(?i)^(?:order|tracking)[\s#:]*([A-Z0-9]+)$"
ENT_T = "STRUCT(s INTEGER, e INTEGER, type VARCHAR, value VARCHAR, conf DOUBLE)"
EMPTY_ENTS = f"CAST([] AS {ENT_T}[])"
UNPROF_RE = r"\b(" + "|".join(G.UNPROFESSIONAL_WORDS) + r")\b"
PII_ISSUE_HEAD = G.ISSUE_PII_PREFIX + "['"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def matches(t: str, etype: str, pattern: str, conf: float = pii.REGEX_CONFIDENCE, post: str | None = None) -> str:
    p = q("(?i)" + pattern)
    m = f"regexp_extract_all({t}, {p})"
    g = f"string_split_regex({t}, {p})"
    before = f"length(array_to_string({g}[1:li], '')) + length(array_to_string({m}[1:li-1], ''))"
    e = (
        f"list_transform({m}, lambda lx, li: {{'s': CAST({before} AS INTEGER), "
        f"'e': CAST({before} + length(lx) AS INTEGER), 'type': {q(etype)}, 'value': lx, 'conf': {conf}}})"
    )
    if post:
        e = f"list_filter({e}, lambda ly: {post})"
    return e


def type_matches(t: str, etype: str) -> str:
    if etype == "ORDER_ID":
        return matches(
            t, etype, DUCK_ORDER_ID,
            post=f"length(regexp_extract(ly.value, {q(DUCK_ORDER_ID_PART)}, 1)) BETWEEN 6 AND 15",
        )
    return matches(t, etype, pii.PATTERN_BY_TYPE[etype])


def candidates(t: str) -> str:
    return "list_concat(" + ", ".join(type_matches(t, et) for et, _ in pii.PII_PATTERNS) + ")"


def resolve(cands: str) -> str:
    """Greedy keep-if-no-overlap in list order, then sort by start."""
    return (
        f"list_sort(list_reduce({cands}, lambda lacc, lx: CASE WHEN len(list_filter(lacc, lambda lz: lx.s < lz.e AND lx.e > lz.s)) > 0 "
        f"THEN lacc ELSE list_append(lacc, lx) END, {EMPTY_ENTS}))"
    )


def entities(t: str) -> str:
    return resolve(candidates(t))


def redact(t: str, ents: str, style: str = "type") -> str:
    ph = "'[' || lx.type || ']'" if style == "type" else q(pii.GENERIC_PLACEHOLDER)
    st = (
        f"list_reduce({ents}, lambda lacc, lx: {{'out': lacc.out || substr({t}, lacc.pos + 1, lx.s - lacc.pos) || {ph}, 'pos': lx.e}}, "
        f"{{'out': '', 'pos': 0}})"
    )
    return f"(CASE WHEN {t} IS NULL THEN NULL ELSE {st}.out || substr({t}, {st}.pos + 1) END)"


def types_of(ents: str) -> str:
    return f"list_sort(list_distinct(list_transform({ents}, lambda lx: lx.type)))"


def spark_round(x: str, d: int) -> str:
    """Spark's round: HALF_UP on the shortest decimal form of the double."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18)), {d}) AS DOUBLE)"


def spark_bround(x: str, d: int) -> str:
    return f"CAST(round_even(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18)), {d}) AS DOUBLE)"


def fmt_fixed(x: str, d: int) -> str:
    """Java's %.nf: HALF_UP of the shortest decimal form."""
    return f"printf('%.{d}f', {spark_round(x, d)})"


def any_contains(lower_t: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({lower_t}, {q(p)})" for p in phrases) + ")"


def guard_parts(t: str, ents: str, score: str, intent: str) -> dict[str, str]:
    lt = f"lower({t})"
    has_pii = f"(len({ents}) > 0)"
    g2 = f"regexp_matches({lt}, {q(UNPROF_RE)})"
    g3 = any_contains(lt, G.OVERPROMISE_PHRASES)
    g4 = f"({score} < 0.3 AND NOT {any_contains(lt, G.EMPATHY_PHRASES)})"
    g5 = f"({intent} = 'refund_request' AND contains({lt}, 'refund') AND NOT {any_contains(lt, G.HUMAN_WORDS)})"
    g6 = f"(regexp_matches({lt}, {q('(?i)' + G.DELIVERY_PROMISE)}) AND {intent} = 'order_status')"
    pii_issue = q(PII_ISSUE_HEAD) + f" || array_to_string({types_of(ents)}, ''', ''') || ''']'"
    issues = (
        f"list_filter([CASE WHEN {has_pii} THEN {pii_issue} END, CASE WHEN {g2} THEN {q(G.ISSUE_UNPROFESSIONAL)} END, "
        f"CASE WHEN {g3} THEN {q(G.ISSUE_OVERPROMISE)} END, CASE WHEN {g4} THEN {q(G.ISSUE_EMPATHY)} END, "
        f"CASE WHEN {g5} THEN {q(G.ISSUE_REFUND)} END, CASE WHEN {g6} THEN {q(G.ISSUE_DELIVERY)} END], lambda lz: lz IS NOT NULL)"
    )
    suggestions = (
        f"list_filter([CASE WHEN {has_pii} THEN {q(G.SUGGEST_PII)} END, CASE WHEN {g2} THEN {q(G.SUGGEST_UNPROFESSIONAL)} END, "
        f"CASE WHEN {g3} THEN {q(G.SUGGEST_OVERPROMISE)} END, CASE WHEN {g4} THEN {q(G.SUGGEST_EMPATHY)} END], lambda lz: lz IS NOT NULL)"
    )
    return {
        "has_pii": has_pii, "g2": g2, "g3": g3, "g4": g4, "g5": g5, "g6": g6,
        "issues": issues, "suggestions": suggestions,
        "modified": f"(CASE WHEN {has_pii} THEN {redact(t, ents)} ELSE {t} END)",
    }


def resolution_ctes(src: str, reply: str, score: str, intent: str, prefix: str) -> tuple[str, str]:
    """CTEs resolving ``reply`` of relation ``src`` in two passes; returns
    (cte text, name of the last CTE) adding final_response, guardrail_outcome,
    first_pass_issues."""
    p = prefix
    r = f"coalesce({reply}, {q(G.FALLBACK_REPLY)})"
    g1 = guard_parts("_reply", "_e1", score, intent)
    g2 = guard_parts("_text2", "_e2", "0.5", "''")
    ctes = f"""
{p}a AS (SELECT *, {r} AS _reply FROM {src}),
{p}b AS (SELECT *, {entities('_reply')} AS _e1 FROM {p}a),
{p}c AS (SELECT *, len({g1['issues']}) = 0 AS _safe1, {g1['issues']} AS first_pass_issues, {g1['modified']} AS _text2, {g1['has_pii']} AS _had_pii FROM {p}b),
{p}d AS (SELECT *, CASE WHEN _safe1 THEN {EMPTY_ENTS} ELSE {entities('_text2')} END AS _e2 FROM {p}c),
{p}e AS (SELECT *, len({g2['issues']}) = 0 AS _safe2 FROM {p}d),
{p}f AS (SELECT *,
  CASE WHEN _safe1 THEN 'pass' WHEN _safe2 AND _had_pii THEN 'redacted' WHEN _safe2 THEN 'waived' ELSE 'fallback' END AS guardrail_outcome,
  CASE WHEN _safe1 THEN _reply WHEN _safe2 THEN _text2 ELSE {q(G.FALLBACK_REPLY)} END AS final_response
  FROM {p}e)"""
    return ctes, f"{p}f"


def triage_ctes(scored: str = "v_scored") -> str:
    """CTEs ending in ``triaged`` (same columns as the Spark triage)."""
    res, last = resolution_ctes("t_rin", "_reply_in", "score", "intent", "t_g")
    cost = "(CAST(input_tokens AS DOUBLE) / 1000000.0) * 0.8 + (CAST(output_tokens AS DOUBLE) / 1000000.0) * 4.0"
    return f"""
t_m AS (SELECT message_id, conv_id, turn, ts, content, {entities('content')} AS _me FROM v_messages),
t_r AS (SELECT message_id, conv_id, turn, ts, {redact('content', '_me')} AS redacted_message, len(_me) > 0 AS pii_in_message FROM t_m),
t_s AS (SELECT t_r.*, coalesce(sc.intent, 'general_inquiry') AS intent,
  CASE WHEN sc.intent IS NULL THEN 0.0 ELSE sc.confidence END AS confidence, coalesce(sc.score, 0.5) AS score,
  coalesce(sc.sentiment, 'neutral') AS model_label
  FROM t_r LEFT JOIN {scored} sc USING (message_id)),
t_e AS (SELECT *, coalesce(score < 0.3, false) OR coalesce(score < 0.5 AND intent IN ('refund_request', 'complaint'), false) AS escalated FROM t_s),
t_rp AS (SELECT t_e.*, rr.reply, u.input_tokens, u.output_tokens FROM t_e
  LEFT JOIN v_replies rr USING (message_id) LEFT JOIN v_reply_usage u USING (message_id)),
t_rin AS (SELECT *, CASE WHEN escalated THEN '' ELSE reply END AS _reply_in FROM t_rp),{res},
t_c AS (SELECT *, sum(CASE WHEN NOT escalated AND reply IS NOT NULL THEN {cost} ELSE 0.0 END)
  OVER (PARTITION BY conv_id ORDER BY turn, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _session_cost FROM {last}),
t_o AS (SELECT message_id, conv_id, turn, ts, redacted_message,
  CASE WHEN escalated THEN {q(G.ESCALATION_REPLY)} ELSE final_response END AS response,
  intent, CASE WHEN escalated THEN 1.0 ELSE confidence END AS intent_confidence,
  CASE WHEN escalated THEN 'negative' ELSE model_label END AS sentiment,
  score AS sentiment_score, escalated, (NOT escalated AND pii_in_message) AS pii_detected, pii_in_message,
  true AS safe, CASE WHEN escalated THEN 0.0 ELSE _session_cost END AS cost,
  CASE WHEN escalated THEN 'escalated' ELSE guardrail_outcome END AS guardrail_outcome FROM t_c),
triaged AS (SELECT *, review_reason IS NOT NULL AS needs_human_review FROM (SELECT *,
  CASE WHEN escalated THEN 'escalated' WHEN intent IN ('refund_request', 'complaint') THEN 'risky_intent'
    WHEN sentiment_score < 0.4 THEN 'negative_sentiment' WHEN NOT safe THEN 'unsafe'
    WHEN intent NOT IN ('greeting', 'general_inquiry', 'order_status', 'shipping_question', 'product_question')
      AND intent_confidence < 0.7 THEN 'low_confidence' END AS review_reason FROM t_o) x)"""
