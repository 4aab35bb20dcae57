"""Registered queries: one Spark plan per operator over the fixture views,
and, for each, an independent DuckDB statement of the same result.

Every query reads whole tables (through the views of
``parley.sources.fixtures``). Outputs are flat scalar columns; floating
aggregates are rounded (12 decimals, 9 for window averages) so both engines
agree bit-for-bit on the compared values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import guardrails as G
from parley.functions import lexicon, parse, pii, rules
from parley.operators import conversation as conv
from parley.operators import cost as cost_ops
from parley.operators import kb, kb_index, monitor, orders, tickets, tools
from parley.operators import triage as tri
from parley.plans import duck as D
from parley.sources import fixtures as fx
from parley.sources import kb_files
from parley.sources import model_io as mio
from parley.session import shared_folder, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def V(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return fx.view(spark, sf, name)


def VS(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """View read for CPU-heavy text work: spread over the cores when the
    files give fewer splits than there are cores."""
    return spread(fx.view(spark, sf, name))


def TS(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(fx.load_table(spark, sf, name))


def W(*views: str) -> str:
    return fx.duckdb_ctes(list(views))


def r12(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 12)


def r9(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


def big(c: str) -> Column:
    return F.col(c).cast("bigint").alias(c)


def ts_str(c: str, alias: str | None = None) -> Column:
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss").alias(alias or c)


DTS = "strftime({}, '%Y-%m-%d %H:%M:%S')"

# ---------------------------------------------------------------- PII

_PER_TYPE = {
    "pii_email": "EMAIL",
    "pii_phone": "PHONE",
    "pii_ssn": "SSN",
    "pii_credit_card": "CREDIT_CARD",
    "pii_ip": "IP_ADDRESS",
    "pii_order_id": "ORDER_ID",
    "pii_zip": "ZIP_CODE",
}


def _explode_entities(df: DataFrame, keys: list[str], ents: Column, no: str, extra: bool = False) -> DataFrame:
    cols = [
        *keys,
        F.col("_no").cast("bigint").alias(no),
        F.col("_e.type").alias("type"),
        F.col("_e.value").alias("value"),
        F.col("_e.start").cast("bigint").alias("start_pos"),
        F.col("_e.end").cast("bigint").alias("end_pos"),
    ]
    if extra:
        cols.append(F.col("_e.confidence").alias("confidence"))
    # (an inner explode would be given a filter that repeats the whole scan of a text, once more for every use of it)
    return df.select(*keys, F.posexplode_outer(ents).alias("_no", "_e")).where(F.col("_no").isNotNull()).select(*cols)


def _duck_explode(src: str, keys: str, ents_expr: str, no: str, extra: bool = False) -> str:
    conf = ", e.conf AS confidence" if extra else ""
    return f"""SELECT {keys}, CAST(n AS BIGINT) AS {no}, e.type AS type, e.value AS value,
  CAST(e.s AS BIGINT) AS start_pos, CAST(e.e AS BIGINT) AS end_pos{conf}
FROM (SELECT {keys}, unnest(range(len(ents))) AS n, unnest(ents) AS e FROM (SELECT {keys}, {ents_expr} AS ents FROM {src}) a) b"""


def _make_type_query(key: str, etype: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        c = pii.with_entities(VS(spark, sf, "v_pii_corpus"), "text", types=[etype], candidates=True)
        return _explode_entities(c, ["src", "id"], F.col("entities"), "match_no")

    register(key, W("v_pii_corpus") + "\n" + _duck_explode("v_pii_corpus", "src, id", D.type_matches("text", etype), "match_no"))(run)


for _k, _t in _PER_TYPE.items():
    _make_type_query(_k, _t)


@register("pii_entities", W("v_pii_corpus") + "\n" + _duck_explode("v_pii_corpus", "src, id", D.candidates("text"), "cand_no"))
def q_pii_entities(spark, sf):
    c = pii.with_entities(VS(spark, sf, "v_pii_corpus"), "text", candidates=True)
    return _explode_entities(c, ["src", "id"], F.col("entities"), "cand_no")


@register("pii_dedup", W("v_pii_corpus") + "\n" + _duck_explode("v_pii_corpus", "src, id", D.entities("text"), "ent_no"))
def q_pii_dedup(spark, sf):
    c = pii.with_pii(VS(spark, sf, "v_pii_corpus"), "text")
    return _explode_entities(c, ["src", "id"], F.col("entities"), "ent_no")


@register(
    "pii_redact",
    W("v_pii_corpus")
    + f""", x AS (SELECT src, id, text, {D.entities('text')} AS ents FROM v_pii_corpus)
SELECT src, id, {D.redact('text', 'ents')} AS redacted, CAST(len(ents) AS BIGINT) AS entity_count FROM x""",
)
def q_pii_redact(spark, sf):
    c = pii.with_pii(VS(spark, sf, "v_pii_corpus"), "text")
    return c.select("src", "id", "redacted", F.col("pii.entity_count").cast("bigint").alias("entity_count"))


@register(
    "pii_redact_generic",
    W("v_pii_corpus")
    + f""", x AS (SELECT src, id, text, {D.entities('text')} AS ents FROM v_pii_corpus)
SELECT src, id, {D.redact('text', 'ents', 'generic')} AS redacted FROM x""",
)
def q_pii_redact_generic(spark, sf):
    c = pii.with_entities(VS(spark, sf, "v_pii_corpus"), "text", "_e")
    return c.select("src", "id", pii.redact_with(F.col("text"), F.col("_e"), style="generic").alias("redacted"))


@register(
    "pii_metadata",
    W("v_pii_corpus")
    + f""", x AS (SELECT src, id, {D.entities('text')} AS ents FROM v_pii_corpus)
SELECT src, id, len(ents) > 0 AS pii_detected, CAST(len(ents) AS BIGINT) AS entity_count,
  array_to_string({D.types_of('ents')}, ',') AS entity_types,
  array_to_string(list_transform(ents, lambda e: e.type || ':' || CAST(e.conf AS VARCHAR) || ':' || CAST(e.s AS VARCHAR) || '-' || CAST(e.e AS VARCHAR)), ';') AS positions
FROM x""",
)
def q_pii_metadata(spark, sf):
    c = pii.with_pii(VS(spark, sf, "v_pii_corpus"), "text")
    m = F.col("pii")
    pos = F.transform(
        m["entities"],
        lambda e: F.concat_ws(
            "",
            e["type"], F.lit(":"), e["confidence"].cast("string"), F.lit(":"),
            e["position"]["start"].cast("string"), F.lit("-"), e["position"]["end"].cast("string"),
        ),
    )
    return c.select(
        "src",
        "id",
        m["pii_detected"].alias("pii_detected"),
        m["entity_count"].cast("bigint").alias("entity_count"),
        F.array_join(m["entity_types"], ",").alias("entity_types"),
        F.array_join(pos, ";").alias("positions"),
    )


_EXT_SQL = (
    W("v_name_messages", "v_name_annotations")
    + f""", ann AS (SELECT message_id, list({{'s': start_pos, 'e': end_pos, 'type': 'NAME_' || label, 'value': value, 'conf': {pii.NAME_CONFIDENCE}}}
    ORDER BY start_pos, end_pos) AS ext FROM v_name_annotations WHERE label IN ('PERSON', 'ORG') GROUP BY message_id),
x AS (SELECT m.message_id, {D.resolve("list_concat(" + D.candidates("m.content") + ", coalesce(ann.ext, " + D.EMPTY_ENTS + "))")} AS ents
  FROM v_name_messages m LEFT JOIN ann USING (message_id))
"""
    + _duck_explode("x", "message_id", "ents", "ent_no", extra=True)
)


@register("pii_external_entities", _EXT_SQL)
def q_pii_external(spark, sf):
    msgs = VS(spark, sf, "v_name_messages")
    ann = V(spark, sf, "v_name_annotations").filter(F.col("label").isin(*pii.NAME_LABELS))
    ext = ann.groupBy("message_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("start_pos").alias("start"),
                    F.col("end_pos").alias("end"),
                    F.concat(F.lit("NAME_"), F.col("label")).alias("type"),
                    F.col("value"),
                    F.lit(pii.NAME_CONFIDENCE).alias("confidence"),
                )
            ),
            lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"]),
        ).alias("ext")
    )
    j = msgs.join(ext, "message_id", "left")
    out = pii.with_pii(j, "content", external_col="ext")
    return _explode_entities(out, ["message_id"], F.col("entities"), "ent_no", extra=True)


# ---------------------------------------------------------------- intent

_INTENT_LIST = ", ".join(D.q(i) for i in rules.INTENTS)


@register("intent_known", W("v_scored") + f"\nSELECT message_id, intent, intent IN ({_INTENT_LIST}) AS is_known FROM v_scored")
def q_intent_known(spark, sf):
    s = V(spark, sf, "v_scored")
    return s.select("message_id", "intent", F.col("intent").isin(*rules.INTENTS).alias("is_known"))


def _duck_request(user: str, system: str | None, max_tokens: int, temperature: float) -> str:
    sys_part = f", 'system': {system}" if system is not None else ""
    return (
        f"to_json({{'anthropic_version': {D.q(mio.API_VERSION)}, 'max_tokens': {max_tokens}, "
        f"'temperature': {float(temperature)}, 'messages': [{{'role': 'user', 'content': {user}}}]{sys_part}}})"
    )


_REDACTED_MSGS_SQL = (
    f"rm AS (SELECT message_id, conv_id, turn, content, {D.entities('content')} AS _e FROM v_messages), "
    f"rmsg AS (SELECT message_id, conv_id, turn, {D.redact('content', '_e')} AS redacted_message FROM rm)"
)


def _redacted_messages(spark, sf) -> DataFrame:
    return tri.redact_messages(V(spark, sf, "v_messages")).select("message_id", "conv_id", "turn", "redacted_message")


@register(
    "intent_request",
    W("v_messages") + ", " + _REDACTED_MSGS_SQL + "\nSELECT message_id, "
    + _duck_request(f"{D.q(mio.INTENT_USER_PREFIX)} || redacted_message", D.q(mio.INTENT_SYSTEM_PROMPT), mio.INTENT_MAX_TOKENS, mio.INTENT_TEMPERATURE)
    + " AS request FROM rmsg",
)
def q_intent_request(spark, sf):
    return mio.intent_requests(_redacted_messages(spark, sf))


def _duck_parse(raw: str, fields: list[parse.ReplyField], errors: dict) -> dict[str, str]:
    """DuckDB statement of the reply parse; returns field expressions + ok."""
    s = f"regexp_replace({raw}, '^\\s+|\\s+$', '', 'g')"
    inner = f"split_part({s}, '```', 2)"
    inner = f"(CASE WHEN starts_with({inner}, 'json') THEN substr({inner}, 5) ELSE {inner} END)"
    body = f"(CASE WHEN starts_with({s}, '```') THEN {inner} ELSE {s} END)"
    sb = f"regexp_replace({body}, '^\\s+|\\s+$', '', 'g')"
    vb = f"(CASE WHEN json_valid({body}) THEN {body} END)"
    is_obj = f"coalesce(json_type({vb}) = 'OBJECT' AND ends_with({sb}, '}}'), false)"
    ok = is_obj
    vals = {}
    for f in fields:
        path = f"'$.{f.name}'"
        missing = f"(json_type(CASE WHEN {is_obj} THEN {body} END, {path}) IS NULL)"
        if f.kind == "double":
            num = f"TRY_CAST(json_extract_string(CASE WHEN {is_obj} THEN {body} END, {path}) AS DOUBLE)"
            vals[f.name] = f"(CASE WHEN {missing} THEN {float(f.default)} ELSE {num} END)"
            ok = f"({ok} AND ({missing} OR {num} IS NOT NULL))"
        else:
            vals[f.name] = f"(CASE WHEN {missing} THEN {D.q(f.default)} ELSE json_extract_string(CASE WHEN {is_obj} THEN {body} END, {path}) END)"
    out = {}
    for f in fields:
        err = errors[f.name]
        err_sql = str(float(err)) if f.kind == "double" else D.q(err)
        out[f.name] = f"(CASE WHEN {ok} THEN {vals[f.name]} ELSE {err_sql} END)"
    out["parse_ok"] = ok
    return out


_IP = _duck_parse("raw_response", parse.INTENT_FIELDS, parse.INTENT_ERROR)
_SP = _duck_parse("raw_response", parse.SENTIMENT_FIELDS, parse.SENTIMENT_ERROR)


@register(
    "intent_parse",
    W("v_raw_responses")
    + f"\nSELECT message_id, {_IP['intent']} AS intent, {_IP['confidence']} AS confidence, {_IP['reasoning']} AS reasoning, "
    f"{_IP['parse_ok']} AS parse_ok FROM v_raw_responses WHERE raw_response IS NOT NULL",
)
def q_intent_parse(spark, sf):
    r = VS(spark, sf, "v_raw_responses").filter(F.col("raw_response").isNotNull())
    return r.select("message_id", parse.parse_intent(F.col("raw_response")).alias("p")).select(
        "message_id", "p.intent", "p.confidence", "p.reasoning", "p.parse_ok"
    )


_INTENT_FALLBACK_SQL = (
    W("v_raw_responses")
    + f"""
SELECT message_id,
  CASE WHEN raw_response IS NULL THEN {D.q(parse.INTENT_FAILED['intent'])} ELSE {_IP['intent']} END AS intent,
  CASE WHEN raw_response IS NULL THEN {float(parse.INTENT_FAILED['confidence'])} ELSE {_IP['confidence']} END AS confidence,
  CASE WHEN raw_response IS NULL THEN {D.q(parse.INTENT_FAILED_PREFIX + 'no response')} ELSE {_IP['reasoning']} END AS reasoning,
  CASE WHEN raw_response IS NULL THEN 'call_failed' WHEN {_IP['parse_ok']} THEN 'model' ELSE 'parse_error' END AS source
FROM v_raw_responses"""
)


@register("intent_fallback", _INTENT_FALLBACK_SQL)
def q_intent_fallback(spark, sf):
    r = VS(spark, sf, "v_raw_responses")
    p = parse.intent_result(F.col("raw_response"))
    return r.select("message_id", "raw_response", p.alias("p")).select(
        "message_id", "p.intent", "p.confidence", "p.reasoning",
        parse.reply_source(F.col("raw_response"), F.col("p")).alias("source"),
    )


@register(
    "intent_attach",
    W("v_messages", "v_raw_responses")
    + f""", j AS (SELECT m.message_id, m.conv_id, r.raw_response FROM v_messages m LEFT JOIN v_raw_responses r USING (message_id))
SELECT message_id, conv_id,
  CASE WHEN raw_response IS NULL THEN {D.q(parse.INTENT_FAILED['intent'])} ELSE {_IP['intent']} END AS intent,
  CASE WHEN raw_response IS NULL THEN {float(parse.INTENT_FAILED['confidence'])} ELSE {_IP['confidence']} END AS confidence
FROM j""",
)
def q_intent_attach(spark, sf):
    m = V(spark, sf, "v_messages").select("message_id", "conv_id")
    r = VS(spark, sf, "v_raw_responses")
    j = m.join(r, "message_id", "left")
    p = parse.intent_result(F.col("raw_response"))
    return j.select("message_id", "conv_id", p["intent"].alias("intent"), p["confidence"].alias("confidence"))


def _duck_lexicon(text: str, words, default) -> tuple[str, str]:
    lab = "CASE " + " ".join(f"WHEN regexp_matches(lower({text}), {D.q(p)}) THEN {D.q(n)}" for n, p, _ in words) + f" ELSE {D.q(default[0])} END"
    sc = "CASE " + " ".join(f"WHEN regexp_matches(lower({text}), {D.q(p)}) THEN {w}" for _, p, w in words) + f" ELSE {default[1]} END"
    return lab, sc


_IL = _duck_lexicon("content", lexicon.INTENT_LEXICON, lexicon.INTENT_LEXICON_DEFAULT)
_SL = _duck_lexicon("content", lexicon.SENTIMENT_LEXICON, lexicon.SENTIMENT_LEXICON_DEFAULT)


@register("intent_lexicon", W("v_messages") + f"\nSELECT message_id, {_IL[0]} AS intent, CAST({_IL[1]} AS BIGINT) AS lexicon_score FROM v_messages")
def q_intent_lexicon(spark, sf):
    m = V(spark, sf, "v_messages")
    r = lexicon.label(F.col("content"), lexicon.INTENT_LEXICON, lexicon.INTENT_LEXICON_DEFAULT)
    return m.select("message_id", r["label"].alias("intent"), r["score"].cast("bigint").alias("lexicon_score"))


@register("sentiment_lexicon", W("v_messages") + f"\nSELECT message_id, {_SL[0]} AS sentiment, CAST({_SL[1]} AS DOUBLE) AS score FROM v_messages")
def q_sentiment_lexicon(spark, sf):
    m = V(spark, sf, "v_messages")
    r = lexicon.label(F.col("content"), lexicon.SENTIMENT_LEXICON, lexicon.SENTIMENT_LEXICON_DEFAULT)
    return m.select("message_id", r["label"].alias("sentiment"), r["score"].cast("double").alias("score"))


# ---------------------------------------------------------------- sentiment

@register(
    "sentiment_request",
    W("v_messages") + ", " + _REDACTED_MSGS_SQL + "\nSELECT message_id, "
    + _duck_request(f"{D.q(mio.SENTIMENT_USER_PREFIX)} || redacted_message", D.q(mio.SENTIMENT_SYSTEM_PROMPT), mio.SENTIMENT_MAX_TOKENS, mio.SENTIMENT_TEMPERATURE)
    + " AS request FROM rmsg",
)
def q_sentiment_request(spark, sf):
    return mio.sentiment_requests(_redacted_messages(spark, sf))


@register(
    "sentiment_parse",
    W("v_raw_sentiment")
    + f"\nSELECT message_id, {_SP['sentiment']} AS sentiment, {_SP['score']} AS score, {_SP['parse_ok']} AS parse_ok "
    "FROM v_raw_sentiment WHERE raw_response IS NOT NULL",
)
def q_sentiment_parse(spark, sf):
    r = VS(spark, sf, "v_raw_sentiment").filter(F.col("raw_response").isNotNull())
    return r.select("message_id", parse.parse_sentiment(F.col("raw_response")).alias("p")).select(
        "message_id", "p.sentiment", "p.score", "p.parse_ok"
    )


@register(
    "sentiment_fallback",
    W("v_raw_sentiment")
    + f"""
SELECT message_id,
  CASE WHEN raw_response IS NULL THEN 'neutral' ELSE {_SP['sentiment']} END AS sentiment,
  CASE WHEN raw_response IS NULL THEN 0.5 ELSE {_SP['score']} END AS score,
  CASE WHEN raw_response IS NULL THEN 'call_failed' WHEN {_SP['parse_ok']} THEN 'model' ELSE 'parse_error' END AS source
FROM v_raw_sentiment""",
)
def q_sentiment_fallback(spark, sf):
    r = VS(spark, sf, "v_raw_sentiment")
    p = parse.sentiment_result(F.col("raw_response"))
    return r.select("message_id", "raw_response", p.alias("p")).select(
        "message_id", "p.sentiment", "p.score", parse.reply_source(F.col("raw_response"), F.col("p")).alias("source")
    )


_ESC_SQL = "(coalesce({s} < 0.3, false) OR coalesce({s} < 0.5 AND {i} IN ('refund_request', 'complaint'), false))"


@register(
    "sentiment_attach",
    W("v_messages", "v_raw_sentiment", "v_scored")
    + f""", j AS (SELECT m.message_id, m.conv_id, r.raw_response, sc.intent FROM v_messages m
  LEFT JOIN v_raw_sentiment r USING (message_id) LEFT JOIN v_scored sc USING (message_id)),
k AS (SELECT message_id, conv_id, intent,
  CASE WHEN raw_response IS NULL THEN 'neutral' ELSE {_SP['sentiment']} END AS sentiment,
  CASE WHEN raw_response IS NULL THEN 0.5 ELSE {_SP['score']} END AS score FROM j)
SELECT message_id, conv_id, sentiment, score, {_ESC_SQL.format(s='score', i='intent')} AS should_escalate FROM k""",
)
def q_sentiment_attach(spark, sf):
    m = V(spark, sf, "v_messages").select("message_id", "conv_id")
    r = VS(spark, sf, "v_raw_sentiment")
    s = V(spark, sf, "v_scored").select("message_id", "intent")
    j = m.join(r, "message_id", "left").join(s, "message_id", "left")
    p = parse.sentiment_result(F.col("raw_response"))
    j = j.select("message_id", "conv_id", "intent", p["sentiment"].alias("sentiment"), p["score"].alias("score"))
    return j.select(
        "message_id", "conv_id", "sentiment", "score", rules.should_escalate(F.col("score"), F.col("intent")).alias("should_escalate")
    )


@register("should_escalate", W("v_scored") + f"\nSELECT message_id, {_ESC_SQL.format(s='score', i='intent')} AS should_escalate FROM v_scored")
def q_should_escalate(spark, sf):
    s = V(spark, sf, "v_scored")
    return s.select("message_id", rules.should_escalate(F.col("score"), F.col("intent")).alias("should_escalate"))


@register(
    "escalation_reasons",
    W("v_scored")
    + f"""
SELECT message_id, array_to_string(list_filter([
  CASE WHEN score < 0.3 THEN {D.q(rules.REASON_VERY_NEGATIVE)} END,
  CASE WHEN score < 0.5 AND intent = 'refund_request' THEN {D.q(rules.REASON_REFUND)} END,
  CASE WHEN intent = 'complaint' AND score < 0.5 THEN {D.q(rules.REASON_COMPLAINT)} END], lambda x: x IS NOT NULL), '; ') AS reasons
FROM v_scored""",
)
def q_escalation_reasons(spark, sf):
    s = V(spark, sf, "v_scored")
    return s.select("message_id", F.array_join(rules.escalation_reasons(F.col("score"), F.col("intent")), "; ").alias("reasons"))


_BAND_SQL = (
    "CASE WHEN {s} >= 0.8 THEN 'very_positive' WHEN {s} >= 0.6 THEN 'positive' WHEN {s} >= 0.4 THEN 'neutral' "
    "WHEN {s} >= 0.2 THEN 'negative' ELSE 'very_negative' END"
)


@register(
    "sentiment_band",
    W("v_raw_sentiment")
    + f""", p AS (SELECT message_id, {_SP['sentiment']} AS sentiment, {_SP['score']} AS score FROM v_raw_sentiment WHERE raw_response IS NOT NULL)
SELECT message_id, {_BAND_SQL.format(s='score')} AS band, sentiment <> ({_BAND_SQL.format(s='score')}) AS band_mismatch FROM p""",
)
def q_sentiment_band(spark, sf):
    r = VS(spark, sf, "v_raw_sentiment").filter(F.col("raw_response").isNotNull())
    p = r.select("message_id", parse.parse_sentiment(F.col("raw_response")).alias("p"))
    band = rules.sentiment_band(F.col("p.score"))
    return p.select("message_id", band.alias("band"), (F.col("p.sentiment") != band).alias("band_mismatch"))


@register(
    "tone_tier",
    W("v_scored") + "\nSELECT message_id, CASE WHEN score > 0.4 THEN 'friendly' WHEN score >= 0.2 THEN 'frustrated' ELSE 'angry' END AS tone FROM v_scored",
)
def q_tone_tier(spark, sf):
    s = V(spark, sf, "v_scored")
    return s.select("message_id", rules.tone_tier(F.col("score")).alias("tone"))


# ---------------------------------------------------------------- guardrails

_RS = (
    W("v_replies", "v_scored")
    + ", rs AS (SELECT r.message_id, r.reply, s.score, s.intent FROM v_replies r JOIN v_scored s USING (message_id) WHERE r.reply IS NOT NULL)"
)


def _replies_scored(spark, sf) -> DataFrame:
    r = VS(spark, sf, "v_replies").filter(F.col("reply").isNotNull())
    s = V(spark, sf, "v_scored").select("message_id", "score", "intent")
    return r.join(s, "message_id")


_GP = D.guard_parts("reply", "_e", "score", "intent")
_RS_E = _RS + f", rse AS (SELECT *, {D.entities('reply')} AS _e FROM rs)"


@register(
    "guard_pii",
    _RS_E + f"\nSELECT message_id, {_GP['has_pii']} AS pii_in_reply, array_to_string({D.types_of('_e')}, ',') AS pii_types, {_GP['modified']} AS modified_response FROM rse",
)
def q_guard_pii(spark, sf):
    g = G.with_guardrails(_replies_scored(spark, sf), "reply", "score", "intent")
    return g.select(
        "message_id",
        (F.size("guard.pii_types") > 0).alias("pii_in_reply"),
        F.array_join("guard.pii_types", ",").alias("pii_types"),
        F.col("guard.modified_response").alias("modified_response"),
    )


@register(
    "guard_unprofessional",
    W("v_replies")
    + f"""
SELECT 'reply' AS src, message_id AS id, regexp_matches(lower(reply), {D.q(D.UNPROF_RE)}) AS unprofessional FROM v_replies WHERE reply IS NOT NULL
UNION ALL SELECT 'document', doc_id, regexp_matches(lower(text), {D.q(D.UNPROF_RE)}) FROM documents""",
)
def q_guard_unprofessional(spark, sf):
    r = VS(spark, sf, "v_replies").filter(F.col("reply").isNotNull())
    d = TS(spark, sf, "documents")
    return r.select(F.lit("reply").alias("src"), F.col("message_id").alias("id"), G.unprofessional(F.col("reply")).alias("unprofessional")).unionByName(
        d.select(F.lit("document").alias("src"), F.col("doc_id").alias("id"), G.unprofessional(F.col("text")).alias("unprofessional"))
    )


def _simple_guard(key: str, sql_expr: str, col_fn, name: str) -> None:
    def run(spark, sf):
        rs = _replies_scored(spark, sf)
        return rs.select("message_id", col_fn(F.col("reply"), F.col("score"), F.col("intent")).alias(name))

    register(key, _RS + f"\nSELECT message_id, {sql_expr} AS {name} FROM rs")(run)


_simple_guard("guard_overpromise", _GP["g3"], lambda t, s, i: G.overpromises(t), "overpromises")
_simple_guard("guard_empathy", _GP["g4"], lambda t, s, i: (s < 0.3) & ~G.shows_empathy(t), "empathy_issue")
_simple_guard("guard_refund_policy", _GP["g5"], lambda t, s, i: G.refund_policy_issue(t, i), "refund_issue")
_simple_guard("guard_delivery_policy", _GP["g6"], lambda t, s, i: G.delivery_policy_issue(t, i), "delivery_issue")


@register(
    "guardrails",
    _RS_E
    + f"""
SELECT message_id, len({_GP['issues']}) = 0 AS safe, array_to_string({_GP['issues']}, ' | ') AS issues,
  array_to_string({_GP['suggestions']}, ' | ') AS suggestions, {_GP['modified']} AS modified_response FROM rse""",
)
def q_guardrails(spark, sf):
    g = G.with_guardrails(_replies_scored(spark, sf), "reply", "score", "intent")
    return g.select(
        "message_id",
        F.col("guard.safe").alias("safe"),
        F.array_join("guard.issues", " | ").alias("issues"),
        F.array_join("guard.suggestions", " | ").alias("suggestions"),
        F.col("guard.modified_response").alias("modified_response"),
    )


_RES_CTES, _RES_LAST = D.resolution_ctes("rsa", "reply", "score", "intent", "gr")


@register(
    "guardrail_resolve",
    W("v_replies", "v_scored")
    + f""", rsa AS (SELECT r.message_id, r.reply, s.score, s.intent FROM v_replies r JOIN v_scored s USING (message_id)),{_RES_CTES}
SELECT message_id, final_response, guardrail_outcome, CAST(len(first_pass_issues) AS BIGINT) AS first_pass_issue_count FROM {_RES_LAST}""",
)
def q_guardrail_resolve(spark, sf):
    r = VS(spark, sf, "v_replies")
    s = V(spark, sf, "v_scored").select("message_id", "score", "intent")
    out = G.with_resolution(r.join(s, "message_id"), "reply", "score", "intent")
    return out.select(
        "message_id", "final_response", "guardrail_outcome", F.size("first_pass_issues").cast("bigint").alias("first_pass_issue_count")
    )


@register("reply_fallback", W("v_replies") + f"\nSELECT message_id, coalesce(reply, {D.q(G.FALLBACK_REPLY)}) AS reply FROM v_replies")
def q_reply_fallback(spark, sf):
    r = VS(spark, sf, "v_replies")
    return r.select("message_id", F.coalesce(F.col("reply"), F.lit(G.FALLBACK_REPLY)).alias("reply"))


# ---------------------------------------------------------------- triage (A1-A10)

_TRIAGE = W("v_messages", "v_scored", "v_replies", "v_reply_usage") + "," + D.triage_ctes()


def triaged(spark, sf) -> DataFrame:
    return tri.triage(
        V(spark, sf, "v_messages"), V(spark, sf, "v_scored"), V(spark, sf, "v_replies"), V(spark, sf, "v_reply_usage")
    )


_TRIAGE_COLS_SQL = (
    "message_id, conv_id, turn, " + DTS.format("ts") + " AS ts, redacted_message, response, intent, intent_confidence, sentiment, "
    "sentiment_score, escalated, pii_detected, pii_in_message, safe, " + D.spark_round("cost", 12) + " AS cost, "
    "needs_human_review, review_reason, guardrail_outcome"
)


def _triage_cols(t: DataFrame) -> DataFrame:
    return t.select(
        "message_id", "conv_id", "turn", ts_str("ts"), "redacted_message", "response", "intent", "intent_confidence", "sentiment",
        "sentiment_score", "escalated", "pii_detected", "pii_in_message", "safe", r12("cost").alias("cost"),
        "needs_human_review", "review_reason", "guardrail_outcome",
    )


@register("triage", _TRIAGE + f"\nSELECT {_TRIAGE_COLS_SQL} FROM triaged")
def q_triage(spark, sf):
    return _triage_cols(triaged(spark, sf))


_RAW_SCORED = f"""ri AS (SELECT message_id,
    CASE WHEN raw_response IS NULL THEN {D.q(parse.INTENT_FAILED['intent'])} ELSE {_IP['intent']} END AS intent,
    CASE WHEN raw_response IS NULL THEN {float(parse.INTENT_FAILED['confidence'])} ELSE {_IP['confidence']} END AS confidence FROM v_raw_responses),
rn AS (SELECT message_id, CASE WHEN raw_response IS NULL THEN 'neutral' ELSE {_SP['sentiment']} END AS sentiment,
    CASE WHEN raw_response IS NULL THEN 0.5 ELSE {_SP['score']} END AS score FROM v_raw_sentiment),
raw_scored AS (SELECT * FROM ri JOIN rn USING (message_id)),"""


@register(
    "triage_from_raw",
    W("v_messages", "v_raw_responses", "v_raw_sentiment", "v_replies", "v_reply_usage") + ",\n" + _RAW_SCORED + D.triage_ctes("raw_scored")
    + f"\nSELECT {_TRIAGE_COLS_SQL} FROM triaged",
)
def q_triage_from_raw(spark, sf):
    names = ["v_messages", "v_raw_responses", "v_raw_sentiment", "v_replies", "v_reply_usage"]
    return _triage_cols(tri.triage_from_raw(*(V(spark, sf, n) for n in names)))


@register(
    "escalation_short_circuit",
    _TRIAGE + "\nSELECT message_id, response, intent, intent_confidence, sentiment, sentiment_score, pii_detected, pii_in_message, safe, cost "
    "FROM triaged WHERE escalated",
)
def q_escalation_short_circuit(spark, sf):
    t = triaged(spark, sf).filter(F.col("escalated"))
    return t.select(
        "message_id", "response", "intent", "intent_confidence", "sentiment", "sentiment_score", "pii_detected", "pii_in_message", "safe", "cost"
    )


@register("needs_review", _TRIAGE + "\nSELECT message_id, needs_human_review AS needs_review, review_reason FROM triaged")
def q_needs_review(spark, sf):
    return triaged(spark, sf).select("message_id", F.col("needs_human_review").alias("needs_review"), "review_reason")


@register(
    "route_counts",
    _TRIAGE + "\nSELECT CASE WHEN needs_human_review THEN 'pending_review' ELSE 'auto_sent' END AS route, count(*) AS n FROM triaged GROUP BY 1",
)
def q_route_counts(spark, sf):
    return tri.route_counts(triaged(spark, sf))


_STRATEGY_SQL = (
    "CASE WHEN intent = 'complaint' AND score < 0.2 THEN 'escalate' "
    + " ".join(f"WHEN intent = {D.q(k)} THEN {D.q(v)}" for k, v in rules.INTENT_STRATEGY.items())
    + f" ELSE {D.q(rules.DEFAULT_STRATEGY)} END"
)


@register("intent_strategy", W("v_scored") + f"\nSELECT message_id, intent, {_STRATEGY_SQL} AS next_step FROM v_scored")
def q_intent_strategy(spark, sf):
    s = V(spark, sf, "v_scored")
    return s.select("message_id", "intent", rules.intent_next_step(F.col("intent"), F.col("score")).alias("next_step"))


@register("tool_dispatch", _TRIAGE + f"\nSELECT message_id, next_step AS tool, intent FROM (SELECT message_id, intent, {_STRATEGY_SQL} AS next_step FROM (SELECT message_id, intent, escalated, sentiment_score AS score FROM triaged) WHERE NOT escalated) WHERE next_step IS NOT NULL")
def q_tool_dispatch(spark, sf):
    """What each tool of the strategy is handed, from one evaluation of the triage."""
    registry = tools.ToolRegistry()
    registry.register_tools({s: lambda rows, s=s: rows.select("message_id", F.lit(s).alias("tool"), "intent") for s in rules.NEXT_STEPS})
    served = tools.dispatch_once(triaged(spark, sf), registry, shared_folder(spark, "dispatch"))
    return reduce(DataFrame.unionByName, served.values())


@register(
    "analysis_log",
    _TRIAGE + "\nSELECT message_id, conv_id, turn, intent, intent_confidence AS confidence, sentiment, sentiment_score AS score, "
    "pii_detected AS pii, safe, needs_human_review AS needs_review, " + DTS.format("ts") + " AS ts FROM triaged",
)
def q_analysis_log(spark, sf):
    return tri.analysis_log(triaged(spark, sf)).withColumn("ts", ts_str("ts"))


def _duck_title(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split(replace({x}, '_', ' '), ' '), "
        "lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
    )


@register(
    "analysis_log_recent",
    _TRIAGE
    + f""", lg AS (SELECT conv_id, turn, intent, intent_confidence AS confidence, needs_human_review AS needs_review,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM triaged)
SELECT conv_id, turn, CAST(recency AS INTEGER) AS recency, '#' || CAST(place AS VARCHAR) || ' ' || {_duck_title('intent')} AS label,
  {D.fmt_fixed('confidence * 100', 0)} || '%' AS confidence_pct,
  CASE WHEN needs_review THEN 'Human' ELSE 'Auto-sent' END AS review FROM lg WHERE recency <= 10""",
)
def q_analysis_log_recent(spark, sf):
    return conv.analysis_log_recent(tri.analysis_log(triaged(spark, sf)))


@register(
    "review_resolve",
    (_TRIAGE
    + f""", j AS (SELECT t.*, e.action, e.edited_text FROM triaged t JOIN v_review_events e USING (message_id)
  WHERE t.needs_human_review AND e.action <> 'reject')
SELECT message_id, conv_id, turn, action,
  CASE WHEN action = 'send' THEN response WHEN action = 'send_edited' THEN edited_text ELSE {D.q(rules.PRIORITY_MESSAGES['high'])} END AS sent_text,
  true AS human_reviewed, action = 'send_edited' AS edited, action = 'escalate' AS escalated_by_agent,
  CASE WHEN action = 'send' THEN pii_detected END AS pii_detected, CASE WHEN action = 'send' THEN safe END AS safe FROM j"""
    ).replace("WITH v_messages", "WITH v_review_events AS (" + fx.VIEWS["v_review_events"] + "), v_messages", 1),
)
def q_review_resolve(spark, sf):
    return tri.review_resolve(triaged(spark, sf), V(spark, sf, "v_review_events"))


def _with_review_events(sql: str) -> str:
    return sql.replace("WITH v_messages", "WITH v_review_events AS (" + fx.VIEWS["v_review_events"] + "), v_messages", 1)


@register(
    "session_stats",
    _with_review_events(
        _TRIAGE
        + """
SELECT t.conv_id, count(*) AS messages, count(*) FILTER (WHERE NOT t.needs_human_review) AS auto_sent,
  count(*) FILTER (WHERE t.needs_human_review AND e.action IN ('send', 'send_edited', 'escalate')) AS reviewed
FROM triaged t LEFT JOIN v_review_events e USING (message_id) GROUP BY t.conv_id"""
    ),
)
def q_session_stats(spark, sf):
    return conv.session_stats(triaged(spark, sf), V(spark, sf, "v_review_events"))


@register(
    "sentiment_badge",
    W("v_scored") + "\nSELECT message_id, CASE WHEN score > 0.6 THEN 'positive' WHEN score > 0.4 THEN 'neutral' ELSE 'negative' END AS badge FROM v_scored",
)
def q_sentiment_badge(spark, sf):
    s = V(spark, sf, "v_scored")
    return s.select("message_id", rules.sentiment_badge(F.col("score")).alias("badge"))


@register(
    "review_warning",
    _TRIAGE + "\nSELECT message_id, CASE WHEN escalated THEN 'error' WHEN sentiment_score < 0.4 THEN 'warning' END AS warning FROM triaged WHERE needs_human_review",
)
def q_review_warning(spark, sf):
    t = triaged(spark, sf).filter(F.col("needs_human_review"))
    return t.select("message_id", rules.review_warning(F.col("escalated"), F.col("sentiment_score")).alias("warning"))


# ---------------------------------------------------------------- conversation memory

_CM = W("v_conv_messages")


@register(
    "conv_running_turn",
    _CM + "\nSELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn_count FROM v_conv_messages",
)
def q_conv_running_turn(spark, sf):
    m = V(spark, sf, "v_conv_messages")
    return conv.running_turn_count(m).select("conv_id", "turn", "turn_count")


_MEM = (
    _TRIAGE
    + """, mem AS (SELECT conv_id, turn, 0 AS sub, 'customer' AS role, redacted_message AS content FROM triaged WHERE NOT escalated
  UNION ALL SELECT conv_id, turn, 1, 'agent', response FROM triaged WHERE NOT escalated)"""
)


def _memory(spark, sf) -> DataFrame:
    return conv.memory_entries(triaged(spark, sf))


@register(
    "conv_bounded_history",
    _MEM
    + f"""
SELECT conv_id, turn, CAST(sub AS INTEGER) AS sub, role, content, CAST(pos AS INTEGER) AS pos_from_end FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, sub DESC) AS pos FROM mem) x WHERE pos <= {conv.MAX_MESSAGES}""",
)
def q_conv_bounded_history(spark, sf):
    m = _memory(spark, sf)
    return conv.top_k(m, ["conv_id"], [F.col("turn").desc(), F.col("sub").desc()], conv.MAX_MESSAGES, "pos_from_end").select(
        "conv_id", "turn", "sub", "role", "content", "pos_from_end"
    )


@register(
    "conv_last_n",
    _CM
    + """
SELECT conv_id, turn, role, CAST(pos AS INTEGER) AS pos_from_end FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS pos FROM v_conv_messages) x WHERE pos <= 3""",
)
def q_conv_last_n(spark, sf):
    m = V(spark, sf, "v_conv_messages")
    return conv.last_n(m, 3).select("conv_id", "turn", "role", "pos_from_end")


_CTX_LINE = "'**' || CASE WHEN role = 'customer' THEN 'Customer' ELSE 'Agent' END || ':** ' || content || chr(10)"
_CTX_TEXT = (
    "CASE WHEN len(lines) = 0 THEN " + D.q(conv.NO_HISTORY) + " ELSE " + D.q(conv.HISTORY_HEADING)
    + " || chr(10) || array_to_string(lines, chr(10)) END"
)


@register(
    "conv_context",
    _CM
    + f""", h AS (SELECT conv_id, turn, role, content, {D.entities('content')} AS _e FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS pos FROM v_conv_messages) x WHERE pos <= {conv.MAX_MESSAGES}),
hr AS (SELECT conv_id, turn, role, {D.redact('content', '_e')} AS content FROM h),
g AS (SELECT conv_id, list({_CTX_LINE} ORDER BY turn) AS lines FROM hr GROUP BY conv_id)
SELECT conv_id, {_CTX_TEXT} AS context FROM g""",
)
def q_conv_context(spark, sf):
    return conv.conversation_context(VS(spark, sf, "v_conv_messages"))


@register(
    "reply_request",
    _MEM.replace("WITH v_messages", "WITH v_instructions AS (" + fx.VIEWS["v_instructions"] + "), v_messages", 1)
    + f""", ctx AS (SELECT conv_id, turn, sub, list({_CTX_LINE}) OVER (PARTITION BY conv_id ORDER BY turn, sub
    ROWS BETWEEN {conv.MAX_MESSAGES - 1} PRECEDING AND CURRENT ROW) AS lines FROM mem),
p AS (SELECT t.message_id, '## Current Message' || chr(10) || t.redacted_message || chr(10) || chr(10) || '## Context' || chr(10)
    || '- Intent: ' || t.intent || chr(10) || '- Sentiment: ' || {D.fmt_fixed('t.sentiment_score', 2)} || chr(10) || chr(10)
    || ({_CTX_TEXT}) || chr(10) || chr(10) || {D.q(mio.REPLY_TASK)} AS prompt
  FROM triaged t JOIN ctx c ON c.conv_id = t.conv_id AND c.turn = t.turn AND c.sub = 0 WHERE NOT t.escalated)
SELECT message_id, prompt, {_duck_request('prompt', "(SELECT base || " + D.q(mio.INSTRUCTION_SEPARATOR) + " || specialised FROM v_instructions)", mio.REPLY_MAX_TOKENS, mio.REPLY_TEMPERATURE)} AS request FROM p""",
)
def q_reply_request(spark, sf):
    carry = ["message_id", "redacted_message", "intent", "sentiment_score"]
    system = V(spark, sf, "v_instructions").select(mio.combined_instructions(F.col("base"), F.col("specialised")).alias("system"))
    # requests hold no costs
    rows = tri.triage(V(spark, sf, "v_messages"), V(spark, sf, "v_scored"), V(spark, sf, "v_replies"))
    return mio.reply_requests(conv.context_per_turn(rows, carry), mio.system_prompt(system))


@register(
    "conv_escalation_state",
    _TRIAGE
    + f"""
SELECT conv_id, true AS escalated, arg_max('Negative sentiment (' || {D.fmt_fixed('sentiment_score', 2)} || ')', turn) AS escalation_reason,
  max(turn) AS escalation_turn FROM triaged WHERE escalated GROUP BY conv_id""",
)
def q_conv_escalation_state(spark, sf):
    return conv.escalation_state(triaged(spark, sf))


_SUMMARY = (
    _TRIAGE
    + """, pi AS (SELECT conv_id, arg_max(intent, [n, -first_turn]) AS primary_intent FROM (
    SELECT conv_id, intent, count(*) AS n, min(turn) AS first_turn FROM triaged WHERE NOT escalated GROUP BY conv_id, intent) x GROUP BY conv_id),
ag AS (SELECT conv_id, CAST(2 * count(*) FILTER (WHERE NOT escalated) AS BIGINT) AS turn_count, min(ts) AS _start, max(ts) AS _last,
    count(*) FILTER (WHERE NOT escalated) AS _kept, bool_or(escalated) AS escalated,
    avg(CAST(sentiment_score AS DECIMAL(20,10))) FILTER (WHERE NOT escalated) AS _avg FROM triaged GROUP BY conv_id),
summ AS (SELECT ag.conv_id, turn_count,
    CASE WHEN _kept = 0 THEN 0.0 ELSE """
    + D.spark_round("(epoch_us(_last) - epoch_us(_start)) / 6e7", 2)
    + """ END AS duration_minutes,
    escalated, coalesce(primary_intent, 'unknown') AS primary_intent,
    coalesce(""" + D.spark_round("_avg", 2) + """, 0.5) AS avg_sentiment FROM ag LEFT JOIN pi USING (conv_id))"""
)


def _summary(spark, sf) -> DataFrame:
    return conv.summary(tri.labelled(V(spark, sf, "v_messages"), V(spark, sf, "v_scored")))


@register("conv_summary", _SUMMARY + "\nSELECT * FROM summ")
def q_conv_summary(spark, sf):
    return _summary(spark, sf)


@register("conv_primary_intent", _SUMMARY + "\nSELECT conv_id, primary_intent FROM summ")
def q_conv_primary_intent(spark, sf):
    return _summary(spark, sf).select("conv_id", "primary_intent")


@register("conv_avg_sentiment", _SUMMARY + "\nSELECT conv_id, avg_sentiment FROM summ")
def q_conv_avg_sentiment(spark, sf):
    return _summary(spark, sf).select("conv_id", "avg_sentiment")


@register("session_mood", _SUMMARY + "\nSELECT conv_id, avg_sentiment, CASE WHEN avg_sentiment > 0.6 THEN 'Positive' WHEN avg_sentiment > 0.4 THEN 'Neutral' ELSE 'Negative' END AS mood FROM summ WHERE turn_count > 0")
def q_session_mood(spark, sf):
    return conv.session_mood(_summary(spark, sf))


@register(
    "conv_duration",
    "SELECT user_id, "
    + D.spark_round("(epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7", 2)
    + " AS duration_minutes FROM events GROUP BY user_id",
)
def q_conv_duration(spark, sf):
    e = fx.load_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return conv.duration_minutes(e, "user_id")


@register(
    "latest_customer_msg",
    _CM + "\nSELECT conv_id, arg_max(content, turn) AS last_customer_message FROM v_conv_messages WHERE role = 'customer' GROUP BY conv_id",
)
def q_latest_customer_msg(spark, sf):
    return conv.latest_customer_message(V(spark, sf, "v_conv_messages"))


# ---------------------------------------------------------------- monitor

_MON_COLS = ["window_n", "escalation_rate", "pii_success_rate", "avg_sentiment", "avg_cost"]


def _rolled(spark, sf, plan="halo") -> DataFrame:
    return monitor.rolling(V(spark, sf, "v_interactions"), plan=plan, key="monitor_key")


def _duck_rolling(partition: str = "") -> str:
    w100 = f"({partition} ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"
    w10 = f"({partition} ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
    return (
        W("v_interactions")
        + f""", d AS (SELECT event_id, ts, monitor_key, coalesce(pii_filter_success, true) AS pii_filter_success,
    coalesce(escalated, false) AS escalated, coalesce(sentiment_score, 0.5) AS sentiment_score,
    coalesce(response_time_ms, 0) AS response_time_ms, coalesce(cost, 0.0) AS cost FROM v_interactions),
rolled AS (SELECT *, count(*) OVER {w100} AS window_n,
    sum(CAST(escalated AS BIGINT)) OVER {w100} / count(*) OVER {w100} AS escalation_rate,
    sum(CAST(pii_filter_success AS BIGINT)) OVER {w100} / count(*) OVER {w100} AS pii_success_rate,
    sum(CAST(sentiment_score AS DECIMAL(28,10))) OVER {w100} / count(*) OVER {w100} AS avg_sentiment,
    sum(CAST(cost AS DECIMAL(28,10))) OVER {w100} / count(*) OVER {w100} AS avg_cost,
    sum(CAST(sentiment_score AS DECIMAL(28,10))) OVER {w10} / count(*) OVER {w10} AS recent_sentiment FROM d)"""
    )


_ROLL_SELECT = "SELECT event_id, window_n, " + ", ".join(
    f"{D.spark_round(c, 9)} AS {c}" for c in _MON_COLS[1:]
) + " FROM rolled"


def _rolled_cols(r: DataFrame) -> DataFrame:
    return r.select("event_id", F.col("window_n").cast("bigint").alias("window_n"), *[r9(c).alias(c) for c in _MON_COLS[1:]])


@register(
    "monitor_defaults",
    _duck_rolling() + "\nSELECT event_id, pii_filter_success, escalated, sentiment_score, response_time_ms, cost FROM d",
)
def q_monitor_defaults(spark, sf):
    return monitor.with_defaults(V(spark, sf, "v_interactions")).select(
        "event_id", "pii_filter_success", "escalated", "sentiment_score", "response_time_ms", "cost"
    )


@register("monitor_rolling", _duck_rolling() + "\n" + _ROLL_SELECT)
def q_monitor_rolling(spark, sf):
    return _rolled_cols(_rolled(spark, sf, "halo"))


@register("monitor_rolling_keyed", _duck_rolling("PARTITION BY monitor_key") + "\n" + _ROLL_SELECT.replace("SELECT event_id,", "SELECT event_id, monitor_key,"))
def q_monitor_rolling_keyed(spark, sf):
    r = _rolled(spark, sf, "keyed")
    return r.select("event_id", "monitor_key", F.col("window_n").cast("bigint").alias("window_n"), *[r9(c).alias(c) for c in _MON_COLS[1:]])


for _key, _col in [
    ("monitor_escalation_rate", "escalation_rate"),
    ("monitor_pii_rate", "pii_success_rate"),
    ("monitor_avg_sentiment", "avg_sentiment"),
    ("monitor_avg_cost", "avg_cost"),
]:
    def _mk(col):
        def run(spark, sf):
            return _rolled(spark, sf).select("event_id", r9(col).alias(col))
        return run

    register(_key, _duck_rolling() + f"\nSELECT event_id, {D.spark_round(_col, 9)} AS {_col} FROM rolled")(_mk(_col))


# the whole interaction, field by field, as the alert of a single interaction carries it
_RECORD_SQL = "'{' || " + " || ',' || ".join(
    f"'\"{c}\":' || CAST({c} AS VARCHAR)" for c in ("pii_filter_success", "escalated", "sentiment_score", "response_time_ms", "cost")
) + " || '}'"

_ALERTS_SQL = (
    _duck_rolling()
    + f""", cand AS (SELECT event_id, ts, list_filter([
    CASE WHEN NOT pii_filter_success THEN {{'severity': 'CRITICAL', 'title': {D.q(monitor.TITLE_PII)}, 'message': {D.q(monitor.MESSAGE_PII)}, 'details': {_RECORD_SQL}}} END,
    CASE WHEN escalation_rate > 0.3 THEN {{'severity': 'WARNING', 'title': {D.q(monitor.TITLE_ESCALATION)}, 'message':
      'Escalation rate at ' || printf('%.1f', {D.spark_bround('escalation_rate * 100', 1)}) || '% (baseline: '
      || printf('%.1f', {D.spark_bround(str(monitor.BASELINES['escalation_rate']) + ' * 100', 1)}) || '%)',
      'details': '{{"current_rate":' || CAST({D.spark_round('escalation_rate', 9)} AS VARCHAR) || '}}'}} END,
    CASE WHEN recent_sentiment < 0.3 THEN {{'severity': 'WARNING', 'title': {D.q(monitor.TITLE_SENTIMENT)}, 'message':
      'Recent average sentiment: ' || printf('%.2f', {D.spark_bround(D.spark_round('recent_sentiment', 9), 2)}),
      'details': '{{"avg_sentiment":' || CAST({D.spark_round('recent_sentiment', 9)} AS VARCHAR) || '}}'}} END,
    CASE WHEN cost > {monitor.BASELINES['avg_cost'] * monitor.COST_SPIKE_FACTOR} THEN {{'severity': 'WARNING', 'title': {D.q(monitor.TITLE_COST)}, 'message':
      'Single interaction cost: $' || printf('%.4f', {D.spark_bround('cost', 4)}),
      'details': {_RECORD_SQL}}} END], lambda a: a IS NOT NULL) AS fired FROM rolled),
alerts AS (SELECT event_id, ts, CAST(n AS BIGINT) AS alert_no, a.severity AS severity, a.title AS title, a.message AS message, a.details AS details FROM (
    SELECT event_id, ts, unnest(range(len(fired))) AS n, unnest(fired) AS a FROM cand) x)"""
)


def _alerts(spark, sf) -> DataFrame:
    return monitor.alerts(_rolled(spark, sf))


@register("alerts", _ALERTS_SQL + f"\nSELECT event_id, {DTS.format('ts')} AS ts, alert_no, severity, title, message, details FROM alerts")
def q_alerts(spark, sf):
    return _alerts(spark, sf).select("event_id", ts_str("ts"), "alert_no", "severity", "title", "message", "details")


def _register_alert(key: str, title: str, rows) -> None:
    def run(spark, sf):
        return rows(spark, sf).select("event_id", "severity", "message")

    register(key, _ALERTS_SQL + f"\nSELECT event_id, severity, message FROM alerts WHERE title = {D.q(title)}")(run)


def _titled(title: str):
    return lambda spark, sf: _alerts(spark, sf).filter(F.col("title") == title)


_register_alert("alert_pii_failure", monitor.TITLE_PII, lambda spark, sf: monitor.row_alerts(V(spark, sf, "v_interactions"), monitor.pii_alert()))
_register_alert("alert_escalation_rate", monitor.TITLE_ESCALATION, _titled(monitor.TITLE_ESCALATION))
_register_alert("alert_sentiment_spike", monitor.TITLE_SENTIMENT, _titled(monitor.TITLE_SENTIMENT))
_register_alert("alert_cost_spike", monitor.TITLE_COST, lambda spark, sf: monitor.row_alerts(V(spark, sf, "v_interactions"), monitor.cost_alert()))


_DASH_SQL = (
    _ALERTS_SQL
    + f""", dash AS (SELECT {D.spark_round('s.escalation_rate', 9)} AS escalation_rate, {D.spark_round('s.pii_success_rate', 9)} AS pii_success_rate,
    {D.spark_round('s.avg_sentiment', 9)} AS avg_sentiment, CAST(s.window_n AS BIGINT) AS total_interactions,
    (SELECT count(*) FROM alerts WHERE severity = 'CRITICAL') AS recent_alerts, {D.spark_round('s.avg_cost', 9)} AS avg_cost
  FROM (SELECT arg_max({{'escalation_rate': escalation_rate, 'pii_success_rate': pii_success_rate, 'avg_sentiment': avg_sentiment,
    'window_n': window_n, 'avg_cost': avg_cost}}, (ts, event_id)) AS s FROM rolled) x)"""
)


def _dashboard(spark, sf) -> DataFrame:
    d = monitor.dashboard(V(spark, sf, "v_interactions"))
    return d.select(
        r9("escalation_rate").alias("escalation_rate"), r9("pii_success_rate").alias("pii_success_rate"),
        r9("avg_sentiment").alias("avg_sentiment"), "total_interactions", "recent_alerts", r9("avg_cost").alias("avg_cost"),
    )


@register("dashboard", _DASH_SQL + "\nSELECT * FROM dash")
def q_dashboard(spark, sf):
    return _dashboard(spark, sf)


_B = monitor.BASELINES


@register(
    "health_report",
    _DASH_SQL
    + f"""
SELECT 'total_interactions' AS metric, CAST(total_interactions AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS baseline FROM dash
UNION ALL SELECT 'escalation_rate', escalation_rate, {_B['escalation_rate']} FROM dash
UNION ALL SELECT 'pii_success_rate', pii_success_rate, {_B['pii_success_rate']} FROM dash
UNION ALL SELECT 'avg_sentiment', avg_sentiment, {_B['avg_sentiment']} FROM dash
UNION ALL SELECT 'avg_cost', avg_cost, {_B['avg_cost']} FROM dash
UNION ALL SELECT 'critical_alerts', CAST(recent_alerts AS DOUBLE), CAST(NULL AS DOUBLE) FROM dash""",
)
def q_health_report(spark, sf):
    return monitor.health_report(_dashboard(spark, sf))


@register(
    "health_recent_alerts",
    _ALERTS_SQL + "\nSELECT event_id, alert_no, severity, title FROM alerts ORDER BY ts DESC, event_id DESC, alert_no DESC LIMIT 5",
)
def q_health_recent_alerts(spark, sf):
    return monitor.recent_alerts(_alerts(spark, sf)).select("event_id", "alert_no", "severity", "title")


# ---------------------------------------------------------------- cost

_COST = "(CAST(input_tokens AS DOUBLE) / 1000000.0) * 0.8 + (CAST(output_tokens AS DOUBLE) / 1000000.0) * 4.0"


@register("call_cost", W("v_calls") + f"\nSELECT session_id, seq, agent, {D.spark_round(_COST, 12)} AS total_cost FROM v_calls")
def q_call_cost(spark, sf):
    c = cost_ops.call_cost(V(spark, sf, "v_calls"))
    return c.select("session_id", "seq", "agent", r12("total_cost").alias("total_cost"))


@register(
    "session_cost",
    W("v_calls")
    + f""", s AS (SELECT session_id, sum({_COST}) AS total_cost, count(*) AS calls FROM v_calls GROUP BY session_id)
SELECT session_id, {D.spark_round('total_cost', 12)} AS total_cost, calls,
  'Session Costs: $' || {D.fmt_fixed('total_cost', 4)} || ', Total calls: ' || CAST(calls AS VARCHAR) AS summary FROM s""",
)
def q_session_cost(spark, sf):
    s = cost_ops.session_cost(V(spark, sf, "v_calls"))
    return s.select("session_id", r12("total_cost").alias("total_cost"), "calls", "summary")


_RUN_COST = (
    W("v_calls")
    + f""", rc AS (SELECT session_id, seq, {_COST} AS total_cost, sum({_COST}) OVER (PARTITION BY session_id ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_cost FROM v_calls WHERE agent = 'support_agent')"""
)


@register(
    "running_session_cost",
    _RUN_COST + f"\nSELECT session_id, seq, {D.spark_round('total_cost', 12)} AS total_cost, {D.spark_round('session_cost', 12)} AS session_cost FROM rc",
)
def q_running_session_cost(spark, sf):
    r = cost_ops.running_session_cost(V(spark, sf, "v_calls"))
    return r.select("session_id", "seq", r12("total_cost").alias("total_cost"), r12("session_cost").alias("session_cost"))


@register(
    "displayed_cost",
    _RUN_COST + f"\nSELECT session_id, {D.spark_round('sum(session_cost)', 12)} AS displayed_cost, {D.spark_round('sum(total_cost)', 12)} AS true_cost FROM rc GROUP BY session_id",
)
def q_displayed_cost(spark, sf):
    d = cost_ops.displayed_cost(V(spark, sf, "v_calls"))
    return d.select("session_id", r12("displayed_cost").alias("displayed_cost"), r12("true_cost").alias("true_cost"))


# ---------------------------------------------------------------- knowledge base

_WS_RE2 = r"[\t\n\x0B\f\r\x{85}\p{Z}]+"
_KB_SECTIONS = (
    """kbs AS (SELECT doc_id, CAST(n AS BIGINT) AS section_no, source, content FROM (
    SELECT doc_id, source, unnest(range(len(parts))) AS n, unnest(parts) AS content FROM (
      SELECT doc_id, source, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10) || chr(10)) AS parts
      FROM documents) a) b WHERE regexp_matches(content, '[^\\s\\x{85}\\p{Z}]'))"""
)


def _duck_tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), {D.q(_WS_RE2)}), lambda t: t <> ''))"


def _kb_sections(spark, sf) -> DataFrame:
    return kb_files.sections_from_table(TS(spark, sf, "documents"))


@register("kb_sections", "WITH " + _KB_SECTIONS + "\nSELECT doc_id, section_no, source, content FROM kbs")
def q_kb_sections(spark, sf):
    return _kb_sections(spark, sf)


@register("kb_tokens", W("v_kb_queries") + f"\nSELECT query_id, unnest({_duck_tokens('query')}) AS token FROM v_kb_queries")
def q_kb_tokens(spark, sf):
    return kb.query_tokens(V(spark, sf, "v_kb_queries"))


_KB_SEARCH = (
    W("v_kb_queries")
    + ", "
    + _KB_SECTIONS
    + f""", qt AS (SELECT query_id, unnest({_duck_tokens('query')}) AS token FROM v_kb_queries),
st AS (SELECT doc_id, section_no, unnest({_duck_tokens('content')}) AS token FROM kbs),
sc AS (SELECT query_id, doc_id, section_no, count(*) AS score FROM qt JOIN st USING (token) GROUP BY query_id, doc_id, section_no),
top AS (SELECT * FROM (SELECT sc.*, kbs.source, kbs.content, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kbs.source, doc_id, section_no) AS rank
    FROM sc JOIN kbs USING (doc_id, section_no)) x WHERE rank <= {kb.TOP_K})"""
)


@register("kb_search", _KB_SEARCH + "\nSELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, section_no, score, source, content FROM top")
def q_kb_search(spark, sf):
    found = kb.search(V(spark, sf, "v_kb_queries"), _kb_sections(spark, sf))
    return found.select("query_id", "rank", "doc_id", "section_no", "score", "source", "content")


@register("kb_topk", _KB_SEARCH + "\nSELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, section_no, score FROM top")
def q_kb_topk(spark, sf):
    return kb.topk(V(spark, sf, "v_kb_queries"), _kb_sections(spark, sf)).select("query_id", "rank", "doc_id", "section_no", "score")


@register("kb_topk_index", _KB_SEARCH + "\nSELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, section_no, score FROM top")
def q_kb_topk_index(spark, sf):
    """The same search from a stored index, which is written on the way."""
    sections = _kb_sections(spark, sf)
    index = kb_index.Index(spark, shared_folder(spark, "kb-index"), sections.schema["doc_id"].dataType)
    index.add(sections, 0)
    return index.topk(V(spark, sf, "v_kb_queries")).select("query_id", "rank", "doc_id", "section_no", "score")


@register(
    "kb_format",
    _KB_SEARCH
    + f""", blocks AS (SELECT query_id, list(('### Result ' || CAST(rank AS VARCHAR) || ' (Score: ' || CAST(score AS VARCHAR) || ')') || chr(10)
    || content || chr(10) || '*Source: ' || source || '*' || chr(10) ORDER BY rank) AS items FROM top GROUP BY query_id)
SELECT q.query_id, CASE WHEN b.items IS NULL THEN {D.q(kb.NO_RESULTS)} ELSE {D.q(kb.RESULTS_HEADING)} || chr(10) || array_to_string(b.items, chr(10)) END AS formatted
FROM v_kb_queries q LEFT JOIN blocks b USING (query_id)""",
)
def q_kb_format(spark, sf):
    q = V(spark, sf, "v_kb_queries")
    sections = _kb_sections(spark, sf)
    return kb.format_results(q, kb.topk(q, sections), sections)


# ---------------------------------------------------------------- orders

_ORDER_PART = D.q(D.DUCK_ORDER_ID_PART)


@register(
    "order_id_extract",
    W("v_messages")
    + f"""
SELECT message_id, regexp_extract(list_filter(regexp_extract_all(content, {D.q('(?i)' + D.DUCK_ORDER_ID)}),
  lambda y: length(regexp_extract(y, {_ORDER_PART}, 1)) BETWEEN 6 AND 15)[1], {_ORDER_PART}, 1) AS order_ref FROM v_messages""",
)
def q_order_id_extract(spark, sf):
    m = V(spark, sf, "v_messages")
    return m.select("message_id", orders.extract_order_ref(F.col("content")).alias("order_ref"))


_NORM = "upper(regexp_replace(requested_id, '^\\s+|\\s+$', '', 'g'))"


@register("order_normalise", W("v_lookup_requests") + f"\nSELECT request_id, {_NORM} AS normalised_id FROM v_lookup_requests")
def q_order_normalise(spark, sf):
    r = V(spark, sf, "v_lookup_requests")
    return r.select("request_id", orders.normalise_id(F.col("requested_id")).alias("normalised_id"))


_LOOKUP = (
    W("v_lookup_requests", "v_orders")
    + f""", lk AS (SELECT r.request_id, {_NORM.replace('requested_id', 'r.requested_id')} AS normalised_id FROM v_lookup_requests r),
lj AS (SELECT lk.*, o.order_id, o.o_orderkey, o.status, o.order_date, o.ship_date, o.expected_delivery, o.tracking_number, o.total
    FROM lk LEFT JOIN v_orders o ON o.order_id = lk.normalised_id)"""
)


def _lookup(spark, sf) -> DataFrame:
    return orders.lookup(V(spark, sf, "v_lookup_requests"), V(spark, sf, "v_orders"))


@register("order_lookup", _LOOKUP + "\nSELECT request_id, normalised_id, status, total FROM lj")
def q_order_lookup(spark, sf):
    return _lookup(spark, sf).select("request_id", "normalised_id", "status", "total")


@register(
    "order_lookup_state",
    _LOOKUP
    + """
SELECT request_id, CASE WHEN status IS NOT NULL THEN 'found' WHEN starts_with(normalised_id, 'ORDER') AND length(normalised_id) >= 10
  THEN 'unverified' ELSE 'not_found' END AS state FROM lj""",
)
def q_order_lookup_state(spark, sf):
    return _lookup(spark, sf).select("request_id", "state")


@register(
    "order_format",
    _LOOKUP
    + f""", items AS (SELECT l.l_orderkey AS o_orderkey, list(p.p_name ORDER BY l.l_linenumber, l.l_partkey) AS items
    FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY l.l_orderkey)
SELECT request_id, CASE WHEN status IS NULL THEN {D.q(orders.NOT_FOUND_TEXT)} ELSE concat_ws(chr(10),
  '## Order ' || normalised_id, '**Status:** ' || upper(status), '**Order Date:** ' || strftime(order_date, '%Y-%m-%d'),
  '**Shipped:** ' || strftime(ship_date, '%Y-%m-%d'), '**Expected Delivery:** ' || strftime(expected_delivery, '%Y-%m-%d'),
  '**Tracking:** ' || tracking_number, '**Items:** ' || array_to_string(coalesce(items, []), ', '),
  '**Total:** $' || {D.fmt_fixed('total', 2)}) END AS formatted
FROM lj LEFT JOIN items USING (o_orderkey)""",
)
def q_order_format(spark, sf):
    lk = _lookup(spark, sf)
    found = lk.where("state = 'found'").select("o_orderkey")
    items = orders.order_items(fx.load_table(spark, sf, "lineitem"), fx.load_table(spark, sf, "part"), found)
    j = lk.join(items, "o_orderkey", "left")
    return j.select("request_id", orders.format_order(F.col("state") == "found").alias("formatted"))


# ---------------------------------------------------------------- tickets

_PRIO = "CASE WHEN priority IN ('low', 'medium', 'high', 'urgent') THEN priority ELSE 'medium' END"


@register("ticket_priority", W("v_ticket_requests") + f"\nSELECT ticket_id, {_PRIO} AS priority FROM v_ticket_requests")
def q_ticket_priority(spark, sf):
    t = V(spark, sf, "v_ticket_requests")
    return t.select("ticket_id", rules.normalise_priority(F.col("priority")).alias("priority"))


_TICKET_TRIAGE = (
    _TRIAGE.replace("WITH v_messages", "WITH v_orders AS (" + fx.VIEWS["v_orders"] + "), v_messages", 1)
    + """, nq AS (SELECT *, lower(regexp_replace(trim(redacted_message), '\\s+', ' ', 'g')) AS _q FROM triaged),
rep AS (SELECT conv_id, _q, count(*) AS repeats FROM nq GROUP BY conv_id, _q),
tp AS (SELECT nq.*, rep.repeats, o.total AS order_total,
    CASE WHEN sentiment_score < 0.3 THEN 'high' WHEN intent = 'refund_request' AND o.total > 100 THEN 'medium'
      WHEN intent_confidence < 0.5 OR rep.repeats >= 3 THEN 'low' ELSE 'medium' END AS priority
  FROM nq JOIN rep USING (conv_id, _q) LEFT JOIN v_orders o ON o.o_orderkey = nq.message_id WHERE nq.escalated)"""
)


def _order_totals(spark, sf) -> DataFrame:
    return V(spark, sf, "v_orders").select(F.col("o_orderkey").alias("message_id"), F.col("total").alias("order_total"))


@register("ticket_triage", _TICKET_TRIAGE + "\nSELECT message_id, priority FROM tp")
def q_ticket_triage(spark, sf):
    return tickets.triage_priority(triaged(spark, sf), _order_totals(spark, sf)).select("message_id", "priority")


_TICKETS = (
    _TICKET_TRIAGE
    + f""", tk AS (SELECT 'ESC' || strftime(ts, '%Y%m%d%H%M%S') || '-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS escalation_id, ts,
  {DTS.format('ts')} AS created_at, 'Negative sentiment (' || {D.fmt_fixed('sentiment_score', 2)} || ')' AS reason, priority,
  redacted_message AS customer_message, intent, sentiment_score, '{{}}' AS conversation_summary, 'pending' AS status FROM tp)"""
)


def _tickets(spark, sf) -> DataFrame:
    return tickets.create_from_triage(triaged(spark, sf), _order_totals(spark, sf))


_TICKET_COLS = ["escalation_id", "created_at", "reason", "priority", "customer_message", "intent", "sentiment_score", "conversation_summary", "status"]


@register("ticket_create", _TICKETS + f"\nSELECT {', '.join(_TICKET_COLS)} FROM tk")
def q_ticket_create(spark, sf):
    return _tickets(spark, sf).select(*_TICKET_COLS)


_MSG_SQL = "CASE " + " ".join(f"WHEN priority = {D.q(k)} THEN {D.q(v)}" for k, v in rules.PRIORITY_MESSAGES.items()) + f" ELSE {D.q(rules.PRIORITY_MESSAGES['medium'])} END"


@register("ticket_message", _TICKETS + f"\nSELECT escalation_id, priority, {_MSG_SQL} AS customer_notice FROM tk")
def q_ticket_message(spark, sf):
    return tickets.with_customer_message(_tickets(spark, sf)).select("escalation_id", "priority", "customer_notice")


@register("ticket_pending", _TICKETS + "\nSELECT escalation_id, priority, created_at FROM tk WHERE status = 'pending' ORDER BY ts DESC, escalation_id")
def q_ticket_pending(spark, sf):
    return tickets.pending(_tickets(spark, sf)).select("escalation_id", "priority", "created_at")


_SLA_SQL = "CASE priority WHEN 'urgent' THEN 5 WHEN 'high' THEN 15 WHEN 'medium' THEN 60 WHEN 'low' THEN 240 END"


@register(
    "ticket_sla",
    _TICKETS + f"\nSELECT escalation_id, priority, CAST({_SLA_SQL} AS BIGINT) AS sla_minutes, "
    f"{DTS.format('ts + to_minutes(CAST(' + _SLA_SQL + ' AS BIGINT))')} AS due_at FROM tk",
)
def q_ticket_sla(spark, sf):
    t = tickets.with_sla(_tickets(spark, sf))
    return t.select("escalation_id", "priority", "sla_minutes", ts_str("due_at"))


@register(
    "ticket_from_review",
    _with_review_events(
        _TRIAGE
        + f"""
SELECT 'ESC' || strftime(t.ts, '%Y%m%d%H%M%S') || '-' || CAST(t.conv_id AS VARCHAR) || '-' || CAST(t.turn AS VARCHAR) AS escalation_id,
  {D.q(tickets.AGENT_REASON)} AS reason, {D.q(tickets.AGENT_PRIORITY)} AS priority, t.redacted_message AS customer_message, t.intent, t.sentiment_score
FROM triaged t JOIN v_review_events e USING (message_id) WHERE t.needs_human_review AND e.action = 'escalate'"""
    ),
)
def q_ticket_from_review(spark, sf):
    t = tickets.create_from_review(triaged(spark, sf), V(spark, sf, "v_review_events"))
    return t.select("escalation_id", "reason", "priority", "customer_message", "intent", "sentiment_score")


# ---------------------------------------------------------------- model I/O

@register(
    "inference_request",
    W("v_messages") + ", " + _REDACTED_MSGS_SQL + "\nSELECT message_id, " + _duck_request("redacted_message", None, 4000, 0.7) + " AS request FROM rmsg",
)
def q_inference_request(spark, sf):
    m = _redacted_messages(spark, sf)
    return m.select("message_id", mio.request_json(F.col("redacted_message"), None, 4000, 0.7).alias("request"))


@register(
    "inference_response",
    W("v_response_bodies")
    + """
SELECT message_id, json_extract_string(body, '$.content[0].text') AS content,
  CAST(json_extract(body, '$.usage.input_tokens') AS BIGINT) AS input_tokens,
  CAST(json_extract(body, '$.usage.output_tokens') AS BIGINT) AS output_tokens,
  coalesce(json_extract_string(body, '$.stop_reason'), 'end_turn') AS stop_reason FROM v_response_bodies""",
)
def q_inference_response(spark, sf):
    return mio.parse_responses(VS(spark, sf, "v_response_bodies"))
