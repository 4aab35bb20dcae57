"""Templated input views derived from the driver tables.

The driver tables hold invented prose in which support keywords, SSNs, ZIP+4
codes and model replies never occur, so the support-specific operators are fed
by these views: deterministic SQL over ``orders``, ``events``, ``lineitem``,
``customer``, ``benchmark``, ``documents``, ``pages`` and ``conversations``.
Every view reads a whole table (no id subsets, no prefixes), so its size grows
with the scale factor. The SQL text is dialect-neutral: the same string runs in
Spark SQL and in DuckDB, which is how the oracle queries reuse it.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {
    # customer messages, one per order; conv = customer, turn = order number (unique, with gaps)
    "v_messages": """
SELECT o_orderkey AS message_id, o_custkey AS conv_id,
  o_orderkey AS turn, o_orderdate AS ts, 'customer' AS role,
  CASE o_orderkey % 13
    WHEN 0 THEN concat('Where is order #AB', lpad(CAST(o_orderkey AS STRING), 8, '0'), '?')
    WHEN 1 THEN concat('I want a refund, mail user', CAST(o_custkey AS STRING), '@example.com')
    WHEN 2 THEN concat('Call (555) ', CAST(100 + o_orderkey % 900 AS STRING), '-4567 about my parcel')
    WHEN 3 THEN concat('My SSN is ', CAST(100 + o_custkey % 900 AS STRING), '-45-6789')
    WHEN 4 THEN concat('Card 4532-1234-5678-', CAST(1000 + o_orderkey % 9000 AS STRING), ' was charged twice')
    WHEN 5 THEN concat('Card 453212345678', CAST(1000 + o_orderkey % 9000 AS STRING), ' was charged twice')
    WHEN 6 THEN concat('order 453212345678', CAST(1000 + o_orderkey % 9000 AS STRING), ' is late')
    WHEN 7 THEN concat('Login from 10.0.', CAST(o_orderkey % 256 AS STRING), '.7 failed, zip 12345-6789')
    WHEN 8 THEN 'What is your return policy?'
    WHEN 9 THEN concat('Reach me at 555.123.', CAST(1000 + o_orderkey % 9000 AS STRING), ' or a|b@c.example.org')
    WHEN 10 THEN 'This is the worst service ever'
    WHEN 11 THEN 'order #12345 please'
    ELSE 'Thank you so much' END AS content
FROM orders""",
    # canned classifier output: intent, confidence, the model's own sentiment label
    # (often at odds with the score, sometimes absent) and sentiment score per message
    "v_scored": """
SELECT o_orderkey AS message_id,
  CASE o_orderkey % 9 WHEN 0 THEN 'order_status' WHEN 1 THEN 'refund_request' WHEN 2 THEN 'product_question'
    WHEN 3 THEN 'shipping_question' WHEN 4 THEN 'account_help' WHEN 5 THEN 'technical_issue'
    WHEN 6 THEN 'complaint' WHEN 7 THEN 'general_inquiry' ELSE 'greeting' END AS intent,
  CAST(50 + o_orderkey % 51 AS DOUBLE) / 100 AS confidence,
  CASE o_orderkey % 6 WHEN 0 THEN 'very_positive' WHEN 1 THEN 'positive' WHEN 2 THEN 'neutral'
    WHEN 3 THEN 'negative' WHEN 4 THEN 'very_negative' END AS sentiment,
  CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 AS score
FROM orders""",
    # canned model replies (NULL = the reply call failed)
    "v_replies": """
SELECT o_orderkey AS message_id,
  CASE o_orderkey % 11
    WHEN 0 THEN 'I can help you track your parcel. Could you share the number?'
    WHEN 1 THEN concat('We will write to user', CAST(o_custkey AS STRING), '@example.com')
    WHEN 2 THEN 'That is a stupid question'
    WHEN 3 THEN 'It definitely will be fixed'
    WHEN 4 THEN 'It arrives when it arrives'
    WHEN 5 THEN 'We issue a refund now'
    WHEN 6 THEN 'A specialist will review the refund'
    WHEN 7 THEN 'It will arrive by Friday'
    WHEN 8 THEN concat('order 453212345678', CAST(1000 + o_orderkey % 9000 AS STRING), ' found')
    WHEN 9 THEN 'I understand, and I am sorry. It comes tomorrow'
    ELSE CAST(NULL AS STRING) END AS reply
FROM orders""",
    # token usage of the reply calls
    "v_reply_usage": """
SELECT o_orderkey AS message_id,
  CAST(900 + o_orderkey % 400 AS BIGINT) AS input_tokens,
  CAST(20 + o_orderkey % 180 AS BIGINT) AS output_tokens
FROM orders""",
    # raw intent-classifier reply text (NULL = the call failed)
    "v_raw_responses": """
SELECT o_orderkey AS message_id,
  CASE o_orderkey % 7
    WHEN 0 THEN '{"intent":"order_status","confidence":0.95,"reasoning":"r"}'
    WHEN 1 THEN concat('```json', chr(10), '{"intent":"complaint","confidence":0.88}', chr(10), '```')
    WHEN 2 THEN '  {"intent":"refund_request","confidence":"0.75"}  '
    WHEN 3 THEN 'not json'
    WHEN 4 THEN '[1]'
    WHEN 5 THEN '{"confidence":null}'
    ELSE CAST(NULL AS STRING) END AS raw_response
FROM orders""",
    # raw sentiment-analyzer reply text (NULL = the call failed)
    "v_raw_sentiment": """
SELECT o_orderkey AS message_id,
  CASE o_orderkey % 8
    WHEN 0 THEN concat('{"sentiment":"negative","score":0.', CAST(10 + o_orderkey % 80 AS STRING), '}')
    WHEN 1 THEN concat('```', chr(10), '{"sentiment":"very_positive","score":0.95}', chr(10), '```')
    WHEN 2 THEN concat(chr(10), '{"sentiment":"neutral","score":"0.5"}', chr(10))
    WHEN 3 THEN '{"sentiment":"positive"}'
    WHEN 4 THEN '{"score":0.25}'
    WHEN 5 THEN 'I think it is negative'
    WHEN 6 THEN '{"sentiment":"negative","score":"low"}'
    ELSE CAST(NULL AS STRING) END AS raw_response
FROM orders""",
    # full response bodies of the inference service
    "v_response_bodies": """
SELECT o_orderkey AS message_id,
  concat('{"content":[{"type":"text","text":"',
    CASE o_orderkey % 3 WHEN 0 THEN 'Happy to help' WHEN 1 THEN 'Order shipped' ELSE 'Refund noted' END,
    '"}],"usage":{"input_tokens":', CAST(100 + o_orderkey % 50 AS STRING),
    ',"output_tokens":', CAST(10 + o_orderkey % 30 AS STRING), '}',
    CASE WHEN o_orderkey % 4 = 0 THEN ',"stop_reason":"max_tokens"' ELSE '' END, '}') AS body
FROM orders""",
    # interaction metrics for the health monitor
    "v_interactions": """
SELECT event_id, ts, user_id AS monitor_key,
  NOT (event_type = 'signup' AND k = 7) AS pii_filter_success,
  event_type = 'error' AS escalated,
  CAST(k AS DOUBLE) / 100 AS sentiment_score,
  CAST(k * 40 AS BIGINT) AS response_time_ms,
  CAST(k * 500 AS DOUBLE) / 1000000 AS cost
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events) e""",
    # model calls with token counts, one session per order
    "v_calls": """
SELECT l_orderkey AS session_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS BIGINT) AS seq,
  CASE l_linenumber % 3 WHEN 0 THEN 'intent_classifier' WHEN 1 THEN 'sentiment_analyzer' ELSE 'support_agent' END AS agent,
  l_partkey % 2000 + 1 AS input_tokens, CAST(l_quantity AS BIGINT) * 10 AS output_tokens
FROM lineitem""",
    # order-id lookups as typed by users
    "v_lookup_requests": """
SELECT o_orderkey AS request_id,
  CASE o_orderkey % 5
    WHEN 0 THEN concat('ORDER', lpad(CAST(o_orderkey AS STRING), 8, '0'))
    WHEN 1 THEN concat('  order', lpad(CAST(o_orderkey AS STRING), 8, '0'), ' ')
    WHEN 2 THEN concat('ORDER9', lpad(CAST(o_orderkey AS STRING), 8, '0'))
    WHEN 3 THEN 'ORDER12'
    ELSE 'XYZ' END AS requested_id
FROM orders""",
    # the order dimension
    "v_orders": """
SELECT concat('ORDER', lpad(CAST(o_orderkey AS STRING), 8, '0')) AS order_id, o_orderkey,
  CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'P' THEN 'shipped' ELSE 'processing' END AS status,
  CAST(o_orderdate AS DATE) AS order_date,
  CASE WHEN o_orderstatus IN ('F','P') THEN CAST(o_orderdate + INTERVAL 1 DAY AS DATE) END AS ship_date,
  CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate + INTERVAL 6 DAY AS DATE) END AS expected_delivery,
  CASE WHEN o_orderstatus IN ('F','P') THEN concat('TRACK', lpad(CAST(o_orderkey AS STRING), 8, '0')) END AS tracking_number,
  o_totalprice AS total
FROM orders""",
    # requested ticket priorities, unknown ones among them
    "v_ticket_requests": """
SELECT event_id AS ticket_id,
  CASE k % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'urgent' ELSE 'bogus' END AS priority
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events) e""",
    # the two instruction texts of the reply model, as one row
    "v_instructions": """
SELECT concat('You answer for ', CAST(count(*) AS STRING), ' regions.') AS base,
  concat('They run from ', min(r_name), ' to ', max(r_name), '.') AS specialised
FROM region""",
    # human review actions on held replies
    "v_review_events": """
SELECT o_orderkey AS message_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'send' WHEN 1 THEN 'send_edited' WHEN 2 THEN 'escalate' ELSE 'reject' END AS action,
  CASE WHEN o_orderkey % 4 = 1 THEN 'Edited reply' END AS edited_text
FROM orders""",
    # knowledge-base queries: every benchmark item, whole text
    "v_kb_queries": """
SELECT item_id AS query_id, text AS query FROM benchmark""",
    # messages that name the customer, and an entity annotation table over them
    "v_name_messages": """
SELECT c_custkey AS message_id,
  concat('Hi, I am ', c_name, ' from Acme Corp, mail user', CAST(c_custkey AS STRING), '@example.com') AS content
FROM customer""",
    "v_name_annotations": """
SELECT c_custkey AS message_id, 'PERSON' AS label, c_name AS value,
  CAST(9 AS INT) AS start_pos, CAST(9 + length(c_name) AS INT) AS end_pos
FROM customer
UNION ALL
SELECT c_custkey, 'ORG', 'Acme Corp', CAST(15 + length(c_name) AS INT), CAST(24 + length(c_name) AS INT) FROM customer
UNION ALL
SELECT c_custkey, 'GPE', 'user', CAST(31 + length(c_name) AS INT), CAST(35 + length(c_name) AS INT) FROM customer
UNION ALL
SELECT c_custkey, 'PERSON', concat('user', CAST(c_custkey AS STRING)), CAST(31 + length(c_name) AS INT),
  CAST(35 + length(c_name) + length(CAST(c_custkey AS STRING)) AS INT) FROM customer""",
    # conversation messages: user → customer, every other role → agent
    "v_conv_messages": """
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'customer' ELSE 'agent' END AS role, text AS content
FROM conversations""",
    # every text the PII operators scan: messages, replies, documents, web pages
    "v_pii_corpus": """
SELECT 'message' AS src, o_orderkey AS id,
  CASE o_orderkey % 13
    WHEN 0 THEN concat('Where is order #AB', lpad(CAST(o_orderkey AS STRING), 8, '0'), '?')
    WHEN 1 THEN concat('I want a refund, mail user', CAST(o_custkey AS STRING), '@example.com')
    WHEN 2 THEN concat('Call (555) ', CAST(100 + o_orderkey % 900 AS STRING), '-4567 about my parcel')
    WHEN 3 THEN concat('My SSN is ', CAST(100 + o_custkey % 900 AS STRING), '-45-6789')
    WHEN 4 THEN concat('Card 4532-1234-5678-', CAST(1000 + o_orderkey % 9000 AS STRING), ' was charged twice')
    WHEN 5 THEN concat('Card 453212345678', CAST(1000 + o_orderkey % 9000 AS STRING), ' was charged twice')
    WHEN 6 THEN concat('order 453212345678', CAST(1000 + o_orderkey % 9000 AS STRING), ' is late')
    WHEN 7 THEN concat('Login from 10.0.', CAST(o_orderkey % 256 AS STRING), '.7 failed, zip 12345-6789')
    WHEN 8 THEN 'What is your return policy?'
    WHEN 9 THEN concat('Reach me at 555.123.', CAST(1000 + o_orderkey % 9000 AS STRING), ' or a|b@c.example.org')
    WHEN 10 THEN 'This is the worst service ever'
    WHEN 11 THEN 'order #12345 please'
    ELSE 'Thank you so much' END AS text
FROM orders
UNION ALL SELECT 'document' AS src, doc_id AS id, text FROM documents
UNION ALL SELECT 'page' AS src, page_id AS id, html AS text FROM pages""",
}

# Base tables each view reads.
_TABLE = re.compile(r"\bFROM (" + "|".join(BASE_TABLES) + r")\b")
VIEW_DEPS = {name: sorted(set(_TABLE.findall(sql))) for name, sql in VIEWS.items()}


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view ``name`` over the tables of ``sf_dir`` (timestamps as UTC). Its
    tables are temporary views under names of their own while the SQL is read."""
    own = {t: f"_parley_{zlib.crc32(sf_dir.encode()):08x}_{t}" for t in VIEW_DEPS[name]}
    for table, temporary in own.items():
        load_table(spark, sf_dir, table).createOrReplaceTempView(temporary)
    df = spark.sql(_TABLE.sub(lambda m: f"FROM {own[m[1]]}", VIEWS[name]))
    ntz = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    for temporary in own.values():
        spark.catalog.dropTempView(temporary)
    return df.withColumns({c: df[c].cast("timestamp") for c in ntz}) if ntz else df


def duckdb_ctes(names: list[str]) -> str:
    """``WITH`` clause defining the given views for the DuckDB oracle."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
