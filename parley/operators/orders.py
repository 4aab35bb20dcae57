"""Order lookup: id extraction, normalisation, lookup join and formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.parse import strip_ws

# The order-reference pattern (the ORDER_ID entity with the id
# captured), the id prefix and minimum length of a plausible id, texts.
ORDER_REF = r"(?i)\b(?:order|tracking)[\s#:]*(?=[A-Z0-9]*\d)([A-Z0-9]{6,15})\b"
PLAUSIBLE_PREFIX = "ORDER"
PLAUSIBLE_MIN_LEN = 10
NOT_FOUND_TEXT = "Order not found. Please verify the order number."


def extract_order_ref(text: Column) -> Column:
    """First order reference in a raw (unredacted) text, or null."""
    ref = F.regexp_extract(text, ORDER_REF, 1)
    return F.when(ref != "", ref)


def normalise_id(order_id: Column) -> Column:
    return F.upper(strip_ws(order_id))


def order_items(lineitem: DataFrame, part: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Item names per order key, in line order; with ``found`` (rows with
    ``o_orderkey``) only of those orders, so other lines are not grouped."""
    li = lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    if found is not None:
        li = li.join(found.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    p = part.select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return (
        li.join(p, "l_partkey")
        .groupBy("l_orderkey")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))), lambda s: s["p_name"]).alias("items"))
        .withColumnRenamed("l_orderkey", "o_orderkey")
    )


def lookup(requests: DataFrame, orders: DataFrame, id_col: str = "requested_id") -> DataFrame:
    """Left join of the normalised id on the order dimension, plus ``state``:
    found, unverified (looks like an id: ORDER prefix, length >= 10) or
    not_found."""
    req = requests.withColumn("normalised_id", normalise_id(F.col(id_col)))
    o = orders.withColumn("normalised_id", F.col("order_id")).withColumn("_there", F.lit(True))
    j = req.join(o, "normalised_id", "left")
    found = F.coalesce(F.col("_there"), F.lit(False))
    state = (
        F.when(found, "found")
        .when(F.col("normalised_id").startswith(PLAUSIBLE_PREFIX) & (F.length("normalised_id") >= PLAUSIBLE_MIN_LEN), "unverified")
        .otherwise("not_found")
    )
    return j.withColumn("state", state).drop("_there")


def format_order(found: Column) -> Column:
    """Markdown block of one order row (columns order_id, status, order_date,
    ship_date, expected_delivery, tracking_number, items, total); absent
    optional fields are skipped; no order → fixed text."""
    d = lambda c: F.date_format(F.col(c), "yyyy-MM-dd")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("## Order "), F.col("order_id")),
        F.concat(F.lit("**Status:** "), F.upper(F.col("status"))),
        F.concat(F.lit("**Order Date:** "), d("order_date")),
        F.concat(F.lit("**Shipped:** "), d("ship_date")),
        F.concat(F.lit("**Expected Delivery:** "), d("expected_delivery")),
        F.concat(F.lit("**Tracking:** "), F.col("tracking_number")),
        F.concat(F.lit("**Items:** "), F.array_join(F.coalesce(F.col("items"), F.array().cast("array<string>")), ", ")),
        F.concat(F.lit("**Total:** $"), F.format_string("%.2f", F.col("total"))),
    )
    return F.when(found, text).otherwise(F.lit(NOT_FOUND_TEXT))
