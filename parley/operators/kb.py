"""Knowledge-base search for many queries at once.

Score of (query, section) = number of distinct lower-cased whitespace tokens
they share (punctuation stays part of a token). A section is known by
``KEY`` = (doc_id, section_no); ``doc_id`` may be of any type.

Sections are dealt by their key before their tokens meet the queries' tokens.
While the planner broadcasts the query tokens (its own estimate decides, no
hint is given), a section's matches stay where the section is: scores are
counted there, each task keeps its best ``k`` sections of a query, and only
those are shuffled. With query sets too large for that, the token join and the
counts are shuffled like any other join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.plans.windows import top_k

# Result count and the texts of the formatted block.
TOP_K = 3
NO_RESULTS = "No relevant information found in knowledge base."
RESULTS_HEADING = "## Knowledge Base Results\n"

KEY = ["doc_id", "section_no"]


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+", -1), lambda t: t != ""))


def query_tokens(queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    return queries.select(F.col(id_col).alias("query_id"), F.explode(tokens(F.col(text_col))).alias("token"))


def section_tokens(sections: DataFrame) -> DataFrame:
    own = sections.select(*KEY, "source", tokens(F.col("content")).alias("tokens")).repartition(*KEY)
    return own.select(*KEY, "source", F.explode("tokens").alias("token"))


def _scores(queries: DataFrame, sections: DataFrame) -> DataFrame:
    matched = section_tokens(sections).join(query_tokens(queries), "token")
    return matched.groupBy(*KEY, "source", "query_id").agg(F.count(F.lit(1)).alias("score"))


def topk(queries: DataFrame, sections: DataFrame, k: int = TOP_K) -> DataFrame:
    """Best k sections per query; ties in section order (source, then ``KEY``).
    The section text is not carried through the search (join it for the k
    winners only, as ``format_results`` does)."""
    order = [F.col("score").desc(), F.col("source"), *(F.col(c) for c in KEY)]
    return top_k(_scores(queries, sections), ["query_id"], order, k, "rank").select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), *KEY, "source", "score"
    )


def search(queries: DataFrame, sections: DataFrame, k: int = TOP_K) -> DataFrame:
    """The matching sections of each query with their texts, best first (``rank``)."""
    return topk(queries, sections, k).join(sections.select(*KEY, "content"), KEY)


def format_results(queries: DataFrame, top: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """One formatted block per query; queries with no match get the fixed text.
    ``sections`` supplies the content of the winners when ``top`` lacks it."""
    if "content" not in top.columns:
        top = top.join(sections.select(*KEY, "content"), KEY)
    item = F.concat_ws(
        "\n",
        F.format_string("### Result %d (Score: %d)", F.col("rank"), F.col("score")),
        F.col("content"),
        F.concat(F.lit("*Source: "), F.col("source"), F.lit("*\n")),
    )
    blocks = top.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("text")))), lambda s: s["text"]).alias("_items")
    )
    return (
        queries.select("query_id")
        .join(blocks, "query_id", "left")
        .select(
            "query_id",
            F.when(F.col("_items").isNull(), F.lit(NO_RESULTS))
            .otherwise(F.concat_ws("\n", F.lit(RESULTS_HEADING), F.array_join("_items", "\n")))
            .alias("formatted"),
        )
    )
