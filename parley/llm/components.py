"""Connected components of a link table, as DataFrame joins.

Alternating large-star and small-star steps: each node hands its neighbours to
its smallest neighbour, until every component is a star around its smallest
node. Each step is an aggregation (map-side minima) and a join; a hub is one row
on the minima side, so a skewed join can split the other side. Every round is
written with ``checkpoint()`` to the session's shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.session import cut_lineage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step on distinct (u, v) links with u > v."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        out = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _sum(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return row[0], row[1]


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node reachable.

    ``links`` has long columns ``u`` and ``v``; direction, repeats and loops do not matter.
    """
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    links = cut_lineage(links)
    last = _sum(links)
    for _ in range(max_rounds):
        links = cut_lineage(_star(_star(links, True), False))
        now = _sum(links)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components: no fixed point within the round limit")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
