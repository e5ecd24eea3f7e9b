"""Connected components of a table of links, by large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import dropped, stored


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root from links (u, v): root is the smallest node one can reach.

    Nodes without links are not in the result. Every round stores its links, so
    neither a plan nor a lost executor reaches further back than one round. A
    round sends one row for each link, whatever the degree of its nodes, and a
    node's minimum is combined before it is sent.
    """
    now = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    for _ in range(rounds):
        pairs = _both(now)
        least = stored(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        # large star: larger neighbours move to the smallest one
        large = pairs.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "links")
        dropped(now, least)
        # small star: a node and its smaller neighbours move to the smallest one
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = stored(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        dropped(large, least)
        after = now.agg(F.count("*"), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0))).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components: still moving after {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.union(now.select("u", "v"))
