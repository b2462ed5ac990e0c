"""Connected components of a table of links, by rounds of joins until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgate.llm.tables import stage


def _stars(links: DataFrame) -> DataFrame:
    """One round: larger neighbours are hung on the smallest one known, then each node on its smallest.

    Sums and minima are taken before rows are shuffled; a node with very many links is split by the planner's
    treatment of skewed joins, as the other side has one row for each node.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("_of"), F.least("a", "least").alias("least"))
    large = (
        both.filter("b > a").join(least, F.col("a") == F.col("_of")).filter("b != least")
        .select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    )
    # From here a > b: b stands for a smaller node.
    least = large.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("_of"), "least")
    joined = large.join(least, F.col("a") == F.col("_of"))
    return (
        joined.filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        .unionByName(least.select(F.col("_of").alias("a"), F.col("least").alias("b"))).distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(a, b) links between numbers -> (node, component): each node's smallest reachable number, itself included.

    Links of a node with itself and repeated ones don't matter. Each round is written to the shared folder, so a lost
    executor costs a part of one round; the rounds grow with the logarithm of the longest chain.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    links, before = stage(links, "links"), None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        links = stage(_stars(links), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
