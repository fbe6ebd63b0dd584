"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import checkpointed


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, root): each linked node with the smallest node it can reach; roots are left out.

    Links may repeat, point either way or to themselves. The number of links never grows; rounds are logarithmic in the
    longest chain. Each round is checkpointed in the shared folder; only a count and a sum reach the driver.
    """
    links = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(links)
    while state[0]:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = checkpointed(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        state, before = _state(links), state
        if state == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
