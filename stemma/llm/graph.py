"""Connected components of links, as joins that no node's number of links can unbalance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import all_salts, salt, written

#: Tasks that the links of one node are spread over.
SALTS = 16


def _with_least(links: DataFrame) -> DataFrame:
    """(u, v, m): every link in both directions with the least node among u and its neighbours."""
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    spread = both.withColumn("salt", salt([F.col("v")], SALTS))
    return spread.join(least.withColumn("salt", all_salts(SALTS)), ["u", "salt"]).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable by links, for every node that has one.

    Takes (u, v) of any orderable type; links with a null node, links of a node with itself and
    repeated links add nothing, and a table without links gives an empty result. Large-star and small-star rounds alternate until
    every node points at its least node; rounds grow with the logarithm of the longest
    chain. Each round is written to the shared folder, so lost executors cost one round.
    """
    links = written(links.toDF("u", "v").filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        large = _with_least(links).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        spread = down.withColumn("salt", salt([F.col("v")], SALTS)).join(least.withColumn("salt", all_salts(SALTS)), ["u", "salt"])
        small = spread.select("v", "m").union(least.select("u", "m")).toDF("u", "v").filter("u != v").distinct()
        links = written(small, "links")
        # equal counts and sums of hashes mean that a round changed nothing
        new = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if new == state:
            break
        state = new
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
