"""Connected components of a link table, by alternating large and small stars.

Every round is two joins on (u, v) rows; each round's links are written to the shared folder,
so a lost executor costs one round.  Only two numbers per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flawscope.session import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of u to the smallest of u and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    to_least = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_least.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; component is its smallest node.

    ``links`` has long columns u and v.  Rows with a null and links of a node to itself are
    ignored, repeated links count once; an empty table gives an empty result.
    """
    now = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"),
                                   F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
                      .toDF("u", "v", "ok").where("ok").select("u", "v").distinct(), "table")
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if not state["n"] or state == seen:
            break
        seen = state
        now = materialize(_small_star(_large_star(now)), "table")
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(now.select(F.col("v"), F.col("v")).distinct()))
