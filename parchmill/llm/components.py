"""Connected components of a link table by alternating large-star and small-star steps (public algorithm).

Links stay in tables; the driver sees two numbers a round. Every step sends each node's least neighbour
along its links, so the rounds are logarithmic in the size of a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm.common import sized, stored


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links: (u, v) long, in any direction, with repeats or loops. Returns (u, v): each linked node but a root, and its root,
    the least node of its component. Nodes that are only linked with themselves aren't listed."""
    e = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    state = _state(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(sized(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct(), 2 * state[0]))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        e = stored(sized(large.join(down, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).distinct(), 2 * state[0]))
        if (now := _state(e)) == state:
            return e
        state = now
