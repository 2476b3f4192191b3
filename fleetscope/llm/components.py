"""Connected components of a link table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import stored


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Re-hang every node's neighbours on the smallest one (links: u > v)."""
    if larger:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = links.groupBy("u").agg(F.min("v").alias("m"))
        joined = links.join(low, "u")
        moved = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))))
    return moved.where("u > v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of comparable ids -> ``(node, root)`` for every node of
    a link, ``root`` the smallest id it reaches.  Self links and repeated links
    change nothing; an empty table gives an empty result.  Large-star and
    small-star steps alternate until the table stops changing, about log(n)
    rounds; each round is a grouped minimum (combined on the map side, so a hub
    is no hot group) and a join, stored in the shared folder."""
    links = (links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .where("u > v").distinct())
    links = stored(links, "links")
    before = None
    while True:
        links = stored(_stars(_stars(links, True), False), "links")
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return (links.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .union(links.select("v", "v").distinct()))
