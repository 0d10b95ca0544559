"""Connected components of a link table by alternating star contraction, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import materialise


def _least(edges: DataFrame) -> DataFrame:
    """Per node u of (u, v): the least of itself and its neighbours. A hot node's rows are combined before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("w"), F.least("u", "v").alias("m"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of a link; root is the least node of its component. Links of a node to itself are allowed."""
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = materialise(links, "links")
    state = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours greater than u go to the least of u's neighbourhood
        large = both.where("v > u").join(_least(both), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        alone = links.where("u = v")
        down = large.union(alone).distinct().where("v <= u")
        # small star: u and its lesser neighbours go to the least of them
        small = down.join(_least(down), F.col("u") == F.col("w"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u > v or u = v")
        links = materialise(small.distinct(), "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return links.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("root"))
