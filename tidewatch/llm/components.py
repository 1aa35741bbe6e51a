"""Connected components by alternating stars.

Kiveris, Lattanzi, Mirrokni, Rastogi and Vassilvitskii, "Connected Components in MapReduce and
Beyond" (2014): each round hangs every node on the smallest node it knows. Rounds grow with the
logarithm of the size of a component; every round is joins and aggregates on two longs per link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node that an edge ``a, b`` touches; the smallest node names it.

    Loops, repeated edges and edges with a null end are allowed and change nothing.
    """
    ends = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    links = settle(edges.where("a != b").select(*ends).distinct())
    seen = None
    while True:
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = links.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u")
        own = links.join(low, "u").where("m != u").select("u", "m")
        hung = large.select(F.col("w").alias("u"), F.col("m").alias("v"))
        links = settle(hung.union(own.toDF("u", "v")).where("u != v").distinct())

        low = links.groupBy("u").agg(F.min("v").alias("m"))
        small = links.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = settle(small.where("u != v").union(low.toDF("u", "v")).distinct())

        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            return links.toDF("node", "component")
        seen = state
