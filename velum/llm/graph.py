"""Connected components of an edge table by hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.shared import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges (a, b)``: the smallest node that it reaches.

    Each round turns every node's links towards the smallest node around it (large star), then every smaller node's
    towards the smallest (small star); both keep the components and make a forest of stars within a few rounds, also for
    long chains. Loops and repeated links do no harm. Ends when a round changes no edge.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v > u").distinct())
    before = None
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v"), F.col("m").alias("u"))
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")))).alias("e"), "m").select(F.col("e.v").alias("v"), F.col("m").alias("u")).where("v > u").distinct()
        after = cut(small)
        # The sums change whenever an edge does, as links only ever turn to smaller nodes.
        sums = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(pairs)
        pairs = after
        if sums == before:
            break
        before = sums
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("label")).union(pairs.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct())
