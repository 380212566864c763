"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeledger.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Each round links the larger neighbours of every node to its smallest one, then the smaller ones.
    Stars grow until nothing changes, after about log n rounds. Minima are pre-aggregated; a hub's
    edges may be split by a skew join. Loops and edges with a null end are left out; repeated edges
    count once. Each round is written to the shared folder.
    """
    one, two = F.col(a), F.col(b)
    now = edges.where(one.isNotNull() & two.isNotNull() & (one != two)).select(
        F.greatest(one, two).alias("u"), F.least(one, two).alias("v")
    ).distinct()
    now, seen = stored(now, "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        seen = mark
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(near, "u").select(
            F.col("w").alias("u"), F.col("m").alias("v")
        ).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        ).where("u != v").distinct()
        now = stored(small, "edges")
