"""Connected components of a graph given as an edge table, without the driver.

Large-star and small-star rounds (Kiveris et al., 2014): each round links the
neighbours of a node to the smallest of them, until every component is a star around
its smallest node. Each round is written to shared storage, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import forget, shared_dir, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node in ``edges`` (a long, b long); root is the component's smallest node.

    Loops, repeated edges and both directions are allowed. An empty table gives no rows.
    """
    spark = edges.sparkSession
    path = shared_dir(spark, "edges")
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", path)
    last = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        before, path = path, shared_dir(spark, "edges")
        edges = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct(), "edges", path)
        forget(spark, before)
        now = edges.agg(F.count("*").alias("n"), F.countDistinct("u").alias("k"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
