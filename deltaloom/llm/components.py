"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import stage


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of each node of links (a, b), component being the smallest node it reaches.

    Alternates large-star and small-star steps (Kiveris et al., 2014): every node tells its neighbours of the
    smallest one, so that paths shorten until all links point at the smallest node. A node's neighbours are only
    folded to their minimum, never gathered. Each step is written to the shared folder, which cuts its lineage.
    Null ends and links of a node with itself are ignored; without links the result is empty.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    links = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).withColumn("m", F.least("m", "node"))
        large = both.join(least, F.col("a") == F.col("node")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.filter("m < node").select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()
        least = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.filter("a <> b").unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()
        links = stage(small, "links")
        now = links.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h"), F.sum(F.col("b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
