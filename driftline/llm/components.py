"""Connected components of links, distributed: no link, label or component comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import written
from driftline.sources.intermediate import discard


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for all nodes of ``links(a, b)``.

    Alternating large-star and small-star contraction: every node's larger neighbours, then its smaller
    ones, are hung on its least neighbour. The rounds grow with the logarithm of the longest chain; each is
    written to the shared folder, so its lineage is short, and the driver sees only the number of links that
    changed. A node's least neighbour is an aggregate joined back, so a node with very many links is never
    gathered in one task.
    """
    links = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = links.union(links.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large.filter("a <> b"), "links")
        # small star: a's neighbours are all smaller than a here
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        earlier, links = links, written(small.filter("a <> b").distinct(), "links")
        discard(earlier), discard(large)  # the new table stands by itself
        # a round that changes nothing has found stars only: every node hangs on its root
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
        seen = state
