"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwelltrace.llm.common import join_by_key, staged


def connected_components(links: DataFrame) -> DataFrame:
    """Columns ``node, component``, the smallest node of each component, for linked nodes.

    ``links`` has long columns ``a`` and ``b``. Each round hangs the neighbours of a node on its
    smallest one: first the larger neighbours (large star), then the smaller ones (small star),
    until nothing moves. Minima are pre-aggregated before the shuffle and joined back; nodes with
    more links than a two-hundredth of all are few, and their minima go to the links instead. So
    neither the links of a node meet in a task, nor is a list of neighbours ever built. Every
    round is written to the shared folder.
    """
    edges = staged(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links"
    )
    before = None
    while True:
        # Large star: every node tells its larger neighbours the smallest one it knows.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n_rows"))
        low = staged(low.select("u", F.least("u", "m").alias("m"), "n_rows"), "large-lows")
        met = join_by_key(both.filter("v > u"), low.select("u", "m"), ["u"], low.select("u", "n_rows"))
        large = staged(met.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        # Small star: every node hangs its smaller neighbours, and itself, on the smallest one.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n_rows"))
        lowest = staged(lowest, "small-lows")
        joined = join_by_key(large, lowest.select("u", "m"), ["u"], lowest.select("u", "n_rows"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lowest.select("u", F.col("m").alias("v"))
        )
        edges = staged(small.filter("u <> v").distinct(), "small-star")
        state = edges.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
