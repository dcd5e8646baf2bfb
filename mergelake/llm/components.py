"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014), on tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelake.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b); self-loops are harmless.

    Each round groups by node with map-side minima and joins them back, so a node with very many neighbours is one row
    for each task, and its edges are dealt out by skew-join. Edges never exceed the input's number. Rounds grow with the
    logarithm of the longest path; each is staged in the shared folder.
    """
    now = staged(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).filter("low < high").distinct(), "edges")
    while True:
        both = now.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(now.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least-neighbours")
        large = staged(both.filter("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high")).filter("low < high").distinct(), "large-star")
        smallest = staged(large.groupBy("high").agg(F.min("low").alias("m")), "least-neighbours")
        linked = large.join(smallest, "high")
        small = linked.select(F.col("m").alias("low"), "high").unionByName(linked.filter("low > m").select(F.col("m").alias("low"), F.col("low").alias("high"))).distinct()
        after = staged(small, "small-star")
        digest = [F.count("*"), F.sum(F.xxhash64("low", "high") % 1_000_003)]
        # Equal digests may hide a change; both are sets, so equal numbers and none missing decide.
        if after.agg(*digest).first() == now.agg(*digest).first() and after.join(now, ["low", "high"], "left_anti").isEmpty():
            nodes = after.select(F.col("high").alias("node"), F.col("low").alias("component"))
            return staged(nodes.unionByName(after.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()), "components")
        now = after
