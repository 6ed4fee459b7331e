"""Connected components by alternating large-star and small-star steps on DataFrames.

Every step replaces the edges of a node by edges to the least node that it knows;
the edges end as stars whose centres are the components' least nodes.  Each round is
a table in the shared folder.  A hub with very many edges meets only aggregations
with map-side sums and joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, settle


def _stars(near: DataFrame, low: DataFrame) -> DataFrame:
    """(u, v, m): neighbours v of u with the least node m around u, u included."""
    return near.join(low, "u")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): for every end of an edge (a, b), the least node it reaches.

    Self-edges, repeated edges and either direction are accepted; edges with a null end
    are ignored.  No edges: no rows.  Raises if ``rounds`` are not enough.
    """
    spark = edges.sparkSession
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).filter("node IS NOT NULL").distinct()
    nodes, _ = settle(nodes, "nodes")
    now, path = settle(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _stars(both, low).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_path = settle(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        after = (
            _stars(large, low).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        )
        after, after_path = settle(after, "small-star")
        forget(spark, path, large_path)
        now, path, last = after, after_path, mark
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        mark = tuple(seen)
        if mark == last:
            break
    else:
        raise RuntimeError(f"the components need more than {rounds} rounds")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
