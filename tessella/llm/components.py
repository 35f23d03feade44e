"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import use_checkpoints

#: Up to so many edges go through their rounds in one partition (16 bytes an edge), without a shuffle: each shuffle costs
#: as many files and tasks as the session has partitions, however few the rows.
EDGES = 200_000


def _with_least(edges: DataFrame, few: bool) -> DataFrame:
    """(a, b, m): edges with the least neighbour b of each a; ``few`` edges are in one partition already."""
    if few:
        return edges.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), both long: root is the least node of its component.

    Each round links every node's greater neighbours, then its smaller ones, to the least node in reach, until nothing
    changes; the number of rounds grows with the logarithm of the nodes. No node's neighbours are gathered in one place
    (but see EDGES): their minimum is an aggregate with map-side partials, and a join carries it back. Rounds cut their
    lineage with a checkpoint. At most EDGES edges stay in one partition; more are spread over all. Loops and repeated
    edges are allowed; an empty table has no nodes.
    """
    use_checkpoints(edges.sparkSession)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node")))
    own = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before, rows = None, own.count()
    while True:
        # Greater neighbours of u go to the least node that u sees.
        few = rows <= EDGES
        both = own.union(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seen = _with_least(both.coalesce(1) if few else both, few).filter("b > a")
        large = seen.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        # u and its smaller neighbours go to the least of them.
        moved = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        own = _with_least(large, few).select(F.explode(moved).alias("e")).select("e.*").filter("a <> b").distinct().checkpoint()
        now = own.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, rows = now, now[0]
    return nodes.distinct().join(own.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
