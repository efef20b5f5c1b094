"""Connected components of an edge list by alternating star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _only_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a lesser node, or none but from larger ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    counted = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counted.where("up > 1 OR up > 0 AND down > 0").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes on an edge (a bigint, b bigint).

    Ends when star steps have left nothing but stars; the number
    of rounds grows with the logarithm of the graph, not with its diameter.
    """
    current = materialize(edges.where("a <> b").distinct(), "edges")
    while True:
        current = materialize(_small_star(_large_star(current)).distinct(), "stars")
        if _only_stars(current):
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
