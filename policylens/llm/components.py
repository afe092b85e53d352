"""Connected components of a table of edges."""

from pyspark.sql import functions as F

from policylens.sources.staging import stage


def _larger_to_smaller(edges):
    """Large star: every neighbour above a node is tied to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.join(least, "a").where("b > a").select(F.col("m").alias("a"), F.col("b"))
        .where("a != b").distinct())


def _smaller_to_smallest(edges):
    """Small star: a node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("s"))
    least = down.groupBy("n").agg(F.min("s").alias("m"))
    tied = down.join(least, "n")
    return (
        tied.select(F.col("m").alias("a"), F.col("s").alias("b"))
        .unionByName(least.select(F.col("m").alias("a"), F.col("n").alias("b")))
        .where("a != b").distinct())


def connected(edges):
    """(node, component): the smallest node that edges (a, b) reach, for every node of an edge.

    Alternates the two star steps until the edges are stars around the smallest nodes. Every round is written to the shared
    folder, which cuts the lineage; the number of rounds grows with the logarithm of the nodes.
    """
    signature = None
    while True:
        edges = stage(_smaller_to_smallest(_larger_to_smaller(edges)), "stars")
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == signature:
            break
        signature = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
