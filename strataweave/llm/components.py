"""Connected components with DataFrame operations only: alternating large-star and small-star rounds on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.common import counted_join, discard, write_cut


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every neighbour above a node is linked to the least node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return counted_join(both.where("b > a"), least.where("n > 0"), ["a"], "n", n).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """edges have a > b. A node's lower neighbours, and the node, are linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    lower = counted_join(edges, least, ["a"], "n", n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of the component.

    Edges with a null end are left out; a loop makes a component of its one node; repeated edges and either direction do no harm; no edges
    give no rows. Nodes with many neighbours meet them by broadcast (counted_join), so a hot one doesn't weigh on a task. Every round is written to the shared folder and its predecessor removed. The driver sees one count and checksum a round."""
    spark = edges.sparkSession
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    start = ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, path = write_cut(start, gathered=True)
    loops = current.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    kept, first, seen = path, current.where("a <> b"), None
    current = first
    while True:
        row = current.agg(F.count("*").alias("n"), F.sum(F.expr("cast(xxhash64(a, b) as decimal(38,0))")).alias("s")).first()
        if row["n"] == 0 or (row["n"], row["s"]) == seen:
            break
        seen = (row["n"], row["s"])
        large, between = write_cut(_large_star(current, row["n"]), gathered=True)  # small plans: each half of a round is written
        current, new = write_cut(_small_star(large, row["n"]), gathered=True)
        for old in {path, between} - {kept}:
            discard(spark, old)
        path = new
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = stars.select(F.col("root").alias("node"), "root").distinct()
    return stars.unionByName(roots).unionByName(loops.join(stars, "node", "left_anti").join(roots, "node", "left_anti"))
