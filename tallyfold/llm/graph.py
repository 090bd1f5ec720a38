"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove, scratch_path
from .shared import materialize


#: edges in one file of an interim table
PART_EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node of its component.

    Large-star and small-star steps in turn (Kiveris et al. 2014), each round
    written to the shared folder. A hub is met only by aggregates, which
    combine before the shuffle, and by joins, which Spark can split. Loops and
    repeated edges are allowed. No edges give no rows.
    """
    spark = edges.sparkSession
    used: list[str] = []

    def kept(e: DataFrame, name: str, parts: int | None) -> DataFrame:
        # small tables in few files; the steps never add edges, so an earlier count bounds the size
        used.append(scratch_path(spark, name))
        return materialize(e.coalesce(parts) if parts else e, name, used[-1])

    def tidy(e: DataFrame, parts: int | None) -> DataFrame:
        e = e.filter(F.col("a") != F.col("b"))
        return kept(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", parts)

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()

    edges = tidy(edges, None)
    state = mark(edges)
    while True:
        parts = 1 + 2 * state["n"] // PART_EDGES
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # as a table of its own, so that Spark can split the rows of a hub in the join
        least = kept(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")), "least", parts)
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = kept(large.filter(F.col("a") != F.col("b")).distinct(), "large", parts)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = tidy(small.unionAll(least.select("a", F.col("m").alias("b"))), parts)
        before, state = state, mark(edges)
        while len(used) > 1:  # all but the edges just written have served
            remove(spark, used.pop(0))
        if before == state:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
