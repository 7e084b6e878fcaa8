"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import written


def _shortened(parents: DataFrame) -> DataFrame:
    """Every child's parent replaced by the end of its chain of parents."""
    while True:
        above = parents.select(F.col("child").alias("_child"), F.col("parent").alias("_above"))
        longer = parents.join(above, F.col("parent") == F.col("_child"), "left")
        shorter = written(
            longer.select(
                "child",
                F.coalesce("_above", "parent").alias("parent"),
                F.col("_above").isNotNull().alias("moved"),
            ),
            "component_parents",
        )
        parents = shorter.drop("moved")
        if shorter.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``); roots are least nodes.

    Each round hangs every node under its least neighbour, follows the chains to
    their ends and keeps the edges between different ends. Rounds fall with the
    logarithm of the longest path; a node with many edges costs its row per edge in
    joins that are split where they are skewed, and is combined before shuffles.
    """
    ordered = edges.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).filter("a != b")
    live = written(ordered.distinct(), "component_edges")
    both = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    roots = both.withColumn("root", F.col("node"))
    while not live.isEmpty():
        parents = live.groupBy(F.col("b").alias("child")).agg(F.min("a").alias("parent"))
        parents = _shortened(written(parents, "component_parents"))

        def at_end(df: DataFrame, column: str, parents: DataFrame = parents) -> DataFrame:
            found = parents.select(F.col("child").alias("_child"), F.col("parent").alias("_end"))
            return (
                df.join(found, F.col(column) == F.col("_child"), "left")
                .withColumn(column, F.coalesce("_end", column))
                .drop("_child", "_end")
            )

        roots = written(at_end(roots, "root"), "component_roots")
        moved = at_end(at_end(live, "a"), "b").filter("a != b")
        live = written(
            moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
            "component_edges",
        )
    return roots
