"""Connected components of a graph by alternating large-star and small-star steps.

Each round joins every node with the smallest node that it or a neighbour knows, and writes
its edges to the shared folder, so a lost executor costs a round at most and the plan stays
short. The rounds end when the edges are stars. A node with very many neighbours is aggregated
before the shuffle. The join that spreads its smallest neighbour is one by sorting: the nodes are
as many as the data has, and Spark, which knows the size of their packed file alone, would gather
them in the driver, several tables of them a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulbook.session import free_driver, materialize


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of an edge (a, b) the smallest node it is connected with."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # A round reads its edges several times, so they are a file from the start: what made them
    # would else be planned, and run, as often within the first round.
    edges = materialize(edges, "component-links")
    while not _are_stars(edges):
        edges = materialize(_small_star(_large_star(edges)), "component-edges")
        free_driver(edges.sparkSession)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b"), F.col("b")).distinct()
    )


def components_of_both(one: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components of two graphs, found in the same rounds: as many jobs as for one of them."""
    graphs = [g.select(*(F.shiftleft(c, 1).bitwiseOR(F.lit(odd)).alias(c) for c in ("a", "b"))) for odd, g in enumerate((one, other))]
    found = components(graphs[0].union(graphs[1]))
    of = lambda odd: found.where(F.col("node").bitwiseAND(1) == odd).select(*(F.shiftright(c, 1).alias(c) for c in ("node", "root")))
    return of(0), of(1)


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller node, or only edges from larger ones."""
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(F.col("a").alias("node"), one.alias("up"), none.alias("down")).union(edges.select("b", none, one))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.max(F.expr("up > 1 or up > 0 and down > 0"))).first()[0]


def contracted(links: DataFrame) -> DataFrame:
    """Fewer links with the same components, for links (a, b) of members a to heads b.

    A member has a head for every bucket at most, so its links are a bounded group. It keeps the
    link to its smallest head, and its other heads are linked with that one; such links of heads
    are the same for many members and are made distinct before they are shuffled.
    """
    least = F.min("b").over(Window.partitionBy("a"))
    known = links.select("a", "b", least.alias("m"))
    return known.select("a", F.col("m").alias("b")).distinct().union(
        known.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
