"""Connected components on DataFrames: alternating large-star and small-star rounds.

Each round rewires every node's larger (then smaller) neighbours to its least neighbour. Rounds are aggregations with
map-side combining and equi-joins, so a hub costs no task more than its share; each round's edges are checkpointed,
which also bounds the lineage. Only whether they have settled reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: Rows of two numbers up to which a written table is taken by one task, without shuffles; larger ones are dealt out.
FEW = 100_000


def gathered(table: DataFrame) -> DataFrame:
    """A written table, in one partition if it is small: joins and groups of such tables need no shuffle."""
    return table.coalesce(1) if table.count() <= FEW else table


def hinted(table: DataFrame, most: int = FEW) -> DataFrame:
    """A written table, broadcast if it has few rows: what it is joined with needs no shuffle then."""
    return F.broadcast(table) if table.count() <= most else table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v). The large star links each larger neighbour to the least one, the small star each smaller one."""
    # Both directions by explode, not union: a graph gathered in one partition stays there, without shuffles.
    if large:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        side = both.where(F.col("v") > F.col("u"))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        side = both
    least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
    moved = side.join(least, F.col("u") == F.col("w"))
    if large:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        ends = F.array(*[F.struct(F.col(x).alias("u"), F.col("m").alias("v")) for x in "vw"])
        moved = moved.select(F.explode(ends).alias("e")).select("e.*")
    moved = moved.where(F.col("u") != F.col("v"))
    return moved if large else moved.distinct()  # the small star follows the large one and takes its repeats


def _settled(edges: DataFrame) -> bool:
    """Whether all edges (u, v) lead from nodes with a single edge to nodes that are no u themselves."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("end"))
    per_node = ends.groupBy("end.node").agg(F.sum("end.out").alias("out"), F.count("*").alias("n"))
    return per_node.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("n") > F.col("out")))).isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): for each node of an edge, the least node it is connected with. Nodes are of an orderable type."""
    current = gathered(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v")))
    while True:  # every round but the last lowers a neighbour; paths shorten to their square root or so
        current = cut_lineage(_star(_star(current, True), False))
        if _settled(current):
            roots = current.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
            return current.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)


def between_labels(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs: (a, b). Those of different classes, with these as l_a and l_b; an unlinked node is a class of its own."""
    classes = hinted(classes)
    for x in "ab":
        pairs = pairs.join(classes.select(F.col("node").alias(f"n_{x}"), F.col("label").alias(f"l_{x}")), F.col(x) == F.col(f"n_{x}"), "left")
        pairs = pairs.drop(f"n_{x}").withColumn(f"l_{x}", F.coalesce(f"l_{x}", x))
    return pairs.where(F.col("l_a") != F.col("l_b"))


def merge_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes joined by further links; only the graph of classes is walked."""
    links, classes = gathered(links), gathered(classes)
    moved = cut_lineage(components(cut_lineage(between_labels(links, classes)), "l_a", "l_b"))
    new = moved.select(F.col("node").alias("old"), F.col("label").alias("new"))
    relabelled = classes.join(new, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
    return cut_lineage(relabelled.union(moved.join(classes.select("node"), "node", "left_anti").select("node", "label")))
