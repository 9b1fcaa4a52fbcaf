"""Groups from pairwise links: a two-dimensional grid of link blocks with local union-find.

Vertices are hashed into ``B`` blocks, a link belongs to the cell (block of one end, block of the other). A round has
two steps: every cell runs union-find over its own links and keeps for each of its vertices one representative; then
the cells of a vertex's row and column exchange representatives. The first of them is the vertex's parent, and any other
one is linked to the parent. These links, between representatives that changed, are dealt to a grid of their own, as
large as they need, for the next round; components whose representatives agree are settled and drop out. When nothing is
left, parents are stable, and each stands for the smallest vertex of its component.

A hub's links spread over the 2B - 1 cells of its row and column, a cell that still holds too many of them is cut, and a
vertex has at most one representative in each task, however many links it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import components as core

#: Links a cell is meant to hold.
CELL_EDGES = core.CELL_LINKS


def links(pairs: DataFrame, a: str, b: str, similarity: str | None = None, threshold: float = 0.0) -> DataFrame:
    """Rows (a, b) that link two different non-null ids, with a similarity that is a number of at least ``threshold``."""
    keep: Column = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    if similarity:
        keep = keep & F.col(similarity).isNotNull() & ~F.isnan(similarity) & (F.col(similarity) >= threshold)
    return pairs.where(keep).select(F.col(a).alias("a"), F.col(b).alias("b"))


def grid(edges: DataFrame, cells: int) -> DataFrame:
    """``edges`` (a, b) with ``cell`` in a square grid of at least ``cells`` cells: its row is the block of a, its column that of b."""
    blocks = 1
    while blocks * blocks < cells:
        blocks += 1
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    return edges.withColumn("cell", (block("a") * blocks + block("b")).cast("int"))


def connected_components(edges: DataFrame, cell_edges: int = CELL_EDGES) -> DataFrame:
    """(unit_id, group_id): each vertex of ``edges`` (a, b) with the smallest vertex, in string order, of its component.

    Ids are strings; edges with a null end or of a vertex to itself are ignored; repeated edges and either direction
    count once. No edges give no rows.
    """
    return core.components(links(edges, "a", "b"), grid, cell_edges).select(F.col("v").alias("unit_id"), F.col("label").alias("group_id"))
