"""Connected components of a table of links, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillview.sources.scratch import materialize


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of a link the smallest node it is joined to.

    Alternates large-star and small-star rounds (Kiveris et al., 2014): each node links
    its larger neighbours, then its smaller ones, to the smallest node near by, until
    nothing changes; O(log^2 n) rounds. Every round is a minimum per node with
    map-side combine and one join, and is written to the shared folder, so no lineage
    grows and no neighbourhood is gathered in one task. Links from a node to itself and
    repeated links are allowed; null ends are ignored.
    """
    edges = (
        links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    edges = materialize(edges, "links")
    before = _state(edges)
    while True:
        edges = materialize(_small_star(_large_star(edges)), "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.union(roots)


def _state(edges: DataFrame) -> tuple:
    """Changes with the set of links, whatever their order."""
    mixed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(mixed, 20)), F.bit_xor(mixed)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # u, a larger neighbour of x, is linked to the smallest node around x
    joined = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).join(lowest.withColumnRenamed("u", "x"), "x")
    return joined.select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(lowest, "u")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(joined.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
