"""Connected components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import as_table


def _stars(pairs: DataFrame, keep: str) -> DataFrame:
    """Each node's neighbours, joined to the smallest of them. A node with very many neighbours is the
    hot side of a plain join, which adaptive execution splits; its minimum is summed in the map tasks."""
    least = pairs.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("low", "u"))
    return pairs.join(least, "u").where(keep)


def _round(edges: DataFrame) -> DataFrame:
    # every larger neighbour of a node is tied to the node's least neighbour ...
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _stars(both, "v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
    # ... then the smaller neighbours of a node among themselves
    least = large.groupBy("u").agg(F.min("v").alias("low"))
    small = (large.join(least, "u").select(F.explode(F.expr(
        "filter(array(struct(u AS u, low AS v), struct(v AS u, low AS v)), e -> e.u > e.v)")).alias("e"))
        .select("e.u", "e.v").distinct())
    return small


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v) pairs of longs -> (node, root): each node of an edge with the least node it is tied to.

    Alternating star contraction: O(log^2 n) rounds whatever the diameter. Every round is written to the
    shared folder, so lineage stays short and a lost executor costs a file read. Nothing but one row of
    checksums per round reaches the driver. No edges: no rows. Loops and null ends are ignored.
    """
    now = as_table(edges.where("u IS NOT NULL AND v IS NOT NULL AND u != v")
                   .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark = None
    while True:
        # the checksum is order-free; equal count and hashes: nothing has changed
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if tuple(seen) == mark or seen[0] == 0:
            break
        mark = tuple(seen)
        now = as_table(_round(now), name)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
