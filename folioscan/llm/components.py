"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import materialize, only_read, written


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour or itself."""
    both = links.select(F.col("u").alias("a"), F.col("v").alias("b")).union(links.select(F.col("v").alias("a"), F.col("u").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("m").alias("u"), F.col("b").alias("v")).where("u <> v").distinct()


def _small(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them (u < v in links)."""
    least = materialize(links.groupBy("v").agg(F.min("u").alias("m")), "least")
    moved = links.join(least, "v").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.union(least.select(F.col("m").alias("u"), "v")).where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links(u, v): label is the smallest node that it reaches.

    Loops, repeated links and nulls are ignored. Minima are written before links are joined to
    them, so adaptive execution can split a hub's links; no neighbourhood is gathered in one
    row. Rounds end when the links no longer change: each round that changes them moves some node to a smaller
    one, so the end is always reached, in practice after about the logarithm of the longest path.
    """
    links = links.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    since = written()
    links = materialize(links, "links")
    before, now = None, _state(links)
    while now[0] and now != before:
        large = materialize(_large(links), "links")
        links = only_read(materialize(_small(large), "links"), since)
        before, now = now, _state(links)
    return links.select(F.col("v").alias("node"), F.col("u").alias("label")).union(links.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct())


def _state(links: DataFrame) -> tuple:
    """Count and order-free digest of the links."""
    return tuple(links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
