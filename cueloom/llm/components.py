"""Connected components of a graph of long ids by alternating star contractions.

Every round is a few joins and groupings; its result is checkpointed, so a lost executor costs
one round at most, and nothing but counts reaches the driver. Relations are in as few parts as their rows
need, as rounds are many and most of them see few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, join_by_key, packed


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """u, v and m: the least of u and its neighbours; the edges of a node with very many are spread."""
    least = packed(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), total)
    return packed(join_by_key(edges, least.select("u", F.least("u", "m").alias("m"), "n"), ["u"], total), total).select("u", "v", "m")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """node and component (its least node) of every node with an edge; edges: u, v, at most so many if that is known."""
    edges = edges.filter("u <> v").select(*_ordered(F.col("u"), F.col("v"))).distinct()
    edges = cut_lineage(edges if most is None else packed(edges, most))
    total, before = edges.count(), None
    edges = packed(edges, total)
    while total:
        # large star: greater neighbours go to the least
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        down = cut_lineage(packed(large, total))
        here = down.count()
        small = _with_least(down, here)
        starred = (
            small.select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .filter("a <> b")
            .select(*_ordered(F.col("a"), F.col("b")))
            .distinct()
        )
        edges = cut_lineage(packed(starred, 2 * here))
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first())
        if state == before:
            break
        total, before = state[0], state
    roots = packed(edges.select(F.col("v").alias("node")).distinct(), total)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
