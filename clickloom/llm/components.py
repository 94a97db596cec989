"""Connected components of a large edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import discard, written_at


def _both_ways(edges: DataFrame) -> DataFrame:
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return edges.unionByName(turned)


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        near.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of longs to ``(node, component)`` with the least reachable node, roots left out.

    The edge table is written to the shared folder after each round and the one before deleted, so a lost executor costs
    one round at most.
    Minima are taken with partial aggregation and the joins have one row a key on one side, so a hub's rows are
    split by adaptive skew handling. An empty table gives an empty result; loops and repeated edges are ignored.
    """
    edges, path = written_at(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    before = _digest(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        edges, new = written_at(_small_star(_large_star(edges)), "components")
        now = _digest(edges)
        discard(path)
        path = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
