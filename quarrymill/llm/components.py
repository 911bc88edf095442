"""Connected components of a graph that no machine holds: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SCOPES, STAYS, Scope, discard, materialize, passing, stored


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.col(a).alias("u"), F.col(b).alias("v"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours (the larger ones, or the smaller ones and itself) move to its smallest neighbour."""
    near = edges.unionByName(_pairs(edges, "v", "u")) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # A table of its own: the join then stands between two exchanges, and a hub's partition can be split.
    least = materialize(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    moved = near.join(least, "u")
    if large:
        return _pairs(moved.where("v > u"), "v", "m").where("u != v").distinct()
    return _pairs(moved, "v", "m").unionByName(_pairs(least, "u", "m")).where("u != v").distinct()


def components(edges: DataFrame, max_rounds: int = 60, scope: Scope | None = None) -> DataFrame:
    """edges (u, v) -> (node, component): the smallest node that each node with an edge reaches. Each round's edges are
    written to the shared folder, so plans stay short and lost executors cost one round at most; those of the round before
    are then discarded, the last ones stay as long as scope (see materialize). A hub's edges are combined before they
    are exchanged, and adaptive execution splits the joins' hot keys."""
    spark = edges.sparkSession
    now, path = stored(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u != v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before or not state[0]:
            (scope or (_SCOPES[-1] if _SCOPES else STAYS)).paths.append(path)
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
        with passing(spark):
            after, new = stored(_star(_star(now, True), False), "edges")
        discard(spark, path)
        now, path = after, new
    raise RuntimeError(f"no end after {max_rounds} rounds")
