"""Connected components of a large edge table by contraction: nothing is collected, hubs are pre-aggregated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def component_ids(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component_id) for the ends of edges (a, b); component_id is the smallest id reachable.

    In each round every vertex joins its neighbour (or itself) of lowest random priority and edges are contracted, which
    removes a constant fraction of the vertices on average, so rounds grow with the logarithm of the longest chain. Maps of
    the rounds are then applied backwards. Tables are written to the shared folder in between.
    """
    live = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    for turn in range(max_rounds):
        if live.isEmpty():
            break
        pick = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("p"), F.col(c).alias("id"))
        ends = live.select(F.col("a").alias("id"), F.least(pick("a"), pick("b")).alias("to")).unionByName(
            live.select(F.col("b").alias("id"), F.least(pick("a"), pick("b")).alias("to"))
        )
        step = materialise(ends.groupBy("id").agg(F.min("to").alias("to")).select("id", F.col("to.id").alias("to")), "step")
        maps.append(step)
        half = live.join(step.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").select("x", "b")
        both = half.join(step.select(F.col("id").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        live = materialise(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    if not maps:
        return live.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    # a vertex absent from a later map stays where it is
    final = maps[-1]
    for step in reversed(maps[:-1]):
        later = final.select(F.col("id").alias("to"), F.col("to").alias("end"))
        final = materialise(step.join(later, "to", "left").select("id", F.coalesce("end", "to").alias("to")), "final")
    lowest = materialise(final.groupBy("to").agg(F.min("id").alias("low")), "lowest")
    return materialise(final.join(lowest, "to").select("id", F.least("low", "to").alias("component_id")), "components")
