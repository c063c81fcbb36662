"""Connected components of an edge table, by alternating stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.operators.durable import drop, save


def _min_of(directed: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself. The aggregate combines on the map side, so a hub costs one row a task."""
    return directed.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_min_of(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _min_of(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every endpoint of ``edges``; the component is the smallest node that links reach.

    Rounds of large and small stars shrink every path geometrically; each round is two aggregates and two equi joins on
    node ids, written to the shared folder so that lineage stays short. A hub's rows are aggregated before they are
    shuffled and its join side is one row, which AQE splits. Null endpoints and self loops link nothing; a node that only has a self loop is
    still returned. Duplicate and mirrored edges count once. An empty table gives an empty result.
    """
    raw = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    raw = save(raw.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    current, seen = raw.where("u <> v"), None
    kept = None
    for _ in range(max_rounds):
        step = save(_small_star(_large_star(current).where("u <> v").distinct()).where("u <> v").distinct(), "stars")
        mark = step.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if kept is not None:
            drop(kept)
        kept = current = step
        if (mark.n, mark.h) == seen:
            break
        seen = (mark.n, mark.h)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = raw.select(F.col("u").alias("node")).unionByName(raw.select(F.col("v").alias("node"))).distinct()
    found = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
