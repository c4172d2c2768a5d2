"""Connected components of an edge table by alternating large-star and small-star rounds.

Everything stays in DataFrames. Each round is a minimum per node (aggregated before the shuffle) joined back to the edges, so
a node with very many neighbours costs no task more than its share: the joins are plain sort-merge joins that adaptive
execution splits. Edges never grow in number. Rounds are written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    got = both.join(_minima(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return got.where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _minima(down)
    near = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another; the component is its smallest node.

    ``edges`` has long columns u and v, in either direction, repeated or not; self loops and nulls are ignored.
    """
    now = checkpointed(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u != v"))
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    before = None
    for _ in range(most_rounds):
        now = checkpointed(_small(_large(now)))
        after = mark(now)
        if after == before or not after[0]:
            stars = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
            return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
        before = after
    raise RuntimeError("the components did not settle")
