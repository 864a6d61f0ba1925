"""Connected components of a link table, by alternating large-star and small-star steps.

Works on DataFrames throughout: nothing is gathered on the driver but one row of totals a round, and each round
is cut with a checkpoint in the shared folder. Hubs are pre-aggregated to their minimum before the join that
spreads it, so no task holds a hub's neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b") % 1000003)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(low.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component_id) of every node that has a link; the id is the smallest node reachable.

    Self-links, repeated links and null ends are ignored.
    """
    edges = cut(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    state = _state(edges)
    while state[0]:
        edges = cut(_small_star(_large_star(edges)))
        before, state = state, _state(edges)
        if before == state:
            break
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component_id"))).distinct()
