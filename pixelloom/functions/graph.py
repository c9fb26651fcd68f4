"""Connected components as joins with aggregated minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.grid import cut


def with_least(edges: DataFrame, keys: tuple[str, ...] = (), salts: int = 64) -> DataFrame:
    """Edges (keys, a, b) with ``m``, the least b of their a.

    Minima come together in salted groups and edges find them by node and salt, so a
    node that a third of all edges have is spread over ``salts`` tasks.
    """
    k = list(keys)
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    parts = salted.groupBy(*k, "a", "salt").agg(F.min("b").alias("part"))
    whole = parts.groupBy(*k, "a").agg(F.min("part").alias("m"))
    return salted.join(parts.join(whole, [*k, "a"]).drop("part"), [*k, "a", "salt"]).drop("salt")


def components(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, node, root: the least node of each connected component, for all nodes that have an edge.

    ``edges`` has the keys and the orderable columns a, b; components don't cross keys. Large-star and
    small-star steps alternate: each node's greater (then its lesser) neighbours are
    linked to its least one, by salted joins, as the least node of a large component has all others for neighbours.
    A logarithmic number of rounds, each written to the checkpoint folder; only two counts come to the driver.
    """
    k = list(keys)
    turned = lambda e: e.select(*k, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut(turned(edges.where("a <> b")).distinct())
    before = None
    while True:
        near = edges.union(edges.select(*k, F.col("b").alias("a"), F.col("a").alias("b")))
        large = turned(with_least(near, keys).where("b > a").select(*k, F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b")).distinct()
        small = with_least(large, keys).select(*k, F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = cut(small.where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*k, "a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(*k, F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
