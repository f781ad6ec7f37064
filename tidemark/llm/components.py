"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round is two joins and two aggregations with map-side combining, so a hub with very many links is never
gathered in one task. Rounds are written to the shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    moved = down.join(least, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
    return moved.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in the links ``(a, b)``, root being the least node reachable (and itself a row)."""
    spark = edges.sparkSession
    now, path = common.write_scratch(edges.select("a", "b").where("a <> b").distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        nxt, nxt_path = common.write_scratch(_small_star(_large_star(now)), "links")
        common.drop_scratch(spark, path)
        now, path = nxt, nxt_path
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
