"""Joins and connected parts that no hot key slows down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celloom.session import stored

#: Rows over which a key counts as hot, and most hot keys: the limit rises with the rows so that there are never more.
HOT_ROWS, HOT_KEYS = 500, 100_000


def hot_join(rows: DataFrame, facts: DataFrame, key: str, keys: int = HOT_KEYS) -> DataFrame:
    """rows with the facts of their key, facts(key, n, ...) being stored, one row a key with n, the number of its rows.

    Facts of hot keys, at most so many, are broadcast, so that no task gets all rows of one; the others meet their rows in a shuffle.
    """
    total = facts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(facts.where(F.col("n") > max(HOT_ROWS, total // keys)).drop("n"))
    cold = rows.join(hot.select(key), key, "left_anti").join(facts.drop("n"), key)
    return rows.join(hot, key).unionByName(cold)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node of the edges with the least node of its connected part, by alternating large and small stars.

    Each round is stored in the shared folder; rounds grow with the logarithm of the longest path. A node with many edges, the
    middle of a star, has them in many tasks.
    """
    both = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    most = 2 * edges.count()  # of edges or nodes in any round
    now, seen = stored(both, "edges", most), None
    while True:
        # large star: each node's larger neighbours move to its least neighbour
        larger = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        own = now.unionByName(larger).groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        moved = hot_join(larger, stored(own, "edge-stars", most), "u")
        large = stored(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "edges", most)
        # small star: each node and its smaller neighbours move to the least of them
        own = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "edge-stars", most)
        moved = hot_join(large, own, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own.select("u", F.col("m").alias("v")))
        now = stored(moved.where("u != v").distinct(), "edges", most)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        seen = state
