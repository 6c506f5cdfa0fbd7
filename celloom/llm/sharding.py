"""Rendezvous hashing of stable record keys over weighted shards, in Spark SQL functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from celloom.session import small, stored

#: Least parts into which the rows of a shard are split while they are numbered, and rows of a part that are aimed at with more.
PARTS, PART_ROWS = 64, 50_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the best draw for this key: -ln(u) / weight is least, u being a hash of key and shard in (0, 1).

    A draw depends on its own shard and the key alone, so a new shard only takes rows and a removed one only gives rows away.
    """
    if not weights or any(not (w > 0 and math.isfinite(w)) for w in weights):
        raise ValueError("weights must be positive numbers, at least one")

    def draw(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
        return F.struct((-F.log(u) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))

    draws = [draw(i, w) for i, w in enumerate(weights)]
    return (draws[0] if len(draws) == 1 else F.least(*draws))["shard"]


def shard(df: DataFrame, key: str, weights: Sequence[float], order: Sequence[str] = ()) -> DataFrame:
    """df with two more columns: shard (int) and slot (long), the gapless place in the shard from 0.

    Null keys count as one key. Rows with equal keys share a shard; order (further columns) settles their places, and rows equal
    in those too are interchangeable. Rows are numbered in parts by a hash of key and order, so that no task sees a whole shard, nor
    all rows of a key that differ. An empty table gives an empty one. Clashing columns shard and slot are replaced.
    """
    parts = max(PARTS, -(-df.count() // (PART_ROWS * len(weights))))
    part = F.pmod(F.xxhash64(F.col(key), *order, F.lit("part")), F.lit(parts)).cast("int")
    placed = df.withColumns({"shard": rendezvous(F.col(key), weights), "__part": part})
    # counts of parts give where each part begins
    counts = stored(placed.groupBy("shard", "__part").count(), "shard-parts")
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("shard", "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__begin"))
    within = Window.partitionBy("shard", "__part").orderBy(key, *order)
    return (
        placed.join(small(begins), ["shard", "__part"])
        .withColumn("slot", F.col("__begin") + F.row_number().over(within) - 1)
        .drop("__part", "__begin")
    )
