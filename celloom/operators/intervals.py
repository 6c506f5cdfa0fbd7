"""Overlap joins of half-open intervals on bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from celloom.session import stored


def overlaps(fragments: DataFrame, peaks: DataFrame, width: int = 1000) -> DataFrame:
    """Pairs of fragments(chrom, start, end, ...) and peaks(chrom, p_start, p_end, peak) that overlap: p_start < end and p_end > start.

    Both sides are spread over bins of a width and joined on (chrom, bin); a pair is kept in the bin where its overlap begins, so it
    comes once. Adjacent intervals do not overlap; empty or turned intervals overlap nothing; repeated fragments give repeated pairs.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    left = fragments.where("start < `end`").withColumn("__bin", bins("start", "end"))
    right = peaks.where("p_start < p_end").withColumn("__bin", bins("p_start", "p_end"))
    pair = left.join(right, ["chrom", "__bin"]).where((F.col("p_start") < F.col("end")) & (F.col("p_end") > F.col("start")))
    return pair.where(F.floor(F.greatest("start", "p_start") / width) == F.col("__bin")).drop("__bin")


def near_points(intervals: DataFrame, points: DataFrame, window: int) -> DataFrame:
    """Pairs of points(chrom, pos, ...) and intervals(chrom, p_start, p_end, ...) with p_start <= pos + window and p_end >= pos - window."""
    step = max(2 * window, 1)
    left = points.withColumn("__bin", F.explode(F.sequence(F.floor((F.col("pos") - window) / step), F.floor((F.col("pos") + window) / step))))
    right = intervals.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("p_start") / step), F.floor(F.col("p_end") / step))))
    pair = left.join(right, ["chrom", "__bin"]).where((F.col("p_start") <= F.col("pos") + window) & (F.col("p_end") >= F.col("pos") - window))
    return pair.where(F.floor(F.greatest(F.col("pos") - window, F.col("p_start")) / step) == F.col("__bin")).drop("__bin")


def quantify(fragments: DataFrame, peaks: DataFrame) -> DataFrame:
    """(cell, peak, n): fragments of each cell over each peak."""
    return overlaps(fragments, peaks).groupBy("cell", "peak").agg(F.count("*").alias("n"))


def encode_blocks(fragments: DataFrame, rows: int = 1000) -> DataFrame:
    """(chrom, block, k, delta, length, cell): fragments in the order of their starts, in blocks of so many rows of a chromosome; the
    first start of a block stands whole, the others as distances from the one before. Empty chromosomes have no block.

    A task sees a range of starts, not a chromosome; only one count a range is summed in one place.
    """
    held = stored(fragments.select("chrom", "start", "end", "cell").repartitionByRange("chrom", "start", "end", "cell").withColumn("__part", F.spark_partition_id()), "fragments")
    sizes = held.groupBy(F.col("chrom").alias("__c"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    begins = sizes.select("__c", "__p", (F.sum("__n").over(Window.partitionBy("__c").orderBy("__p")) - F.col("__n")).alias("__begin"))
    placed = held.join(F.broadcast(begins), F.col("chrom").eqNullSafe(F.col("__c")) & (F.col("__part") == F.col("__p")))
    order = Window.partitionBy("chrom", "__part").orderBy("start", "end", "cell")
    placed = placed.withColumn("__at", F.col("__begin") + F.row_number().over(order) - 1)
    placed = placed.select("chrom", F.floor(F.col("__at") / rows).alias("block"), (F.col("__at") % rows).cast("int").alias("k"), "start", "end", "cell")
    inside = Window.partitionBy("chrom", "block").orderBy("k")
    delta = F.col("start") - F.coalesce(F.lag("start").over(inside), F.lit(0))
    return placed.select("chrom", "block", "k", delta.alias("delta"), (F.col("end") - F.col("start")).alias("length"), "cell")


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """(chrom, start, end, cell) of encode_blocks()'s rows; each block is decoded by itself."""
    start = F.sum("delta").over(Window.partitionBy("chrom", "block").orderBy("k"))
    return blocks.withColumn("start", start).select("chrom", "start", (F.col("start") + F.col("length")).alias("end"), "cell")
