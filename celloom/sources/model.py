"""The omics tables that stand behind the driver's star schema: entries, cells, features, fragments, peaks, points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celloom.session import table


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x = line items of a customer for a part: a sparse count matrix of cells by features."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cell"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("feat"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("cell", "feat").agg(F.count("*").cast("double").alias("x"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("grp"), F.col("c_nationkey").alias("batch"), F.col("c_acctbal").alias("bal"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feat"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_partkey") * 50 + F.col("l_linenumber") * 37
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("chrom"), start.alias("start"), (start + (F.col("l_quantity") * 4).cast("long")).alias("end"), F.col("l_orderkey").alias("cell"))


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 5).alias("chrom"), (F.col("s_suppkey") * 997).alias("p_start"), (F.col("s_suppkey") * 997 + 400).alias("p_end"), F.col("s_suppkey").alias("peak"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
