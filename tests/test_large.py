import pytest
from pyspark.sql import functions as F

from celloom.operators import intervals, stats, tidy
from celloom.sources import tables


def plan(df):
    return df._jdf.queryExecution().toString()


def test_made_draws_are_not_broadcast(spark):
    seen = spark.range(100).select("id", F.col("id").cast("double").alias("value"))
    null = seen.select("id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).select("id", F.col("i").cast("double").alias("null_value"))
    out = stats.monte_carlo(null, seen, ["id"])
    assert "Broadcast" not in plan(out)
    assert {r.id: round(r.p, 6) for r in out.collect()} == {i: round((max(0, 10 - i) + 1) / 11, 6) for i in range(100)}


def test_common_names_do_not_multiply(spark):
    sets = spark.range(2000).select(F.lit("s").alias("set"), F.lit("n").alias("name"), (F.col("id") % 7).cast("double").alias("weight"))
    features = spark.range(2000).select(F.col("id").alias("feat"), F.lit("n").alias("name"))
    out = tidy.resolve_sets(sets, features, ["name"])
    assert "Aggregate" in plan(out).split("Join")[-1]  # below the join
    assert sorted((r.feat, r.weight) for r in out.collect()) == [(i, 6.0) for i in range(2000)]


def test_blocks_of_one_chromosome_are_placed_by_many_tasks(spark):
    held = spark.range(5000).select(F.when(F.col("id") % 50 > 0, "chr1").alias("chrom"), (F.col("id") * 7919 % 3001).alias("start"), F.lit(4000).cast("long").alias("end"), (F.col("id") % 3).alias("cell"))
    blocks = intervals.encode_blocks(held, 100)
    assert "RangePartitioning" in plan(blocks) or "__part" in plan(blocks)
    assert {(r.block, r.n) for r in blocks.where("chrom = 'chr1'").groupBy("block").agg(F.count("*").alias("n")).collect()} == {(i, 100) for i in range(49)}
    rows = lambda df: sorted((str(r.chrom), r.start, r.end, r.cell) for r in df.collect())
    assert rows(intervals.decode_blocks(blocks)) == rows(held)


@pytest.mark.parametrize("parts", [1, 5])
def test_written_matrix_has_many_files_in_order(spark, tmp_path, parts):
    entries = spark.range(600).repartition(parts).select((F.col("id") % 20).alias("cell"), F.floor(F.col("id") / 20).alias("feat"), (F.col("id") + 1.0).alias("x"))
    cells = spark.range(20).repartition(4).select(F.col("id").alias("cell"), F.concat(F.lit("c"), F.col("id")).alias("barcode"))
    feats = spark.range(30).repartition(4).select(F.col("id").alias("feat"), F.concat(F.lit("f"), F.col("id")).alias("id"), F.lit("s").alias("symbol"), F.lit("Peaks").alias("type"))
    folder = f"file://{tmp_path}/m"
    tables.write_mtx(entries, cells, feats, folder)
    assert len(list((tmp_path / "m/matrix.mtx").glob("part-*"))) >= parts  # one partition may be put behind the head
    found, names, held = tables.read_10x(spark, folder, "atac")
    assert {(r.cell, r.feat, r.x) for r in found.collect()} == {(i % 20, i // 20, i + 1.0) for i in range(600)}
    assert {(r.cell, r.barcode) for r in names.collect()} == {(i, f"c{i}") for i in range(20)}
    assert {(r.feat, r.id) for r in held.collect()} == {(i, f"f{i}") for i in range(30)}
