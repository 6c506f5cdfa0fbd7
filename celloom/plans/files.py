"""Queries of readers and writers: tables are written as files of a format to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from celloom.operators import doublets, graphs, intervals, layout, metrics, neighbors, normalize, provenance
from celloom.plans.catalog import BASE, C, query, rounded
from celloom.session import scratch_path, stored, table
from celloom.sources import model, tables


def _folder(spark, sf_dir):
    folder = scratch_path(spark, "matrix")
    held, cells, features = model.entries(spark, sf_dir), model.cells(spark, sf_dir), model.features(spark, sf_dir)
    kind = F.when(F.col("feat") % 10 == 0, "Peaks").otherwise("Gene Expression")
    tables.write_mtx(held, cells.select("cell", F.concat(F.lit("c"), "cell").alias("barcode")), features.select("feat", F.concat(F.lit("f"), "feat").alias("id"), "name", kind.alias("type")).withColumnRenamed("name", "symbol"), folder)
    return folder


@query(f"{BASE} SELECT cell, feat, x FROM e WHERE feat % 10 <> 0")
def read_matrix(spark, sf_dir):
    return tables.read_10x(spark, _folder(spark, sf_dir))[0]


@query("SELECT c_custkey AS cell, 'c' || c_custkey AS barcode FROM customer")
def read_barcodes(spark, sf_dir):
    return tables.read_10x(spark, _folder(spark, sf_dir))[1]


@query(f"{BASE} SELECT sample || ':' || cell AS cell, feat, x FROM e, (VALUES (0), (1)) t(sample) WHERE feat % 10 = 0")
def read_samples(spark, sf_dir):
    folder = _folder(spark, sf_dir)
    return tables.read_samples(spark, [folder, folder], "atac")[0]


@query("SELECT chrom, p_start, p_end, (row_number() OVER (ORDER BY s_suppkey) - 1)::BIGINT AS peak, chrom || ':' || p_start || '-' || p_end AS name FROM (SELECT s_suppkey, 'chr' || (s_suppkey % 5) AS chrom, s_suppkey * 997 AS p_start, s_suppkey * 997 + s_suppkey % 3 * 400 AS p_end FROM supplier) WHERE p_end > p_start")
def read_bed(spark, sf_dir):
    held = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws("\t", F.concat(F.lit("chr"), F.col("s_suppkey") % 5), F.col("s_suppkey") * 997, F.col("s_suppkey") * 997 + F.col("s_suppkey") % 3 * 400).alias("value"))
    lines = held.unionByName(spark.createDataFrame([(-2, "# peaks"), (-1, "track name=x"), (0, "chr1\t5")], "s_suppkey long, value string"))
    path = scratch_path(spark, "bed")
    lines.orderBy("s_suppkey").select("value").write.text(path)
    return tables.read_bed(spark, path)


@query("SELECT 'chr' || (s_suppkey % 5) AS chrom, s_suppkey * 997 AS p_start, s_suppkey * 997 + 400 AS p_end, CASE s_suppkey % 3 WHEN 0 THEN 'PLS,CTCF' WHEN 1 THEN 'pELS' END AS cls FROM supplier WHERE s_suppkey % 3 < 2")
def read_elements(spark, sf_dir):
    kind = F.when(F.col("s_suppkey") % 3 == 0, "PLS,CTCF").when(F.col("s_suppkey") % 3 == 1, "pELS").otherwise("DNase")
    held = table(spark, sf_dir, "supplier").select(F.concat_ws("\t", F.concat(F.lit("chr"), F.col("s_suppkey") % 5), F.col("s_suppkey") * 997, F.col("s_suppkey") * 997 + 400, F.lit("a"), F.lit("b"), kind).alias("value"))
    path = scratch_path(spark, "elements")
    held.write.text(path)
    return tables.read_regulatory_elements(spark, path, ["PLS", "ELS"])


@query("SELECT p_brand AS cell_type, list(p_name ORDER BY p_partkey) AS genes FROM part GROUP BY 1")
def read_markers(spark, sf_dir):
    path = scratch_path(spark, "markers")
    held = table(spark, sf_dir, "part").orderBy("p_partkey")
    held.select(F.col("p_brand").alias("cell_type"), F.col("p_name").alias("gene")).write.json(f"{path}.json")
    return tables.read_markers(spark, f"{path}.json")


@query("SELECT l_orderkey AS cell, 'chr' || (l_suppkey % 5) AS chrom, count(*) AS n FROM lineitem WHERE l_suppkey % 5 <> 3 GROUP BY 1, 2")
def remapped_chromosomes(spark, sf_dir):
    names = spark.createDataFrame([(str(i), f"chr{i}") for i in range(5) if i != 3], "source string, target string")
    held = model.fragments(spark, sf_dir).withColumn("chrom", F.col("chrom").cast("string"))
    return tables.remap_chromosomes(held, names).groupBy("cell", "chrom").agg(F.count("*").alias("n"))


@query(f"{BASE} SELECT e.cell, e.feat, round(ln(1 + x / depth * 10000.0::DOUBLE), 6) AS y FROM e JOIN d ON d.cell = e.cell")
def saved_layer(spark, sf_dir):
    path = scratch_path(spark, "layers")
    tables.save_layer(normalize.log1p(model.entries(spark, sf_dir), model.cells(spark, sf_dir)).select("cell", "feat", "y"), path, "rna", "log1p")
    return rounded(spark.read.parquet(path).where("modality = 'rna' and layer = 'log1p'").select("cell", "feat", "y"), "y")


@query(f"WITH {C}, t AS (SELECT count(*) AS a, count(*) FILTER (bal > 0) AS b, count(*) FILTER (bal > 0 AND grp = 'BUILDING') AS d FROM c) SELECT 'filter_cells' AS operation, a AS n_before, b AS n_after FROM t UNION ALL SELECT 'filter_cells', b, d FROM t")
def provenance_log(spark, sf_dir):
    path, cells = scratch_path(spark, "provenance"), model.cells(spark, sf_dir)
    n = [cells.count(), cells.where("bal > 0").count(), cells.where("bal > 0 and grp = 'BUILDING'").count()]
    provenance.record(spark, path, "filter_cells", {"mask": "bal > 0"}, n[0], n[1])
    provenance.record(spark, path, "filter_cells", {"mask": "grp == 'BUILDING'"}, n[1], n[2])
    return provenance.history(spark, path).select("operation", "n_before", "n_after")


@query(f"WITH {C}, l AS (SELECT grp, 'bal' AS metric, avg(bal) AS mean, median(bal) AS median FROM c GROUP BY 1 UNION ALL SELECT grp, 'batch', avg(batch), median(batch) FROM c GROUP BY 1) SELECT grp, metric, round(mean, 6) AS mean, round(median, 6) AS median FROM l")
def group_means(spark, sf_dir):
    return rounded(metrics.group_means(model.cells(spark, sf_dir), "grp", ["bal", "batch"]), "mean", "median")


@query()
def variable_features(spark, sf_dir):
    return doublets.variable_features(stored(model.entries(spark, sf_dir), "entries"), model.cells(spark, sf_dir), least_counts=1)


@query()
def umap_layout(spark, sf_dir):
    held = model.points(spark, sf_dir)
    return rounded(layout.lay_out(stored(neighbors.fuzzy_graph(neighbors.knn(held, held, 14), 15), "graph"), held), "x", "y")


@query()
def stitch_space(spark, sf_dir):
    held = model.points(spark, sf_dir)
    cells = held.select(F.col("id").alias("cell"), (F.col("label") % 2).alias("batch"))
    entries = held.select(F.col("id").alias("cell"), F.posexplode("vec").alias("feat", "x")).select("cell", "feat", F.greatest(F.col("x").cast("double"), F.lit(0.0)).alias("x")).where("x > 0")
    return rounded(graphs.stitch_space(held.select("id", "vec"), entries, cells, "batch"), "value")


@query()
def crosstab_order(spark, sf_dir):
    left, right = metrics.svd_order(metrics.crosstab(model.cells(spark, sf_dir), "grp", "batch", "query"), "grp", "batch")
    return spark.createDataFrame([("query", str(x), i) for i, x in enumerate(left)] + [("reference", str(x), i) for i, x in enumerate(right)], "side string, value string, place int")


@query()
def doublets_by_library(spark, sf_dir):
    cells = model.cells(spark, sf_dir).withColumn("library", F.col("batch") % 2)
    return rounded(doublets.find(stored(model.entries(spark, sf_dir), "entries"), cells, components=10, library="library"), "doublet_score")


@query("SELECT l_suppkey % 5 AS chrom, l_partkey * 50 + l_linenumber * 37 AS start, l_partkey * 50 + l_linenumber * 37 + (l_quantity * 4)::BIGINT AS \"end\", l_orderkey AS cell FROM lineitem")
def decoded_blocks(spark, sf_dir):
    return intervals.decode_blocks(stored(intervals.encode_blocks(model.fragments(spark, sf_dir)), "blocks"))


@query()
def knn_lists(spark, sf_dir):
    """Neighbours by inverted lists; tests measure the recall against all pairs."""
    held = model.points(spark, sf_dir)
    return rounded(neighbors.knn_lists(held, held, 15), "distance")
