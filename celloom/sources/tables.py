"""Readers of sparse matrices, intervals and marker tables, and the writer of layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from celloom.operators.stats import ranks
from celloom.session import small, stored

#: Feature types of the modalities.
MODALITIES = {"rna": ["Gene Expression"], "atac": ["Peaks"], "adt": ["Antibody Capture"], "hto": ["Antibody Capture", "Multiplexing Capture"], "crispr": ["CRISPR Guide Capture"]}


def _place() -> list[Column]:
    """Columns that put lines in their order: files of a folder by name, blocks within them, and lines within the block."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]


def make_unique(names: DataFrame, name: str, order: str) -> DataFrame:
    """The k-th repeat of a name gets the suffix -k; the first stays."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return names.withColumn("__k", k).withColumn(name, F.when(F.col("__k") == 0, F.col(name)).otherwise(F.concat_ws("-", name, "__k"))).drop("__k")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines of a text file with their numbers from 0, counted within the blocks that tasks read; only one count a block is summed in one place."""
    lines = spark.read.text(path).select("value", *_place())
    held = stored(lines, "lines")
    sizes = held.groupBy("file", "block").agg(F.count("*").alias("n"))
    begins = sizes.select("file", "block", (F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")).alias("begin"))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return held.join(F.broadcast(begins), ["file", "block"]).select((F.col("begin") + place - 1).cast("long").alias("line"), "value")


def read_mtx(spark: SparkSession, matrix: str, barcodes: str, features: str, modality: str | None = "rna", prefix: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, cells, features) of a MatrixMarket folder, features by cells with places from 1; gz is read alike.

    A feature without a type is Gene Expression. A modality keeps its feature types; one that is not known is a type itself.
    """
    parts = F.split("value", "\t")
    types = F.when(F.size(parts) > 2, F.get(parts, F.lit(2))).otherwise("Gene Expression")
    feats = numbered_lines(spark, features).select(F.col("line").cast("long").alias("feat"), F.get(parts, F.lit(0)).alias("id"), F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))).alias("symbol"), types.alias("type"))
    if modality not in (None, "all"):
        feats = feats.where(F.col("type").isin(MODALITIES.get(modality, [modality])))
    cells = numbered_lines(spark, barcodes).select(F.col("line").cast("long").alias("cell"), F.concat(F.lit(prefix), "value").alias("barcode"))
    # the size line is the first that is not a comment: of all lines the one at the least place
    body = spark.read.text(matrix).select("value", F.struct(*_place()).alias("__at")).where(~F.col("value").startswith("%"))
    numbers = F.split(F.trim("value"), r"\s+")
    first = body.agg(F.min("__at").alias("__first"))
    rows = body.crossJoin(F.broadcast(first)).where("__at > __first").select((numbers[0].cast("long") - 1).alias("feat"), (numbers[1].cast("long") - 1).alias("cell"), numbers[2].cast("double").alias("x"))
    return rows.join(feats.select("feat"), "feat", "left_semi").select("cell", "feat", "x"), cells, feats


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _first(spark: SparkSession, folder: str, names: list[str]) -> str | None:
    return next((f"{folder}/{n}{end}" for n in names for end in ("", ".gz") if _exists(spark, f"{folder}/{n}{end}")), None)


def read_10x(spark: SparkSession, path: str, modality: str | None = "rna", prefix: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """read_mtx() of a folder: one with matrix.mtx, barcodes.tsv and features.tsv or genes.tsv (gz or not), or one that holds such a
    folder, the filtered one before the raw one. HDF5 files raise, as does a folder without these files."""
    if path.endswith((".h5", ".hdf5")):
        raise ValueError("HDF5 is not read; give the folder with matrix.mtx")
    folders = [path, *(f"{path}/{outs}{kind}_feature_bc_matrix" for outs in ("", "outs/") for kind in ("filtered", "raw"))]
    for folder in folders:
        parts = [_first(spark, folder, names) for names in (["matrix.mtx"], ["barcodes.tsv"], ["features.tsv", "genes.tsv"])]
        if all(parts):
            return read_mtx(spark, *parts, modality, prefix)
    raise FileNotFoundError(f"no matrix.mtx, barcodes.tsv and features.tsv in {', '.join(folders)}")


def read_samples(spark: SparkSession, paths: list[str], modality: str | None = "rna") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, cells, features) of several folders under one numbering; they must list the same features, else this raises."""
    read = [read_10x(spark, p, modality) for p in paths]
    first = read[0][2]
    for path, (_, _, features) in zip(paths[1:], read[1:], strict=True):
        if first.select("feat", "id").exceptAll(features.select("feat", "id")).limit(1).count() or features.select("feat", "id").exceptAll(first.select("feat", "id")).limit(1).count():
            raise ValueError(f"{path} lists other features than {paths[0]}")
    entries, cells = merge_samples([(e, c) for e, c, _ in read])
    return entries, cells, first


def write_mtx(entries: DataFrame, cells: DataFrame, features: DataFrame, folder: str) -> None:
    """A folder that read_10x() reads: entries(cell, feat, x) with places from 0, cells(cell, barcode), features(feat, id, symbol, type).

    Each table is a folder of files whose names are in the order of their lines; the matrix begins with the file of its head.
    """
    sizes = [df.count() for df in (features, cells, entries)]
    body = entries.select(F.concat_ws(" ", F.col("feat") + 1, F.col("cell") + 1, F.col("x")).alias("value"))
    head = entries.sparkSession.createDataFrame([("%%MatrixMarket matrix coordinate real general\n" + " ".join(map(str, sizes)),)], "value string")
    head.coalesce(1).unionByName(body).write.mode("overwrite").text(f"{folder}/matrix.mtx")
    cells.orderBy("cell").select("barcode").write.mode("overwrite").text(f"{folder}/barcodes.tsv")
    features.orderBy("feat").select(F.concat_ws("\t", "id", "symbol", "type")).write.mode("overwrite").text(f"{folder}/features.tsv")


def merge_samples(samples: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(entries, cells) of several samples under new cell ids (sample, cell); barcodes get the sample's number from 0 as a suffix."""
    key = lambda i: F.concat_ws(":", F.lit(i), F.col("cell"))
    entries, cells = None, None
    for i, (e, c) in enumerate(samples):
        e, c = e.withColumn("cell", key(i)), c.withColumns({"cell": key(i), "barcode": F.concat_ws("-", "barcode", F.lit(i)), "sample": F.lit(i)})
        entries, cells = (e, c) if entries is None else (entries.unionByName(e), cells.unionByName(c))
    return entries, cells


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, p_start, p_end, peak, name): comments, track lines, short lines and turned intervals are left out; peak is the place among the rest."""
    parts = F.split("value", "\t")
    lines = numbered_lines(spark, path).where(~F.col("value").startswith("#") & ~F.col("value").startswith("track") & (F.size(parts) >= 3))
    held = lines.select("line", parts[0].alias("chrom"), parts[1].try_cast("long").alias("p_start"), parts[2].try_cast("long").alias("p_end")).where("p_start < p_end")
    places = ranks(held, "line", F.lit(1)).select("line", F.col("below0").alias("peak"))
    return held.join(places, "line").select("chrom", "p_start", "p_end", "peak", F.concat(F.col("chrom"), F.lit(":"), F.col("p_start"), F.lit("-"), F.col("p_end")).alias("name"))


def read_regulatory_elements(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """BED lines whose sixth column contains one of the classes."""
    parts = F.split("value", "\t")
    wanted = F.lit(False)
    for c in classes:
        wanted |= parts[5].contains(c)
    return spark.read.text(path).where(F.size(parts) >= 6).where(wanted).select(parts[0].alias("chrom"), parts[1].cast("long").alias("p_start"), parts[2].cast("long").alias("p_end"), parts[5].alias("cls"))


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """(cell_type, genes): the genes of each cell type in the order of a CSV or JSON table."""
    held = spark.read.json(path) if path.endswith(".json") else spark.read.option("header", True).csv(path)
    placed = held.select("cell_type", "gene", F.struct(*_place()).alias("__at"))
    return placed.groupBy("cell_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "gene"))), lambda s: s["gene"]).alias("genes"))


def remap_chromosomes(df: DataFrame, names: DataFrame, chrom: str = "chrom") -> DataFrame:
    """chrom replaced by names(source, target); rows without a target are dropped."""
    return df.join(small(names), F.col(chrom) == F.col("source")).withColumn(chrom, F.col("target")).drop("source", "target")


def ensembl_to_ucsc(chrom: Column) -> Column:
    return F.when(chrom == "MT", F.lit("chrM")).when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))


def save_layer(entries: DataFrame, path: str, modality: str, layer: str) -> None:
    """Writes a matrix as the partition (modality, layer) of a table of layers."""
    entries.write.mode("overwrite").parquet(f"{path}/modality={modality}/layer={layer}")
