"""Normalisation of sparse matrices held as entries(cell, feat, x); entries that are absent are zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from celloom.operators.stats import quantiles
from celloom.session import stored


def depths(entries: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell, depth): the sum of every cell, 0 where it has no entries."""
    sums = entries.groupBy("cell").agg(F.sum("x").alias("depth"))
    return cells.select("cell").join(sums, "cell", "left").select("cell", F.coalesce("depth", F.lit(0.0)).alias("depth"))


def _constants(entries: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: n_cells, the median depth s and the grand total t. The median is read from distributed ranks."""
    depth = stored(depths(entries, cells), "depths")
    middle = quantiles(depth, "depth", [0.5]).select(F.col("q0").alias("s"))
    return depth.agg(F.count("*").alias("n_cells"), F.sum("depth").alias("t")).crossJoin(middle)


def infog(entries: DataFrame, cells: DataFrame, trim: bool = True) -> DataFrame:
    """entries with z = (x / cell sum) * sqrt(median cell sum * total / feature sum), at most sqrt(number of cells) if trimmed."""
    return apply_infog(entries, depths(entries, cells), entries.groupBy("feat").agg(F.sum("x").alias("total")), _constants(entries, cells), trim)


def apply_infog(entries: DataFrame, depth: DataFrame, totals: DataFrame, constants: DataFrame, trim: bool = True) -> DataFrame:
    z = F.when(F.col("depth") > 0, F.col("x") / F.col("depth") * F.sqrt(F.col("s") * F.col("t") / F.col("total"))).otherwise(F.lit(0.0))
    out = entries.join(depth, "cell").join(totals, "feat").crossJoin(F.broadcast(constants))
    limit = F.sqrt(F.col("n_cells").cast("double"))
    return out.select(*entries.columns, (F.least(z, limit) if trim else z).alias("z"))


def frozen_infog(query: DataFrame, reference: DataFrame, reference_cells: DataFrame) -> DataFrame:
    """The reference's constants applied to other cells; features are aligned by id, and depths count shared features only."""
    totals = reference.groupBy("feat").agg(F.sum("x").alias("total"))
    shared = query.join(totals.select("feat"), "feat", "left_semi")
    depth = shared.groupBy("cell").agg(F.sum("x").alias("depth"))
    return apply_infog(shared, depth, totals, _constants(reference, reference_cells))


def moments(values: DataFrame, n_cells: Column, value: str) -> DataFrame:
    """(feat, mean, var) over all cells, zeros included."""
    mean, square = F.sum(value) / F.first(n_cells), F.sum(F.col(value) * F.col(value)) / F.first(n_cells)
    return values.groupBy("feat").agg(mean.alias("mean"), (square - mean * mean).alias("var"))


def highly_variable(stats: DataFrame, n: int, digits: int = 9) -> DataFrame:
    """The n features of the largest variance (compared at so many digits), ties by the lower feature. A top-k: only n rows meet."""
    return stats.orderBy(F.round("var", digits).desc(), "feat").limit(n)


def log1p(entries: DataFrame, cells: DataFrame, target: float = 1e4) -> DataFrame:
    return entries.join(depths(entries, cells), "cell").select(*entries.columns, F.log1p(F.col("x") / F.when(F.col("depth") == 0, 1.0).otherwise(F.col("depth")) * F.lit(target)).alias("y"))


def tfidf(entries: DataFrame, cells: DataFrame, scale: float = 1e4) -> DataFrame:
    """log1p(x / cell sum * scale) * log1p(cells / max(feature sum, 1)); a scale of 0 or 1 leaves the share unscaled."""
    totals = entries.groupBy("feat").agg(F.sum("x").alias("total"))
    n = cells.agg(F.count("*").alias("n_cells"))
    share = F.col("x") / F.when(F.col("depth") == 0, 1.0).otherwise(F.col("depth"))
    share = share if scale in (0, 1) else share * F.lit(float(scale))
    weight = F.log1p(share) * F.log1p(F.col("n_cells") / F.greatest("total", F.lit(1.0)))
    return entries.join(depths(entries, cells), "cell").join(totals, "feat").crossJoin(F.broadcast(n)).select(*entries.columns, weight.alias("w")).where("w != 0")


def total_count(entries: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells scaled to the mean cell sum."""
    mean = depths(entries, cells).agg(F.avg("depth").alias("mean"))
    return entries.join(depths(entries, cells), "cell").crossJoin(F.broadcast(mean)).select(*entries.columns, (F.col("x") * F.col("mean") / F.when(F.col("depth") == 0, 1e-10).otherwise(F.col("depth"))).alias("y"))


def l2_columns_rows(values: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Each column divided by its length (below 1e-12: by 1), then each row likewise."""
    v = F.col(value)
    columns = values.groupBy(col).agg(F.sqrt(F.sum(v * v)).alias("__c"))
    scaled = values.join(columns, col).withColumn(value, v / F.when(F.col("__c") < 1e-12, 1.0).otherwise(F.col("__c"))).drop("__c")
    length = F.sqrt(F.sum(v * v).over(Window.partitionBy(row)))
    return scaled.withColumn(value, v / F.when(length < 1e-12, 1.0).otherwise(length))


def rotate(points: DataFrame, x: str, y: str, angle: float, clockwise: bool = False) -> DataFrame:
    """Points turned about their centroid by an angle in degrees."""
    turn = F.radians(F.lit(-angle if clockwise else angle))
    centre = points.agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"))
    dx, dy = F.col(x) - F.col("cx"), F.col(y) - F.col("cy")
    out = points.crossJoin(F.broadcast(centre))
    return out.withColumns({"__x": F.col("cx") + dx * F.cos(turn) - dy * F.sin(turn), "__y": F.col("cy") + dx * F.sin(turn) + dy * F.cos(turn)}).drop(x, y, "cx", "cy").withColumnsRenamed({"__x": x, "__y": y})


def scale_by(values: DataFrame, by: str, value: str, how: str = "minmax") -> DataFrame:
    """Values of each `by` scaled to 0..1 ("minmax"), or to mean 0 and sample ("zscore") or population ("zscore_pop") deviation 1."""
    w = Window.partitionBy(by)
    v = F.col(value)
    if how == "minmax":
        shift, size = F.min(v).over(w), F.max(v).over(w) - F.min(v).over(w)
    else:
        shift, size = F.avg(v).over(w), (F.stddev_samp(v) if how == "zscore" else F.stddev_pop(v)).over(w)
    return values.withColumn("scaled", F.when(F.coalesce(size, F.lit(0.0)) == 0, F.lit(0.0)).otherwise((v - shift) / size))


def cross_categories(a: str, b: str, sep: str = "@") -> Column:
    return F.concat_ws(sep, F.col(a), F.col(b))


def strip_suffix(label: Column) -> Column:
    """Without what follows the last hyphen."""
    return F.regexp_replace(label, "-[^-]*$", "")
