"""Quality metrics and tidy tables: per cell, per feature, per group."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most pairs of categories that are put in order.
ORDERED = 1_000_000


def cell_metrics(entries: DataFrame, cells: DataFrame, sets: dict[str, Column], features: DataFrame) -> DataFrame:
    """(cell, n_counts, n_features and, for each set of features, n_counts_k and pct_counts_k); empty cells have zeros."""
    joined = entries.join(features, "feat")
    sums = [F.sum("x").alias("n_counts"), F.sum((F.col("x") > 0).cast("long")).alias("n_features")]
    sums += [F.sum(F.when(test, F.col("x")).otherwise(0.0)).alias(f"n_counts_{k}") for k, test in sets.items()]
    names = ["n_counts", "n_features", *(f"n_counts_{k}" for k in sets)]
    out = cells.select("cell").join(joined.groupBy("cell").agg(*sums), "cell", "left").fillna(0, names)
    total = F.when(F.col("n_counts") == 0, 1.0).otherwise(F.col("n_counts"))
    return out.withColumns({f"pct_counts_{k}": F.col(f"n_counts_{k}") * 100.0 / total for k in sets}) if sets else out


def feature_metrics(entries: DataFrame, features: DataFrame) -> DataFrame:
    stats = entries.groupBy("feat").agg(F.sum((F.col("x") > 0).cast("long")).alias("n_cells"), F.sum("x").alias("n_counts"))
    return features.select("feat").join(stats, "feat", "left").fillna(0, ["n_cells", "n_counts"])


def group_metrics(entries: DataFrame, cells: DataFrame, group: str, detection: float = 0.1, cutoff: float = 0.0) -> DataFrame:
    """(group, n_cells, n_detected, mean_counts, median_counts, median_features); a null group is NA."""
    held = cells.select("cell", F.coalesce(F.col(group), F.lit("NA")).alias(group))
    per_cell = entries.groupBy("cell").agg(F.sum("x").alias("counts"), F.sum((F.col("x") > cutoff).cast("long")).alias("features"))
    joined = held.join(per_cell, "cell", "left").fillna(0, ["counts", "features"])
    stats = joined.groupBy(group).agg(F.count("*").alias("n_cells"), F.avg("counts").alias("mean_counts"), F.median("counts").alias("median_counts"), F.median("features").alias("median_features"))
    seen = entries.where(F.col("x") > cutoff).join(held, "cell").groupBy(group, "feat").agg(F.count("*").alias("k"))
    detected = seen.join(stats.select(group, "n_cells"), group).where(F.col("k") / F.col("n_cells") > detection).groupBy(group).agg(F.count("*").alias("n_detected"))
    return stats.join(detected, group, "left").fillna(0, ["n_detected"])


def value_table(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, query: str, reference: str, normalize: str | None = None) -> DataFrame:
    """(query, reference, n, share): counts of pairs, nulls dropped, as a share of the query's, the reference's or all."""
    counts = df.where(F.col(query).isNotNull() & F.col(reference).isNotNull()).groupBy(query, reference).agg(F.count("*").alias("n"))
    if normalize is None:
        return counts.withColumn("share", F.col("n").cast("double"))
    if normalize == "all":
        return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("of")))).withColumn("share", F.col("n") / F.col("of")).drop("of")
    by = {"query": query, "reference": reference}[normalize]
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def dotplot(values: DataFrame, cells: DataFrame, group: str, value: str, expressing_only: bool = False) -> DataFrame:
    """(group, feat, fraction, mean) of the features in values: the share of cells over 0 and the mean over all or expressing cells."""
    sizes = cells.groupBy(group).agg(F.count("*").alias("size"))
    sums = values.join(cells.select("cell", group), "cell").groupBy(group, "feat").agg(F.sum(value).alias("total"), F.sum((F.col(value) > 0).cast("long")).alias("k"))
    every = sizes.crossJoin(values.select("feat").distinct())
    out = every.join(sums, [group, "feat"], "left").fillna(0, ["total", "k"])
    of = F.when(F.col("k") == 0, 1).otherwise(F.col("k")) if expressing_only else F.col("size")
    return out.select(group, "feat", (F.col("k") / F.col("size")).alias("fraction"), (F.col("total") / of).alias("mean"))


def centroids(points: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, dim, mean): mean vectors, one row a dimension."""
    return points.select(group, F.posexplode(vector).alias("dim", "v")).groupBy(group, "dim").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def stratified(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows a group, without replacement, in the order of a hash of key and seed."""
    w = Window.partitionBy(group).orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed))), key)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def frip(counts: DataFrame, fragments: DataFrame, x: str = "x", n: str = "n_fragments") -> DataFrame:
    """(cell, frip) for each cell of fragments(cell, n): the sum of its counts(cell, x) over its fragments, 0 if it has none of either."""
    sums = counts.groupBy("cell").agg(F.sum(x).alias("__s"))
    share = F.when(F.col(n) > 0, F.coalesce("__s", F.lit(0)) / F.col(n)).otherwise(0.0)
    return fragments.join(sums, "cell", "left").select("cell", share.alias("frip"))


def svd_order(counts: DataFrame, query: str, reference: str, value: str = "share") -> tuple[list, list]:
    """The query's and the reference's categories in the order of the first singular vectors of their table, so that like ones meet.

    The categories of a crosstab are few; more than ORDERED pairs raise.
    """
    rows = counts.select(query, reference, F.col(value).cast("double")).limit(ORDERED + 1).collect()
    if len(rows) > ORDERED:
        raise ValueError(f"over {ORDERED} pairs")
    left, right = (sorted({r[i] for r in rows}, key=str) for i in range(2))
    table = np.zeros((len(left), len(right)))
    for a, b, v in rows:
        table[left.index(a), right.index(b)] = v
    if not table.size:
        return left, right
    u, _, vt = np.linalg.svd(table, full_matrices=False)
    sign = -1.0 if u[np.abs(u[:, 0]).argmax(), 0] < 0 else 1.0
    order = lambda v: np.argsort(np.round(sign * v, 9), kind="stable")
    return [left[i] for i in order(u[:, 0])], [right[i] for i in order(vt[0])]


def group_means(cells: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, metric, mean, median) of columns of the cells, nulls left out; a null group is NA."""
    held = cells.select(F.coalesce(F.col(group).cast("string"), F.lit("NA")).alias(group), F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("m"))
    return held.select(group, "m.*").groupBy(group, "metric").agg(F.avg("v").alias("mean"), F.median("v").alias("median"))
