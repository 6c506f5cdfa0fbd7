"""Marker-guided embeddings: scores of marker sets as coordinates, by batch, of found groups, and of new cells in a frozen space."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celloom.operators import decompose, graphs, markers, neighbors, normalize, stats, tidy
from celloom.session import small, stored

#: Cells that a query needs to be scaled by its own lengths.
SELF_CELLS = 500
#: Digits of coordinates that are compared.
DIGITS = 9


def _sets(scores: DataFrame, group: str, n: int) -> DataFrame:
    best = markers.top_per_group(scores, group, n)
    return stored(best.select(F.col(group).alias("set"), "feat", F.lit(1.0).alias("weight")), "sets")


def _moments(z: DataFrame, cells: DataFrame) -> DataFrame:
    return normalize.moments(z.crossJoin(F.broadcast(cells.agg(F.count("*").alias("n_cells")))), F.col("n_cells"), "z")


@dataclass
class Reference:
    """A frozen space: marker sets, control features, normalisation constants, lengths of the axes, and where its own cells lie."""

    sets: DataFrame  # set, feat, weight
    near: DataFrame  # feat, neighbour, rank
    totals: DataFrame  # feat, total
    constants: DataFrame  # n_cells, s, t
    lengths: DataFrame  # set, length
    embedding: DataFrame  # cell, set, score

    def save(self, path: str) -> None:
        """Writes every table as Parquet, and a manifest with a fingerprint of each, under a path."""
        spark, told = self.sets.sparkSession, {}
        for f in fields(self):
            held = getattr(self, f.name)
            held.write.mode("overwrite").parquet(f"{path}/{f.name}")
            told[f.name] = fingerprint(spark.read.parquet(f"{path}/{f.name}"))
        spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Reference:
        """The reference saved under a path; raises if a table is not the one that was saved."""
        told = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        tables = {f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)}
        changed = [name for name, held in tables.items() if fingerprint(held) != told[name]]
        if changed:
            raise ValueError(f"{', '.join(changed)} changed since the reference was saved")
        return cls(**tables)


def fingerprint(df: DataFrame) -> str:
    """Rows and an order-free hash of a table."""
    n, h = df.agg(F.count("*"), F.bit_xor(F.xxhash64(*sorted(df.columns)))).first()
    return f"{n}:{h}"


def embed(scores: DataFrame, lengths: DataFrame | None = None, block: str | None = None) -> DataFrame:
    """(cell, set, score): each axis over its length (its own unless lengths(set, length) are given), then each cell's row, or each
    block(set) of it, to length 1; lengths under 1e-12 count as 1."""
    own = scores.groupBy("set").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("length")) if lengths is None else lengths
    over = F.col("score") / F.when(F.col("length") < 1e-12, 1.0).otherwise(F.col("length"))
    scaled = scores.join(F.broadcast(own), "set").select("cell", "set", over.alias("score"), (F.lit(0) if block is None else F.expr(block)).alias("__block"))
    rows = scaled.groupBy("cell", "__block").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("__l"))
    out = F.round(F.col("score") / F.when(F.col("__l") < 1e-12, 1.0).otherwise(F.col("__l")), DIGITS)
    return scaled.join(rows, ["cell", "__block"]).select("cell", "set", out.alias("score"))


def fit(entries: DataFrame, cells: DataFrame, group: str, n: int = 20, mu: float = 1.0, expressed: float = 0.005, neighbours: int = 30) -> Reference:
    """The space of the n best markers of each group of the reference's cells."""
    entries = stored(entries, "reference-entries")
    z = stored(normalize.infog(entries, cells), "infog")
    sets = _sets(markers.cosg(z, cells, group, "z", mu, expressed), group, n)
    near = stored(neighbors.feature_neighbours(_moments(z, cells), sets.select("feat").distinct(), neighbours), "reference-neighbours")
    scores = stored(markers.score_sets(z, None, sets, "z", cells, neighbours, near=near), "reference-scores")
    lengths = stored(scores.groupBy("set").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("length")), "reference-lengths")
    totals = stored(entries.groupBy("feat").agg(F.sum("x").alias("total")), "reference-totals")
    return Reference(sets, near, totals, stored(normalize._constants(entries, cells), "reference-constants"), lengths, stored(embed(scores, lengths), "reference-embedding"))


def project(reference: Reference, entries: DataFrame, cells: DataFrame, mode: str = "reference") -> DataFrame:
    """(cell, set, score): other cells in the reference's space, by its constants, control features and lengths.

    Features are aligned by id and depths count shared ones. mode "self" scales by the query's own lengths if it has SELF_CELLS cells.
    If more than half of the sets have less than a fifth of their features in the query, this raises.
    """
    shared = entries.join(reference.totals.select("feat"), "feat", "left_semi")
    tidy.recovery(reference.sets, shared.select("feat").distinct())
    depth = shared.groupBy("cell").agg(F.sum("x").alias("depth"))
    z = stored(normalize.apply_infog(shared, depth, reference.totals, reference.constants), "query-infog")
    scores = stored(markers.score_sets(z, None, reference.sets, "z", cells, near=reference.near), "query-scores")
    own = mode == "self" and cells.limit(SELF_CELLS).count() == SELF_CELLS
    return stored(embed(scores, None if own else reference.lengths), "query-embedding")


def points(embedding: DataFrame) -> DataFrame:
    """(id, vec): coordinates in the order of the sets."""
    rows = embedding.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("set", "score"))).alias("v"))
    return rows.select(F.col("cell").alias("id"), F.col("v.score").alias("vec"))


def novelty(reference: Reference, embedding: DataFrame, k: int = 15, share: float = 0.99) -> DataFrame:
    """(cell, novelty, novel): the mean distance to the k nearest reference cells, and whether it is over this quantile of the
    reference's own (each cell left out of its own neighbours)."""
    known = stored(points(reference.embedding), "reference-points")
    mean = lambda found: found.groupBy(F.col("query").alias("cell")).agg(F.round(F.avg("distance"), DIGITS).alias("novelty"))
    own = stats.quantiles(mean(neighbors.knn(known, known, k)), "novelty", [share])
    found = mean(neighbors.knn(known, points(embedding), k, skip_self=False))
    return found.crossJoin(F.broadcast(own)).select("cell", "novelty", (F.col("novelty") > F.col("q0")).alias("novel"))


def novelty_test(reference: Reference, embedding: DataFrame, k: int = 15) -> DataFrame:
    """stats.two_samples() of the query's mean distances (first) and the reference's own."""
    known = stored(points(reference.embedding), "reference-points")
    mean = lambda found, one: found.groupBy("query").agg(F.avg("distance").alias("d")).select("d", F.lit(one).alias("one"))
    both = mean(neighbors.knn(known, points(embedding), k, skip_self=False), True).unionByName(mean(neighbors.knn(known, known, k), False))
    return stats.two_samples(both, "d", "one")


def predict(reference: Reference, embedding: DataFrame, labels: DataFrame, k: int = 15) -> DataFrame:
    """(cell, label, confidence): the vote of the k nearest reference cells; labels(neighbour, label)."""
    near = neighbors.knn(points(reference.embedding), points(embedding), k, skip_self=False)
    return stats.majority(near.join(labels, "neighbour"), "query", "label").withColumnRenamed("query", "cell")


def gdr_batches(z: DataFrame, cells: DataFrame, group: str, batch: str, n: int = 20) -> DataFrame:
    """(cell, set, score): markers of every group in every batch, set group@batch; each batch's cells are scored on all sets with
    control features of their own batch, axes scaled within the batch and each batch's sets to length 1 a cell.

    Batches are few; each is a partition of the same tables, and their results are put together at the end.
    """
    names = [r[0] for r in cells.select(batch).distinct().orderBy(batch).collect()]
    held = {b: (stored(z.join(own.select("cell"), "cell", "left_semi"), "batch-values"), own) for b in names for own in [cells.where(F.col(batch) == b)]}
    found = [markers.top_per_group(markers.cosg(own, c, group, "z"), group, n).select(F.concat_ws("@", F.col(group), F.lit(b)).alias("set"), "feat", F.lit(1.0).alias("weight")) for b, (own, c) in held.items()]
    sets = stored(reduce(DataFrame.unionByName, found), "sets")
    parts = [embed(stored(markers.score_sets(own, _moments(own, c), sets, "z", c), "batch-scores"), block="substring_index(set, '@', -1)") for own, c in held.values()]
    return reduce(DataFrame.unionByName, parts)


def gdr_clusters(z: DataFrame, cells: DataFrame, components: int = 50, k: int = 15, variable: int = 3000, n: int = 20, resolution: float = 1.0) -> DataFrame:
    """(cell, set, score) with the communities of the k nearest neighbours in an SVD of the most variable features as groups."""
    spread = _moments(z, cells)
    best = stored(normalize.highly_variable(spread, variable).select("feat"), "variable")
    scores, _, _ = decompose.svd(z.join(small(best), "feat", "left_semi").select("cell", "feat", F.col("z").alias("x")), components)
    held = stored(scores.select(F.col("cell").alias("id"), "vec"), "cluster-points")
    found = stored(graphs.communities(neighbors.fuzzy_graph(neighbors.knn(held, held, k - 1), k), resolution), "clusters")
    named = cells.join(found.select(F.col("node").alias("cell"), F.col("community").cast("string").alias("cluster")), "cell").select("cell", "cluster")
    sets = _sets(markers.cosg(z, named, "cluster", "z"), "cluster", n)
    return embed(markers.score_sets(z, spread, sets, "z", cells))
