"""Marker features by cosine similarity, marker-set scores, ligand-receptor scores and marker-table analysis."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from celloom.operators.neighbors import feature_neighbours
from celloom.operators.stats import bh, draw, reached
from celloom.session import ship, small, spread, stored


def cosg(values: DataFrame, cells: DataFrame, group: str, value: str, mu: float = 1.0, expressed: float = 0.0) -> DataFrame:
    """(group, feat, score) of the published cosine method: cos^3 / ((1 - mu) cos^2 + mu * sum of cos^2 over groups).

    cos = sum over the group / (length of the feature * sqrt(cells of the group)). Features expressed in less than the given share of
    a group score -1 there. Pairs without any expression are left out.
    """
    sizes = cells.groupBy(group).agg(F.count("*").alias("n"))
    sums = values.join(cells.select("cell", group), "cell").groupBy(group, "feat").agg(F.sum(value).alias("s"), F.sum((F.col(value) > 0).cast("long")).alias("k"), F.sum(F.col(value) * F.col(value)).alias("q"))
    by_feature = Window.partitionBy("feat")
    cos = sums.join(sizes, group).withColumn("cos", F.col("s") / (F.sqrt(F.sum("q").over(by_feature)) * F.sqrt(F.col("n").cast("double"))))
    square = F.col("cos") * F.col("cos")
    out = cos.withColumn("all", F.sum(square).over(by_feature))
    score = square * F.col("cos") / (F.lit(1.0 - mu) * square + F.lit(float(mu)) * F.col("all"))
    return out.select(group, "feat", F.when(F.col("k") / F.col("n") < expressed, F.lit(-1.0)).otherwise(score).alias("score"))


def top_per_group(scores: DataFrame, group: str, n: int, digits: int = 9) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.round("score", digits).desc(), "feat")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _controls(stats: DataFrame, sets: DataFrame, neighbours: int, draws: int, seed: int, near: DataFrame | None = None) -> DataFrame:
    """(set, draw, feat, weight): in each draw every feature of a set gives way to one of its nearest neighbours by mean and variance."""
    near = feature_neighbours(stats, sets.select("feat").distinct(), neighbours) if near is None else near
    drawn = sets.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("rank", draw(neighbours, F.col("feat"), F.col("set"), F.col("draw"), seed) + 1)
    return drawn.join(near, ["feat", "rank"]).select("set", "draw", F.col("neighbour").alias("feat"), "weight")


def score_sets(values: DataFrame, stats: DataFrame, sets: DataFrame, value: str, cells: DataFrame, neighbours: int = 30, draws: int = 100, seed: int = 1927, near: DataFrame | None = None) -> DataFrame:
    """(cell, set, score) for every cell and set: the set's weighted sum less the mean of its controls, over median weight times set size.

    sets(set, feat, weight), stats(feat, mean, var), cells(cell); near(feat, neighbour, rank), if given, stands for stats. Only the mean over draws is needed here, so the draws add up to one
    weight a feature before the entries are joined once. Cells without any of these features score 0.
    """
    control = _controls(stats, sets, neighbours, draws, seed, near).groupBy("set", "feat").agg((-F.sum("weight") / F.lit(float(draws))).alias("weight"))
    size = sets.groupBy("set").agg((F.median("weight") * F.count("*")).alias("of"))
    weights = sets.select("set", "feat", "weight").unionByName(control).groupBy("set", "feat").agg(F.sum("weight").alias("weight")).join(size, "set")
    found = values.join(small(stored(weights, "set-weights")), "feat").groupBy("cell", "set").agg((F.sum(F.col(value) * F.col("weight")) / F.first("of")).alias("score"))
    every = cells.select("cell").crossJoin(small(stored(sets.select("set").distinct(), "set-names")))
    return every.join(found, ["cell", "set"], "left").select("cell", "set", F.coalesce("score", F.lit(0.0)).alias("score"))


def score_p_values(values: DataFrame, stats: DataFrame, sets: DataFrame, value: str, cells: DataFrame, neighbours: int = 30, draws: int = 100, seed: int = 1927, digits: int = 9) -> DataFrame:
    """score_sets() with its parts and p-values, a row a cell and set: score_query, score_ctrl_average, score; p_mc, the share of the
    cell's own draws at or over the query; p, its rank among the draws of all cells; their rates by Benjamini-Hochberg within the set
    and the negative logarithms of all four to base 10.

    Draws are compared at so many digits. Only draws other than 0 are rows; the others of a cell are counted, not made.
    """
    size = stored(sets.groupBy("set").agg((F.median("weight") * F.count("*")).alias("of")), "set-sizes")
    control = stored(_controls(stats, sets, neighbours, draws, seed).groupBy("set", "draw", "feat").agg(F.sum("weight").alias("weight")), "set-controls")
    null = values.join(control, "feat").groupBy("cell", "set", "draw").agg(F.sum(F.col(value) * F.col("weight")).alias("v"))
    null = stored(null.select("cell", "set", F.round("v", digits).alias("v")).where("v != 0"), "set-draws")
    query = values.join(small(stored(sets, "sets")), "feat").groupBy("cell", "set").agg(F.sum(F.col(value) * F.col("weight")).alias("q"))
    every = cells.select("cell").crossJoin(small(size))
    held = every.join(query, ["cell", "set"], "left").withColumn("q", F.round(F.coalesce("q", F.lit(0.0)), digits))
    own = null.join(held.select("cell", "set", "q"), ["cell", "set"]).groupBy("cell", "set").agg(F.count("*").alias("made"), F.sum((F.col("v") >= F.col("q")).cast("long")).alias("over"), F.sum("v").alias("sum"))
    held = held.join(own, ["cell", "set"], "left").fillna(0, ["made", "over", "sum"])
    over = F.col("over") + F.when(F.col("q") <= 0, F.lit(draws) - F.col("made")).otherwise(0)
    held = stored(held.withColumn("p_mc", (over + F.lit(1.0)) / F.lit(draws + 1.0)), "set-scores")
    # all draws of a set together: the made ones by rank, the others as one value of 0
    known = null.select("set", "v", F.lit(1).alias("k")).unionByName(held.groupBy("set").agg(F.sum(F.lit(draws) - F.col("made")).alias("k")).select("set", F.lit(0.0).alias("v"), "k"))
    known = known.unionByName(held.select("set", F.col("q").alias("v"), F.lit(0).alias("k")))
    ranks = reached(known, "v", "k", "set")
    out = held.withColumn("v", F.col("q")).join(ranks, ["set", "v"]).withColumn("p", (F.col("reach") + F.lit(1.0)) / (F.col("all") + F.lit(1.0)))
    out = out.select("cell", "set", (F.col("q") / F.col("of")).alias("score_query"), (F.col("sum") / F.lit(float(draws)) / F.col("of")).alias("score_ctrl_average"), "p_mc", "p")
    out = out.withColumn("score", F.col("score_query") - F.col("score_ctrl_average"))
    for p in ("p_mc", "p"):
        out = bh(stored(out, "set-p"), p, ["set"]).withColumnRenamed("fdr", f"{p}_fdr")
    return out.withColumns({f"nlog10_{p}": -F.log10(p) for p in ("p_mc", "p_mc_fdr", "p", "p_fdr")})


def predict(scores: DataFrame, digits: int = 9) -> DataFrame:
    """(cell, label, score): for each cell of score_sets() the set of the greatest score, compared at so many digits; ties fall to the
    set that comes first."""
    best = scores.groupBy("cell").agg(F.min(F.struct((-F.round("score", digits)).alias("cost"), "set", "score")).alias("b"))
    return best.select("cell", F.col("b.set").alias("label"), F.col("b.score").alias("score"))


def ligand_receptor(specificity: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ligand, receptor, annotation, sender, receiver, score): the product of both specificities for every sender and receiver."""
    left = specificity.select(F.col("feat").alias("ligand"), F.col("grp").alias("sender"), F.col("score").alias("l"))
    right = specificity.select(F.col("feat").alias("receptor"), F.col("grp").alias("receiver"), F.col("score").alias("r"))
    return pairs.join(left, "ligand").join(right, "receptor").select("ligand", "receptor", "annotation", "sender", "receiver", (F.col("l") * F.col("r")).alias("score"))


def analyse_markers(markers: DataFrame, query: DataFrame, least: int = 1) -> DataFrame:
    """(set, cell_type, study, count, avg_score, rank): marker records that each gene set hits, best first by count, then mean score."""
    hits = query.join(markers, "feat").groupBy("set", "cell_type", "study").agg(F.count("*").alias("count"), F.avg("score").alias("avg_score")).where(F.col("count") >= least)
    w = Window.partitionBy("set").orderBy(F.col("count").desc(), F.round("avg_score", 9).desc(), "cell_type", "study")
    return hits.withColumn("rank", F.row_number().over(w))


#: Most numbers of the specificities and neighbours that every task gets.
TABLE = 20_000_000


def _reached(scored: DataFrame, near: DataFrame, specificity: DataFrame, neighbours: int, draws: int, seed: int, digits: int) -> DataFrame:
    """(ligand, receptor, sender, receiver, count): how many draws of a pair reach its score there, compared at so many digits.

    A pair's draws are two arrays of ranks, made with it; each task holds the specificities and the neighbours as arrays and counts a
    pair's draws at once, so none becomes a row. Over TABLE numbers this raises.
    """
    spark = scored.sparkSession
    ship(spark)
    known, told = specificity.limit(TABLE + 1).toArrow(), near.limit(TABLE + 1).toArrow()
    if len(known) + len(told) > TABLE:
        raise ValueError(f"over {TABLE} specificities and neighbours")
    feats, at = np.unique(known["feat"].to_numpy(), return_inverse=True)
    names = sorted(set(known["grp"].to_pylist()))
    table = np.full((len(feats) + 1, len(names)), np.nan)
    table[at, np.searchsorted(np.array(names, object), np.array(known["grp"].to_pylist(), object))] = known["score"].to_numpy()
    owners, own = np.unique(told["feat"].to_numpy(), return_inverse=True)
    place = np.full((len(owners) + 1, neighbours), len(feats))  # the last row of the table: no specificity
    found = np.minimum(np.searchsorted(feats, told["neighbour"].to_numpy()), max(len(feats) - 1, 0))
    place[own, told["rank"].to_numpy() - 1] = np.where(feats[found] == told["neighbour"].to_numpy(), found, len(feats)) if len(feats) else len(feats)
    shared = spark.sparkContext.broadcast((feats, np.array(names, object), table, owners, place))
    pick = lambda side: F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda i: draw(neighbours, F.col("ligand"), F.col("receptor"), i, side, seed))
    values = scored.groupBy("ligand", "receptor").agg(F.collect_set(F.struct("sender", "receiver", "score")).alias("own"))
    values = stored(values, "lr-values")
    values = spread(values, 2 * draws * values.count())
    rows = values.select("ligand", "receptor", F.col("own.sender").alias("senders"), F.col("own.receiver").alias("receivers"), F.col("own.score").alias("scores"), pick("ligand").alias("lk"), pick("receptor").alias("rk"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        feats, names, table, owners, place = shared.value

        def drawn(feat: int, ranks: np.ndarray) -> np.ndarray:
            k = np.searchsorted(owners, feat)
            return table[place[k if k < len(owners) and owners[k] == feat else len(owners)][ranks]]

        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                left, right = drawn(r.ligand, np.asarray(r.lk)), drawn(r.receptor, np.asarray(r.rk))
                for sender, receiver, score in zip(r.senders, r.receivers, r.scores, strict=True):
                    null = np.round(left[:, np.searchsorted(names, sender)] * right[:, np.searchsorted(names, receiver)], digits)
                    out.append((r.ligand, r.receptor, sender, receiver, int((null >= np.round(score, digits)).sum())))
            yield pd.DataFrame(out, columns=["ligand", "receptor", "sender", "receiver", "count"])

    kinds = ", ".join(f"{c} {scored.schema[c].dataType.simpleString()}" for c in ("ligand", "receptor", "sender", "receiver"))
    counts = rows.mapInPandas(run, f"{kinds}, count long")
    return counts.groupBy("ligand", "receptor", "sender", "receiver").agg(F.max("count").alias("count"))


def ligand_receptor_p(specificity: DataFrame, pairs: DataFrame, stats: DataFrame, neighbours: int = 30, draws: int = 1000, seed: int = 1927, threshold: float | None = None, digits: int = 12) -> DataFrame:
    """ligand_receptor()'s rows with p_value, p_value_fdr and nlog10_p_value_fdr.

    In each draw ligand and receptor give way to neighbours by mean and variance, drawn apart; p is (draws whose product reaches the
    score + 1) / (draws + 1). Missing specificities never reach it. Rates are found within each sender and receiver, from p at six
    digits; rows at or below the threshold are left out there and get 1. pairs(ligand, receptor, annotation) may repeat.
    """
    scored = stored(ligand_receptor(specificity, pairs), "lr-scores")
    both = stored(scored.select("ligand", "receptor").distinct(), "lr-pairs")
    near = stored(feature_neighbours(stats, both.select(F.col("ligand").alias("feat")).union(both.select("receptor")).distinct(), neighbours), "lr-neighbours")
    keys = ["ligand", "receptor", "sender", "receiver"]
    over = _reached(scored, near, stored(specificity.select("feat", "grp", "score"), "lr-specificity"), neighbours, draws, seed, digits)
    tested = stored(scored.join(over, keys, "left").withColumn("p_value", (F.coalesce("count", F.lit(0)) + F.lit(1.0)) / F.lit(draws + 1.0)).drop("count"), "lr-tested")
    fits = F.lit(True) if threshold is None else F.col("score") > F.lit(threshold)
    rated = bh(tested.where(fits).withColumn("__p", F.round("p_value", 6)), "__p", ["sender", "receiver"], ["ligand", "receptor", "annotation"]).drop("__p").withColumnRenamed("fdr", "p_value_fdr")
    if threshold is not None:
        rated = rated.unionByName(tested.where(~fits | F.col("score").isNull()).withColumn("p_value_fdr", F.lit(1.0)))
    return rated.withColumn("nlog10_p_value_fdr", F.greatest(F.lit(0.0), -F.log10(F.col("p_value_fdr") + F.lit(1e-10))))


def query_markers(markers: DataFrame, limit: int | None = None, offset: int = 0, min_score: float | None = None, max_score: float | None = None, **wanted: str | list[str]) -> DataFrame:
    """Marker records by descending score, then feature and the wanted columns: each wanted column is one of its values, scores are
    within inclusive limits. Scores and paging below 0, or a column that is not there, raise."""
    if any(x is not None and x < 0 for x in (min_score, max_score, limit, offset)):
        raise ValueError("scores, limit and offset must be 0 or more")
    if min_score is not None and max_score is not None and min_score > max_score:
        raise ValueError("min_score is over max_score")
    for name, values in wanted.items():
        if name not in markers.columns:
            raise KeyError(f"{name}: columns are {', '.join(markers.columns)}")
        markers = markers.where(F.col(name).isin([values] if isinstance(values, str) else list(values)))
    if min_score is not None:
        markers = markers.where(F.col("score") >= min_score)
    if max_score is not None:
        markers = markers.where(F.col("score") <= max_score)
    found = markers.orderBy(F.round("score", 9).desc(), "feat", *[c for c in markers.columns if c not in ("feat", "score")])
    found = found.offset(offset) if offset else found
    return found if limit is None else found.limit(limit)
