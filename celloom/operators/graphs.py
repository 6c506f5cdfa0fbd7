"""Communities of weighted graphs, modularity, pruned edges, smoothing over edges, and trees of groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from celloom.session import ship, small, stored

#: Tasks for each core in which nodes look for communities.
TASKS = 2


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, weight) in both directions, once each, of edges given in one or both; the greater weight stands, loops are left out."""
    one = edges.where("a != b and weight > 0").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.max("weight").alias("weight"))
    ends = F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b"))))
    return one.select(ends.alias("e"), "weight").select("e.a", "e.b", "weight")


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity) of labels(node, label) over edges in both directions: sum over labels of inside / 2m - resolution (total / 2m)^2."""
    ends = edges.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b")
    sums = ends.groupBy(F.col("la").alias("label")).agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("weight")).otherwise(0.0)).alias("inside"))
    return sums.agg((F.sum("inside") / F.sum("total") - F.lit(resolution) * F.sum(F.col("total") * F.col("total")) / (F.sum("total") * F.sum("total"))).alias("modularity"))


def _quality(edges: DataFrame, named: DataFrame, scale: DataFrame, resolution: float) -> float | None:
    """Modularity with each node's own total weight m, summed over all groups by their weight."""
    ends = edges.join(named.toDF("a", "la"), "a").join(named.toDF("b", "lb"), "b")
    sums = ends.groupBy(F.col("la").alias("label")).agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("weight")).otherwise(0.0)).alias("inside"))
    held = sums.join(named.join(scale, "node").groupBy("label").agg(F.max("m").alias("m")), "label")
    return held.agg(F.sum(F.col("inside") - F.lit(resolution) * F.col("total") * F.col("total") / F.col("m")) / F.sum("total")).first()[0]


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 10, levels: int = 5, groups: DataFrame | None = None) -> DataFrame:
    """(node, community): communities of high modularity, numbered from 0 by falling size, then least node.

    In a round every node weighs the communities of its neighbours, and the half of the nodes that a hash picks for the round moves
    to the best one (ties: the smaller name), so that two nodes cannot swap for ever. When a round of both halves moves nothing, or
    after `rounds` such rounds, communities become the nodes of the next level; a level that doesn't raise the modularity is
    dropped and ends the work. Every round is stored. Nodes have long ids and occur in an edge; edges may be given in one or both
    directions. groups(node, grp), if given, hold all nodes; no edge joins two groups, and each has its own total weight. At the end
    a community that is not connected is divided into its connected parts, which never lowers the modularity. Labels differ from
    other implementations.

    A graph of at most SMALL edges is divided by the driver in the same way, but node by node, which takes fewer passes.
    """
    whole = stored(both_ways(edges), "graph")
    if whole.limit(2 * SMALL + 1).count() <= 2 * SMALL:
        named = _of_small(whole, groups, resolution, levels)
        return _numbered(_joined(whole, named))
    strength = whole.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("k"))
    owned = strength.join(groups, "node") if groups is not None else strength.withColumn("grp", F.lit(0))
    totals = owned.groupBy("grp").agg(F.sum("k").alias("m"))
    first = scale = stored(owned.join(small(stored(totals, "graph-totals")), "grp").select("node", "m"), "graph-scale")
    named = stored(scale.select("node", F.col("node").alias("label")), "labels")
    level, reached = whole, _quality(whole, named, scale, resolution)
    for _ in range(levels if reached is not None else 0):
        sums = level.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("k"))
        state = stored(sums.join(scale, "node").select("node", "k", "m", F.col("node").alias("c")), "graph-state")
        state = _moved(level, state, resolution, rounds)
        joined = stored(named.join(state.select(F.col("node").alias("label"), "c"), "label").select("node", F.col("c").alias("label")), "labels")
        now = _quality(whole, joined, first, resolution)
        if not now > reached + 1e-9:
            break
        named, reached = joined, now
        scale = stored(state.groupBy(F.col("c").alias("node")).agg(F.max("m").alias("m")), "graph-scale")
        ends = level.join(state.select(F.col("node").alias("a"), F.col("c").alias("u")), "a").join(state.select(F.col("node").alias("b"), F.col("c").alias("v")), "b")
        level = stored(ends.groupBy(F.col("u").alias("a"), F.col("v").alias("b")).agg(F.sum("weight").alias("weight")), "graph")
    return _numbered(_joined(whole, named))


#: Most nodes whose communities the driver and every task hold as arrays; of more they stay tables.
LABELS = 20_000_000


def _moved(level: DataFrame, state: DataFrame, resolution: float, rounds: int) -> DataFrame:
    """state(node, k, m, c) after the rounds of one level."""
    if state.limit(LABELS + 1).count() > LABELS:
        return _moved_tables(level, state, resolution, rounds)
    spark = state.sparkSession
    ship(spark)
    bits = F.expr(" | ".join(f"shiftleft(pmod(xxhash64(node, {r}), 2), {r})" for r in range(rounds))) if rounds else F.lit(0)
    own = state.select("node", "k", "m", bits.cast("long").alias("bits"))
    held = state.select(F.col("node").cast("long").alias("node"), "k", "c").orderBy("node").toArrow()
    nodes, k = held["node"].to_numpy(), held["k"].to_numpy()
    c = np.searchsorted(nodes, held["c"].to_numpy())
    names = spark.sparkContext.broadcast(nodes)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                sizes, at = batch.bs.map(len).to_numpy(), np.searchsorted(names.value, np.concatenate([*batch.bs, np.zeros(0, np.int64)])).astype(np.int32)
                ends = np.cumsum(sizes)[:-1]
                yield pd.DataFrame({"i": np.searchsorted(names.value, batch.node.to_numpy()).astype(np.int32), "k": batch.k, "m": batch.m, "bits": batch.bits, "js": np.split(at, ends), "ws": batch.ws})

    near = level.where("a != b").groupBy(F.col("a").alias("node")).agg(F.collect_list(F.struct("b", F.col("weight").cast("double").alias("w"))).alias("own"))
    near = near.join(own, "node").select(F.col("node").cast("long").alias("node"), "k", "m", "bits", F.col("own.b").cast("array<long>").alias("bs"), F.col("own.w").alias("ws"))
    near = near.repartition(TASKS * spark.sparkContext.defaultParallelism)
    near = stored(near.mapInPandas(place, "i int, k double, m double, bits long, js array<int>, ws array<double>"), "graph-near")
    quiet = 0
    for turn in range(2 * rounds):
        told = spark.sparkContext.broadcast((c, np.bincount(c, k, len(c))))

        def best(batches: Iterator[pd.DataFrame], turn: int = turn, told=told) -> Iterator[pd.DataFrame]:
            c, total = told.value
            for batch in batches:
                batch = batch[(batch.bits.to_numpy() >> (turn // 2)) % 2 == turn % 2]
                if not len(batch):
                    continue
                i, k, m = batch.i.to_numpy(), batch.k.to_numpy(), batch.m.to_numpy()
                sizes = batch.js.map(len).to_numpy()
                row = np.concatenate([np.repeat(np.arange(len(i)), sizes), np.arange(len(i))])
                group = np.concatenate([c[np.concatenate(list(batch.js))], c[i]])
                key, at = np.unique(row * len(c) + group, return_inverse=True)
                weight = np.bincount(at, np.concatenate([*batch.ws, np.zeros(len(i))]))
                row, group = key // len(c), key % len(c)
                stays = group == c[i[row]]
                gain = np.round(weight - resolution * k[row] * (total[group] - np.where(stays, k[row], 0.0)) / m[row], 9)
                order = np.lexsort((group, -gain, row))
                first = order[np.flatnonzero(np.r_[True, np.diff(row[order]) > 0])]
                moves = gain[first] > gain[stays]
                yield pd.DataFrame({"i": i[moves], "c": group[first][moves]})

        found = near.mapInPandas(best, "i int, c long").toArrow()
        told.unpersist()
        if len(found):
            c = c.copy()
            c[found["i"].to_numpy()] = found["c"].to_numpy()
        quiet = 0 if len(found) else quiet + 1
        if quiet == 2:
            break
    labels = spark.createDataFrame(pa.table({"node": nodes, "c": nodes[c]}), "node long, c long")
    return stored(state.drop("c").join(stored(labels, "graph-labels"), "node").select("node", "k", "m", "c"), "graph-state")


def _moved_tables(level: DataFrame, state: DataFrame, resolution: float, rounds: int) -> DataFrame:
    """_moved() of any number of nodes."""
    links, quiet = level.where("a != b"), 0
    for turn in range(2 * rounds):
        all_of = state.groupBy("c").agg(F.sum("k").alias("all"))
        near = links.join(state.select(F.col("node").alias("b"), "c"), "b").select(F.col("a").alias("node"), "c", F.col("weight").alias("w"))
        near = near.unionByName(state.select("node", "c", F.lit(0.0).alias("w"))).groupBy("node", "c").agg(F.sum("w").alias("w"))
        seen = near.join(state.select("node", "k", "m", F.col("c").alias("own")), "node").join(all_of, "c")
        rest = F.col("all") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - F.lit(resolution) * F.col("k") * rest / F.col("m"), 9)
        best = seen.withColumn("gain", gain).groupBy("node", "k", "m", "own").agg(
            F.min(F.struct((-F.col("gain")).alias("cost"), "c")).alias("best"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay")
        )
        mine = F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2
        moves = mine & (-F.col("best.cost") > F.col("stay"))
        state = stored(best.select("node", "k", "m", F.when(moves, F.col("best.c")).otherwise(F.col("own")).alias("c"), moves.alias("moved")), "graph-state")
        quiet = 0 if state.where("moved").limit(1).count() else quiet + 1
        state = state.drop("moved")
        if quiet == 2:
            break
    return state


def _joined(whole: DataFrame, named: DataFrame) -> DataFrame:
    """(node, label) with each label divided into its connected parts."""
    inside = whole.join(named.toDF("a", "la"), "a").join(named.toDF("b", "lb"), "b").where("la = lb").select("a", "b")
    parts = connected(inside).toDF("node", "part")
    return stored(named.join(parts, "node", "left").select("node", F.coalesce("part", "node").alias("label")), "labels")


def _numbered(named: DataFrame) -> DataFrame:
    order = Window.orderBy(F.col("n").desc(), "first")
    ids = named.groupBy("label").agg(F.count("*").alias("n"), F.min("node").alias("first")).select("label", (F.row_number().over(order) - 1).alias("community"))
    return named.join(small(stored(ids, "graph-ids")), "label").select("node", "community")


#: Most edges of a graph that the driver divides by itself.
SMALL = 500_000


def _of_small(whole: DataFrame, groups: DataFrame | None, resolution: float, levels: int) -> DataFrame:
    """(node, label) of a small graph."""
    spark = whole.sparkSession
    held = whole.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("weight").cast("double").alias("w")).orderBy("a", "b").toArrow()
    a, b, w = (held[c].to_numpy() for c in "abw")
    nodes = np.unique(a)
    of = np.zeros(len(nodes), np.int64)
    if groups is not None and len(nodes):
        ids = spark.createDataFrame(pa.table({"node": nodes}))
        told = groups.join(ids, "node", "left_semi").select("node", F.dense_rank().over(Window.orderBy("grp")).alias("g")).toArrow()
        of[np.searchsorted(nodes, told["node"].to_numpy())] = told["g"].to_numpy()
    label = divide(np.searchsorted(nodes, a), np.searchsorted(nodes, b), w, of, resolution, levels)
    return stored(spark.createDataFrame(pa.table({"node": nodes, "label": nodes[label] if len(nodes) else nodes}), "node long, label long"), "labels")


def divide(a: np.ndarray, b: np.ndarray, w: np.ndarray, group: np.ndarray, resolution: float = 1.0, levels: int = 5) -> np.ndarray:
    """Each node's community, named by one of its nodes; edges in both directions, nodes from 0, no edge between two groups.

    Nodes whose neighbours moved are looked at again until none moves to a better community; then communities become nodes.
    """
    n = len(group)
    out = np.arange(n)
    total = np.bincount(group[a], w, int(group.max()) + 1 if n else 1) if n else np.zeros(1)
    scale = total[group] if n else np.zeros(0)
    for _ in range(levels):
        size = len(scale)
        inside = a == b
        near: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for i, j, x in zip(a[~inside].tolist(), b[~inside].tolist(), w[~inside].tolist(), strict=True):
            near[i].append((j, x))
        k = np.bincount(a, w, size).tolist()
        m, own, held, moved = scale.tolist(), list(range(size)), list(k), False
        queue, waits = list(range(size)), [True] * size
        at = 0
        while at < len(queue):
            i = queue[at]
            at += 1
            waits[i] = False
            here = own[i]
            held[here] -= k[i]
            found = {here: 0.0}
            for j, x in near[i]:
                found[own[j]] = found.get(own[j], 0.0) + x
            best = min(found, key=lambda c: (-round(found[c] - resolution * k[i] * held[c] / m[i], 9), c != here, c))
            held[best] += k[i]
            if best != here:
                own[i], moved = best, True
                for j, _ in near[i]:
                    if own[j] != best and not waits[j]:
                        waits[j] = True
                        queue.append(j)
        if not moved:
            break
        names, short = np.unique(own, return_inverse=True)
        out = short[out]
        scale = scale[names]
        key, back = np.unique(short[a] * len(names) + short[b], return_inverse=True)
        a, b, w = key // len(names), key % len(names), np.bincount(back, w)
    first = np.full(int(out.max()) + 1 if n else 0, n)
    np.minimum.at(first, out, np.arange(n))
    return first[out]


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's connected part, of edges(a, b) given in both directions.

    In a round a node takes the least root among its neighbours' and its own, then its root's root; rounds are stored, and their
    number grows with the logarithm of the longest path in most graphs.
    """
    held = stored(edges.where("a != b").distinct(), "edges")
    state = stored(held.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while True:
        near = held.join(state.toDF("b", "r"), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        least = stored(state.join(near, "node").select("node", "root", F.least("root", "r").alias("next")), "roots")
        jumped = least.join(least.select(F.col("node").alias("next"), F.col("next").alias("jump")), "next")
        now = stored(jumped.select("node", F.col("root").alias("before"), F.least("next", "jump").alias("root")), "roots")
        if not now.where("root != before").limit(1).count():
            return now.select("node", "root")
        state = now.select("node", "root")


def stitch_space(points: DataFrame, entries: DataFrame, cells: DataFrame, batch: str, k: int = 3, n: int = 20, least: float = 0.1, rounds: int = 1) -> DataFrame:
    """(node, dim, value): points(id, vec) of several batches moved towards their alike in all batches.

    Each point has k neighbours in every batch; the graph within a batch gives its communities, whose n best markers are compared:
    edges between batches stay where the marker sets of their communities have a Jaccard of at least the least. Then points move to
    the weighted means of their neighbours. entries(cell, feat, x), cells(cell, batch).
    """
    from celloom.operators import markers, neighbors, normalize, stats

    held = stored(points.join(cells.select(F.col("cell").alias("id"), F.col(batch).alias("batch")), "id"), "stitch-points")
    near = stored(neighbors.knn(held, held, k, within="batch"), "stitch-neighbours")
    edges = stored(both_ways(near.select(F.col("query").alias("a"), F.col("neighbour").alias("b"), F.lit(1.0).alias("weight"))), "stitch-edges")
    groups = stored(held.select(F.col("id").alias("node"), F.col("batch").alias("grp")), "stitch-groups")
    found = stored(within_groups(edges, groups), "stitch-communities")
    z = normalize.infog(entries, cells).join(found.select(F.col("node").alias("cell")), "cell", "left_semi")
    best = markers.top_per_group(markers.cosg(z, found.select(F.col("node").alias("cell"), F.col("community").alias("cluster")), "cluster", "z"), "cluster", n)
    alike = stats.jaccard(stored(best, "stitch-markers"), "cluster", "feat").where(F.col("jaccard") >= least)
    nodes = groups.join(found, "node").select("node", F.col("grp").alias("batch"), F.col("community").alias("cluster"))
    kept = stored(prune(edges, nodes, alike.select(F.col("a").alias("ca"), F.col("b").alias("cb"))), "stitch-kept")
    out = held.select(F.col("id").alias("node"), F.posexplode(F.col("vec").cast("array<double>")).alias("dim", "value"))
    for _ in range(rounds):
        out = stored(stitch(kept, out), "stitch-moved")
    return out


def within_groups(edges: DataFrame, groups: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(node, community): each group of groups(node, grp) is divided by its own edges; names are group-00, group-01 ... by falling size.

    All groups are divided in one run, as no edge joins two of them. A node without an edge in its group is a community of its own.
    """
    own = edges.join(groups.toDF("a", "ga"), "a").join(groups.toDF("b", "gb"), "b").where("ga = gb").select("a", "b", "weight")
    found = groups.join(communities(own, resolution, groups=groups), "node", "left").withColumn("part", F.coalesce(F.col("community").cast("string"), F.concat(F.lit("n"), F.col("node").cast("string"))))
    order = Window.partitionBy("grp").orderBy(F.col("n").desc(), "first")
    ids = found.groupBy("grp", "part").agg(F.count("*").alias("n"), F.min("node").alias("first")).withColumn("i", F.row_number().over(order) - 1)
    text = F.col("i").cast("string")
    number = F.when(F.col("i") < 10, F.concat(F.lit("0"), text)).otherwise(text)
    return found.join(ids.select("grp", "part", "i"), ["grp", "part"]).select("node", F.concat_ws("-", F.col("grp").cast("string"), number).alias("community"))


def prune(edges: DataFrame, nodes: DataFrame, compatible: DataFrame) -> DataFrame:
    """The edges within a batch, or between clusters that compatible(ca, cb) lists in either order; nodes(node, batch, cluster)."""
    ends = edges.join(nodes.toDF("a", "ba", "ca"), "a").join(nodes.toDF("b", "bb", "cb"), "b")
    pairs = compatible.select("ca", "cb").unionByName(compatible.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"))).distinct().withColumn("__fit", F.lit(True))
    return ends.join(small(pairs), ["ca", "cb"], "left").where("ba = bb or __fit").select("a", "b", "weight")


def stitch(edges: DataFrame, points: DataFrame) -> DataFrame:
    """(node, dim, value): points(node, dim, value) moved to the weighted mean of their neighbours; a node without neighbours stays."""
    total = edges.groupBy("a").agg(F.sum("weight").alias("all"))
    share = edges.join(total, "a").select(F.col("a").alias("to"), F.col("b").alias("node"), (F.col("weight") / F.col("all")).alias("share"))
    moved = share.join(points, "node").groupBy(F.col("to").alias("node"), "dim").agg(F.sum(F.col("share") * F.col("value")).alias("__m"))
    return points.join(moved, ["node", "dim"], "left").select("node", "dim", F.coalesce("__m", "value").alias("value"))


#: Most groups of a tree; the driver holds their distances.
TREE_GROUPS = 4000


def linkage(means: np.ndarray, method: str = "average") -> np.ndarray:
    """Rows (left, right, height, size) of the agglomeration of the rows of means; merged groups are numbered on. average or ward."""
    n = len(means)
    if n > TREE_GROUPS:
        raise ValueError(f"over {TREE_GROUPS} groups")
    if method not in ("average", "ward"):
        raise ValueError(method)
    d = np.sqrt(((means[:, None] - means[None]) ** 2).sum(2)) if n else np.zeros((0, 0))
    np.fill_diagonal(d, np.inf)
    name, size, out = np.arange(n), np.ones(n), []
    for step in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        height = d[i, j]
        out.append((*sorted((name[i], name[j])), height, size[i] + size[j]))
        if method == "average":
            row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        else:
            with np.errstate(invalid="ignore"):
                row = np.sqrt(((size[i] + size) * d[i] ** 2 + (size[j] + size) * d[j] ** 2 - size * height**2) / (size[i] + size[j] + size))
        row[[i, j]] = np.inf
        row[np.isnan(row)] = np.inf
        d[i], d[:, i], d[j], d[:, j] = row, row, np.inf, np.inf
        name[i], size[i] = n + step, size[i] + size[j]
    return np.array(out, float).reshape(-1, 4)
