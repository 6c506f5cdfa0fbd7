import itertools
import math

import numpy as np
import pytest

from celloom import session
from celloom.operators import decompose, doublets, filters, graphs, layout, markers, metrics, motifs, neighbors, normalize, projection, stats, tidy
from celloom.plans import catalog, files  # noqa: F401
from celloom.plans import tidy as plans
from celloom.sources import tables
from conftest import SF

F = stats.F


def test_bh_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, None if g == 2 and i % 5 == 0 else "abc"[g % 3] if g else None, float(rng.integers(1, 60)) / 64 if i % 11 else None) for i, g in enumerate(rng.integers(0, 4, 900))]
    df = spark.createDataFrame(rows, "id long, grp string, p double")
    for by in (["grp"], None):
        got = {r.id: r.fdr for r in stats.bh(df, "p", by).collect()}
        assert len(got) == 900
        for g in {r[1] for r in rows} if by else [None]:
            own = [(p, i) for i, h, p in rows if p is not None and (not by or h == g)]
            for p, i in own:
                want = min(q * len(own) / sum(x <= q for x, _ in own) for q, _ in own if q >= p)
                assert got[i] == pytest.approx(min(1.0, want))
        assert all(got[i] is None for i, _, p in rows if p is None)
    assert stats.bh(df.limit(0), "p").count() == 0


def test_plane_neighbours_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    plane = np.round(np.concatenate([rng.normal(size=(300, 2)), np.zeros((60, 2)), rng.integers(0, 3, (60, 2))]), 2)
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in enumerate(plane)], "feat long, mean double, var double")
    want = {}
    for i, p in enumerate(plane):
        order = sorted((j for j in range(len(plane)) if j != i), key=lambda j: (round(math.dist(p, plane[j]), 9), j))
        want[i] = order[:12]
    for most in (neighbors.PLANE, 10):
        monkeypatch.setattr(neighbors, "PLANE", most)
        got = {}
        for r in neighbors.feature_neighbours(df, df.select("feat").where("feat % 7 = 0"), 12).orderBy("feat", "rank").collect():
            got.setdefault(r.feat, []).append(r.neighbour)
        assert got == {i: w for i, w in want.items() if i % 7 == 0}


def test_centred_svd(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson(1.0, (60, 12)).astype(float)
    df = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*x.nonzero())], "cell long, feat long, x double")
    centres = spark.createDataFrame([(j, float(m)) for j, m in enumerate(x.mean(0))], "feat long, centre double")
    scores, values, loadings = decompose.svd(df, 3, rounds=30, centres=centres)
    u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert values == pytest.approx(s[:3])
    got = np.array([r.vec for r in scores.orderBy("cell").collect()])
    assert np.abs(got) == pytest.approx(np.abs(u[:, :3] * s[:3]), abs=1e-6)
    assert loadings.count() == 12 and decompose.svd(df.limit(0), 3)[2].count() == 0


def test_masks_by_place_and_array(spark):
    cells = spark.createDataFrame([(i * 3, float(i)) for i in range(10)], "cell long, v double")
    entries = spark.createDataFrame([(0, 1, 1.0)], "cell long, feat long, x double")
    ids = lambda mask, **k: sorted(r.cell for r in filters.filter_cells(entries, cells, mask=mask, **k).collect())
    assert ids(np.arange(10) % 2 == 0) == [0, 6, 12, 18, 24] and ids(np.array([1, 1, -1])) == [3, 27] and ids([0]) == [0]
    assert ids({"v": np.array([1.0, 2.0])}) == [3, 6] and ids({"v": (np.float64(7), None)}) == [21, 24, 27]
    for bad, error in ((np.ones(3, bool), ValueError), (np.array([10]), IndexError)):
        with pytest.raises(error):
            ids(bad)
    with pytest.raises(ValueError):
        ids({"v": -1.0}, required=True)


def test_names_and_guards(spark):
    feats = spark.createDataFrame([("RNA", 1, "a"), ("GA", 2, "a"), ("GA", 3, "b")], "modality string, feat long, symbol string")
    assert tidy.resolve_feature(feats, "a", "GA").first().feat == 2 and tidy.resolve_feature(feats, "b").first().feat == 3
    for name, modality, error in (("x", None, KeyError), ("a", None, ValueError), ("b", "RNA", KeyError)):
        with pytest.raises(error):
            tidy.resolve_feature(feats, name, modality)
    sets = spark.createDataFrame([(s, f) for s in "abc" for f in range(10)], "set string, feat long")
    with pytest.raises(ValueError):
        tidy.recovery(sets, spark.range(1).withColumnRenamed("id", "feat"))
    with pytest.raises(KeyError):
        tidy.select(feats, ["nothing"])
    with pytest.raises(ValueError):
        tidy.split_values(spark.range(60), "id")
    with pytest.raises(ValueError):
        tidy.split_values(spark.range(3).select(F.col("id").cast("double")), "id")
    assert [r.v for r in tidy.categories(spark.createDataFrame([("10",), ("9",), ("b",), (None,), ("a",)], "v string"), "v").orderBy("place").collect()] == ["9", "10", "a", "b"]
    assert len(set(tidy.palette(12))) == 12 and all(c.startswith("#") and len(c) == 7 for c in tidy.palette(3))


def test_otsu_and_noise():
    scores, weights = np.array([0.0, 0.1, 0.2, 0.8, 0.9]), np.array([50.0, 80, 40, 10, 12])
    every = np.repeat(scores, weights.astype(int))
    between = {t: (every <= t).mean() * (every > t).mean() * (every[every <= t].mean() - every[every > t].mean()) ** 2 for t in scores[:-1]}
    assert max(between, key=between.get) < doublets.threshold(scores, weights) < 0.8
    assert doublets.threshold(scores[:1], weights[:1]) == math.inf
    rng = np.random.default_rng(4)
    mean = np.exp(rng.normal(0, 1, 500))
    counts = rng.poisson(mean, (400, 500)).astype(float)
    counts[:, :20] *= rng.gamma(0.4, 2.5, (400, 20))
    held = counts[:, counts.mean(0) > 0]
    v = doublets.noise_excess(held.mean(0), held.var(0) / held.mean(0), 50, 0.001)
    assert np.median(v[:20]) > 1.5 * np.median(v[20:])


def test_variable_features(spark):
    rng = np.random.default_rng(5)
    counts = rng.poisson(2.0, (80, 40))
    counts[:40, :5] += rng.poisson(12, (40, 5))
    df = spark.createDataFrame([(int(i), int(j), float(counts[i, j])) for i, j in zip(*counts.nonzero())], "cell long, feat long, x double")
    found = {r.feat for r in doublets.variable_features(df, spark.range(80).withColumnRenamed("id", "cell"), percentile=85).collect()}
    assert set(range(5)) <= found and len(found) <= 7


def test_connected_parts(spark):
    edges = [(1, 2), (2, 3), (3, 9), (10, 11), (20, 20)] + [(i, i + 1) for i in range(100, 140)]
    df = spark.createDataFrame([e for a, b in edges for e in ((a, b), (b, a))], "a long, b long")
    root = {r.node: r.root for r in graphs.connected(df).collect()}
    assert root == {1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 11: 10} | {i: 100 for i in range(100, 141)}
    assert graphs.connected(df.limit(0)).count() == 0


def test_layout_keeps_groups_apart(spark, monkeypatch):
    rng = np.random.default_rng(6)
    edges = [(a, b, 1.0) for g in range(3) for a, b in itertools.combinations(range(20 * g, 20 * g + 20), 2) if rng.random() < 0.4]
    edges += [(b, a, w) for a, b, w in edges]
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    at = np.array([(r.x, r.y) for r in layout.umap(df, rounds=150).orderBy("node").collect()])
    d = np.linalg.norm(at[:, None] - at[None], axis=2)
    same = np.arange(60)[:, None] // 20 == np.arange(60)[None] // 20
    assert np.isfinite(at).all() and np.median(d[same]) < 0.5 * np.median(d[~same])
    assert layout.umap(df.limit(0)).count() == 0
    monkeypatch.setattr(layout, "NODES", 10)
    with pytest.raises(ValueError):
        layout.umap(df)
    a, b = layout.curve(0.1)
    assert 1 / (1 + a * 0.05 ** (2 * b)) > 0.95 and 1 / (1 + a * 3 ** (2 * b)) < 0.1


def test_reference_round_trip_and_modes(spark, tmp_path):
    reference, entries, cells, known = plans._halves(spark, SF)
    here = projection.project(reference, entries, cells)
    reference.save(f"file://{tmp_path}/r")
    again = projection.Reference.load(spark, f"file://{tmp_path}/r")
    assert projection.fingerprint(projection.project(again, entries, cells)) == projection.fingerprint(here)
    own = projection.project(reference, entries, cells, "self")
    assert own.count() == here.count() and projection.fingerprint(own) != projection.fingerprint(here)
    test = projection.novelty_test(reference, here).first()
    assert test.n1 == cells.count() and test.n2 == known.count() and 0 <= test.ks <= 1
    again.totals.limit(3).write.mode("overwrite").parquet(f"file://{tmp_path}/r/totals2")
    spark.read.parquet(f"file://{tmp_path}/r/totals2").write.mode("overwrite").parquet(f"file://{tmp_path}/r/totals")
    with pytest.raises(ValueError):
        projection.Reference.load(spark, f"file://{tmp_path}/r")


def test_clusters_and_stitching_run_whole(spark):
    found = catalog.queries()["gdr_clusters"](spark, SF).toPandas()
    cells = catalog.model.cells(spark, SF).count()
    assert len(found) == cells * found.set.nunique() and (found.groupby("cell").score.apply(lambda s: (s**2).sum()) < 1 + 1e-5).all()
    moved = catalog.queries()["stitch_space"](spark, SF).toPandas()
    assert moved.node.nunique() == 500 and len(moved) == 500 * 64
    order = catalog.queries()["crosstab_order"](spark, SF).toPandas()
    assert sorted(order[order.side == "query"].place) == list(range(5))
    assert catalog.queries()["umap_layout"](spark, SF).count() == 500


def test_scores_of_cells_without_features_are_zero(spark):
    cells = spark.createDataFrame([(1,), (2,), (3,)], "cell long")
    z = spark.createDataFrame([(1, 10, 2.0), (2, 99, 1.0)], "cell long, feat long, z double")
    moments = spark.createDataFrame([(10, 1.0, 1.0), (11, 1.0, 1.1), (99, 9.0, 9.0)], "feat long, mean double, var double")
    sets = spark.createDataFrame([("s", 10, 1.0), ("t", 11, 1.0)], "set string, feat long, weight double")
    got = {(r.cell, r.set): r.score for r in markers.score_sets(z, moments, sets, "z", cells, neighbours=1).collect()}
    assert got == {(1, "s"): 2.0, (1, "t"): -2.0, (2, "s"): 0.0, (2, "t"): 0.0, (3, "s"): 0.0, (3, "t"): 0.0}
    best = {r.cell: (r.label, r.score) for r in markers.predict(markers.score_sets(z.withColumn("z", -F.col("z")), moments, sets, "z", cells, neighbours=1)).collect()}
    assert best == {1: ("t", 2.0), 2: ("s", 0.0), 3: ("s", 0.0)}


def test_readers(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.read_10x(spark, "x.h5")
    with pytest.raises(FileNotFoundError):
        tables.read_10x(spark, f"file://{tmp_path}")
    entries = spark.createDataFrame([(0, 1, 2.0), (1, 0, 3.5)], "cell long, feat long, x double")
    cells = spark.createDataFrame([(0, "A"), (1, "B")], "cell long, barcode string")
    feats = spark.createDataFrame([(0, "g0", "S0", "Gene Expression"), (1, "g1", "S1", "Peaks")], "feat long, id string, symbol string, type string")
    tables.write_mtx(entries, cells, feats, f"file://{tmp_path}/outs/raw_feature_bc_matrix")
    e, c, f = tables.read_10x(spark, f"file://{tmp_path}", "all", "p-")
    assert sorted(tuple(r) for r in e.collect()) == [(0, 1, 2.0), (1, 0, 3.5)] and [r.barcode for r in c.orderBy("cell").collect()] == ["p-A", "p-B"]
    tables.write_mtx(entries, cells, feats.limit(1), f"file://{tmp_path}/other")
    with pytest.raises(ValueError):
        tables.read_samples(spark, [f"file://{tmp_path}", f"file://{tmp_path}/other"], "all")
    (tmp_path / "lines.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = tables.numbered_lines(spark, f"file://{tmp_path}/lines.txt")
        assert got.rdd.getNumPartitions() >= 1 and sorted((r.line, r.value) for r in got.collect()) == [(i, f"line {i}") for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_log_odds_guards():
    assert np.isfinite(motifs.log_odds(np.array([[1.0, 0], [0, 0], [0, 0], [0, 0]]), np.array([0.0, 0.5, 0.5, 0.0]))).all()


def test_broadcast_by_bytes_and_shared_folder(spark, monkeypatch):
    plan = lambda df: spark.range(5).join(df, "id")._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(session.small(spark.range(100), width=1000)) and "BroadcastHashJoin" not in plan(session.small(spark.range(100_000), width=1000))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    class Far:
        master = "spark://x"

    class Session:
        sparkContext = Far()
        conf = {}

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_marker_tables(spark):
    df = spark.createDataFrame([(f, t, s, x) for f, t, s, x in ((1, "a", "s1", 0.5), (2, "a", "s1", 0.7), (3, "b", "s2", 0.9), (2, "b", "s2", 0.1))], "feat long, cell_type string, study string, score double")
    sets = spark.createDataFrame([("x", 1), ("x", 2), ("y", 8)], "set string, feat long")
    got = {r.set: (r.label, r["count"], r.features) for r in tidy.best_matches(df, sets, ["cell_type", "study"], 2).collect()}
    assert got == {"x": ("a|s1", 2, "1,2"), "y": ("Unassigned", 0, None)}
    assert metrics.svd_order(spark.createDataFrame([("a", "x", 1.0), ("b", "y", 1.0), ("c", "x", 0.9)], "q string, r string, share double"), "q", "r")[0][0] == "b"
    assert normalize.infog(spark.createDataFrame([], "cell long, feat long, x double"), spark.range(0).withColumnRenamed("id", "cell")).count() == 0


def test_recall_of_inverted_lists(spark, monkeypatch):
    held = catalog.model.points(spark, SF)
    exact = {(r.query, r.neighbour) for r in neighbors.knn(held, held, 15).collect()}
    got = {(r.query, r.neighbour): r.distance for r in neighbors.knn_lists(held, held, 15).collect()}
    assert len(got.keys() & exact) >= 0.9 * len(exact)
    monkeypatch.setattr(neighbors, "BLOCK", 7)  # lists in several blocks give the same
    assert {(r.query, r.neighbour): r.distance for r in neighbors.knn_lists(held, held, 15).collect()} == got
    every = {(r.query, r.neighbour) for r in neighbors.knn_lists(held, held, 15, lists=4, probes=4).collect()}
    assert every == exact and neighbors.knn_lists(held.limit(0), held, 15).count() == 0
