import itertools
import math
from collections import Counter
from hashlib import md5

import numpy as np
import pytest
from conftest import SF

from celloom.operators import doublets, graphs, markers, motifs, provenance, stats
from celloom.plans import catalog
from celloom.sources import model


def planted(groups=4, size=12, inside=0.8, between=0.05, seed=1):
    draw, nodes = np.random.default_rng(seed), range(groups * size)
    return [(a, b, 1.0) for a, b in itertools.combinations(nodes, 2) if draw.random() < (inside if a // size == b // size else between)]


def modularity(edges, label):
    m2, inside, total = 2 * sum(w for *_, w in edges), Counter(), Counter()
    for a, b, w in edges:
        total[label[a]] += w
        total[label[b]] += w
        inside[label[a]] += 2 * w * (label[a] == label[b])
    return sum(inside[c] / m2 - (total[c] / m2) ** 2 for c in total)


@pytest.mark.parametrize("most", [graphs.SMALL, 0])
def test_planted_communities_and_modularity(spark, monkeypatch, most):
    monkeypatch.setattr(graphs, "SMALL", most)
    edges = planted()
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    label = {r.node: r.community for r in graphs.communities(df).collect()}
    assert all(len({label[i] for i in range(12 * g, 12 * g + 12)}) == 1 for g in range(4)) and len(set(label.values())) == 4
    held = spark.createDataFrame(list(label.items()), "node long, label int")
    assert graphs.modularity(graphs.both_ways(df), held).first()[0] == pytest.approx(modularity(edges, label))
    assert graphs.communities(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [graphs.SMALL, 0])
def test_communities_within_groups(spark, monkeypatch, most):
    monkeypatch.setattr(graphs, "SMALL", most)
    edges = spark.createDataFrame(planted(4, 10), "a long, b long, weight double")
    groups = spark.createDataFrame([(i, "xy"[i >= 20]) for i in range(41)], "node long, grp string")
    found = {r.node: r.community for r in graphs.within_groups(edges, groups).collect()}
    assert Counter(found.values()) == {"x-00": 10, "x-01": 10, "y-00": 10, "y-01": 10, "y-02": 1}


def test_linkage_heights():
    points = np.array([[0.0], [1.0], [5.0], [7.0]])
    assert graphs.linkage(points).tolist() == [[0, 1, 1, 2], [2, 3, 2, 2], [4, 5, 5.5, 4]]
    ward = graphs.linkage(points, "ward")
    assert ward[:, 2] == pytest.approx([1, 2, math.sqrt(2 * 2 * 2 / 4) * 5.5])
    assert graphs.linkage(points[:0]).shape == (0, 4)


def brute_hits(odds, seq, threshold):
    out = []
    for strand, m in (("+", odds), ("-", odds[::-1, ::-1])):
        for i in range(len(seq) - m.shape[1] + 1):
            s = sum(m["ACGT".index(c), j] if c in "ACGT" else m[:, j].min() for j, c in enumerate(seq[i : i + m.shape[1]].upper()))
            if s >= threshold:
                out.append((i if strand == "+" else len(seq) - m.shape[1] - i, strand, s))
    return out


def test_motif_scan_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(motifs, "CHUNK", 50)
    draw = np.random.default_rng(4)
    seqs = ["".join(draw.choice(list("ACGTNacgt"), n)) for n in (0, 3, 5, 6, 30, 80, 200)] + [None, "CACGTG", "xxéCACGTG"]
    held = {w: (motifs.log_odds(np.array([[0.91 if b == c else 0.03 for c in w] for b in "ACGT"])), 2.0) for w in ("CACGTG", "GGGCC")}
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, s string")
    rows = {(r.id, r.motif): (r.best, r.n_hits) for r in motifs.scan(df, held, "id", "s").collect()}
    assert len(rows) == 2 * len(seqs)
    for i, seq in enumerate(seqs):
        for name, (odds, threshold) in held.items():
            want = brute_hits(odds, seq or "", threshold)
            assert rows[i, name][1] == len(want)
            assert rows[i, name][0] == (pytest.approx(max(s for *_, s in want)) if want else None)
            assert sorted(x[:2] for x in motifs.hits(odds, seq or "", threshold)) == sorted(x[:2] for x in want)


def test_pvalue_threshold_is_the_least_rare_score():
    odds = motifs.log_odds(np.array([[0.7, 0.1, 0.2], [0.1, 0.7, 0.3], [0.1, 0.1, 0.4], [0.1, 0.1, 0.1]]))
    every = sorted(sum(odds[b, j] for j, b in enumerate(w)) for w in itertools.product(range(4), repeat=3))
    step = (odds.max(0).sum() - odds.min(0).sum()) / 1000
    for p in (0.5, 0.1, 0.03):
        found = motifs.pvalue_threshold(odds, p)
        assert sum(s >= found + 2 * step for s in every) / 64 <= p < sum(s >= found - 3 * step for s in every) / 64
    assert motifs.pvalue_threshold(np.ones((4, 3))) == 3


def test_two_samples(spark):
    draw = np.random.default_rng(2)
    x, y = draw.integers(0, 9, 40), draw.integers(2, 12, 60)
    df = spark.createDataFrame([(float(v), True) for v in x] + [(float(v), False) for v in y] + [(None, True)], "v double, one boolean")
    r = stats.two_samples(df, "v", "one").first()
    assert (r.n1, r.n2) == (40, 60)
    assert r.u == sum((a > b) + 0.5 * (a == b) for a in x for b in y)
    assert r.ks == pytest.approx(max(abs((x <= v).mean() - (y <= v).mean()) for v in range(12)))
    assert stats.two_samples(df.where("one"), "v", "one").first().u is None


def test_numbered_is_gapless(spark):
    df = spark.range(1000).select((stats.F.col("id") * 7).alias("id"))
    assert sorted(r.i for r in stats.numbered(df, "id").collect()) == list(range(1000))


def test_doublets_among_two_types(spark):
    draw = np.random.default_rng(8)
    counts = draw.poisson(0.3, (130, 40))
    counts[:60, :20] += draw.poisson(6, (60, 20))
    counts[60:120, 20:] += draw.poisson(6, (60, 20))
    counts[120:] = counts[:10] + counts[60:70]
    df = spark.createDataFrame([(int(i), int(j), float(counts[i, j])) for i, j in zip(*counts.nonzero())], "cell long, feat long, x double")
    cells = spark.range(130).withColumnRenamed("id", "cell")
    score = np.array([r.doublet_score for r in doublets.find(df, cells, components=5).orderBy("cell").collect()])
    assert score[120:].min() > np.median(score[:120])
    assert (score[120:, None] > score[None, :120]).mean() > 0.95
    with pytest.raises(ValueError):
        doublets.find(df, cells.limit(10))
    both = doublets.find(df.unionByName(df.withColumn("cell", df.cell + 1000)), cells.withColumn("lib", stats.F.lit("a")).unionByName(cells.select((stats.F.col("cell") + 1000).alias("cell")).withColumn("lib", stats.F.lit("b"))), components=5, library="lib")
    assert both.count() == 260


def test_marker_queries(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.9), (3, "a", 0.9), (4, "c", 0.1)], "feat long, cell_type string, score double")
    ids = lambda *a, **k: [r.feat for r in markers.query_markers(df, *a, **k).collect()]
    assert ids() == [2, 3, 1, 4] and ids(2, 1) == [3, 1] and ids(cell_type="a") == [3, 1] and ids(min_score=0.5, max_score=0.5) == [1]
    with pytest.raises(ValueError):
        markers.query_markers(df, min_score=-1)
    with pytest.raises(KeyError):
        markers.query_markers(df, tissue="x")


def test_provenance(spark, tmp_path):
    path = str(tmp_path / "log")
    provenance.record(spark, path, "filter_cells", {"min": 3}, 10, 8)
    provenance.record(spark, path, "filter_cells", {"min": 4}, 8, 7)
    assert [r.n_after for r in provenance.history(spark, path).collect()] == [8, 7]
    assert provenance.last_params(spark, path, "filter_cells") == {"min": 4} and provenance.last_params(spark, path, "x") is None


def test_every_batch_is_searched(spark):
    found = catalog.queries()["knn_across_batches"](spark, SF).toPandas()
    points = model.points(spark, SF).toPandas()
    counts = points.label.value_counts()
    assert len(found) == sum(min(3, n - (label == own)) for own in points.label for label, n in counts.items())


def test_every_feature_is_in_the_dot_plot(spark):
    dots = catalog.queries()["dotplot"](spark, SF).toPandas()
    assert set(dots.feat) == {r.feat for r in model.entries(spark, SF).select("feat").distinct().collect()} and dots.feat.max() > 50


def test_ligand_receptor_p_of_all_draws(spark, monkeypatch):
    rng, feats, groups = np.random.default_rng(5), range(1, 41), ("A", "B")
    score = {(f, g): float(rng.random()) for f in feats for g in groups}
    score[1, "A"] = score[2, "B"] = 2.0  # above all others
    moments = {f: (float(rng.random()), float(rng.random())) for f in feats}
    specificity = spark.createDataFrame([(f, g, s) for (f, g), s in score.items()], "feat long, grp string, score double")
    stats_of = spark.createDataFrame([(f, *m) for f, m in moments.items()], "feat long, mean double, var double")
    monkeypatch.setattr(catalog, "_infog", lambda *_: specificity)
    monkeypatch.setattr(catalog, "_cosg", lambda *_: specificity)
    monkeypatch.setattr(catalog, "_moments", lambda *_: stats_of)
    pairs = spark.createDataFrame([(1, "x"), (7, "y")], "p_partkey long, p_type string")
    monkeypatch.setattr(catalog, "table", lambda *_: pairs)
    near = {f: sorted((o for o in feats if o != f), key=lambda o: (round(math.dist([round(x, 9) for x in moments[f]], [round(x, 9) for x in moments[o]]), 9), o))[:30] for f in (1, 2, 7, 8)}
    pick = lambda *parts: int(md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) % 30
    found = {(r.ligand, r.sender, r.receiver): r.p_value for r in catalog.queries()["ligand_receptor_p"](spark, SF).collect()}
    assert len(found) == 8
    for (a, sender, receiver), p in found.items():
        drawn = [(near[a][pick(a, a + 1, i, "ligand", 1927)], near[a + 1][pick(a, a + 1, i, "receptor", 1927)]) for i in range(1000)]
        value = round(score[a, sender] * score[a + 1, receiver], 12)
        over = sum(round(score[x, sender] * score[y, receiver], 12) >= value for x, y in drawn)
        assert p == round((over + 1) / 1001, 6)
    assert found[1, "A", "B"] < 1 / 21


def test_rounds_over_arrays_equal_rounds_over_tables(spark, monkeypatch):
    draw = np.random.default_rng(5)
    edges = [(int(a) * 7, int(b) * 7, float(w)) for a, b, w in zip(draw.integers(0, 60, 300), draw.integers(0, 60, 300), draw.random(300), strict=True)]
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    monkeypatch.setattr(graphs, "SMALL", 0)
    found = {}
    for most in (graphs.LABELS, 0):
        monkeypatch.setattr(graphs, "LABELS", most)
        found[most > 0] = {r.node: r.community for r in graphs.communities(df, rounds=3, levels=2).collect()}
    assert found[True] == found[False] and len(set(found[True].values())) > 1
