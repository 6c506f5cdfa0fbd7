import math

import numpy as np
import pytest

from celloom.operators import decompose, filters, intervals, metrics, neighbors, stats
from celloom.sources import tables


def test_mask_grammar(spark):
    df = spark.createDataFrame([(1, "A", 5.0), (2, "B", -2.0), (3, None, 0.0)], "id long, c string, x double")
    ids = lambda text: [r.id for r in df.where(filters.parse_mask(text, df.columns)).orderBy("id").collect()]
    assert ids("x > -1") == [1, 3]
    assert ids("-3 < x <= 0") == [2, 3]
    assert ids("c == 'A' or x.between(-5, -1)") == [1, 2]
    assert ids("c.isin(['B']) & ~(x > 0)") == [2]
    assert ids("c != 'A'") == [2]
    with pytest.raises(KeyError):
        filters.parse_mask("nope > 1", df.columns)
    with pytest.raises(ValueError):
        filters.parse_mask("x + 1 > 2", df.columns)


@pytest.mark.parametrize(
    ("start", "end", "hits"),
    [(0, 10, 0), (0, 100, 0), (0, 101, 1), (200, 300, 0), (199, 300, 1), (120, 130, 1), (50, 250, 1), (100, 200, 1), (0, 5000, 2), (150, 150, 0)],
)
def test_overlap_edges(spark, start, end, hits):
    peaks = spark.createDataFrame([("1", 100, 200, 0), ("1", 3000, 3001, 1), ("2", 100, 200, 2)], "chrom string, p_start long, p_end long, peak long")
    fragments = spark.createDataFrame([("1", start, end, 7)], "chrom string, start long, `end` long, cell long")
    assert intervals.overlaps(fragments, peaks).count() == hits


def test_read_mtx_and_bed(spark, tmp_path):
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket\n%x\n3 2 3\n1 1 5\n3 2 1\n2 1 4\n")
    (tmp_path / "barcodes.tsv").write_text("AA-1\nCC-1\n")
    (tmp_path / "features.tsv").write_text("g1\tA\tGene Expression\ng2\tA\tGene Expression\np1\tchr1:1-2\tPeaks\n")
    entries, cells, feats = tables.read_mtx(spark, *(str(tmp_path / n) for n in ("matrix.mtx", "barcodes.tsv", "features.tsv")))
    assert sorted(map(tuple, entries.collect())) == [(0, 0, 5.0), (0, 1, 4.0)]
    assert [r.barcode for r in cells.orderBy("cell").collect()] == ["AA-1", "CC-1"]
    assert [r.symbol for r in tables.make_unique(feats, "symbol", "feat").orderBy("feat").collect()] == ["A", "A-1"]
    (tmp_path / "p.bed").write_text("#c\ntrack x\nchr1\t5\t9\nchr1\t9\t9\nchr1\t1\nchr2\t0\t4\n")
    assert [tuple(r) for r in tables.read_bed(spark, str(tmp_path / "p.bed")).orderBy("peak").collect()] == [("chr1", 5, 9, 0, "chr1:5-9"), ("chr2", 0, 4, 1, "chr2:0-4")]


def test_ranks_and_quantiles(spark):
    values = np.round(np.random.default_rng(3).exponential(size=500), 2)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(7)
    for r in stats.ranks(df, "v", stats.F.lit(1)).collect():
        assert (r.n0, r.below0) == ((values == r.v).sum(), (values < r.v).sum())
    found = stats.quantiles(df, "v", [0.0, 0.5, 0.95, 1.0]).first()
    assert np.allclose(list(found), np.quantile(values, [0.0, 0.5, 0.95, 1.0]))
    assert tuple(stats.quantiles(df.limit(0), "v", [0.5]).first()) == (None,)


def test_pooled_p_of_missing_values(spark):
    null = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),)], "null_value double")
    seen = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 9.0), (4, None)], "id long, value double")
    assert {r.id: r.p for r in stats.pooled(null, seen, ["id"]).collect()} == {1: 3 / 5, 2: 2 / 5, 3: 1 / 5, 4: None}


def test_frip_of_cells_without_fragments(spark):
    counts = spark.createDataFrame([(1, 2.0), (1, 1.0), (3, 4.0)], "cell long, x double")
    sizes = spark.createDataFrame([(1, 6), (2, 5), (3, 0)], "cell long, n_fragments long")
    assert {r.cell: r.frip for r in metrics.frip(counts, sizes).collect()} == {1: 0.5, 2: 0.0, 3: 0.0}


def test_fuzzy_graph_equals_brute_force(spark):
    k, points = 6, np.random.default_rng(5).normal(size=(40, 3))
    points[7] = points[8]
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, vec array<double>")
    directed = {}
    for i in range(len(points)):
        d = sorted((round(math.dist(points[i], points[j]), 9), j) for j in range(len(points)) if j != i)[: k - 1]
        rho = min(x for x, _ in d if x > 0)
        total = lambda s: sum(math.exp(-max(0.0, x - rho) / s) for x, _ in d)  # noqa: B023, E731
        low, high = 1e-9, 1e3
        for _ in range(200):
            low, high = (low, (low + high) / 2) if total((low + high) / 2) > math.log2(k) else ((low + high) / 2, high)
        sigma = max(low, 1e-3 * sum(x for x, _ in d) / len(d))
        directed |= {(i, j): math.exp(-max(0.0, x - rho) / sigma) for x, j in d}
    want = {}
    for a, b in directed:
        u, v = directed[a, b], directed.get((b, a), 0.0)
        want[a, b] = want[b, a] = u + v - u * v
    found = {(r.a, r.b): r.weight for r in neighbors.fuzzy_graph(neighbors.knn(df, df, k - 1), k).collect()}
    assert found.keys() == {p for p, w in want.items() if w > 0}
    assert all(abs(found[p] - want[p]) < 1e-6 for p in found)


def test_svd_equals_numpy(spark):
    rng = np.random.default_rng(11)
    dense = (rng.normal(size=(60, 6)) * [9, 7, 5, 3, 2, 1]) @ rng.normal(size=(6, 40)) * (rng.random((60, 40)) < 0.5)
    rows = [(i, 100 + 3 * j, float(dense[i, j])) for i, j in zip(*np.nonzero(dense), strict=True)]
    df = spark.createDataFrame([(int(a), int(b), c) for a, b, c in rows], "cell long, feat long, x double")
    scores, values, loadings = decompose.svd(df.repartition(5), 4, rounds=30)
    u, s, vt = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(values, s[:4], rtol=1e-6)
    found = np.zeros((60, 4))
    for r in scores.collect():
        found[r.cell] = r.vec
    assert np.allclose(np.abs(found), np.abs(u[:, :4] * s[:4]), atol=1e-3)
    v = np.array([r.vec for r in loadings.orderBy("feat").collect()])
    assert (v[np.abs(v).argmax(0), np.arange(4)] > 0).all()
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-9)
    scores, values, loadings = decompose.svd(df.limit(0), 4)
    assert scores.count() == loadings.count() == len(values) == 0
