import numpy as np

from celloom.operators import tidy


def test_every_pair_of_blocks_is_made_without_shuffling_it(spark, monkeypatch):
    monkeypatch.setattr(tidy, "WIDE", 7)
    draw = np.random.default_rng(1)
    held = {(int(c), int(f)): float(v) for c, f, v in zip(draw.integers(0, 30, 200), draw.integers(0, 40, 200), draw.normal(size=200), strict=True)}
    cells, feats = range(25), {f: f / 10 for f in range(33)}  # some rows are of other cells or features
    entries = spark.createDataFrame([(*k, v) for k, v in held.items()], "cell long, feat long, value double")
    out = tidy.every_pair(entries, spark.createDataFrame([(c,) for c in cells], "cell long"), spark.createDataFrame(list(feats.items()), "feat long, value double"))
    rows = [((r.cell, r.feat), r.value) for r in out.collect()]
    assert len(rows) == 25 * 33 and dict(rows) == {(c, f): held.get((c, f), v) for c in cells for f, v in feats.items()}
    assert tidy.every_pair(entries.limit(0), entries.select("cell").limit(0), entries.select("feat", "value").limit(0)).count() == 0
