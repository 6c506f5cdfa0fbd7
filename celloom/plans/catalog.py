"""Every registered query of the engine with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celloom.operators import decompose, doublets, filters, graphs, intervals, markers, metrics, motifs, neighbors, normalize, stats
from celloom.session import small, spread, stored, table
from celloom.sources import model

FLAGSHIP = "infog"
DIGITS = 6

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

E = "e AS (SELECT o_custkey AS cell, l_partkey AS feat, count(*)::DOUBLE AS x FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"
C = "c AS (SELECT c_custkey AS cell, c_mktsegment AS grp, c_nationkey AS batch, c_acctbal AS bal FROM customer)"
P = "f AS (SELECT p_partkey AS feat, p_name AS name, p_brand AS brand, p_type AS kind FROM part)"
D = "d AS (SELECT c.cell, coalesce(sum(x), 0.0::DOUBLE) AS depth FROM c LEFT JOIN e ON e.cell = c.cell GROUP BY 1)"
G = "g AS (SELECT feat, sum(x) AS total FROM e GROUP BY 1)"
K = "k AS (SELECT count(*) AS n_cells, median(depth) AS s, sum(depth) AS t FROM d)"
Z = "z AS (SELECT e.cell, e.feat, e.x, least(CASE WHEN depth > 0 THEN x / depth * sqrt(s * t / total) ELSE 0 END, sqrt(n_cells::DOUBLE)) AS z FROM e JOIN d ON d.cell = e.cell JOIN g ON g.feat = e.feat CROSS JOIN k)"
V = "v AS (SELECT feat, sum(z) / any_value(n_cells) AS mean, sum(z * z) / any_value(n_cells) - (sum(z) / any_value(n_cells)) ** 2 AS var FROM z CROSS JOIN k GROUP BY 1)"
INFOG = f"WITH {E}, {C}, {P}, {D}, {G}, {K}, {Z}, {V}"
BASE = f"WITH {E}, {C}, {P}, {D}, {G}, {K}"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _infog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.infog(stored(model.entries(spark, sf_dir), "entries"), model.cells(spark, sf_dir))


def _moments(spark: SparkSession, sf_dir: str, z: DataFrame) -> DataFrame:
    n = model.cells(spark, sf_dir).agg(F.count("*").alias("n_cells"))
    return normalize.moments(z.crossJoin(F.broadcast(n)), F.col("n_cells"), "z")


@query(f"{INFOG} SELECT cell, feat, round(z, 6) AS z FROM z")
def infog(spark, sf_dir):
    return rounded(_infog(spark, sf_dir).select("cell", "feat", "z"), "z")


@query(f"{INFOG} SELECT feat, round(mean, 6) AS mean, round(var, 6) AS var FROM v")
def infog_moments(spark, sf_dir):
    return rounded(_moments(spark, sf_dir, _infog(spark, sf_dir)), "mean", "var")


@query(f"{INFOG} SELECT feat, round(var, 6) AS var FROM v ORDER BY round(var, 9) DESC, feat LIMIT 300")
def highly_variable(spark, sf_dir):
    return rounded(normalize.highly_variable(_moments(spark, sf_dir, _infog(spark, sf_dir)), 300).select("feat", "var"), "var")


@query(f"{BASE} SELECT e.cell, e.feat, round(ln(1 + x / depth * 10000.0::DOUBLE), 6) AS y FROM e JOIN d ON d.cell = e.cell")
def log1p(spark, sf_dir):
    return rounded(normalize.log1p(model.entries(spark, sf_dir), model.cells(spark, sf_dir)).select("cell", "feat", "y"), "y")


@query(f"{BASE} SELECT e.cell, e.feat, round(ln(1 + x / depth * 10000.0::DOUBLE) * ln(1 + n_cells / greatest(total, 1.0::DOUBLE)), 6) AS w FROM e JOIN d ON d.cell = e.cell JOIN g ON g.feat = e.feat CROSS JOIN k")
def tfidf(spark, sf_dir):
    return rounded(normalize.tfidf(model.entries(spark, sf_dir), model.cells(spark, sf_dir)).select("cell", "feat", "w"), "w")


@query(f"{BASE} SELECT feat, round(ln(1 + n_cells / greatest(total, 1.0::DOUBLE)), 6) AS idf FROM g CROSS JOIN k")
def tfidf_stats(spark, sf_dir):
    n = model.cells(spark, sf_dir).agg(F.count("*").alias("n_cells"))
    totals = model.entries(spark, sf_dir).groupBy("feat").agg(F.sum("x").alias("total"))
    return rounded(totals.crossJoin(F.broadcast(n)).select("feat", F.log1p(F.col("n_cells") / F.greatest("total", F.lit(1.0))).alias("idf")), "idf")


@query(f"{BASE}, m AS (SELECT avg(depth) AS mean FROM d) SELECT e.cell, e.feat, round(x * mean / depth, 6) AS y FROM e JOIN d ON d.cell = e.cell CROSS JOIN m")
def total_count(spark, sf_dir):
    return rounded(normalize.total_count(model.entries(spark, sf_dir), model.cells(spark, sf_dir)).select("cell", "feat", "y"), "y")


@query(
    f"""WITH {E}, {C}, q AS (SELECT e.* FROM e JOIN c ON c.cell = e.cell WHERE batch % 2 = 1), r AS (SELECT e.* FROM e JOIN c ON c.cell = e.cell WHERE batch % 2 = 0),
    g AS (SELECT feat, sum(x) AS total FROM r GROUP BY 1), rd AS (SELECT c.cell, coalesce(sum(x), 0.0::DOUBLE) AS depth FROM c LEFT JOIN r ON r.cell = c.cell WHERE batch % 2 = 0 GROUP BY 1),
    k AS (SELECT count(*) AS n_cells, median(depth) AS s, sum(depth) AS t FROM rd), h AS (SELECT q.* FROM q JOIN g ON g.feat = q.feat), d AS (SELECT cell, sum(x) AS depth FROM h GROUP BY 1)
    SELECT h.cell, h.feat, round(least(x / depth * sqrt(s * t / total), sqrt(n_cells::DOUBLE)), 6) AS z FROM h JOIN d ON d.cell = h.cell JOIN g ON g.feat = h.feat CROSS JOIN k"""
)
def frozen_infog(spark, sf_dir):
    held, cells = model.entries(spark, sf_dir), model.cells(spark, sf_dir)
    mine, theirs = (cells.where(F.col("batch") % 2 == r) for r in (1, 0))
    out = normalize.frozen_infog(held.join(mine.select("cell"), "cell", "left_semi"), held.join(theirs.select("cell"), "cell", "left_semi"), theirs)
    return rounded(out.select("cell", "feat", "z"), "z")


@query(
    f"""{BASE}, a AS (SELECT feat, sqrt(sum(x * x)) AS l FROM e GROUP BY 1), s AS (SELECT e.cell, e.feat, x / l AS y FROM e JOIN a ON a.feat = e.feat)
    SELECT cell, feat, round(y / sqrt(sum(y * y) OVER (PARTITION BY cell)), 6) AS x FROM s"""
)
def l2_columns_rows(spark, sf_dir):
    return rounded(normalize.l2_columns_rows(model.entries(spark, sf_dir), "cell", "feat", "x").select("cell", "feat", "x"), "x")


@query(
    """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), m AS (SELECT avg(x) AS cx, avg(y) AS cy FROM p)
    SELECT vec_id, round(cx + (x - cx) * cos(radians(30)) - (y - cy) * sin(radians(30)), 6) AS x, round(cy + (x - cx) * sin(radians(30)) + (y - cy) * cos(radians(30)), 6) AS y FROM p, m"""
)
def rotate(spark, sf_dir):
    held = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return rounded(normalize.rotate(held, "x", "y", 30.0), "x", "y")


@query(f"WITH {C} SELECT grp || '@' || batch AS label, count(*) AS n FROM c GROUP BY 1")
def cross_categories(spark, sf_dir):
    return metrics.value_table(model.cells(spark, sf_dir).select(normalize.cross_categories("grp", "batch").alias("label")), "label")


@query("SELECT regexp_replace(p_brand || '-' || p_size, '-[^-]*$', '') AS label, count(*) AS n FROM part GROUP BY 1")
def strip_suffix(spark, sf_dir):
    return table(spark, sf_dir, "part").select(normalize.strip_suffix(F.concat_ws("-", "p_brand", "p_size")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


_FILTERED = f"{BASE}, s AS (SELECT c.cell, grp, bal, coalesce(sum(x), 0) AS n, count(x) AS nf FROM c LEFT JOIN e ON e.cell = c.cell GROUP BY 1, 2, 3)"


@query(f"{_FILTERED} SELECT cell FROM s WHERE n >= 20 AND n <= 60 AND nf >= 10 AND (grp = 'BUILDING' OR bal > -100) AND NOT (bal BETWEEN 0 AND 500) AND grp NOT IN ('MACHINERY')")
def filter_cells_expression(spark, sf_dir):
    mask = "(grp == 'BUILDING' or bal > -100) and not bal.between(0, 500) and grp not in ['MACHINERY']"
    return filters.filter_cells(model.entries(spark, sf_dir), model.cells(spark, sf_dir), 20, 60, 10, mask=mask).select("cell")


@query(f"{_FILTERED} SELECT cell FROM s WHERE bal >= 0 AND bal <= 5000 AND grp IN ('BUILDING', 'FURNITURE')")
def filter_cells_dict(spark, sf_dir):
    return filters.filter_cells(model.entries(spark, sf_dir), model.cells(spark, sf_dir), mask={"bal": (0, 5000), "grp": ["BUILDING", "FURNITURE"]}).select("cell")


@query(f"{BASE}, s AS (SELECT f.feat, count(x) AS n, coalesce(sum(x), 0) AS t FROM f LEFT JOIN e ON e.feat = f.feat GROUP BY 1) SELECT feat FROM s WHERE n >= 5 AND t <= 40")
def filter_features(spark, sf_dir):
    return filters.filter_features(model.entries(spark, sf_dir), model.features(spark, sf_dir), min_cells=5, max_counts=40).select("feat")


@query(
    f"""{BASE}, s AS (SELECT e.cell, sum(x) AS n_counts, count(*) AS n_features, sum(CASE WHEN starts_with(brand, 'Brand#1') THEN x ELSE 0 END) AS b FROM e JOIN f ON f.feat = e.feat GROUP BY 1)
    SELECT c.cell, coalesce(n_counts, 0.0::DOUBLE) AS n_counts, coalesce(n_features, 0) AS n_features, coalesce(b, 0.0::DOUBLE) AS n_counts_b1, round(coalesce(b * 100.0::DOUBLE / n_counts, 0), 6) AS pct_counts_b1 FROM c LEFT JOIN s ON s.cell = c.cell"""
)
def cell_metrics(spark, sf_dir):
    out = metrics.cell_metrics(model.entries(spark, sf_dir), model.cells(spark, sf_dir), {"b1": F.col("brand").startswith("Brand#1")}, model.features(spark, sf_dir))
    return rounded(out, "pct_counts_b1")


@query(f"{BASE} SELECT f.feat, count(x) AS n_cells, coalesce(sum(x), 0.0::DOUBLE) AS n_counts FROM f LEFT JOIN e ON e.feat = f.feat GROUP BY 1")
def feature_metrics(spark, sf_dir):
    return metrics.feature_metrics(model.entries(spark, sf_dir), model.features(spark, sf_dir))


@query(
    f"""{BASE}, a AS (SELECT c.cell, grp, coalesce(sum(x), 0.0::DOUBLE) AS n, count(x) AS nf FROM c LEFT JOIN e ON e.cell = c.cell GROUP BY 1, 2),
    s AS (SELECT grp, count(*) AS n_cells, avg(n) AS mean_counts, median(n) AS median_counts, median(nf) AS median_features FROM a GROUP BY 1),
    t AS (SELECT grp, feat, count(*) AS k FROM e JOIN c ON c.cell = e.cell GROUP BY 1, 2), u AS (SELECT s.grp, count(*) AS n_detected FROM t JOIN s ON s.grp = t.grp WHERE k::DOUBLE / n_cells > 0.02::DOUBLE GROUP BY 1)
    SELECT s.grp, n_cells, round(mean_counts, 6) AS mean_counts, median_counts, median_features::DOUBLE AS median_features, coalesce(n_detected, 0) AS n_detected FROM s LEFT JOIN u ON u.grp = s.grp"""
)
def group_metrics(spark, sf_dir):
    return rounded(metrics.group_metrics(model.entries(spark, sf_dir), model.cells(spark, sf_dir), "grp", 0.02), "mean_counts")


@query(f"WITH {C} SELECT grp, count(*) AS n FROM c GROUP BY 1")
def value_table(spark, sf_dir):
    return metrics.value_table(model.cells(spark, sf_dir), "grp")


@query(f"WITH {C}, t AS (SELECT grp, batch, count(*) AS n FROM c GROUP BY 1, 2) SELECT grp, batch, n, round(n / sum(n) OVER (PARTITION BY grp), 6) AS share FROM t")
def crosstab_query(spark, sf_dir):
    return rounded(metrics.crosstab(model.cells(spark, sf_dir), "grp", "batch", "query"), "share")


@query(f"WITH {C}, t AS (SELECT grp, batch, count(*) AS n FROM c GROUP BY 1, 2) SELECT grp, batch, n, round(n / (SELECT sum(n) FROM t), 6) AS share FROM t")
def crosstab_all(spark, sf_dir):
    return rounded(metrics.crosstab(model.cells(spark, sf_dir), "grp", "batch", "all"), "share")


_DOT = f"{INFOG}, w AS (SELECT * FROM z), s AS (SELECT grp, count(*) AS size FROM c GROUP BY 1), t AS (SELECT grp, feat, sum(z) AS total, count(*) FILTER (z > 0) AS k FROM w JOIN c ON c.cell = w.cell GROUP BY 1, 2), x AS (SELECT grp, feat, size FROM s, (SELECT DISTINCT feat FROM w)), o AS (SELECT x.grp, x.feat, coalesce(k, 0)::DOUBLE / size AS fraction, coalesce(total, 0) / size AS mean FROM x LEFT JOIN t ON t.grp = x.grp AND t.feat = x.feat)"


def _dots(spark, sf_dir):
    return metrics.dotplot(stored(_infog(spark, sf_dir), "infog"), model.cells(spark, sf_dir), "grp", "z")


@query(f"{_DOT} SELECT grp, feat, round(fraction, 6) AS fraction, round(mean, 6) AS mean FROM o")
def dotplot(spark, sf_dir):
    return rounded(_dots(spark, sf_dir), "fraction", "mean")


@query(f"{_DOT}, r AS (SELECT *, max(mean) OVER (PARTITION BY feat) AS hi, min(mean) OVER (PARTITION BY feat) AS lo FROM o) SELECT grp, feat, round(CASE WHEN hi = lo THEN 0 ELSE (mean - lo) / (hi - lo) END, 6) AS scaled FROM r")
def dotplot_minmax(spark, sf_dir):
    return rounded(normalize.scale_by(_dots(spark, sf_dir), "feat", "mean").select("grp", "feat", "scaled"), "scaled")


@query(f"{_DOT}, r AS (SELECT *, stddev_samp(mean) OVER (PARTITION BY feat) AS sd, avg(mean) OVER (PARTITION BY feat) AS m FROM o) SELECT grp, feat, round(CASE WHEN sd = 0 THEN 0 ELSE (mean - m) / sd END, 6) AS scaled FROM r")
def heatmap_zscore(spark, sf_dir):
    return rounded(normalize.scale_by(_dots(spark, sf_dir), "feat", "mean", "zscore").select("grp", "feat", "scaled"), "scaled")


@query("SELECT label, (i - 1)::INTEGER AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2")
def centroids(spark, sf_dir):
    return rounded(metrics.centroids(model.points(spark, sf_dir), "label", "vec"), "mean")


@query(f"WITH {C}, r AS (SELECT cell, grp, row_number() OVER (PARTITION BY grp ORDER BY md5(cell || '|0'), cell) AS k FROM c) SELECT cell, grp FROM r WHERE k <= 20")
def stratified_sample(spark, sf_dir):
    return metrics.stratified(model.cells(spark, sf_dir), "grp", "cell", 20).select("cell", "grp")


_S = "sum(x) AS s, count(*) FILTER (x > 0) AS k, sum(x * x) AS q"
_COSG = f"""m AS (SELECT grp, count(*) AS n FROM c GROUP BY 1), a AS (SELECT grp, feat, {_S.replace('x', 'z')} FROM z JOIN c ON c.cell = z.cell GROUP BY 1, 2),
  b AS (SELECT a.*, n, s / (sqrt(sum(q) OVER (PARTITION BY feat)) * sqrt(n::DOUBLE)) AS cos FROM a JOIN m ON m.grp = a.grp),
  cs AS (SELECT grp, feat, CASE WHEN k::DOUBLE / n < 0.005::DOUBLE THEN -1 ELSE cos ** 3 / (sum(cos * cos) OVER (PARTITION BY feat)) END AS score FROM b)"""
_TOP = "tp AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, feat) AS rank FROM cs QUALIFY rank <= 20)"


def _cosg(spark, sf_dir, z=None):
    return markers.cosg(_infog(spark, sf_dir) if z is None else z, model.cells(spark, sf_dir), "grp", "z", 1.0, 0.005)


@query(f"{INFOG}, {_COSG}, {_TOP} SELECT grp, feat, round(score, 6) AS score, rank::INTEGER AS rank FROM tp")
def cosg(spark, sf_dir):
    return rounded(markers.top_per_group(_cosg(spark, sf_dir), "grp", 20), "score")


@query(
    f"""{INFOG}, zb AS (SELECT z.*, grp || '@' || (batch % 3) AS g2 FROM z JOIN c ON c.cell = z.cell), m AS (SELECT grp || '@' || (batch % 3) AS g2, batch % 3 AS b, count(*) AS n FROM c GROUP BY 1, 2),
    a AS (SELECT g2, feat, sum(z) AS s, sum(z * z) AS q FROM zb GROUP BY 1, 2), b AS (SELECT a.*, m.b, s / (sqrt(sum(q) OVER (PARTITION BY feat, m.b)) * sqrt(n::DOUBLE)) AS cos FROM a JOIN m ON m.g2 = a.g2),
    cs AS (SELECT g2 AS grp, feat, cos ** 3 / (sum(cos * cos) OVER (PARTITION BY feat, b)) AS score FROM b), {_TOP} SELECT grp, feat, round(score, 6) AS score, rank::INTEGER AS rank FROM tp"""
)
def cosg_batches(spark, sf_dir):
    z, cells = stored(_infog(spark, sf_dir), "infog"), model.cells(spark, sf_dir).withColumn("part", F.col("batch") % 3)
    labelled = cells.withColumn("grp", normalize.cross_categories("grp", "part"))
    parts = [markers.cosg(z.join(own.select("cell"), "cell", "left_semi"), own, "grp", "z") for own in (labelled.where(F.col("part") == b) for b in range(3))]
    return rounded(markers.top_per_group(parts[0].unionByName(parts[1]).unionByName(parts[2]), "grp", 20), "score")


_SCORE = f"""pt AS MATERIALIZED (SELECT feat, round(mean, 9) AS mean, round(var, 9) AS var FROM v), st AS (SELECT grp AS set, feat, 1.0::DOUBLE AS weight FROM tp),
  nn AS (SELECT a.feat, b.feat AS neighbour, row_number() OVER (PARTITION BY a.feat ORDER BY round(sqrt((a.mean - b.mean) ** 2 + (a.var - b.var) ** 2), 9), b.feat) AS rank
    FROM pt a JOIN pt b ON a.feat <> b.feat WHERE a.feat IN (SELECT feat FROM st)),
  dr AS (SELECT set, feat, weight, (('0x' || substr(md5(concat_ws('|', feat, set, i, 1927)), 1, 8))::BIGINT % 30) + 1 AS rank FROM st, range(0, 100) t(i)),
  wt AS (SELECT set, feat, sum(weight) AS weight FROM (SELECT set, feat, weight FROM st UNION ALL SELECT set, neighbour, -weight / 100.0::DOUBLE FROM dr JOIN nn USING (feat, rank)) GROUP BY 1, 2),
  sz AS (SELECT set, median(weight) * count(*) AS sz FROM st GROUP BY 1), ss AS (SELECT cell, wt.set, sum(z * weight) / any_value(sz) AS score FROM z JOIN wt ON wt.feat = z.feat JOIN sz ON sz.set = wt.set GROUP BY 1, 2),
  sc AS (SELECT c.cell, sz.set, coalesce(score, 0.0::DOUBLE) AS score FROM c CROSS JOIN sz LEFT JOIN ss ON ss.cell = c.cell AND ss.set = sz.set)"""


def _scores(spark, sf_dir):
    z = stored(_infog(spark, sf_dir), "infog")
    sets = stored(markers.top_per_group(_cosg(spark, sf_dir, z), "grp", 20).select(F.col("grp").alias("set"), "feat", F.lit(1.0).alias("weight")), "sets")
    return markers.score_sets(z, _moments(spark, sf_dir, z), sets, "z", model.cells(spark, sf_dir))


@query(f"{INFOG}, {_COSG}, {_TOP}, {_SCORE} SELECT cell, set, round(score, 6) AS score FROM sc")
def score_sets(spark, sf_dir):
    return rounded(_scores(spark, sf_dir), "score")


@query(
    f"""{INFOG}, {_COSG}, {_TOP}, {_SCORE}, l AS (SELECT set, sqrt(sum(score * score)) AS l FROM sc GROUP BY 1), y AS (SELECT cell, sc.set, score / l AS y FROM sc JOIN l ON l.set = sc.set), r AS (SELECT *, sqrt(sum(y * y) OVER (PARTITION BY cell)) AS n FROM y)
    SELECT cell, set, round(y / CASE WHEN n < 1e-12::DOUBLE THEN 1 ELSE n END, 6) AS score FROM r"""
)
def gdr(spark, sf_dir):
    return rounded(normalize.l2_columns_rows(_scores(spark, sf_dir), "cell", "set", "score").select("cell", "set", "score"), "score")


@query(f"{INFOG}, {_COSG}, {_TOP}, {_SCORE} SELECT cell, set AS label, round(score, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY cell ORDER BY round(score, 9) DESC, set) = 1")
def predict_by_marker(spark, sf_dir):
    return rounded(markers.predict(_scores(spark, sf_dir)), "score")


_LR = "pr AS (SELECT p_partkey AS ligand, p_partkey + 1 AS receptor, p_type AS annotation FROM part)"


@query(f"{INFOG}, {_COSG}, {_LR} SELECT ligand, receptor, annotation, a.grp AS sender, b.grp AS receiver, round(a.score * b.score, 9) AS score FROM pr JOIN cs a ON a.feat = ligand JOIN cs b ON b.feat = receptor")
def ligand_receptor(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ligand"), (F.col("p_partkey") + 1).alias("receptor"), F.col("p_type").alias("annotation"))
    return rounded(markers.ligand_receptor(stored(_cosg(spark, sf_dir), "specificity"), pairs), "score", digits=9)


@query(
    f"""{INFOG}, {_COSG}, {_TOP}, mk AS (SELECT feat, cs.grp AS cell_type, 'study' || (feat % 3) AS study, score FROM cs), h AS (SELECT tp.grp AS set, cell_type, study, count(*) AS count, avg(mk.score) AS avg_score FROM tp JOIN mk ON mk.feat = tp.feat GROUP BY 1, 2, 3 HAVING count(*) >= 2)
    SELECT set, cell_type, study, count, round(avg_score, 6) AS avg_score, row_number() OVER (PARTITION BY set ORDER BY count DESC, round(avg_score, 9) DESC, cell_type, study)::INTEGER AS rank FROM h"""
)
def analyse_markers(spark, sf_dir):
    scores = stored(_cosg(spark, sf_dir), "specificity")
    records = scores.select("feat", F.col("grp").alias("cell_type"), F.concat(F.lit("study"), (F.col("feat") % 3).cast("string")).alias("study"), "score")
    sets = markers.top_per_group(scores, "grp", 20).select(F.col("grp").alias("set"), "feat")
    return rounded(markers.analyse_markers(records, sets, 2), "avg_score")


@query("SELECT feat, set, i::INTEGER AS draw, (('0x' || substr(md5(concat_ws('|', feat, set, i, 1927)), 1, 8))::BIGINT % 30)::INTEGER AS k FROM (SELECT p_partkey AS feat, p_brand AS set FROM part), range(0, 5) t(i)")
def hash_draws(spark, sf_dir):
    held = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feat"), F.col("p_brand").alias("set"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("draw"))
    return held.withColumn("k", stats.draw(30, F.col("feat"), F.col("set"), F.col("draw"), 1927))


_PV = "p AS (SELECT o_orderkey AS id, o_orderstatus AS grp, ((o_orderkey * 7919) % 10007 + 1)::DOUBLE / 10008 AS p FROM orders)"


@query(
    f"""WITH {_PV}, r AS (SELECT *, p * count(*) OVER (PARTITION BY grp) / row_number() OVER (PARTITION BY grp ORDER BY p, id) AS raw FROM p)
    SELECT id, grp, round(least(1.0::DOUBLE, min(raw) OVER (PARTITION BY grp ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS fdr FROM r"""
)
def bh_fdr(spark, sf_dir):
    held = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("grp"), (((F.col("o_orderkey") * 7919) % 10007 + 1).cast("double") / 10008).alias("p"))
    return rounded(stats.bh(held, "p", ["grp"], ["id"]).select("id", "grp", "fdr"), "fdr")


def _seen(spark, sf_dir):
    held = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 97).cast("double").alias("value"))
    return spread(held, 50 * held.count(), "id")


@query(
    """WITH o AS (SELECT p_partkey AS id, (p_partkey % 97)::DOUBLE AS value FROM part), n AS (SELECT id, (('0x' || substr(md5(concat_ws('|', id, i, 5)), 1, 8))::BIGINT % 97)::DOUBLE AS null_value FROM o, range(0, 50) t(i))
    SELECT id, round((count(*) FILTER (null_value >= value) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE), 6) AS p FROM o JOIN n USING (id) GROUP BY id"""
)
def monte_carlo_p(spark, sf_dir):
    seen = _seen(spark, sf_dir)
    null = seen.select("id", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("i")).select("id", stats.draw(97, F.col("id"), F.col("i"), 5).cast("double").alias("null_value"))
    return rounded(stats.monte_carlo(null, seen, ["id"]), "p")


@query(
    """WITH o AS (SELECT p_partkey AS id, (p_partkey % 97)::DOUBLE AS value FROM part), n AS (SELECT id, (('0x' || substr(md5(concat_ws('|', id, i, 5)), 1, 8))::BIGINT % 97)::DOUBLE AS null_value FROM o, range(0, 50) t(i)),
    c AS (SELECT null_value AS v, count(*) AS k FROM n GROUP BY 1), h AS (SELECT value, coalesce(sum(k), 0) AS hits FROM (SELECT DISTINCT value FROM o) LEFT JOIN c ON v >= value GROUP BY 1)
    SELECT id, round((hits + 1.0::DOUBLE) / ((SELECT sum(k) FROM c) + 1.0::DOUBLE), 6) AS p FROM o JOIN h USING (value)"""
)
def pooled_p(spark, sf_dir):
    seen = _seen(spark, sf_dir)
    null = seen.select("id", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("i")).select(stats.draw(97, F.col("id"), F.col("i"), 5).cast("double").alias("null_value"))
    return rounded(stats.pooled(null, seen, ["id"]), "p")


@query(
    f"""{INFOG}, {_COSG}, {_TOP.replace('20', '300')}, h AS (SELECT grp AS a, feat FROM tp), n AS (SELECT a, count(*) AS n FROM h GROUP BY 1), s AS (SELECT x.a, y.a AS b, count(*) AS k FROM h x JOIN h y ON x.feat = y.feat AND x.a < y.a GROUP BY 1, 2)
    SELECT s.a, s.b, round(k::DOUBLE / (n.n + m.n - k), 6) AS jaccard FROM s JOIN n ON n.a = s.a JOIN n m ON m.a = s.b"""
)
def marker_jaccard(spark, sf_dir):
    return rounded(stats.jaccard(stored(markers.top_per_group(_cosg(spark, sf_dir), "grp", 300), "markers"), "grp", "feat"), "jaccard")


_NN = "nn AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY rank <= 15)"


def _near(spark, sf_dir):
    held = model.points(spark, sf_dir)
    return neighbors.knn(held, held, 15)


@query(f"WITH {_NN} SELECT query, neighbour, rank::INTEGER AS rank, round(distance, 6) AS distance FROM nn")
def knn(spark, sf_dir):
    return rounded(_near(spark, sf_dir), "distance")


@query(
    f"""WITH {_NN}, v AS (SELECT query, label, count(*) AS n FROM nn JOIN embeddings ON vec_id = neighbour GROUP BY 1, 2)
    SELECT query AS id, label, round(n / sum(n) OVER (PARTITION BY query), 6) AS confidence FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, label) = 1"""
)
def knn_vote(spark, sf_dir):
    labels = model.points(spark, sf_dir).select(F.col("id").alias("neighbour"), "label")
    voted = stats.majority(_near(spark, sf_dir).join(labels, "neighbour"), "query", "label")
    return rounded(voted.withColumnRenamed("query", "id"), "confidence")


@query(
    f"""WITH bn AS (SELECT a.vec_id AS query, b.label AS batch, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id, b.label ORDER BY round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), b.vec_id) AS rank
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY rank <= 3) SELECT query, batch, neighbour, rank::INTEGER AS rank FROM bn WHERE batch < 2"""
)
def knn_across_batches(spark, sf_dir):
    held = model.points(spark, sf_dir)
    parts = [neighbors.knn(held.where(F.col("label") == b), held, 3).select("query", F.lit(b).alias("batch"), "neighbour", "rank") for b in range(2)]
    return parts[0].unionByName(parts[1])


@query(
    """WITH bn AS (SELECT a.vec_id AS query, b.label AS batch, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id, b.label ORDER BY round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), b.vec_id) AS rank
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY rank <= 3) SELECT query, batch, neighbour, rank::INTEGER AS rank FROM bn"""
)
def knn_across_batches(spark, sf_dir):
    held = model.points(spark, sf_dir).withColumnRenamed("label", "batch")
    return neighbors.knn(held, held, 3, within="batch").select("query", "batch", "neighbour", "rank")


_FAR = "round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)"


@query(
    f"""WITH w AS (SELECT a.vec_id AS id, a.label, {_FAR} AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND b.label <> 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_FAR}, b.vec_id) <= 15),
    m AS (SELECT id, any_value(label) AS label, round(avg(d), 9) AS novelty FROM w GROUP BY 1), q AS (SELECT quantile_cont(novelty, [0.95, 0.99, 0.995, 0.999]) AS q FROM m WHERE label <> 0)
    SELECT id, round(novelty, 6) AS novelty, round(q[1], 6) AS q95, round(q[2], 6) AS q99, round(q[3], 6) AS q995, round(q[4], 6) AS q999, novelty > q[1] AS novel FROM m, q WHERE label = 0"""
)
def novelty(spark, sf_dir):
    held = model.points(spark, sf_dir)
    return rounded(neighbors.novelty(held.where("label <> 0"), held.where("label = 0")), "novelty", "q95", "q99", "q995", "q999")


@query()
def fuzzy_graph(spark, sf_dir):
    held = model.points(spark, sf_dir)
    return rounded(neighbors.fuzzy_graph(neighbors.knn(held, held, 14), 15), "weight")


@query()
def svd(spark, sf_dir):
    scores, _, _ = decompose.svd(model.entries(spark, sf_dir), 10)
    return scores.select("cell", F.transform("vec", lambda x: F.round(x, DIGITS)).alias("vec"))


@query()
def infog_svd(spark, sf_dir):
    """INFOG, then the most variable features, then the decomposition."""
    z = stored(_infog(spark, sf_dir), "infog")
    best = stored(normalize.highly_variable(_moments(spark, sf_dir, z), 3000).select("feat"), "variable")
    scores, _, _ = decompose.svd(z.join(small(best), "feat", "left_semi").select("cell", "feat", F.col("z").alias("x")), 10)
    return scores.select("cell", F.transform("vec", lambda x: F.round(x, DIGITS)).alias("vec"))


_FR = "fr AS (SELECT l_suppkey % 5 AS chrom, l_partkey * 50 + l_linenumber * 37 AS s, l_partkey * 50 + l_linenumber * 37 + (l_quantity * 4)::BIGINT AS t, l_orderkey AS cell FROM lineitem)"
_PK = "pk AS (SELECT s_suppkey % 5 AS chrom, s_suppkey * 997 AS p_start, s_suppkey * 997 + 400 AS p_end, s_suppkey AS peak FROM supplier)"


@query(f'WITH {_FR}, {_PK} SELECT cell, s AS start, t AS "end", peak FROM fr JOIN pk ON fr.chrom = pk.chrom AND p_start < t AND p_end > s')
def interval_overlap(spark, sf_dir):
    return intervals.overlaps(model.fragments(spark, sf_dir), model.peaks(spark, sf_dir)).select("cell", "start", "end", "peak")


@query(f"WITH {_FR}, {_PK} SELECT cell, peak, count(*) AS n FROM fr JOIN pk ON fr.chrom = pk.chrom AND p_start < t AND p_end > s GROUP BY 1, 2")
def quantify_peaks(spark, sf_dir):
    return intervals.quantify(model.fragments(spark, sf_dir), model.peaks(spark, sf_dir))


@query(
    f"""WITH {_FR}, {_PK}, q AS (SELECT cell, count(*) AS x FROM fr JOIN pk ON fr.chrom = pk.chrom AND p_start < t AND p_end > s GROUP BY 1), n AS (SELECT cell, count(*) AS n FROM fr GROUP BY 1)
    SELECT n.cell, round(coalesce(x, 0)::DOUBLE / n, 6) AS frip FROM n LEFT JOIN q ON q.cell = n.cell"""
)
def frip(spark, sf_dir):
    held = model.fragments(spark, sf_dir)
    sizes = held.groupBy("cell").agg(F.count("*").alias("n_fragments"))
    return rounded(metrics.frip(intervals.quantify(held, model.peaks(spark, sf_dir)), sizes, "n"), "frip")


@query(f"WITH {_FR}, {_PK} SELECT pk.peak, q.peak AS other FROM pk JOIN pk q ON q.chrom = pk.chrom AND q.p_start <= pk.p_start + 6000 AND q.p_end >= pk.p_start - 6000")
def intervals_near_points(spark, sf_dir):
    held = model.peaks(spark, sf_dir)
    places = held.select("chrom", F.col("p_start").alias("pos"), "peak")
    return intervals.near_points(held.withColumnRenamed("peak", "other"), places, 6000).select("peak", "other")


@query(f"WITH {_FR} SELECT chrom, count(*) AS n FROM fr WHERE t - s BETWEEN 20 AND 120 GROUP BY 1")
def fragment_counts(spark, sf_dir):
    return model.fragments(spark, sf_dir).where((F.col("end") - F.col("start")).between(20, 120)).groupBy("chrom").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS feat, CASE WHEN k = 1 THEN p_type ELSE p_type || '-' || (k - 1) END AS name FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM part)")
def make_unique(spark, sf_dir):
    from celloom.sources.tables import make_unique as unique

    return unique(model.features(spark, sf_dir).select("feat", F.col("kind").alias("name")), "name", "feat").select("feat", "name")


@query()
def ligand_receptor_p(spark, sf_dir):
    """With 1,000 draws a pair, which take SQL too long; tests compare it with brute force."""
    z = stored(_infog(spark, sf_dir), "infog")
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ligand"), (F.col("p_partkey") + 1).alias("receptor"), F.col("p_type").alias("annotation"))
    found = markers.ligand_receptor_p(stored(_cosg(spark, sf_dir, z), "specificity"), pairs, _moments(spark, sf_dir, z))
    return rounded(found.select("ligand", "receptor", "annotation", "sender", "receiver", "p_value", "p_value_fdr"), "p_value", "p_value_fdr")


@query(f"{INFOG}, {_COSG} SELECT feat, grp AS cell_type, round(score, 6) AS score FROM cs WHERE grp IN ('BUILDING', 'FURNITURE') AND score >= 0 ORDER BY round(score, 9) DESC, feat, grp LIMIT 100 OFFSET 20")
def query_markers(spark, sf_dir):
    records = _cosg(spark, sf_dir).select("feat", F.col("grp").alias("cell_type"), "score")
    return rounded(markers.query_markers(records, 100, 20, min_score=0, cell_type=["BUILDING", "FURNITURE"]), "score")


@query(
    """WITH s AS (SELECT c_acctbal AS v, c_mktsegment = 'BUILDING' AS one FROM customer), n AS (SELECT (count(*) FILTER (one))::DOUBLE AS n1, (count(*) FILTER (NOT one))::DOUBLE AS n2 FROM s),
    r AS (SELECT one, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r FROM s), u AS (SELECT sum(r) FILTER (one) AS r1 FROM r),
    t AS (SELECT sum(k ** 3 - k) AS ties FROM (SELECT count(*)::DOUBLE AS k FROM s GROUP BY v)),
    f AS (SELECT max(abs(a / n1 - b / n2)) AS ks FROM (SELECT count(*) FILTER (one) OVER (ORDER BY v) AS a, count(*) FILTER (NOT one) OVER (ORDER BY v) AS b FROM s), n)
    SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, r1 - n1 * (n1 + 1) / 2 AS u, round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS u_z, round(ks, 6) AS ks FROM n, u, t, f"""
)
def two_samples(spark, sf_dir):
    held = table(spark, sf_dir, "customer").select("c_acctbal", (F.col("c_mktsegment") == "BUILDING").alias("one"))
    return rounded(stats.two_samples(held, "c_acctbal", "one"), "u_z", "ks")


_GRAPH = f"{_NN}, gr AS MATERIALIZED (SELECT query AS a, neighbour AS b FROM nn UNION SELECT neighbour, query FROM nn), pt AS (SELECT vec_id AS node, label FROM embeddings)"


def _graph(spark, sf_dir):
    near = _near(spark, sf_dir).select(F.col("query").alias("a"), F.col("neighbour").alias("b"), F.lit(1.0).alias("weight"))
    return stored(graphs.both_ways(near), "graph")


@query(f"WITH {_GRAPH}, s AS (SELECT x.label, count(*)::DOUBLE AS total, count(*) FILTER (x.label = y.label) AS inside FROM gr JOIN pt x ON x.node = a JOIN pt y ON y.node = b GROUP BY 1) SELECT round(sum(inside) / sum(total) - sum(total * total) / (sum(total) * sum(total)), 6) AS modularity FROM s")
def modularity(spark, sf_dir):
    return rounded(graphs.modularity(_graph(spark, sf_dir), model.points(spark, sf_dir).select("id", "label")), "modularity")


@query(f"WITH {_GRAPH} SELECT a, b FROM gr JOIN pt x ON x.node = a JOIN pt y ON y.node = b WHERE a % 3 = b % 3 OR x.label = y.label OR (x.label IN (0, 1) AND y.label IN (0, 1))")
def prune_edges(spark, sf_dir):
    nodes = model.points(spark, sf_dir).select(F.col("id").alias("node"), (F.col("id") % 3).alias("batch"), F.col("label").alias("cluster"))
    pairs = nodes.select(F.col("cluster").alias("ca"), F.col("cluster").alias("cb")).distinct().unionByName(spark.sql("SELECT 0 AS ca, 1 AS cb"))
    return graphs.prune(_graph(spark, sf_dir), nodes, pairs).select("a", "b")


@query(f"WITH {_GRAPH} SELECT a AS node, (i - 1)::INTEGER AS dim, round(avg(embedding[i]::DOUBLE), 6) AS value FROM gr JOIN embeddings ON vec_id = b, range(1, 65) t(i) GROUP BY 1, 2")
def stitch(spark, sf_dir):
    points = model.points(spark, sf_dir).select(F.col("id").alias("node"), F.posexplode(F.col("vec").cast("array<double>")).alias("dim", "value"))
    return rounded(graphs.stitch(_graph(spark, sf_dir), points), "value")


@query()
def communities(spark, sf_dir):
    held = model.points(spark, sf_dir)
    return graphs.communities(neighbors.fuzzy_graph(neighbors.knn(held, held, 14), 15))


@query()
def communities_within(spark, sf_dir):
    groups = model.points(spark, sf_dir).select(F.col("id").alias("node"), (F.col("label") % 2).alias("grp"))
    return graphs.within_groups(_graph(spark, sf_dir), groups)


@query()
def dendrogram(spark, sf_dir):
    rows = metrics.centroids(model.points(spark, sf_dir), "label", "vec").orderBy("label", "dim").limit(graphs.TREE_GROUPS * 64 + 1).collect()
    means = np.array([r["mean"] for r in rows]).reshape(-1, 64)
    merges = [(int(a), int(b), round(float(h), DIGITS), int(n)) for a, b, h, n in graphs.linkage(means, "ward")]
    return spark.createDataFrame(merges, "left long, right long, height double, size long")


@query()
def find_doublets(spark, sf_dir):
    return rounded(doublets.find(model.entries(spark, sf_dir), model.cells(spark, sf_dir), components=10), "doublet_score")


#: A motif matrix with one likely base a place.
def _matrix(word: str) -> np.ndarray:
    return motifs.log_odds(np.where(np.array(list(motifs.BASES))[:, None] == np.array(list(word)), 0.97, 0.01))


_SEQ = "sq AS (SELECT p_partkey AS seq, translate(md5(p_partkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGN') AS s FROM part)"
_HI, _LO = (f"log2(({p} + 0.0025::DOUBLE) / 1.01::DOUBLE / 0.25::DOUBLE)" for p in (0.97, 0.01))


def _sequences(spark, sf_dir):
    letters = F.translate(F.md5(F.col("p_partkey").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGN")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), letters.alias("s"))


@query(
    f"""WITH {_SEQ}, m(motif, word) AS (VALUES ('ebox', 'CACGTG'), ('gc', 'GGGGCC')), b AS (SELECT * FROM m UNION ALL SELECT motif, reverse(translate(word, 'ACGT', 'TGCA')) FROM m),
    w AS (SELECT seq, motif, list_sum(list_transform(range(1, 7), lambda j: (substr(s, (i + j - 1)::INTEGER, 1) = substr(word, j::INTEGER, 1))::INTEGER)) AS k FROM sq, b, range(1, 28) t(i)),
    x AS (SELECT seq, motif, k * {_HI} + (6 - k) * {_LO} AS score FROM w), h AS (SELECT seq, motif, max(score) AS best, count(*) AS n_hits FROM x WHERE score >= 0.55::DOUBLE * 6 * {_HI} + 0.45::DOUBLE * 6 * {_LO} GROUP BY 1, 2)
    SELECT seq, motif, round(best, 6) AS best, coalesce(n_hits, 0) AS n_hits FROM sq CROSS JOIN m LEFT JOIN h USING (seq, motif)"""
)
def scan_motifs(spark, sf_dir):
    held = {name: (_matrix(word), motifs.relative_threshold(_matrix(word), 0.55)) for name, word in (("ebox", "CACGTG"), ("gc", "GGGGCC"))}
    return rounded(motifs.scan(_sequences(spark, sf_dir), held, "seq", "s"), "best")


@query(
    f"""WITH {_SEQ}, n AS (SELECT sum(length(s) - length(replace(s, 'A', ''))) AS a, sum(length(s) - length(replace(s, 'C', ''))) AS c, sum(length(s) - length(replace(s, 'G', ''))) AS g, sum(length(s) - length(replace(s, 'T', ''))) AS t FROM sq)
    SELECT round((a + 1) / (a + c + g + t + 4), 6) AS a, round((c + 1) / (a + c + g + t + 4), 6) AS c, round((g + 1) / (a + c + g + t + 4), 6) AS g, round((t + 1) / (a + c + g + t + 4), 6) AS t FROM n"""
)
def base_background(spark, sf_dir):
    return rounded(motifs.background(_sequences(spark, sf_dir), "s"), "a", "c", "g", "t")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
