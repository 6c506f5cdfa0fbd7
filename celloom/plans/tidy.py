"""Queries of resolved names, orders, single-feature layers, score p-values, projections and plot tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from celloom.operators import markers, metrics, normalize, projection, tidy
from celloom.plans import catalog
from celloom.plans.catalog import _COSG, _GRAPH, _LR, _NN, _SCORE, _TOP, BASE, INFOG, C, E, P, query, rounded
from celloom.session import stored, table
from celloom.sources import model

_NATURAL = "try_cast({0} AS BIGINT) NULLS LAST, {0}::VARCHAR"


@query(f"WITH {C}, l AS (SELECT DISTINCT grp FROM c), m AS (SELECT DISTINCT batch FROM c) SELECT grp || '@' || batch AS label, (row_number() OVER (ORDER BY grp, batch) - 1)::INTEGER AS place FROM l, m")
def crossed_categories(spark, sf_dir):
    return tidy.crossed(model.cells(spark, sf_dir), "grp", "batch")


@query(f"WITH l AS (SELECT DISTINCT p_size::VARCHAR AS v FROM part UNION SELECT DISTINCT p_brand FROM part) SELECT v, (row_number() OVER (ORDER BY {_NATURAL.format('v')}) - 1)::INTEGER AS place FROM l")
def natural_order(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return tidy.categories(part.select(F.col("p_size").cast("string").alias("v")).unionByName(part.select(F.col("p_brand").alias("v"))), "v")


@query("WITH t AS (SELECT p_size AS v, count(*) AS n FROM part GROUP BY 1) SELECT v, n, (row_number() OVER (ORDER BY n DESC, v) - 1)::INTEGER AS place FROM t")
def value_ranks(spark, sf_dir):
    return tidy.value_ranks(table(spark, sf_dir, "part").select(F.col("p_size").alias("v")), "v")


@query(f"WITH {C}, t AS (SELECT grp, batch, count(*) AS n FROM c GROUP BY 1, 2) SELECT grp, batch, n, round(n / sum(n) OVER (PARTITION BY batch), 6) AS share FROM t")
def crosstab_reference(spark, sf_dir):
    return rounded(metrics.crosstab(model.cells(spark, sf_dir), "grp", "batch", "reference"), "share")


@query(
    f"""WITH {C}, t AS (SELECT 0 AS step, grp AS source, batch::VARCHAR AS target, count(*) AS n FROM c GROUP BY 2, 3 UNION ALL SELECT 1, batch::VARCHAR, (bal > 0)::VARCHAR, count(*) FROM c GROUP BY 2, 3)
    SELECT step, source, target, n, round(n / sum(n) OVER (PARTITION BY step, source), 6) AS share FROM t"""
)
def sankey_flows(spark, sf_dir):
    return rounded(tidy.flows(model.cells(spark, sf_dir).withColumn("rich", F.col("bal") > 0), ["grp", "batch", "rich"]), "share")


@query(f"WITH {C}, t AS (SELECT grp, sum(bal) AS total, avg(bal) AS mean FROM c GROUP BY 1) SELECT grp, round(total, 4) AS total, round(mean, 4) AS mean, (row_number() OVER (ORDER BY round(total, 9) DESC, grp) - 1)::INTEGER AS place FROM t")
def category_totals(spark, sf_dir):
    return rounded(tidy.totals(model.cells(spark, sf_dir), "grp", "bal"), "total", "mean", digits=4)


@query(f"{INFOG}, {_COSG}, {_TOP}, p AS (SELECT p_partkey AS feat, grp FROM part, (SELECT DISTINCT grp FROM c)) SELECT p.feat, p.grp, round(coalesce(score, 0.0::DOUBLE), 6) AS score FROM p LEFT JOIN tp ON tp.feat = p.feat AND tp.grp = p.grp")
def specificity_or_zero(spark, sf_dir):
    best = stored(markers.top_per_group(catalog._cosg(spark, sf_dir), "grp", 20), "markers")
    rows = model.features(spark, sf_dir).select("feat").crossJoin(F.broadcast(model.cells(spark, sf_dir).select("grp").distinct()))
    return rounded(tidy.or_zero(rows, best, ["feat", "grp"], "score"), "score")


@query(f"WITH {C}, i AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS k FROM (SELECT DISTINCT grp FROM c WHERE bal > 0)) SELECT c.cell, coalesce(CASE WHEN bal > 0 THEN k END, -1)::INTEGER AS label_id FROM c LEFT JOIN i ON i.grp = c.grp")
def numbered_labels(spark, sf_dir):
    held = model.cells(spark, sf_dir)
    return tidy.numbered_labels(held.select("cell"), held.where("bal > 0").select("cell", "grp"), "cell", "grp")


@query("SELECT c_custkey AS cell FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def common_cells(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "cell")
    return tidy.common([model.cells(spark, sf_dir).where("bal > 0"), orders.where("o_orderstatus = 'F'"), orders.where("o_totalprice > 100000")], "cell")


@query("SELECT l_partkey AS feat FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08")
def feature_difference(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "feat")
    return lines.where("l_quantity > 45").select("feat").subtract(lines.where("l_discount > 0.08").select("feat"))


_SETS = "s AS (SELECT p_brand AS set, CASE WHEN p_partkey % 3 = 0 THEN p_partkey::VARCHAR ELSE p_name END AS name, (p_size % 5 + 1)::DOUBLE AS weight FROM part WHERE p_size < 20)"


@query(f"WITH {P}, {_SETS}, a AS (SELECT feat, name FROM f UNION SELECT feat, feat::VARCHAR FROM f) SELECT set, feat, max(weight) AS weight FROM s JOIN a ON a.name = s.name GROUP BY 1, 2")
def resolved_sets(spark, sf_dir):
    part = table(spark, sf_dir, "part").where("p_size < 20")
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey").cast("string")).otherwise(F.col("p_name"))
    sets = part.select(F.col("p_brand").alias("set"), name.alias("name"), (F.col("p_size") % 5 + 1).cast("double").alias("weight"))
    return tidy.resolve_sets(sets, model.features(spark, sf_dir), ["feat", "name"])


@query("SELECT p_brand AS set, round(count(*) FILTER (p_size % 4 <> 0)::DOUBLE / count(*), 6) AS recovered FROM part GROUP BY 1")
def marker_recovery(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    sets = part.select(F.col("p_brand").alias("set"), F.col("p_partkey").alias("feat"))
    return rounded(tidy.recovery(sets, part.where("p_size % 4 <> 0").select(F.col("p_partkey").alias("feat"))), "recovered")


@query("WITH l AS (SELECT 'RNA' AS modality, min(p_partkey) AS feat, min_by(p_name, p_partkey) AS symbol FROM part) SELECT 'RNA' AS modality, p_partkey AS feat FROM part, l WHERE p_name = symbol")
def resolved_feature(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.lit("RNA").alias("modality"), F.col("p_partkey").alias("feat"), F.col("p_name").alias("symbol"))
    other = table(spark, sf_dir, "supplier").select(F.lit("GA").alias("modality"), F.col("s_suppkey").alias("feat"), F.col("s_name").alias("symbol"))
    name = part.orderBy("feat").first()["symbol"]
    return tidy.resolve_feature(part.unionByName(other), name, "RNA")


_LAYER = "w AS (SELECT feat FROM f WHERE brand = 'Brand#11')"


def _layer(value):
    return f"{BASE}, {P}, {_LAYER} SELECT c.cell, w.feat, round(coalesce({value}, 0.0::DOUBLE), 6) AS value FROM c CROSS JOIN w CROSS JOIN k LEFT JOIN e ON e.cell = c.cell AND e.feat = w.feat LEFT JOIN d ON d.cell = e.cell LEFT JOIN g ON g.feat = e.feat".replace(f"{P}, {P}", P)


def _one_layer(spark, sf_dir, layer):
    held, cells = stored(model.entries(spark, sf_dir), "entries"), model.cells(spark, sf_dir)
    depth = stored(normalize.depths(held, cells), "depths")
    sums = held.groupBy("feat").agg(F.sum("x").alias("total"))
    wanted = model.features(spark, sf_dir).where("brand = 'Brand#11'")
    return rounded(tidy.feature_layer(held, cells, depth, wanted, layer, sums, normalize._constants(held, cells)), "value")


@query(_layer("ln(1 + x / depth * 10000.0::DOUBLE)").replace(f", {P}", "", 1))
def layer_log1p(spark, sf_dir):
    return _one_layer(spark, sf_dir, "log1p")


@query(_layer("CASE WHEN x IS NOT NULL THEN least(x / depth * sqrt(s * t / total), sqrt(n_cells::DOUBLE)) END").replace(f", {P}", "", 1))
def layer_infog(spark, sf_dir):
    return _one_layer(spark, sf_dir, "infog")


@query(_layer("ln(1 + x / depth * 10000.0::DOUBLE) * ln(1 + n_cells / greatest(total, 1.0::DOUBLE))").replace(f", {P}", "", 1))
def layer_tfidf(spark, sf_dir):
    return _one_layer(spark, sf_dir, "tfidf")


@query(
    f"""{BASE}, {_LAYER}, m AS (SELECT w.feat, coalesce(sum(x), 0) / any_value(n_cells) AS mean, coalesce(sum(x * x), 0) / any_value(n_cells) AS q FROM w CROSS JOIN k LEFT JOIN e ON e.feat = w.feat GROUP BY 1),
    v AS (SELECT feat, mean, sqrt(greatest(q - mean * mean, 0)) AS sd FROM m)
    SELECT c.cell, v.feat, round((coalesce(x, 0.0::DOUBLE) - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS z FROM c CROSS JOIN v LEFT JOIN e ON e.cell = c.cell AND e.feat = v.feat"""
)
def dense_zscores(spark, sf_dir):
    return rounded(tidy.zscores(model.entries(spark, sf_dir), model.cells(spark, sf_dir), model.features(spark, sf_dir).where("brand = 'Brand#11'")), "z")


@query(
    f"""{INFOG}, b AS (SELECT feat FROM v ORDER BY round(var, 9) DESC, feat LIMIT 50), s AS (SELECT grp, count(*) AS size FROM c GROUP BY 1), t AS (SELECT grp, z.feat, sum(z) AS total FROM z JOIN b ON b.feat = z.feat JOIN c ON c.cell = z.cell GROUP BY 1, 2)
    SELECT s.grp, b.feat, round(coalesce(total, 0) / size, 6) AS mean FROM s CROSS JOIN b LEFT JOIN t ON t.grp = s.grp AND t.feat = b.feat"""
)
def top_variance_means(spark, sf_dir):
    return rounded(tidy.top_variance(stored(catalog._infog(spark, sf_dir), "infog"), model.cells(spark, sf_dir), "z", "grp", 50), "mean")


@query("SELECT c_nationkey AS v, (row_number() OVER (ORDER BY c_nationkey) - 1)::INTEGER AS place FROM (SELECT DISTINCT c_nationkey FROM customer)")
def split_values(spark, sf_dir):
    return tidy.split_values(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("v")), "v")


@query("SELECT (l_quantity * 4)::BIGINT::DOUBLE AS x, (l_partkey * 50 + l_linenumber * 37)::DOUBLE AS y FROM lineitem")
def scatter_columns(spark, sf_dir):
    return tidy.scatter_columns(model.fragments(spark, sf_dir), "width", "start")


_Q, _R = "(l_quantity * (sqrt(3.0::DOUBLE) / 3) - l_extendedprice / 1000.0::DOUBLE / 3) / 2.5::DOUBLE", "l_extendedprice / 1000.0::DOUBLE * 2 / 3 / 2.5::DOUBLE"


@query(
    f"""WITH h AS (SELECT {_Q} AS q, {_R} AS r FROM lineitem), a AS (SELECT q, r, round(q) AS rq, round(r) AS rr, round(-q - r) AS rs FROM h), b AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs + q + r) AS ds FROM a)
    SELECT (CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END)::BIGINT AS qx, (CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END)::BIGINT AS qy, count(*) AS n FROM b GROUP BY 1, 2"""
)
def hexbin_counts(spark, sf_dir):
    held = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / F.lit(1000.0)).alias("y"))
    return tidy.hexbins(held, "x", "y", 2.5)


@query(
    f"""WITH {C}, m AS (SELECT min(bal) AS low, max(bal) AS high FROM c) SELECT grp, least(floor((bal - low) / ((high - low) / 40.0::DOUBLE)), 39)::INTEGER AS bin, count(*) AS n, any_value(low) AS low, any_value(high) AS high FROM c, m GROUP BY 1, 2"""
)
def violin_bins(spark, sf_dir):
    return tidy.violin(model.cells(spark, sf_dir), "grp", "bal")


@query(f"WITH {C} SELECT vec_id AS cell, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label AS colour FROM embeddings")
def embedding_table(spark, sf_dir):
    held = model.points(spark, sf_dir).select(F.col("id").alias("cell"), F.col("vec")[0].cast("double").alias("x"), F.col("vec")[1].cast("double").alias("y"), F.col("label").alias("colour"))
    return tidy.select(held, ["cell", "x", "y", "colour"])


_GM = f"WITH {C}, m AS (SELECT grp, 'n' AS metric, count(*)::DOUBLE AS value FROM c GROUP BY 1 UNION ALL SELECT grp, 'bal', avg(bal) FROM c GROUP BY 1)"


@query(f"{_GM}, r AS (SELECT *, min(value) OVER (PARTITION BY metric) AS lo, max(value) OVER (PARTITION BY metric) AS hi FROM m) SELECT grp, metric, round(value, 6) AS value, round(CASE WHEN hi = lo THEN 0 ELSE (value - lo) / (hi - lo) END, 6) AS scaled FROM r")
def group_metrics_minmax(spark, sf_dir):
    held = model.cells(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("n"), F.avg("bal").alias("bal"))
    return rounded(tidy.scaled_metrics(held, "grp", ["n", "bal"]), "value", "scaled")


@query(f"{_GM}, r AS (SELECT *, avg(value) OVER (PARTITION BY metric) AS m, stddev_pop(value) OVER (PARTITION BY metric) AS sd FROM m) SELECT grp, metric, round(value, 6) AS value, round(CASE WHEN sd = 0 THEN 0 ELSE (value - m) / sd END, 6) AS scaled FROM r")
def group_metrics_zscore(spark, sf_dir):
    held = model.cells(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("n"), F.avg("bal").alias("bal"))
    return rounded(tidy.scaled_metrics(held, "grp", ["n", "bal"], "zscore"), "value", "scaled")


def _pairs(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ligand"), (F.col("p_partkey") + 1).alias("receptor"), F.col("p_type").alias("annotation"))
    scores = stored(catalog._cosg(spark, sf_dir), "specificity")
    left, right = (scores.select(F.col("feat").alias(a), F.col("grp").alias(b), F.col("score").alias(c)) for a, b, c in (("ligand", "sender", "ls"), ("receptor", "receiver", "rs")))
    return markers.ligand_receptor(scores, pairs).join(left, ["ligand", "sender"]).join(right, ["receptor", "receiver"]).where("ls >= 0 and rs >= 0")


_PAIRS = f"{INFOG}, {_COSG}, {_LR}, q AS (SELECT ligand, receptor, annotation, a.grp AS sender, b.grp AS receiver, a.score AS ls, b.score AS rs, a.score * b.score AS score FROM pr JOIN cs a ON a.feat = ligand JOIN cs b ON b.feat = receptor WHERE a.score >= 0 AND b.score >= 0)"


@query(
    f"""{_PAIRS}, t AS (SELECT *, ls / CASE WHEN ls + rs = 0 THEN 1 ELSE ls + rs END * score AS ly, rs / CASE WHEN ls + rs = 0 THEN 1 ELSE ls + rs END * score AS ry FROM q)
    SELECT ligand, receptor, sender, receiver, round(least(ly, 0.01::DOUBLE), 9) AS ligand_y, ly > 0.01::DOUBLE AS ligand_clipped, round(-least(ry, 0.01::DOUBLE), 9) AS receptor_y, ry > 0.01::DOUBLE AS receptor_clipped FROM t"""
)
def lollipop_shares(spark, sf_dir):
    out = tidy.score_shares(_pairs(spark, sf_dir), "ls", "rs", "score", high=0.01)
    return rounded(out.select("ligand", "receptor", "sender", "receiver", "ligand_y", "ligand_clipped", "receptor_y", "receptor_clipped"), "ligand_y", "receptor_y", digits=9)


@query(
    f"""{_PAIRS} SELECT ligand, receptor, annotation, sender, receiver, round(score, 9) AS score, row_number() OVER (PARTITION BY annotation ORDER BY round(score, 9) DESC, ligand, receptor, sender, receiver)::INTEGER AS rank FROM q QUALIFY rank <= 5"""
)
def top_pairs(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("annotation").orderBy(F.round("score", 9).desc(), "ligand", "receptor", "sender", "receiver")
    held = _pairs(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    return rounded(held.select("ligand", "receptor", "annotation", "sender", "receiver", "score", "rank"), "score", digits=9)


@query(
    """WITH h AS (SELECT p_partkey AS feat, (p_size - 25) / 25.0::DOUBLE AS v, p_name || '-->' || p_type AS label FROM part), g AS (SELECT feat, label, 0.1 + (exp(v * 1.5) - exp(-1.5)) * 9.4 / (exp(1.5) - exp(-1.5)) AS m FROM h),
    t AS (SELECT feat, round(20 * least(greatest(m, 0.1), 9.5), 6) AS size, CASE WHEN length(label) <= 16 THEN label ELSE (CASE WHEN length(split_part(label, '-->', 1)) > 8 THEN substr(split_part(label, '-->', 1), 1, 7) || '…' ELSE split_part(label, '-->', 1) END)
      || '-->' || (CASE WHEN length(split_part(label, '-->', 2)) > 8 THEN substr(split_part(label, '-->', 2), 1, 7) || '…' ELSE split_part(label, '-->', 2) END) END AS label FROM g)
    SELECT feat, size::DOUBLE AS size, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY feat) = 1 THEN label ELSE label || ' (' || row_number() OVER (PARTITION BY label ORDER BY feat) || ')' END AS label FROM t"""
)
def lollipop_shapes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    held = part.select(F.col("p_partkey").alias("feat"), tidy.circle_size(F.col("p_size") - 25, 20.0, 1.5, 25.0).alias("size"), tidy.short_label(F.concat_ws("-->", "p_name", "p_type"), 16).alias("label"))
    return rounded(tidy.distinct_labels(held, "label", ["feat"]), "size")


_RECORDS = "mk AS (SELECT feat, cs.grp AS cell_type, 'study' || (feat % 3) AS study, CASE WHEN feat % 2 = 0 THEN 'mouse' END AS species, score FROM cs)"


def _records(spark, sf_dir):
    scores = stored(catalog._cosg(spark, sf_dir), "specificity")
    records = scores.select("feat", F.col("grp").alias("cell_type"), F.concat(F.lit("study"), (F.col("feat") % 3).cast("string")).alias("study"), F.when(F.col("feat") % 2 == 0, "mouse").alias("species"), "score")
    return scores, records


@query(
    f"""{INFOG}, {_COSG}, {_TOP}, {_RECORDS}, h AS (SELECT tp.grp AS set, cell_type || '|' || study || '|' || coalesce(species, '') AS label, count(*) AS count, avg(mk.score) AS avg_score, array_to_string(list_sort(list(DISTINCT tp.feat)), ',') AS features FROM tp JOIN mk ON mk.feat = tp.feat GROUP BY 1, 2 HAVING count(*) >= 6),
    bm AS (SELECT *, row_number() OVER (PARTITION BY set ORDER BY count DESC, round(avg_score, 9) DESC, label) AS k FROM h)
    SELECT s.set, coalesce(bm.label, 'Unassigned') AS label, coalesce(bm.count, 0) AS count, round(bm.avg_score, 6) AS avg_score, bm.features AS features FROM (SELECT DISTINCT grp AS set FROM tp) s LEFT JOIN bm ON bm.set = s.set AND bm.k = 1"""
)
def best_matches(spark, sf_dir):
    scores, records = _records(spark, sf_dir)
    sets = stored(markers.top_per_group(scores, "grp", 20).select(F.col("grp").alias("set"), "feat"), "sets")
    return rounded(tidy.best_matches(records, sets, ["cell_type", "study", "species"], 6), "avg_score")


@query(f"{INFOG}, {_COSG}, {_RECORDS} SELECT study, count(*) AS n_records, (row_number() OVER (ORDER BY study) - 1)::INTEGER AS place FROM mk GROUP BY 1")
def study_listing(spark, sf_dir):
    return tidy.listing(_records(spark, sf_dir)[1], "study")


@query(f"{INFOG}, {_COSG}, {_RECORDS}, t AS (SELECT cell_type, study, count(*) AS n FROM mk GROUP BY 1, 2) SELECT cell_type, study, n FROM t QUALIFY row_number() OVER (PARTITION BY cell_type ORDER BY n DESC, study) = 1")
def recommended_studies(spark, sf_dir):
    return tidy.recommended_study(_records(spark, sf_dir)[1], "cell_type", "study")


@query(
    f"""WITH {_GRAPH}, v AS (SELECT a AS node, label FROM gr JOIN pt ON node = b UNION ALL SELECT node, label FROM pt), t AS (SELECT node, label, count(*) AS n FROM v GROUP BY 1, 2)
    SELECT node, label, round(n / sum(n) OVER (PARTITION BY node), 6) AS confidence FROM t QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, label) = 1"""
)
def smoothed_labels(spark, sf_dir):
    return rounded(tidy.smoothed_labels(catalog._graph(spark, sf_dir), model.points(spark, sf_dir).select(F.col("id").alias("node"), "label")), "confidence")


@query(
    f"""WITH {_NN}, r AS (SELECT query AS node, label FROM nn JOIN embeddings ON vec_id = neighbour WHERE rank <= 5), t AS (SELECT node, label, count(*) AS n FROM r GROUP BY 1, 2)
    SELECT node, label, round(n / sum(n) OVER (PARTITION BY node), 6) AS confidence FROM t QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, label) = 1"""
)
def smoothed_labels_nearest(spark, sf_dir):
    near = stored(catalog._near(spark, sf_dir).select(F.col("query").alias("a"), F.col("neighbour").alias("b"), (-F.col("rank")).cast("double").alias("weight")), "graph")
    return rounded(tidy.smoothed_labels(near, model.points(spark, sf_dir).select(F.col("id").alias("node"), "label"), 5, own=False), "confidence")


@query(
    """WITH fr AS (SELECT l_suppkey % 5 AS chrom, l_partkey * 50 + l_linenumber * 37 AS s, l_partkey * 50 + l_linenumber * 37 + (l_quantity * 4)::BIGINT AS t, l_orderkey AS cell FROM lineitem),
    st AS (SELECT s_suppkey % 5 AS chrom, s_suppkey * 997 AS pos FROM supplier), w AS (SELECT chrom, pos, true AS centre FROM st UNION ALL SELECT chrom, pos - 1550, false FROM st UNION ALL SELECT chrom, pos + 1550, false FROM st),
    h AS (SELECT cell, count(*) FILTER (centre) AS centre, count(*) FILTER (NOT centre) AS flanks FROM fr JOIN w ON fr.chrom = w.chrom AND pos - 50 < t AND pos + 50 > s AND s < t GROUP BY 1)
    SELECT f.cell, coalesce(centre, 0) AS centre, coalesce(flanks, 0) AS flanks, CASE WHEN coalesce(flanks, 0) = 0 THEN 0.0 ELSE round(centre * 2.0::DOUBLE / flanks, 6) END::DOUBLE AS enrichment FROM (SELECT DISTINCT cell FROM fr) f LEFT JOIN h ON h.cell = f.cell"""
)
def tss_enrichment(spark, sf_dir):
    sites = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 5).alias("chrom"), (F.col("s_suppkey") * 997).alias("pos"))
    return rounded(tidy.tss_enrichment(model.fragments(spark, sf_dir), sites), "enrichment")


_PVALUES = f"""{INFOG}, {_COSG}, {_TOP}, {_SCORE}, d2 AS (SELECT set, i AS draw, feat, weight, (('0x' || substr(md5(concat_ws('|', feat, set, i, 1927)), 1, 8))::BIGINT % 30) + 1 AS rank FROM st, range(0, 100) t(i)),
  ct AS (SELECT set, draw, neighbour AS feat, sum(weight) AS weight FROM d2 JOIN nn USING (feat, rank) GROUP BY 1, 2, 3), nz AS (SELECT cell, set, draw, round(sum(z * weight), 9) AS v FROM z JOIN ct ON ct.feat = z.feat GROUP BY 1, 2, 3),
  qs AS (SELECT cell, set, round(sum(z * weight), 9) AS q FROM z JOIN st ON st.feat = z.feat GROUP BY 1, 2), h AS MATERIALIZED (SELECT c.cell, sz.set, sz, coalesce(q, 0.0::DOUBLE) AS q FROM c CROSS JOIN sz LEFT JOIN qs ON qs.cell = c.cell AND qs.set = sz.set),
  gd AS MATERIALIZED (SELECT h.cell, h.set, h.q, coalesce(v, 0.0::DOUBLE) AS v FROM h CROSS JOIN range(0, 100) t(i) LEFT JOIN nz ON nz.cell = h.cell AND nz.set = h.set AND nz.draw = i),
  o AS (SELECT cell, set, (count(*) FILTER (v >= q) + 1.0::DOUBLE) / 101.0::DOUBLE AS p_mc, sum(v) / 100.0::DOUBLE AS mean FROM gd GROUP BY 1, 2),
  ev AS (SELECT set, v, sum(k) AS k FROM (SELECT set, v, 1 AS k FROM gd UNION ALL SELECT set, q, 0 FROM h) GROUP BY 1, 2), rk AS (SELECT set, v, sum(k) OVER (PARTITION BY set ORDER BY v DESC) AS reach, sum(k) OVER (PARTITION BY set) AS n FROM ev),
  sp AS (SELECT h.cell, h.set, q / sz AS score_query, mean / sz AS score_ctrl_average, p_mc, (reach + 1.0::DOUBLE) / (n + 1.0::DOUBLE) AS p FROM h JOIN o ON o.cell = h.cell AND o.set = h.set JOIN rk ON rk.set = h.set AND rk.v = q),
  fr AS (SELECT *, p_mc * count(*) OVER (PARTITION BY set) / row_number() OVER (PARTITION BY set ORDER BY p_mc, cell) AS ra, p * count(*) OVER (PARTITION BY set) / row_number() OVER (PARTITION BY set ORDER BY p, cell) AS rb FROM sp),
  fd AS (SELECT *, least(1.0::DOUBLE, min(ra) OVER (PARTITION BY set ORDER BY p_mc, cell ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_mc_fdr, least(1.0::DOUBLE, min(rb) OVER (PARTITION BY set ORDER BY p, cell ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_fdr FROM fr)"""
_P = ["score", "score_query", "score_ctrl_average", "p_mc", "p_mc_fdr", "p", "p_fdr", "nlog10_p_mc", "nlog10_p_mc_fdr", "nlog10_p", "nlog10_p_fdr"]


def _p_values(spark, sf_dir):
    z = stored(catalog._infog(spark, sf_dir), "infog")
    sets = stored(markers.top_per_group(catalog._cosg(spark, sf_dir, z), "grp", 20).select(F.col("grp").alias("set"), "feat", F.lit(1.0).alias("weight")), "sets")
    return markers.score_p_values(z, catalog._moments(spark, sf_dir, z), sets, "z", model.cells(spark, sf_dir))


@query(f"""{_PVALUES} SELECT cell, set, round(score_query - score_ctrl_average, 6) AS score, round(score_query, 6) AS score_query, round(score_ctrl_average, 6) AS score_ctrl_average, {', '.join(f'round({p}, 6) AS {p}, round(-log10({p}), 6) AS nlog10_{p}' for p in ('p_mc', 'p_mc_fdr', 'p', 'p_fdr'))} FROM fd""")
def score_p_values(spark, sf_dir):
    return rounded(_p_values(spark, sf_dir).select("cell", "set", *_P), *_P)


@query(f"{_PVALUES} SELECT cell, set AS label, round(-log10(p), 6) AS score FROM sp QUALIFY row_number() OVER (PARTITION BY cell ORDER BY round(-log10(p), 9) DESC, set) = 1")
def predict_by_marker_p(spark, sf_dir):
    held = _p_values(spark, sf_dir).select("cell", "set", F.col("nlog10_p").alias("score"))
    return rounded(markers.predict(held), "score")


_HALVES = f"""WITH e0 AS (SELECT o_custkey AS cell, l_partkey AS feat, count(*)::DOUBLE AS x FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2), c0 AS (SELECT c_custkey AS cell, c_mktsegment AS grp, c_nationkey AS batch, c_acctbal AS bal FROM customer),
  c AS (SELECT * FROM c0 WHERE batch % 2 = 0), e AS (SELECT e0.* FROM e0 JOIN c ON c.cell = e0.cell)"""
_PROJECT = f"""{INFOG.replace(f"WITH {E}, {C}", _HALVES)}, {_COSG}, {_TOP}, {_SCORE}, nm AS (SELECT set, sqrt(sum(score * score)) AS l FROM sc GROUP BY 1),
  qc AS (SELECT * FROM c0 WHERE batch % 2 = 1), qe AS (SELECT e0.* FROM e0 JOIN qc ON qc.cell = e0.cell JOIN g ON g.feat = e0.feat), qd AS (SELECT cell, sum(x) AS depth FROM qe GROUP BY 1),
  qz AS (SELECT qe.cell, qe.feat, least(x / depth * sqrt(s * t / total), sqrt(n_cells::DOUBLE)) AS z FROM qe JOIN qd ON qd.cell = qe.cell JOIN g ON g.feat = qe.feat CROSS JOIN k),
  qs AS (SELECT cell, wt.set, sum(z * weight) / any_value(sz) AS score FROM qz JOIN wt ON wt.feat = qz.feat JOIN sz ON sz.set = wt.set GROUP BY 1, 2),
  qf AS (SELECT qc.cell, sz.set, coalesce(score, 0.0::DOUBLE) / CASE WHEN l < 1e-12::DOUBLE THEN 1 ELSE l END AS y FROM qc CROSS JOIN sz JOIN nm ON nm.set = sz.set LEFT JOIN qs ON qs.cell = qc.cell AND qs.set = sz.set),
  qr AS (SELECT *, sqrt(sum(y * y) OVER (PARTITION BY cell)) AS n FROM qf), qx AS (SELECT cell, set, round(y / CASE WHEN n < 1e-12::DOUBLE THEN 1 ELSE n END, 9) AS score FROM qr),
  rf AS (SELECT cell, sc.set, score / CASE WHEN l < 1e-12::DOUBLE THEN 1 ELSE l END AS y FROM sc JOIN nm ON nm.set = sc.set), rr AS (SELECT *, sqrt(sum(y * y) OVER (PARTITION BY cell)) AS n FROM rf),
  rx AS (SELECT cell, set, round(y / CASE WHEN n < 1e-12::DOUBLE THEN 1 ELSE n END, 9) AS score FROM rr),
  ql AS MATERIALIZED (SELECT cell, list(score ORDER BY set) AS v FROM qx GROUP BY 1), rl AS MATERIALIZED (SELECT cell, list(score ORDER BY set) AS v FROM rx GROUP BY 1)"""


def _halves(spark, sf_dir):
    cells, entries = model.cells(spark, sf_dir), stored(model.entries(spark, sf_dir), "entries")
    mine, theirs = (cells.where(F.col("batch") % 2 == r) for r in (1, 0))
    reference = projection.fit(entries.join(theirs.select("cell"), "cell", "left_semi"), theirs, "grp")
    return reference, entries.join(mine.select("cell"), "cell", "left_semi"), mine, theirs


@query(f"{_PROJECT} SELECT cell, set, round(score, 6) AS score FROM qx")
def project_gdr(spark, sf_dir):
    reference, entries, cells, _ = _halves(spark, sf_dir)
    return rounded(projection.project(reference, entries, cells), "score")


@query(
    f"""{_PROJECT}, w AS (SELECT a.cell, round(list_distance(a.v, b.v), 9) AS d FROM ql a, rl b QUALIFY row_number() OVER (PARTITION BY a.cell ORDER BY round(list_distance(a.v, b.v), 9), b.cell) <= 15),
    o AS (SELECT a.cell, round(list_distance(a.v, b.v), 9) AS d FROM rl a, rl b WHERE a.cell <> b.cell QUALIFY row_number() OVER (PARTITION BY a.cell ORDER BY round(list_distance(a.v, b.v), 9), b.cell) <= 15),
    q AS (SELECT quantile_cont(n, 0.99::DOUBLE) AS q FROM (SELECT round(avg(d), 9) AS n FROM o GROUP BY cell)) SELECT cell, round(round(avg(d), 9), 6) AS novelty, round(avg(d), 9) > any_value(q) AS novel FROM w, q GROUP BY 1"""
)
def project_gdr_novelty(spark, sf_dir):
    reference, entries, cells, _ = _halves(spark, sf_dir)
    return rounded(projection.novelty(reference, projection.project(reference, entries, cells)).select("cell", "novelty", "novel"), "novelty")


@query(
    f"""{_PROJECT}, w AS (SELECT a.cell, b.cell AS other FROM ql a, rl b QUALIFY row_number() OVER (PARTITION BY a.cell ORDER BY round(list_distance(a.v, b.v), 9), b.cell) <= 15),
    vt AS (SELECT w.cell, grp AS label, count(*) AS n FROM w JOIN c ON c.cell = other GROUP BY 1, 2) SELECT cell, label, round(n / sum(n) OVER (PARTITION BY cell), 6) AS confidence FROM vt QUALIFY row_number() OVER (PARTITION BY cell ORDER BY n DESC, label) = 1"""
)
def predict_by_gdr(spark, sf_dir):
    reference, entries, cells, known = _halves(spark, sf_dir)
    labels = known.select(F.col("cell").alias("neighbour"), F.col("grp").alias("label"))
    return rounded(projection.predict(reference, projection.project(reference, entries, cells), labels), "confidence")


_BATCHES = f"""{INFOG}, zb AS (SELECT z.*, grp, batch % 3 AS b FROM z JOIN c ON c.cell = z.cell), m AS (SELECT grp, batch % 3 AS b, count(*) AS n FROM c GROUP BY 1, 2),
  a AS (SELECT grp, b, feat, sum(z) AS s, sum(z * z) AS q FROM zb GROUP BY 1, 2, 3), x AS (SELECT a.*, s / (sqrt(sum(q) OVER (PARTITION BY feat, a.b)) * sqrt(n::DOUBLE)) AS cos FROM a JOIN m ON m.grp = a.grp AND m.b = a.b),
  cs AS (SELECT grp || '@' || b AS grp, feat, cos ** 3 / (sum(cos * cos) OVER (PARTITION BY feat, b)) AS score FROM x), {_TOP}, st AS (SELECT grp AS set, feat, 1.0::DOUBLE AS weight FROM tp), nb AS (SELECT batch % 3 AS b, count(*) AS n FROM c GROUP BY 1),
  vb AS (SELECT zb.b, feat, sum(z) / any_value(n) AS mean, sum(z * z) / any_value(n) - (sum(z) / any_value(n)) ** 2 AS var FROM zb JOIN nb ON nb.b = zb.b GROUP BY 1, 2), pt AS MATERIALIZED (SELECT b, feat, round(mean, 9) AS mean, round(var, 9) AS var FROM vb),
  nn AS (SELECT a.b, a.feat, o.feat AS neighbour, row_number() OVER (PARTITION BY a.b, a.feat ORDER BY round(sqrt((a.mean - o.mean) ** 2 + (a.var - o.var) ** 2), 9), o.feat) AS rank FROM pt a JOIN pt o ON a.b = o.b AND a.feat <> o.feat WHERE a.feat IN (SELECT feat FROM st)),
  dr AS (SELECT set, feat, weight, (('0x' || substr(md5(concat_ws('|', feat, set, i, 1927)), 1, 8))::BIGINT % 30) + 1 AS rank FROM st, range(0, 100) t(i)),
  wt AS (SELECT b, set, feat, sum(weight) AS weight FROM (SELECT b, set, feat, weight FROM st, nb UNION ALL SELECT b, set, neighbour, -weight / 100.0::DOUBLE FROM dr JOIN nn USING (feat, rank)) GROUP BY 1, 2, 3),
  sz AS (SELECT set, median(weight) * count(*) AS sz FROM st GROUP BY 1), ss AS (SELECT cell, wt.set, sum(z * weight) / any_value(sz) AS score FROM zb JOIN wt ON wt.feat = zb.feat AND wt.b = zb.b JOIN sz ON sz.set = wt.set GROUP BY 1, 2),
  sc AS (SELECT c.cell, batch % 3 AS b, sz.set, coalesce(score, 0.0::DOUBLE) AS score FROM c CROSS JOIN sz LEFT JOIN ss ON ss.cell = c.cell AND ss.set = sz.set),
  y AS (SELECT *, score / greatest(sqrt(sum(score * score) OVER (PARTITION BY b, set)), 1e-300::DOUBLE) AS y FROM sc), r AS (SELECT *, sqrt(sum(y * y) OVER (PARTITION BY cell, split_part(set, '@', 2))) AS n FROM y)"""


@query(f"{_BATCHES} SELECT cell, set, round(round(y / CASE WHEN n < 1e-12::DOUBLE THEN 1 ELSE n END, 9), 6) AS score FROM r")
def gdr_batches(spark, sf_dir):
    cells = model.cells(spark, sf_dir).withColumn("part", (F.col("batch") % 3).cast("string"))
    return rounded(projection.gdr_batches(stored(catalog._infog(spark, sf_dir), "infog"), cells, "grp", "part"), "score")


@query()
def gdr_clusters(spark, sf_dir):
    """The embedding without given groups: communities of the neighbour graph of an INFOG decomposition are the groups."""
    z = stored(catalog._infog(spark, sf_dir), "infog")
    return rounded(projection.gdr_clusters(z, model.cells(spark, sf_dir), 10), "score")


@query("SELECT chrom, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, chrom) - 1)::INTEGER AS place FROM (SELECT l_suppkey % 5 AS chrom FROM lineitem) GROUP BY 1")
def chromosome_order(spark, sf_dir):
    counts = model.fragments(spark, sf_dir).groupBy("chrom").agg(F.count("*").alias("n"))
    return tidy.ranked(counts, [F.col("n").desc(), F.col("chrom")])



