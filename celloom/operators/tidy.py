"""Tidy tables: resolved names, ordered categories, single-feature layers, and the rows that a plot would draw."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from celloom.session import small, spread, stored

#: Most values of a whole-number column by which a plot is split.
SPLITS = 50


def select(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, in this order; one that is not there raises and names those that are."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"no column {', '.join(missing)}; columns are {', '.join(df.columns)}")
    return df.select(*columns)


def natural_order(value: Column) -> list[Column]:
    """Sort keys: whole numbers first, by their value, then other texts."""
    return [value.cast("string").try_cast("bigint").asc_nulls_last(), value.cast("string").asc()]


def ranked(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df, of few rows (categories, groups), with its place from 0 in an order."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def categories(df: DataFrame, column: str) -> DataFrame:
    """(column, place): the distinct values, nulls left out, in natural order."""
    return ranked(df.where(F.col(column).isNotNull()).select(column).distinct(), natural_order(F.col(column)))


def crossed(df: DataFrame, a: str, b: str, sep: str = "@", second_first: bool = False) -> DataFrame:
    """(label, place): every pair of the values of two columns, also those without rows, in the order of the first, then the second
    (second_first: the other way round)."""
    left, right = categories(df, a).withColumnRenamed("place", "pa"), categories(df, b).withColumnRenamed("place", "pb")
    pairs = left.crossJoin(F.broadcast(right)).withColumn("label", F.concat_ws(sep, F.col(a).cast("string"), F.col(b).cast("string")))
    return ranked(pairs, [F.col("pb"), F.col("pa")] if second_first else [F.col("pa"), F.col("pb")]).select("label", "place")


def value_ranks(df: DataFrame, column: str, ascending: bool = False) -> DataFrame:
    """(column, n, place): counts of the values in the order of their counts, ties in natural order."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return ranked(counts, [F.col("n").asc() if ascending else F.col("n").desc(), *natural_order(F.col(column))])


def flows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(step, source, target, n, share): rows from each value of a column to those of the next one, and their share of the source's."""
    steps = [df.select(F.lit(i).alias("step"), F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target")) for i, (a, b) in enumerate(zip(columns, columns[1:], strict=False))]
    counts = reduce(DataFrame.unionByName, steps).dropna().groupBy("step", "source", "target").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("step", "source")))


def totals(df: DataFrame, category: str, value: str) -> DataFrame:
    """(category, total, mean, place): sums and means of a value, the greatest sum first; ties by the category."""
    sums = df.groupBy(category).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return ranked(sums, [F.round("total", 9).desc(), F.col(category)])


def or_zero(rows: DataFrame, facts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with the value of their keys in facts, 0 where there is none."""
    return rows.join(facts.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def numbered_labels(cells: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """cells(key, ...) with label_id: the place of its label in natural order, -1 for a cell without one."""
    ids = categories(labels, label).withColumnRenamed("place", "label_id")
    held = labels.join(F.broadcast(ids), label).select(key, "label_id")
    return cells.join(held, key, "left").withColumn("label_id", F.coalesce("label_id", F.lit(-1)))


def common(keys: list[DataFrame], key: str) -> DataFrame:
    """(key): what all tables hold."""
    return reduce(lambda a, b: a.intersect(b), [t.select(key) for t in keys])


def resolve_sets(sets: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """(set, feat, weight): the features that a set's names mean under any of the name columns; of a feature that several names of a
    set mean, the greatest weight. Names that mean nothing are left out."""
    alias = reduce(DataFrame.unionByName, [features.select("feat", F.col(n).cast("string").alias("name")) for n in names]).dropna().distinct()
    own = sets.groupBy("set", "name").agg(F.max("weight").alias("weight"))  # else a common name gives rows times features
    return own.join(alias, "name").groupBy("set", "feat").agg(F.max("weight").alias("weight"))


def recovery(sets: DataFrame, features: DataFrame, least: float = 0.2, share: float = 0.5) -> DataFrame:
    """(set, recovered): the share of each set's features that features(feat) holds. Raises if more than a share of the sets recover
    less than the least."""
    held = features.select("feat", F.lit(1).alias("__in")).distinct()
    found = stored(sets.join(held, "feat", "left").groupBy("set").agg((F.count("__in") / F.count("*")).alias("recovered")), "recovery")
    low, n = found.agg(F.coalesce(F.sum((F.col("recovered") < least).cast("int")), F.lit(0)), F.count("*")).first()
    if n and low / n > share:
        raise ValueError(f"{low} of {n} sets recover less than {least:.0%} of their features")
    return found


def resolve_feature(features: DataFrame, name: str, modality: str | None = None) -> DataFrame:
    """(modality, feat): the rows of features(modality, feat, symbol) that a name means in one modality.

    A name that none has raises KeyError, one that several have is ambiguous unless the modality is given, and one that another
    modality has is told so.
    """
    found = features.where(F.col("symbol") == name)
    held = sorted(r[0] for r in found.select("modality").distinct().limit(100).collect())
    if not held:
        raise KeyError(f"no feature {name}")
    if modality is None and len(held) > 1:
        raise ValueError(f"{name} is in {', '.join(held)}; say which")
    if modality is not None and modality not in held:
        raise KeyError(f"no feature {name} in {modality}; it is in {', '.join(held)}")
    return found.where(F.col("modality") == (modality or held[0])).select("modality", "feat")


def feature_layer(entries: DataFrame, cells: DataFrame, depth: DataFrame, features: DataFrame, layer: str, totals: DataFrame, constants: DataFrame, scale: float = 1e4) -> DataFrame:
    """(cell, feat, value) of few features for every cell, in a layer made from counts and stored sums: counts, log1p, infog or tfidf.

    depth(cell, depth), totals(feat, total), constants(n_cells, s, t). The features are filtered before anything is computed.
    """
    few = stored(features.select("feat").distinct(), "layer-features")
    held = entries.join(small(few), "feat").join(depth, "cell").join(totals, "feat").crossJoin(F.broadcast(constants))
    share = F.col("x") / F.when(F.col("depth") == 0, 1.0).otherwise(F.col("depth"))
    value = {
        "counts": F.col("x"),
        "log1p": F.log1p(share * F.lit(scale)),
        "infog": F.least(share * F.sqrt(F.col("s") * F.col("t") / F.col("total")), F.sqrt(F.col("n_cells").cast("double"))),
        "tfidf": F.log1p(share * F.lit(scale)) * F.log1p(F.col("n_cells") / F.greatest("total", F.lit(1.0))),
    }[layer]
    return every_pair(held.select("cell", "feat", value.alias("value")), cells, few.withColumn("value", F.lit(0.0)))


#: Features of a block whose rows of a cell are made at once.
WIDE = 8192


def every_pair(held: DataFrame, cells: DataFrame, features: DataFrame) -> DataFrame:
    """(cell, feat, value) for every cell and feature: held(cell, feat, value) where it has a row, one at most, and with a value, else the
    value of features(feat, value), each once.

    Only rows of held are shuffled, not those that are made: a cell gets the stretches between its own features in a block of all
    features, and each stretch becomes rows where it is. A feature's value is a double.
    """
    n, m = features.count(), cells.count()
    block = F.pmod(F.xxhash64("feat"), F.lit(max(1, -(-n // WIDE)))).cast("int")
    blocks = stored(features.groupBy(block.alias("__b")).agg(F.sort_array(F.collect_list(F.struct("feat", F.col("value").cast("double").alias("value")))).alias("__all")), "feature-blocks")
    places = blocks.select("__b", F.posexplode("__all").alias("__at", "__f")).select("__b", "__at", F.col("__f.feat").alias("feat"))
    own = held.where("value is not null").join(small(stored(places, "feature-places")), "feat").groupBy("cell", "__b").agg(F.sort_array(F.collect_list(F.struct("__at", F.col("value").cast("double").alias("value")))).alias("__own"))
    every = cells.select("cell").crossJoin(F.broadcast(blocks.select("__b", F.size("__all").alias("__n"))))
    last = F.array(F.struct(F.col("__n").alias("__at"), F.lit(None).cast("double").alias("value")))
    ends = F.concat(F.coalesce("__own", F.array().cast(own.schema["__own"].dataType)), last)
    every = spread(every.join(own, ["cell", "__b"], "left").select("cell", "__b", ends.alias("__ends")), n * m)
    gaps = F.transform("__ends", lambda e, i: F.struct(F.when(i == 0, 0).otherwise(F.try_element_at("__ends", i)["__at"] + 1).alias("begin"), e["__at"].alias("end"), e["value"].alias("value")))
    every = every.select("cell", "__b", F.explode(gaps).alias("__g")).join(small(blocks, width=WIDE * 32), "__b")
    one = F.array(F.struct(F.get("__all", F.col("__g.end"))["feat"].alias("feat"), F.col("__g.value").alias("value")))
    made = F.concat(F.slice("__all", F.col("__g.begin") + 1, F.col("__g.end") - F.col("__g.begin")), F.when(F.col("__g.value").isNull(), F.array().cast(blocks.schema["__all"].dataType)).otherwise(one))
    return every.select("cell", F.explode(made).alias("__p")).select("cell", F.col("__p.feat").alias("feat"), F.col("__p.value").alias("value"))


def zscores(entries: DataFrame, cells: DataFrame, features: DataFrame) -> DataFrame:
    """(cell, feat, z) for every cell and feature given: the value less the feature's mean, over its deviation over all cells (0: 1)."""
    few = features.select("feat").distinct()
    n = cells.agg(F.count("*").alias("n"))
    sums = entries.join(cells.select("cell"), "cell", "left_semi").groupBy("feat").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).crossJoin(F.broadcast(n))
    mean = F.col("s") / F.col("n")
    held = sums.select("feat", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("sd"))
    known = stored(few.join(held, "feat", "left").fillna(0.0, ["mean", "sd"]), "feature-deviations")
    z = lambda x: ((x - F.col("mean")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))).alias("value")
    own = entries.join(small(known), "feat").select("cell", "feat", z(F.coalesce("x", F.lit(0.0))))
    return every_pair(own, cells, known.select("feat", z(F.lit(0.0)))).withColumnRenamed("value", "z")


def top_variance(values: DataFrame, cells: DataFrame, value: str, group: str, n: int) -> DataFrame:
    """(group, feat, mean): group means, zeros counted, of the n features of the greatest variance over all cells."""
    of = cells.agg(F.count("*").alias("n_cells"))
    sums = values.groupBy("feat").agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")).crossJoin(F.broadcast(of))
    mean = F.col("s") / F.col("n_cells")
    best = stored(sums.select("feat", F.round(F.col("q") / F.col("n_cells") - mean * mean, 9).alias("var")).orderBy(F.col("var").desc(), "feat").limit(n).select("feat"), "top-variance")
    sizes = cells.groupBy(group).agg(F.count("*").alias("size"))
    held = values.join(small(best), "feat").join(cells.select("cell", group), "cell").groupBy(group, "feat").agg(F.sum(value).alias("total"))
    return sizes.crossJoin(F.broadcast(best)).join(held, [group, "feat"], "left").select(group, "feat", (F.coalesce("total", F.lit(0.0)) / F.col("size")).alias("mean"))


def split_values(df: DataFrame, column: str) -> DataFrame:
    """(column, place): the values by which a plot is split, in order. A column of fractions raises, and so does one of whole numbers
    with more than SPLITS values."""
    kind = df.schema[column].dataType.simpleString()
    if kind in ("double", "float") or kind.startswith("decimal"):
        raise ValueError(f"{column} is continuous")
    found = stored(df.where(F.col(column).isNotNull()).select(column).distinct(), "split-values")
    if kind in ("int", "bigint", "smallint", "tinyint") and (n := found.count()) > SPLITS:
        raise ValueError(f"{column} has {n} values, over {SPLITS}; give it as text if it names categories")
    return ranked(found, [F.col(column)])


def scatter_columns(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y) of feature intervals: a column that is text counts as numbers if more than half of it reads as such; width is end - start."""
    out = []
    for name, alias in ((x, "x"), (y, "y")):
        if name == "width" and {"start", "end"} <= set(df.columns):
            out.append((F.col("end") - F.col("start")).cast("double").alias(alias))
            continue
        select(df, [name])
        if df.schema[name].dataType.simpleString() != "string":
            out.append(F.col(name).cast("double").alias(alias))
            continue
        read, n = df.agg(F.count(F.col(name).try_cast("double")), F.count("*")).first()
        out.append((F.col(name).try_cast("double") if read > 0.5 * n else F.col(name)).alias(alias))
    return df.select(*out)


def hexbins(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """(qx, qy, n): points counted by cells of a hexagonal grid of a width, by axial coordinates."""
    q = (F.col(x) * F.lit(3.0**0.5 / 3) - F.col(y) / 3) / F.lit(width)
    r = F.col(y) * 2 / 3 / F.lit(width)
    rq, rr, rs = F.round(q), F.round(r), F.round(-q - r)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
    qx = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    qy = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr)
    return df.groupBy(qx.cast("long").alias("qx"), qy.cast("long").alias("qy")).agg(F.count("*").alias("n"))


def violin(values: DataFrame, group: str, value: str, bins: int = 40) -> DataFrame:
    """(group, bin, n, low, high): each group's values counted in so many equal bins over the range of all values."""
    limits = values.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    held = values.where(F.col(value).isNotNull() & F.col(group).isNotNull()).crossJoin(F.broadcast(limits))
    step = (F.col("high") - F.col("low")) / F.lit(float(bins))
    place = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("low")) / step), F.lit(bins - 1)))
    return held.groupBy(group, place.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"))


def scaled_metrics(df: DataFrame, key: str, columns: list[str], how: str = "minmax") -> DataFrame:
    """(key, metric, value, scaled): each metric over all groups scaled to 0..1, or to mean 0 and population deviation 1; no spread: 0."""
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("m")).select(key, "m.*")
    w = Window.partitionBy("metric")
    shift = F.min("value").over(w) if how == "minmax" else F.avg("value").over(w)
    size = F.max("value").over(w) - F.min("value").over(w) if how == "minmax" else F.stddev_pop("value").over(w)
    return long.withColumn("scaled", F.when(size == 0, F.lit(0.0)).otherwise((F.col("value") - shift) / size))


def score_shares(pairs: DataFrame, ligand: str, receptor: str, score: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """pairs with ligand_y (over the axis) and receptor_y (under it): the score divided by the two specificities, held within limits.

    low and high are the least and greatest distance from the axis; what they change is marked as clipped. Pairs without any
    specificity have shares of 0.
    """
    total = F.col(ligand) + F.col(receptor)
    total = F.when(total == 0, 1.0).otherwise(total)
    sides = {"ligand": F.col(ligand) / total * F.col(score), "receptor": F.col(receptor) / total * F.col(score)}
    out = {}
    for side, size in sides.items():
        held = size if low is None else F.greatest(size, F.lit(float(low)))
        held = held if high is None else F.least(held, F.lit(float(high)))
        out |= {f"{side}_y": held if side == "ligand" else -held, f"{side}_clipped": held != size}
    return pairs.withColumns(out)


def circle_size(value: Column, base: float, level: float, span: float) -> Column:
    """A size that grows exponentially with a value over its span: a share of the base from 0.1 at -1 to 5 + 3 x level at 1."""
    least, most = 0.1, 5.0 + 3.0 * level
    grown = (F.exp(value / F.lit(span) * F.lit(level)) - F.exp(F.lit(-level))) / (F.exp(F.lit(level)) - F.exp(F.lit(-level)))
    return F.lit(base) * F.least(F.greatest(F.lit(least) + grown * F.lit(most - least), F.lit(least)), F.lit(most))


def short_label(label: Column, longest: int, sep: str = "-->") -> Column:
    """A label of at most so many characters: both sides of the separator are cut at half each, others at the end; … stands for the rest."""
    cut = lambda c, n: F.when(F.char_length(c) > longest // 2, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)
    parts = F.split(label, sep.replace("|", "\\|"))
    both = F.concat(cut(parts[0], longest // 2 - 1), F.lit(sep), cut(F.get(parts, F.lit(1)), longest // 2 - 1))
    return F.when(F.char_length(label) <= longest, label).when(F.size(parts) == 2, both).otherwise(F.concat(F.substring(label, 1, longest - 1), F.lit("…")))


def distinct_labels(df: DataFrame, label: str, order: list[str]) -> DataFrame:
    """df with the k-th repeat of a label, in an order, marked (k)."""
    k = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return df.withColumn("__k", k).withColumn(label, F.when(F.col("__k") == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit(" ("), F.col("__k"), F.lit(")")))).drop("__k")


def best_matches(markers: DataFrame, sets: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """(set, label, count, avg_score, features): for each set the group of marker records by the given columns that most of its features
    hit, then of the best mean score, then first in order; sets without any such group are Unassigned."""
    name = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by])
    hits = sets.join(markers, "feat").groupBy("set", name.alias("label")).agg(F.count("*").alias("count"), F.avg("score").alias("avg_score"), F.array_join(F.transform(F.array_sort(F.collect_set("feat")), lambda x: x.cast("string")), ",").alias("features"))
    best = hits.where(F.col("count") >= least).groupBy("set").agg(F.min(F.struct((-F.col("count")).alias("a"), (-F.round("avg_score", 9)).alias("b"), "label", "count", "avg_score", "features")).alias("m"))
    every = sets.select("set").distinct().join(best, "set", "left")
    return every.select("set", F.coalesce("m.label", F.lit("Unassigned")).alias("label"), F.coalesce("m.count", F.lit(0)).alias("count"), F.col("m.avg_score").alias("avg_score"), F.col("m.features").alias("features"))


def listing(markers: DataFrame, column: str) -> DataFrame:
    """(column, n_records, place): the values of a column of marker records in order."""
    return ranked(markers.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n_records")), [F.col(column)])


def recommended_study(markers: DataFrame, topic: str, study: str) -> DataFrame:
    """(topic, study, n): for each topic the study with the most records; ties fall to the first by name."""
    counts = markers.groupBy(topic, study).agg(F.count("*").alias("n"))
    return counts.groupBy(topic).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(study).alias("s"))).alias("b")).select(topic, F.col("b.s").alias(study), (-F.col("b.k")).alias("n"))


def smoothed_labels(edges: DataFrame, labels: DataFrame, k: int | None = None, own: bool = True) -> DataFrame:
    """(node, label, confidence): the most frequent label among a node's k neighbours of the greatest weight (all), the node's own one
    among them if own; ties fall to the first label. edges(a, b, weight), labels(node, label)."""
    near = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight")
    if k is not None:
        order = Window.partitionBy("node").orderBy(F.col("weight").desc(), "other")
        near = near.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k)
    votes = near.join(labels.select(F.col("node").alias("other"), "label"), "other").select("node", "label")
    votes = votes.unionByName(labels.select("node", "label")) if own else votes
    counts = votes.groupBy("node", "label").agg(F.count("*").alias("n"))
    best = counts.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("k"), "label")).alias("b"), F.sum("n").alias("of"))
    return best.select("node", F.col("b.label").alias("label"), (-F.col("b.k") / F.col("of")).alias("confidence"))


def tss_enrichment(fragments: DataFrame, sites: DataFrame, slop: int = 50, shift: int = 1550) -> DataFrame:
    """(cell, centre, flanks, enrichment): fragments over windows of +-slop around sites(chrom, pos) and around places shift away on
    either side; enrichment is the centre over the mean of both flanks, 0 without any."""
    from celloom.operators.intervals import overlaps

    places = [("centre", 0), ("flank", -shift), ("flank", shift)]
    windows = [sites.select("chrom", (F.col("pos") + d - slop).alias("p_start"), (F.col("pos") + d + slop).alias("p_end"), F.lit(name).alias("peak")) for name, d in places]
    hits = overlaps(fragments, reduce(DataFrame.unionByName, windows)).groupBy("cell")
    found = hits.agg(F.sum((F.col("peak") == "centre").cast("long")).alias("centre"), F.sum((F.col("peak") == "flank").cast("long")).alias("flanks"))
    every = fragments.select("cell").distinct().join(found, "cell", "left").fillna(0, ["centre", "flanks"])
    return every.withColumn("enrichment", F.when(F.col("flanks") == 0, F.lit(0.0)).otherwise(F.col("centre") * 2.0 / F.col("flanks")))


def palette(n: int, saturation: float = 0.65, lightness: float = 0.55) -> list[str]:
    """n colours as #rrggbb, hues a golden angle apart so that any first few differ."""
    from colorsys import hls_to_rgb

    colours = [hls_to_rgb((0.61803398875 * i) % 1.0, lightness, saturation) for i in range(n)]
    return ["#" + "".join(f"{round(255 * x):02x}" for x in c) for c in colours]
