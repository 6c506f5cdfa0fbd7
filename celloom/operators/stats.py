"""Hash draws, empirical p-values, false discovery rates, votes and rank statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from celloom.session import stored


def draw(n: int, *parts: Column | int | str) -> Column:
    """A number from 0 to n-1 that the parts decide: the first 32 bits of an MD5, the same in every engine."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def bh(df: DataFrame, p: str, by: list[str] | None = None, key: list[str] | None = None) -> DataFrame:
    """df with fdr: Benjamini-Hochberg within each `by` (all rows without it); null where p is. Equal p have equal rates.

    Distinct p are dealt out by ranges over all groups and stored. A task runs through its own range, the greatest p first; from the
    other ranges of a group it gets two numbers each, the rows before and the least rate behind, so no task sees a whole group.
    """
    own = by or []
    keys = [f"__bh_k{i}" for i in range(len(own))]
    told = df.where(F.col(p).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(own, keys, strict=True)], F.col(p).alias("__bh_p"))
    held = told.groupBy(*keys, "__bh_p").agg(F.count("*").alias("__n"))
    held = stored(held.repartitionByRange(*keys, "__bh_p").withColumn("__part", F.spark_partition_id()), "bh-values")
    held = held.withColumn("__g", F.struct(*keys, F.col("__part").alias("part")))
    of = Window.partitionBy(*keys)
    sizes = held.groupBy(*keys, "__part", "__g").agg(F.sum("__n").alias("__size"))
    sizes = sizes.select("__g", (F.sum("__size").over(of.orderBy("__part")) - F.col("__size")).alias("__before"), F.sum("__size").over(of).alias("__of"))
    inside = Window.partitionBy("__g")
    raw = _same(held, sizes).withColumn("__up", F.sum("__n").over(inside.orderBy("__bh_p")))
    raw = raw.withColumn("__raw", F.col("__bh_p") * F.col("__of") / (F.col("__before") + F.col("__up")))
    raw = stored(raw.select(*keys, "__part", "__g", "__bh_p", F.min("__raw").over(inside.orderBy(F.col("__bh_p").desc())).alias("__least")), "bh-rates")
    behind = raw.groupBy(*keys, "__part", "__g").agg(F.min("__least").alias("__m"))
    behind = behind.select("__g", F.min("__m").over(of.orderBy(F.col("__part").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("__behind"))
    rates = _same(raw, behind).select(*keys, "__bh_p", F.least(F.lit(1.0), "__least", "__behind").alias("fdr"))
    kept = df.drop("fdr")
    return kept.join(rates, [F.col(p) == F.col("__bh_p"), *[F.col(c).eqNullSafe(F.col(k)) for c, k in zip(own, keys, strict=True)]], "left").select(*kept.columns, "fdr")


def _same(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows with the facts of their group __g, whose keys may be null."""
    return rows.join(facts.withColumnRenamed("__g", "__h"), F.col("__g").eqNullSafe(F.col("__h"))).drop("__h")


def monte_carlo(null: DataFrame, observed: DataFrame, keys: list[str], digits: int = 9) -> DataFrame:
    """(keys, p): (draws at or over the observed value + 1) / (draws + 1); missing draws never reach it.

    Spark takes made draws to be as few as the rows they are made of, and would broadcast them; only observed is held, in parts.
    """
    hit = F.sum(F.when(F.round("null_value", digits) >= F.round("value", digits), 1).otherwise(0))
    return observed.hint("shuffle_hash").join(null, keys).groupBy(*keys).agg(((hit + F.lit(1.0)) / (F.count("*") + F.lit(1.0))).alias("p"))


def ranks(values: DataFrame, value: str, *counts: Column) -> DataFrame:
    """(value, n0, below0, n1, below1 ...): for each distinct value the sum of each count over its rows, and over all smaller values.

    Distinct values are dealt out by ranges and stored; a task sums up its own range, and only one total a range is summed in one
    place. Null and NaN values are left out.
    """
    sums = {f"n{i}": F.sum(c).cast("long") for i, c in enumerate(counts)}
    held = values.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(value).agg(*[c.alias(n) for n, c in sums.items()])
    held = stored(held.repartitionByRange(value).withColumn("__part", F.spark_partition_id()), "ranks")
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = held.groupBy("__part").agg(*[F.sum(n).alias(n) for n in sums])
    parts = parts.select("__part", *[before(n, Window.orderBy("__part")).alias(f"__{n}") for n in sums])
    own = Window.partitionBy("__part").orderBy(value)
    below = [c for n in sums for c in (F.col(n), (before(n, own) + F.col(f"__{n}")).alias(f"below{n[1:]}"))]
    return held.join(parts, "__part").select(value, *below)


def quantiles(values: DataFrame, value: str, at: list[float]) -> DataFrame:
    """One row (q0, q1 ...): the quantiles at the given shares, by linear interpolation between neighbours; null without values."""
    held = stored(ranks(values, value, F.lit(1)), "quantile-ranks")
    total = held.agg(F.sum("n0").alias("__n"))
    picks = []
    for i, share in enumerate(at):
        place = F.lit(share) * (F.col("__n") - 1)
        take = lambda k: F.max(F.when((F.col("below0") <= k) & (k < F.col("below0") + F.col("n0")), F.col(value)))
        picks += [take(F.floor(place)).alias(f"lo{i}"), take(F.ceil(place)).alias(f"hi{i}"), F.max(place - F.floor(place)).alias(f"w{i}")]
    found = held.crossJoin(F.broadcast(total)).agg(*picks)
    return found.select(*[(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"w{i}")).alias(f"q{i}") for i in range(len(at))])


def pooled(null: DataFrame, observed: DataFrame, keys: list[str], digits: int = 9) -> DataFrame:
    """(keys, p): (draws of all rows together at or over the observed value + 1) / (draws + 1); missing draws never reach it.

    A missing observed value has a null p.
    """
    both = null.select(F.round("null_value", digits).alias("v"), F.lit(1).alias("k")).unionByName(observed.select(F.round("value", digits).alias("v"), F.lit(0).alias("k")))
    held = stored(ranks(both, "v", F.col("k")), "pooled-ranks")
    totals = null.agg(F.count("*").alias("m")).crossJoin(held.agg(F.coalesce(F.sum("n0"), F.lit(0)).alias("known")))
    seen = observed.select(*keys, F.round("value", digits).alias("v")).join(held.select("v", "below0"), "v", "left")
    return seen.crossJoin(F.broadcast(totals)).select(*keys, ((F.col("known") - F.col("below0") + F.lit(1.0)) / (F.col("m") + F.lit(1.0))).alias("p"))


def reached(values: DataFrame, value: str, count: str, by: str) -> DataFrame:
    """(by, value, reach, all): for each distinct value of a group the sum of count over its rows at or over it, and over all rows.

    Values are dealt out by ranges, so that a task sees a part of a group.
    """
    held = values.groupBy(by, value).agg(F.sum(count).alias("__n"))
    held = stored(held.repartitionByRange(by, value).withColumn("__part", F.spark_partition_id()), "reached-values")
    parts = held.groupBy(by, "__part").agg(F.sum("__n").alias("__size"))
    of = Window.partitionBy(by)
    parts = parts.select(by, "__part", F.sum("__size").over(of).alias("all"), (F.sum("__size").over(of.orderBy(F.col("__part").desc())) - F.col("__size")).alias("__behind"))
    own = Window.partitionBy(by, "__part").orderBy(F.col(value).desc())
    return held.join(parts, [by, "__part"]).select(by, value, (F.sum("__n").over(own) + F.col("__behind")).alias("reach"), "all")


def majority(neighbours: DataFrame, node: str, label: str) -> DataFrame:
    """(node, label, confidence): each node's most frequent neighbour label, ties by the smaller, and its share."""
    counts = neighbours.groupBy(node, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(node)
    ranked = counts.withColumns({"k": F.row_number().over(w.orderBy(F.col("n").desc(), label)), "of": F.sum("n").over(w)})
    return ranked.where("k = 1").select(node, label, (F.col("n") / F.col("of")).alias("confidence"))


def jaccard(sets: DataFrame, name: str, item: str) -> DataFrame:
    """(a, b, jaccard) for pairs of sets that share an item, a < b."""
    held = sets.select(F.col(name).alias("a"), F.col(item).alias("i")).distinct()
    sizes = held.groupBy("a").agg(F.count("*").alias("n"))
    shared = held.join(held.withColumnRenamed("a", "b"), "i").where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    joined = shared.join(sizes, "a").join(sizes.select(F.col("a").alias("b"), F.col("n").alias("m")), "b")
    return joined.select("a", "b", (F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).alias("jaccard"))


def two_samples(df: DataFrame, value: str, first: str) -> DataFrame:
    """One row (n1, n2, u, u_z, ks): Mann-Whitney's U of the rows where `first` holds against the others, its z (normal approximation
    with ties), and the greatest distance of both distribution functions. Null and NaN values are left out; without rows on a side
    the statistics are null."""
    held = df.select(F.col(value).cast("double").alias("v"), F.col(first).alias("one")).where("one is not null")
    by = stored(ranks(held, "v", F.col("one").cast("int"), (~F.col("one")).cast("int")), "two-samples")
    totals = by.agg(F.sum("n0").cast("double").alias("n1"), F.sum("n1").cast("double").alias("n2"))
    rows = by.select("v", F.col("n0").alias("a"), "below0", F.col("n1").alias("b"), "below1").crossJoin(F.broadcast(totals))
    tied = F.col("a").cast("double") + F.col("b")
    gap = F.abs((F.col("below0") + F.col("a")) / F.col("n1") - (F.col("below1") + F.col("b")) / F.col("n2"))
    found = rows.where("n1 > 0 and n2 > 0").agg(
        F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.sum(F.col("a") * (F.col("below1") + F.col("b") / 2.0)).alias("u"), F.sum(tied * tied * tied - tied).alias("ties"), F.max(gap).alias("ks")
    )
    n, product = F.col("n1") + F.col("n2"), F.col("n1") * F.col("n2")
    spread = F.sqrt(product / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return found.select(F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), "u", F.when(spread > 0, (F.col("u") - product / 2) / spread).alias("u_z"), "ks")


#: Parts into which rows are split while they are numbered.
PARTS = 256


def numbered(df: DataFrame, key: str, name: str = "i") -> DataFrame:
    """df with a gapless number from 0, in an order that a hash of the key decides; no task sees more than a part of the rows."""
    held = df.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(PARTS)))
    counts = held.groupBy("__part").count()
    begins = counts.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__begin"))
    within = Window.partitionBy("__part").orderBy(F.xxhash64(key), key)
    return held.join(F.broadcast(begins), "__part").withColumn(name, F.col("__begin") + F.row_number().over(within) - 1).drop("__part", "__begin")
