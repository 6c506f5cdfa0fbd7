"""SpotSigs fingerprints: chains of content words that follow common-word anchors; in Spark SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from celloom.llm.decontamination import let, words
from celloom.session import small, stored

#: Common words of English, French, German and Spanish, which chains skip.
COMMON = """
a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their there they this to
was were which will with you
au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour qui que sa se ses son sur un
une vous
als am auch auf aus bei bin das dem den der die ein eine einem einen einer es für hat ich im ist mit nach nicht oder sich sie sind und
von war wie wir zu zum zur
al como con del el ella era está ha la las lo los más me mi muy no para pero por se sin su sus también un una y ya yo
""".split()

#: The common words at which chains start.
ANCHORS = """
a an the that is was of to and
le la les un une de du est et
der die das ein eine und von ist zu
el los las una que y en es
""".split()

#: Words of a chain, and the words behind an anchor among which they are looked for.
CHAIN, REACH = 2, 12


def signatures(text: Column) -> Column:
    """The sorted distinct spot signatures of a text, hashed to 32 bits.

    An anchor and the next CHAIN words that are not common, among the REACH words behind it, make one. A text with words but
    without such a chain has one signature, of all its words; a text without words (null, empty) has none.
    """
    def of(own: Column) -> Column:
        content = F.transform(own, lambda w: F.when(w.isin(COMMON), F.lit("")).otherwise(w))
        whole = F.array(F.hash(F.array_join(own, " ")))
        spots = let(content, lambda kept: F.array_sort(F.array_distinct(F.filter(F.transform(own, lambda w, i: spot(kept, w, i)), lambda s: s.isNotNull()))))
        return F.when(F.size(own) == 0, F.array().cast("array<int>")).otherwise(let(spots, lambda found: F.when(F.size(found) == 0, whole).otherwise(found)))

    def spot(content: Column, word: Column, i: Column) -> Column:
        def chained(chain: Column) -> Column:
            return F.when(F.size(chain) >= CHAIN, F.hash(word, *[F.get(chain, F.lit(j)) for j in range(CHAIN)]))

        return F.when(word.isin(ANCHORS), let(F.filter(F.slice(content, i + 2, REACH), lambda w: w != ""), chained))

    return let(words(text), of)


def as_text(found: Column) -> Column:
    """Signatures as one string, eight hex digits each."""
    return F.array_join(F.transform(found, lambda s: F.lpad(F.lower(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets; 1 for two empty ones. Sets with nothing to share are not intersected."""
    shared = F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(F.size(F.array_intersect(a, b)))
    return let(shared, lambda n: F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def successors(rows: DataFrame, key: str) -> DataFrame:
    """rows(row, key, ...) in descending order of key (nulls last, then by row) with next_row: the row that follows, the first after the last.

    Rows are numbered within ranges of the key, so no task sees them all; the ranges, as many as there are shuffle partitions,
    are chained by their first rows.
    """
    order = [F.col(key).desc_nulls_last(), F.col("row")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ordered")
    within = Window.partitionBy("part").orderBy(*order)
    placed = ranged.withColumns({"place": F.row_number().over(within), "after": F.lead("row").over(within)})
    firsts = placed.where("place = 1").select("part", F.col("row").alias("first"))
    chain = Window.orderBy("part")
    whole = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    jumps = firsts.select("part", F.coalesce(F.lead("first").over(chain), F.first("first").over(whole)).alias("jump"))
    return placed.join(F.broadcast(jumps), "part").withColumn("next_row", F.coalesce("after", "jump")).drop("part", "place", "after", "jump")


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited, found, next_found): for each text its length in code points, the text with its last third replaced by
    the start of the next document, its signatures and the next document's.

    The last floor(n_chars / 3) code points give way to the first as many (or all) of the next document in descending order of key.
    Null texts are empty. A single document is its own successor. Rows with equal keys follow each other in a fixed order; rows
    equal in key and text are one document in this order, and each gets its results. Null keys come last.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    name = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n"))
    held = docs.select(F.unhex(F.md5(F.concat(name, F.lit("|"), own))).alias("row"), F.col(key).alias("key"), own.alias("text"))
    known = stored(held.select("row", "key", F.char_length("text").cast("long").alias("n_chars"), signatures(F.col("text")).alias("found")), "signatures")
    order = stored(successors(known.select("row", "key", "n_chars").distinct(), "key").drop("key"), "successors")
    found = known.select("row", "found").dropDuplicates(["row"])
    facts = order.join(found.withColumnRenamed("row", "next_row").withColumnRenamed("found", "next_found"), "next_row").join(found, "row")
    starts = (
        held.join(small(order.select(F.col("next_row").alias("row"), F.col("row").alias("to"), F.floor(F.col("n_chars") / 3).cast("int").alias("cut")), width=128), "row")
        .select(F.col("to").alias("row"), F.expr("substring(text, 1, cut)").alias("start"))
    )
    if known.count() != order.count():  # rows repeat
        starts = starts.groupBy("row").agg(F.first("start").alias("start"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))"), "start")
    return held.join(facts, "row").join(starts, "row").select(F.col("key").alias(key), "n_chars", edited.alias("edited"), "found", "next_found")


def near_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(key_a, key_b, likeness) of different signature sets at or over the threshold, one key standing for all rows of equal sets.

    Sets are partitioned by length so that sets within the threshold lie in one partition or two neighbours. A set enters the index
    under as many of its rarest signatures as a set within the threshold cannot all lack; candidates whose lengths differ too much
    are pruned before their sets are compared. Empty sets pair with nothing.
    """
    sets = docs.select(F.col(key).alias("key"), signatures(F.col(text)).alias("found")).where(F.size("found") > 0)
    sets = stored(sets.groupBy("found").agg(F.min("key").alias("key")).withColumn("n", F.size("found")), "signature-sets")
    step = -math.log(threshold)
    sets = sets.withColumn("span", F.floor(F.log(F.col("n").cast("double")) / F.lit(step) + 1e-9).cast("int"))
    rarity = sets.select(F.explode("found").alias("sig")).groupBy("sig").agg(F.count("*").alias("df"))
    spread = sets.select("key", "n", "span", F.explode("found").alias("sig")).join(rarity, "sig")
    ranked = spread.withColumn("rank", F.row_number().over(Window.partitionBy("key", "n").orderBy("df", "sig")))
    index = stored(ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).select("key", "n", "span", "sig"), "signature-index")
    other = index.select(F.col("key").alias("key_b"), F.col("n").alias("n_b"), F.col("span").alias("span_b"), "sig")
    other = other.withColumn("span", F.explode(F.array(F.col("span_b") - 1, F.col("span_b"))))
    near = index.withColumnRenamed("key", "key_a").join(other, ["sig", "span"])
    near = near.where((F.least("n", "n_b") >= F.lit(threshold) * F.greatest("n", "n_b") - 1e-9) & ((F.col("span") < F.col("span_b")) | (F.col("key_a") < F.col("key_b"))))
    near = near.select("key_a", "key_b").distinct()
    left, right = (sets.select(F.col("key").alias(k), F.col("found").alias(f)) for k, f in (("key_a", "f_a"), ("key_b", "f_b")))
    compared = near.join(left, "key_a").join(right, "key_b").withColumn("likeness", likeness(F.col("f_a"), F.col("f_b")))
    return compared.where(F.col("likeness") >= F.lit(threshold) - 1e-9).select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), "likeness")
