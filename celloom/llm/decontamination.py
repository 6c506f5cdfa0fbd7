"""Benchmark decontamination by size-partitioned MinHash containment search, in Spark SQL functions only.

A test item's sketch is the k of its shingles with the smallest hashes. Documents are not sketched, as a sketch of a long document
would not show a short item: each of their shingles looks for items whose sketch has it. Items are partitioned by size, each partition
up to twice the size of the one before: k and the least number of hits depend on the partition alone. A document that contains a share
t of an item misses at most (1 - t) of the partition's greatest size, so one with fewer hits than k less this number is no candidate,
and no other is lost. Candidates are then verified by the exact share of the item's shingles, compared as strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celloom.llm.groups import hot_join
from celloom.llm.words import SEPARATOR, SHINGLE
from celloom.session import small, stored

#: The smallest sketch; items of no more shingles are in theirs whole.
LEAST_SKETCH = 16
THRESHOLD = 0.8
#: Most items quoted by very many documents whose shingles are broadcast.
ITEMS = 10_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, also where lambdas inside use it; the optimizer would inline a plain column."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), lambda w: w != "")


def _starts(own: Column) -> Column:
    """Places (from 0) at which shingles start: one for one to four words, none without words."""
    return F.when(F.size(own) > 0, F.sequence(F.lit(0), F.greatest(F.size(own) - SHINGLE, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def shingles(text: Column) -> Column:
    """Distinct shingles as strings."""
    return let(words(text), lambda own: F.array_distinct(F.transform(_starts(own), lambda i: F.array_join(F.slice(own, i + 1, SHINGLE), " "))))


def shingle_hashes(text: Column) -> Column:
    """Distinct hashes of the shingles, without making their strings."""
    return let(words(text), lambda own: F.array_distinct(F.transform(_starts(own), lambda i: F.xxhash64(*[F.get(own, i + j) for j in range(SHINGLE)]))))


def sketch_sizes(n: Column, threshold: float) -> tuple[Column, Column]:
    """(k, hits that a candidate needs) of an item of n shingles, by the partition of sizes from a power of two to the next.

    k is at least twice what a document at the threshold may lack, so that a candidate has over half of the sketch.
    """
    largest = F.pow(F.lit(2.0), F.length(F.bin(n))) - 1
    lacking = F.floor(largest * F.lit(1 - threshold) + 1e-6).cast("int")
    k = F.least(n, F.greatest(F.lit(LEAST_SKETCH), 2 * lacking))
    return k, F.greatest(F.lit(1), k - lacking)


def find(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc key, item key, n_shared, n_item, containment) for pairs with containment >= threshold: the share of the item's distinct
    five-word shingles that the document has.

    Texts are lower-cased and split at SEPARATOR. An item of one to four words is one shingle, which only a text of just these words
    has; items and texts without words (null, empty) match nothing. Rows with a null id are left out. Of repeated ids the best row
    counts, and a pair comes once. Texts and items of any length are read whole. Empty tables give an empty one. Other columns are
    ignored.
    """
    return _find(docs, items, threshold, key, text, item_key, item_text)[0]


def _find(docs: DataFrame, items: DataFrame, threshold: float, key: str, text: str, item_key: str, item_text: str) -> tuple[DataFrame, int]:
    """What find() returns, and the most pairs that it can have."""
    told = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("__item"), F.col(item_text).alias("w"))
    told = told.select("__item", shingles(F.col("w")).alias("item_shingles"), shingle_hashes(F.col("w")).alias("h")).where(F.size("h") > 0)
    told = stored(told.withColumn("__row", F.monotonically_increasing_id()), "benchmark-items")
    n = F.size("h")
    k, need = sketch_sizes(n, threshold)
    sketch = stored(told.select("__item", "__row", need.alias("need"), F.explode(F.slice(F.array_sort("h"), 1, k)).alias("h")), "benchmark-sketches")
    held = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("__doc"), F.col(text).alias("__text"))
    hits = held.select("__doc", F.explode(shingle_hashes(F.col("__text"))).alias("h")).join(small(sketch), "h")
    pairs = hits.groupBy("__doc", "__row").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need").select("__doc", "__row")
    pairs = stored(pairs, "benchmark-candidates")
    most = pairs.count()
    docs_hit = small(stored(pairs.select("__doc").distinct(), "benchmark-candidate-documents", most))
    texts = held.join(docs_hit, "__doc", "left_semi").select("__doc", shingles(F.col("__text")).alias("doc_shingles"))
    wanted = told.select("__item", "__row", "item_shingles").join(pairs.groupBy("__row").agg(F.count("*").alias("n")), "__row")
    exact = (
        hot_join(texts.join(pairs, "__doc"), stored(wanted, "benchmark-wanted"), "__row", ITEMS)
        .select("__doc", "__item", F.size(F.array_intersect("doc_shingles", "item_shingles")).alias("n_shared"), F.size("item_shingles").alias("n_item"))
        .where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item") - 1e-9)
    )
    best = exact.groupBy("__doc", "__item").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("c"), "n_shared", "n_item")).alias("b"))
    found = best.select(F.col("__doc").alias(key), F.col("__item").alias(item_key), F.col("b")["n_shared"].alias("n_shared"), F.col("b")["n_item"].alias("n_item"), F.col("b")["c"].alias("containment"))
    return found, most


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose id has no pair in find(); rows with a null id stay."""
    pairs, most = _find(docs, items, threshold, key, text, "item_id", "text")
    found = stored(pairs.select(key).distinct(), "benchmark-contaminated", most)
    return docs.join(small(found), key, "left_anti").select(docs.columns)
