"""N-gram Jaccard join: a MinHash LSH forest proposes pairs of texts, which are verified by the exact Jaccard of their five-word shingles.

Each of TREES trees gives a text a signature of DEPTH values of a byte, held as one number, so that prefixes of the signature are its
leading bytes and the sorted signatures of a tree are a prefix trie. The trie is read level by level, from the longest prefix on:
texts with equal prefixes are candidates. After each level the similarities of the pairs found so far tell how many pairs such a
prefix misses (a pair of similarity s is found with a known chance, so one found stands for 1 / chance); the prefix is shortened by a
value until the share found, among the pairs nearest to the threshold, reaches the target recall.

Texts that many trees or levels put together are compared once: buckets with equal members are dropped but for one, a pair counts at
the longest prefix and in the first tree that it shares. Large buckets are compared in blocks by many tasks, and what they return is,
for each text, how many links it has and one link to the smallest member of its connected part, so nothing of quadratic size is
written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celloom.llm.groups import components, hot_join
from celloom.llm.words import in_chunks, mix, shingle_sets
from celloom.session import FILE_ROWS, in_few, ship, small, stored

THRESHOLD = 0.8
TREES, DEPTH, RECALL = 32, 8, 0.999
#: The shortest prefix, and how far over the threshold pairs count as near to it.
LEAST_DEPTH, BAND = 3, 0.05
#: Texts of a block; a bucket of more is compared block by block.
BLOCK = 256


def chance(similarity: np.ndarray | float, depth: int) -> np.ndarray | float:
    """That a pair of a similarity shares a prefix of so many values in some tree; different values share a byte once in 256 times."""
    return 1 - (1 - (similarity + (1 - similarity) / 256) ** depth) ** TREES


_SEEDS = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of TREES signatures for each text, and the numbers of distinct shingles (0: the signatures mean nothing)."""
    out, counts = np.zeros((len(texts), TREES), np.uint64), np.zeros(len(texts), np.int64)
    for a, b in in_chunks(texts, 300_000):
        hashes, at = shingle_sets(texts[a:b])
        full = np.flatnonzero(np.diff(at) > 0)
        if not len(full):
            continue
        begin, low = at[full], (hashes >> np.uint64(32)).astype(np.uint32)
        for i in full:
            counts[a + i] = len(np.unique(hashes[at[i] : at[i + 1]]))
        for k, seed in enumerate(_SEEDS):
            drawn = (low ^ np.uint32(seed >> np.uint64(32))) * np.uint32((seed & np.uint64(0xFFFFFFFF)) | np.uint64(1))
            least = np.minimum.reduceat(drawn, begin).astype(np.uint64)
            out[a + full, k // DEPTH] = (out[a + full, k // DEPTH] << np.uint64(8)) | (mix(least + seed) >> np.uint64(56))
    return out.view(np.int64), counts


def prefixes(rows: np.ndarray, depth: int) -> np.ndarray:
    return rows.view(np.uint64) >> np.uint64(8 * (DEPTH - depth))


def links_in_unit(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, tree: int, depth: int, rows: np.ndarray, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its number of links (weighted by copies) to texts of the other side, and the root of its connected part; and the
    similarities of the pairs.

    A pair counts if one is in left and the other in right, it shares no longer prefix in any tree and this one in none before this
    tree, and its Jaccard reaches the threshold. rows are the texts' signatures.
    """
    sizes = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    flat, ids = np.unique(np.concatenate(sets), return_inverse=True)
    earlier = prefixes(rows, depth)[:, :tree]
    longer = prefixes(rows, depth + 1) if depth < DEPTH else rows[:, :0]
    linked = np.zeros((len(sets), len(sets)), bool)
    found = []
    for i in np.flatnonzero(left):
        marks = np.zeros(len(flat), np.int32)
        marks[ids[at[i] : at[i] + sizes[i]]] = 1
        shared = np.add.reduceat(marks[ids], at)
        good = right & (shared >= threshold * (sizes + sizes[i] - shared) - 1e-9)
        good[i] = False
        some = np.flatnonzero(good)
        some = some[~((earlier[some] == earlier[i]).any(1) | (longer[some] == longer[i]).any(1))]
        new = some[~linked[i, some]]
        found.append(shared[new] / (sizes[new] + sizes[i] - shared[new]))
        linked[i, some] = linked[some, i] = True
    root, rest = np.arange(len(sets)), linked.any(1)
    for i in np.flatnonzero(rest):
        if not rest[i]:
            continue
        part = np.zeros(len(sets), bool)
        edge = np.array([i])
        part[i] = True
        while len(edge):
            new = linked[edge].any(0) & ~part
            part |= new
            edge = np.flatnonzero(new)
        root[part] = i
        rest[part] = False
    return linked @ weight, root, np.concatenate([*found, np.zeros(0)])


#: Bins of similarity from 0 to 1 into which pairs are counted.
BINS = 400


def recall_of(counts: dict[int, int], depth: int, threshold: float) -> float:
    """The estimated share of all pairs that prefixes of a depth find, of those within BAND over the threshold, from counts of the
    found pairs by bin of similarity; 1 if less than half a pair is missing by estimate."""
    near = [(n, float(chance((k + 0.5) / BINS, depth))) for k, n in counts.items() if (k + 0.5) / BINS < threshold + BAND]
    every = sum(n / float(chance((k + 0.5) / BINS, depth)) - n for k, n in counts.items())
    return 1.0 if every < 0.5 else sum(n for n, _ in near) / sum(n / p for n, p in near) if near else float(chance(threshold, depth))


def _links(docs: DataFrame, key: str, text: str, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(id, h) of every row, and by text (h, n, rep, class_id, keeper, n_links): its rows and least id, the class's least id and
    whether this is the text that stands for the class."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    held = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.unhex(F.md5("text")))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, counts = signatures(list(batch.text))
            yield batch.drop(columns="text").assign(n=counts, signatures=list(own))

    rows = stored(held.mapInPandas(sign, f"id {kind}, h binary, n long, signatures array<long>"), "ngram-signatures")
    texts = rows.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("n").alias("n"), F.first("signatures").alias("signatures"))
    texts = stored(texts, "ngram-texts", rows.count() * TREES // 8)  # eight numbers count as a row
    known = texts.count()

    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            own = list(batch.text)
            for a, b in in_chunks(own):
                hashes, at = shingle_sets(own[a:b])
                out += [np.unique(hashes[at[i] : at[i + 1]]).tobytes() for i in range(b - a)]
            yield pd.DataFrame({"h": batch.h, "shingles": out})

    found, seen, counts = [], None, {}
    for depth in range(DEPTH, LEAST_DEPTH - 1, -1):
        buckets, links = _level(held, texts, known, shingle, seen, depth, threshold)
        found.append(links.where("h is not null"))
        for row in links.where("h is null").groupBy("links").agg(F.sum("pairs").alias("n")).collect():
            counts[row["links"]] = counts.get(row["links"], 0) + row["n"]
        if recall_of(counts, depth, threshold) >= recall:
            break
        seen = buckets if seen is None else seen.unionByName(buckets)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    linked = every.groupBy("h").agg(F.sum("links").alias("links"))
    roots = components(every, "h", "peer").withColumnRenamed("node", "h")
    named = stored(texts.select("h", "rep", "weight").join(roots, "h", "left").withColumn("root", F.coalesce("root", "h")).join(linked, "h", "left"), "ngram-roots", known)
    least = named.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("unknown"), "rep", F.col("h").alias("first"))).alias("s"), F.count("*").alias("n"))
    least = stored(least.select("root", F.col("s.rep").alias("class_id"), F.col("s.first").alias("first"), "n"), "ngram-roots", known)
    links = F.coalesce("links", F.lit(0)) + F.when(F.col("weight") > 1, F.col("weight") - 1).otherwise(0)
    named = stored(hot_join(named, least, "root").select("h", F.col("weight").alias("n"), "rep", "class_id", (F.col("h") == F.col("first")).alias("keeper"), links.alias("n_links")), "ngram-classes", known)
    return rows.select("id", "h"), named


def _level(held: DataFrame, texts: DataFrame, known: int, shingle, seen: DataFrame | None, depth: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The buckets (m, members) of prefixes of a depth that no longer prefix had, and the stored links of their pairs: (h, peer, links,
    pairs), and with a null h for each bin of similarity (links) the number of pairs. known is the number of texts."""
    spread = texts.where("n > 0").select("h", F.posexplode("signatures").alias("tree", "key")).withColumn("key", F.shiftrightunsigned("key", 8 * (DEPTH - depth)))
    buckets = spread.groupBy("tree", "key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("h")).alias("members")).where("m > 1")
    buckets = buckets.groupBy("m", "members").agg(F.min(F.struct("tree", "key")).alias("b")).select("b.*", "m", "members")
    buckets = stored(buckets if seen is None else buckets.join(seen, ["m", "members"], "left_anti"), "ngram-buckets", known * TREES // 2)
    places = stored(spread.join(small(buckets.drop("members")), ["tree", "key"]), "ngram-places")
    units = (
        places.withColumn("blocks", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("h", F.lit("block")), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("h", "tree", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own")
    )
    wanted = small(stored(places.select("h").distinct(), "ngram-wanted", known))
    sets = held.join(wanted, "h", "left_semi").select("h", "text").dropDuplicates(["h"]).mapInPandas(shingle, "h binary, shingles binary")
    facts = sets.join(texts.select("h", "weight", "signatures"), "h")
    # a bucket's units are dealt one after the other, so that no task gets two of a large one while another has none
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.pmod(F.xxhash64("tree", "key") % parts + (F.col("hi") * (F.col("hi") + 1) / 2).cast("long") + F.col("lo"), F.lit(parts)).cast("int")
    dealt = units.join(facts, "h").repartitionById(parts, place).sortWithinPartitions("tree", "key", "lo", "hi", "h")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["h", "peer", "links", "pairs"]
        unit, members, out, pairs = None, [], [], np.zeros(BINS, np.int64)

        def close():
            tree, _, lo, hi = unit
            own = np.array([x[0] for x in members])
            sets = [np.frombuffer(x[2], np.uint64) for x in members]
            links, root, similar = links_in_unit(sets, own == lo, own == hi, tree, depth, np.array([x[3] for x in members]), np.array([x[4] for x in members]), threshold)
            out.extend((members[i][1], members[root[i]][1], int(links[i]), None) for i in np.flatnonzero(links > 0))
            np.add.at(pairs, np.minimum((similar * BINS).astype(int), BINS - 1), 1)

        for batch in batches:
            for row in batch.itertuples(index=False):
                now = (row.tree, row.key, row.lo, row.hi)
                if now != unit:
                    if len(members) > 1:
                        close()
                    unit, members = now, []
                members.append((row.own, row.h, row.shingles, row.signatures, row.weight))
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=names).astype({"pairs": "Int64"})
                out = []
        if len(members) > 1:
            close()
        out.extend((None, None, int(k), int(pairs[k])) for k in np.flatnonzero(pairs))
        yield pd.DataFrame(out, columns=names).astype({"pairs": "Int64"})

    # compared by all tasks, written by as many as the rows ask for
    links = dealt.mapInPandas(verify, "h binary, peer binary, links long, pairs long").repartition(max(1, min(parts, -(-places.count() // FILE_ROWS))))
    return buckets.select("m", "members"), stored(links, "ngram-links")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(key, copy_of, class_id, n_links) for every row of docs.

    copy_of is the least id of the rows with an equal text; class_id is the least id of all rows connected by links; n_links counts
    the other rows whose texts have a Jaccard of at least the threshold with this one's, copies among them. Texts of one to four
    words have one shingle, of all their words; texts of any length are read whole. Null texts and texts without words link to
    nothing and are classes of their own, but for equal ones, which are copies. Rows with equal ids and texts are copies, and so are
    rows with equal texts and other ids; rows with equal ids and other texts are texts of their own. Null ids are kept; they name a
    class only if none of its ids is known. An empty table gives an empty one. Other columns are ignored.
    """
    rows, named = _links(docs, key, text, threshold, recall)
    return in_few(hot_join(rows, named, "h").select(F.col("id").alias(key), F.col("rep").alias("copy_of"), "class_id", "n_links"), rows.count())


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of docs, all columns, of which each group of linked or equal texts keeps the one with the least id (nulls last).

    Rows with equal ids and other texts are told apart by their texts; of rows with the same id and the same text one is kept.
    """
    rows, named = _links(docs, key, text, threshold, recall)
    most = rows.count()
    same = stored(rows.groupBy("id", "h").agg(F.count("*").alias("times")).withColumn("n", F.lit(1)), "ngram-rows", most)
    judged = hot_join(same.drop("n"), named, "h").withColumn("stays", F.col("keeper") & F.col("id").eqNullSafe(F.col("rep")))
    judged = stored(judged.select("id", "h", "times", "stays").where("not stays or times > 1"), "ngram-judged", most)
    marked = docs.withColumn("__h", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
    on = lambda t: marked[key].eqNullSafe(t["id"]) & (marked["__h"] == t["h"])
    gone, repeated = (small(judged.where(test).select("id", "h")) for test in ("not stays", "stays"))
    once = judged.where("stays").limit(1).count()
    kept = marked.join(gone, on(gone), "left_anti")
    if once:
        marked = kept
        kept = marked.join(repeated, on(repeated), "left_anti").unionByName(marked.join(repeated, on(repeated), "left_semi").dropDuplicates([key, "__h"]))
    return kept.select(docs.columns)
