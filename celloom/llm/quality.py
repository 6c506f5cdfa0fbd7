"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays for numpy traversal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from celloom.llm.words import in_chunks, word_hashes
from celloom.session import ship, small, stored

#: Most labelled rows that a fit uses: those with the smallest hashes of their ids.
FIT_ROWS = 20_000

#: The classes of bytes whose shares are statistics.
_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\r\f\v",
    "line": b"\n",
    "stop": b".!?",
    "comma": b",;:",
    "mark": b"#$%&*+=<>@\\^_`|~{}[]/",
}
STATISTICS = [
    "log_bytes", "log_words", "log_lines", "mean_word", "spread_word", "long_word_share", "words_a_line", "distinct_share", "log_distinct", "top_word_share", "repeat_share",
    "repeated_lines", "sentence_words", "high_share", *(f"{k}_share" for k in _CLASSES), "bang_a_word",
]

_TABLE = np.full(256, len(_CLASSES) + 1, np.uint8)
for _i, _v in enumerate(_CLASSES.values()):
    _TABLE[list(_v)] = _i
_TABLE[128:] = len(_CLASSES)


def statistics(texts: list[str]) -> np.ndarray:
    """A row of STATISTICS for each whole text; an empty text has zeros."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for a, b in in_chunks(texts):
        hashes, at = word_hashes(texts[a:b])
        for i in range(a, b):
            text = texts[i]
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            if not len(data):
                continue
            share = np.bincount(_TABLE[data], minlength=len(_CLASSES) + 2)[: len(_CLASSES) + 1] / len(data)
            own = hashes[at[i - a] : at[i - a + 1]]
            words = max(len(own), 1)
            lengths = np.fromiter(map(len, text.split()), np.int64)
            lengths = lengths if len(lengths) else np.zeros(1, np.int64)
            ordered = np.sort(own)
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(own) else np.zeros(0, np.int64)
            runs = np.diff(np.append(first, len(own)))
            lines = text.split("\n")
            repeats = 1 - len(set(lines)) / len(lines)
            stops = max(text.count(".") + text.count("?"), 1)
            out[i] = [
                np.log1p(len(data)), np.log1p(len(own)), np.log1p(len(lines)), lengths.mean(), lengths.std(), (lengths > 14).mean(), len(own) / len(lines), len(first) / words, np.log1p(len(first)),
                (runs.max() if len(runs) else 0) / words, (own[1:] == own[:-1]).sum() / words, repeats, np.log1p(words / stops), share[-1], *share[:-1], text.count("!") / words,
            ]
    return out


@dataclass
class Trees:
    """All trees in flat arrays: node i of tree t splits on feature[t, i] at threshold[t, i]; leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, all rows moving down a tree together."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = x[rows, self.feature[t, node]] > self.threshold[t, node]
                node = np.where(right, self.right[t, node], self.left[t, node])
            total += self.value[t, node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, least: int = 8, ridge: float = 1.0) -> Trees:
    """Boosted trees for a 0/1 label with the logistic loss, grown on binned features from sums of gradients per bin.

    Without rows every score is 0.5; with labels of one kind all scores lean to it.
    """
    slots = 2 ** (depth + 1) - 1
    feature, threshold = np.zeros((trees, slots), np.int64), np.full((trees, slots), np.inf)
    left = np.tile(np.arange(slots), (trees, 1))
    right, value = left.copy(), np.zeros((trees, slots))
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    model = Trees(feature, threshold, left, right, value, base, depth)
    if not len(y):
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    total = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        members = {0: np.arange(len(y))}
        for node in range(slots):
            if node not in members:
                continue
            rows = members.pop(node)
            g, h = grad[rows].sum(), hess[rows].sum()
            value[t, node] = rate * g / (h + ridge)
            best = (1e-6, None)
            if 2 * node + 2 < slots and len(rows) >= 2 * least:
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    own = binned[rows, f]
                    gs, hs, ns = (np.cumsum(np.bincount(own, w, len(c) + 1))[:-1] for w in (grad[rows], hess[rows], None))
                    gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                    gain[(ns < least) | (len(rows) - ns < least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (f, k))
            if best[1] is None:
                total[rows] += value[t, node]
                continue
            f, k = best[1]
            feature[t, node], threshold[t, node] = f, cuts[f][k]
            left[t, node], right[t, node] = 2 * node + 1, 2 * node + 2
            down = binned[rows, f] > k
            members[2 * node + 1], members[2 * node + 2] = rows[~down], rows[down]
    return model


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep, and __x: the statistics of the whole text (null: empty)."""
    ship(docs.sparkSession)
    held = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = held.drop("__text").schema.add("__x", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = statistics(list(batch["__text"]))
            yield batch.drop(columns="__text").assign(__x=list(x))

    return held.mapInPandas(run, schema)


def train(scored: DataFrame, labels: DataFrame, key: str, label: str, rows: int = FIT_ROWS) -> Trees:
    """Fits on the rows of scored(key, __x) that labels(key, label) covers: at most `rows`, those with the smallest hashes of the key.

    Ids or labels that are null are left out. Several labels of one id count by their mean, a half as 1.
    """
    told = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("__y"))
    held = scored.join(told, key).withColumn("__h", F.pmod(F.xxhash64(key, F.lit("fit")), F.lit(1 << 30)))
    count = held.count()
    if count > rows:  # so that tasks don't each send as many rows as are wanted in all
        held = held.where(F.col("__h") < int((1 << 30) * min(1.0, 1.2 * rows / count + 0.01)))
    taken = held.select("__h", key, "__x", "__y").orderBy("__h", key, "__x").limit(rows).collect()
    x = np.array([r["__x"] for r in taken]).reshape(len(taken), len(STATISTICS))
    return fit(x, np.array([r["__y"] for r in taken], float))


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> DataFrame:
    """(key, held_out, score, predicted) for every row. Only rows whose crc32(key as text) mod 3 is not 1 teach the trees.

    The statistics are made once, in one pass over the texts, and stored; only they meet the labels. A null key is held out and
    never teaches. Repeated rows get equal scores. Null texts are scored as empty ones; texts of any length are read whole. Without
    labels every score is 0.5. Empty documents give an empty table.
    """
    spark = docs.sparkSession
    held = with_statistics(docs, [key], text)
    held = stored(held.withColumn("held_out", F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(True))), "quality-statistics")
    model = spark.sparkContext.broadcast(train(held.where("not held_out"), labels, key, label, rows))
    schema = held.drop("__x").schema.add("score", T.DoubleType()).add("predicted", T.IntegerType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["__x"]) if len(batch) else np.zeros((0, len(STATISTICS)))
            score = model.value.score(x)
            yield batch.drop(columns="__x").assign(score=score, predicted=(score >= 0.5).astype("int32"))

    return held.mapInPandas(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of docs, all columns, that the classifier does not reject.

    Only labelled rows are read to fit it, then every row is judged by its whole text. Rows with a null key are judged by their text
    alike, null texts as empty ones; repeated rows stay or go together. Without labels nothing is rejected; an empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    told = small(stored(labels.select(key).where(F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1).distinct(), "quality-labelled", labels.count()))
    teach = stored(with_statistics(docs.join(told, key, "left_semi"), [key], text), "quality-statistics")
    model = spark.sparkContext.broadcast(train(teach, labels, key, label))
    schema = docs.schema
    whole = docs.select("*", F.coalesce(F.col(text), F.lit("")).alias("__t"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[model.value.score(statistics(list(batch["__t"]))) >= 0.5].drop(columns="__t")

    return whole.mapInPandas(judge, schema)
