"""Lexical retrieval packing: a sharded BM25 inverted index gives each seed document its unused neighbours, which fill its window."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celloom.llm.tokens import Encoder
from celloom.llm.words import mix
from celloom.session import ship, stored

WINDOW = 1024
#: The id that ends a document.
END = 0
#: Documents and tokens of a shard of the index; a longer document is a shard of its own.
SHARD_DOCS, SHARD_TOKENS = 2048, 2_000_000
#: The inverse share of a shard's documents from which a term counts as common.
DENSE = 4
#: Terms drawn for a document's place in the corpus.
PLACES = 4
K1, B = 1.2, 0.75


def release() -> None:
    """Gives back what a worker kept from tokenising: the encoder and freed memory."""
    Encoder._made.clear()
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _draws() -> np.ndarray:
    """A cost of each id for each of PLACES draws: exponential, by a weight that rises with the id, as ids of rare pieces are high."""
    ids = np.arange(1 << 16, dtype=np.uint64)
    seeds = mix(np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    uniform = ((mix((ids[None] + np.uint64(1)) * np.uint64(0xD1342543DE82EF95) ^ seeds[:, None]) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
    return -np.log(uniform) / np.log(2 + ids.astype(float) / 256) ** 2


def places(parts: list[np.ndarray], draws: np.ndarray) -> np.ndarray:
    """A number for each document, given by its terms, whose order brings alike ones together: the drawn terms' hashes, 16 bits each.

    Two documents draw the same term with a chance of their weighted Jaccard, so documents that share many rare terms share leading
    bits, and copies share all.
    """
    begin = np.cumsum([0, *map(len, parts[:-1])])
    terms = np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
    out = np.zeros(len(parts), np.uint64)
    for costs in draws if len(parts) else ():
        own = costs[terms]
        first = np.flatnonzero(own == np.repeat(np.minimum.reduceat(own, begin), [len(p) for p in parts]))
        drawn = terms[first[np.searchsorted(first, begin)]].astype(np.uint64)
        out = (out << np.uint64(16)) | (mix(drawn + np.uint64(1)) >> np.uint64(48))
    return out.view(np.int64)


def distinct(ids: list[np.ndarray]) -> list[np.ndarray]:
    """The distinct ids of each document, rising, by one sort of all documents' ids."""
    sizes = [len(x) for x in ids]
    held = np.repeat(np.arange(len(ids), dtype=np.uint64) << np.uint64(16), sizes) | np.concatenate([np.zeros(0, np.uint16), *ids])
    held.sort()
    held = held[np.append(True, held[1:] != held[:-1])] if len(held) else held
    bounds = np.searchsorted(held, np.arange(len(ids) + 1, dtype=np.uint64) << np.uint64(16)).tolist()
    terms = (held & np.uint64(0xFFFF)).astype(np.uint16)
    return [terms[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def tokenized(docs: DataFrame, path: str, key: str, text: str) -> DataFrame:
    """(key, ids, place, kind): a row of kind "doc" a document with its 16-bit ids, END included, and its place among the others, and
    a row of kind "df" a task of its document frequencies, (term, count) pairs of 64 bits."""
    ship(docs.sparkSession)
    held = docs.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, df, draws = Encoder.at(path), np.zeros(1 << 16, np.int64), _draws()
        for batch in batches:
            ids = [np.append(x, np.uint16(END)) for x in encoder.encode(list(batch.text))]
            terms = distinct(ids)
            df += np.bincount(np.concatenate([np.zeros(0, np.uint16), *terms]), minlength=1 << 16)
            yield pd.DataFrame({"key": batch.key, "ids": [x.tobytes() for x in ids], "place": places(terms, draws), "kind": "doc"})
        terms = np.flatnonzero(df)
        yield pd.DataFrame({"key": [None], "ids": [np.stack([terms, df[terms]], 1).tobytes()], "place": [0], "kind": ["df"]})

    return held.mapInPandas(run, "key string, ids binary, place long, kind string")


def document_frequencies(tokens: DataFrame) -> np.ndarray:
    """How many documents of all have each id; as many numbers as the vocabulary has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch.ids:
                pairs = np.frombuffer(x, np.int64).reshape(-1, 2)
                yield pd.DataFrame({"term": pairs[:, 0], "n": pairs[:, 1]})

    out = np.zeros(1 << 16, np.int64)
    for term, n in tokens.where("kind = 'df'").select("ids").mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


class Index:
    """The inverted index of one shard: postings of (document, BM25 weight) by term, and each document's distinct terms.

    A term that at least 1 / DENSE of the documents have is a row of a matrix over all documents instead, which takes at most DENSE
    times the room of its postings.
    """

    def __init__(self, docs: list[np.ndarray], df: np.ndarray, total: int, mean: float):
        parts = [np.unique(d, return_counts=True) for d in docs]
        sizes = np.array([len(t) for t, _ in parts])
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        term = np.concatenate([t for t, _ in parts]).astype(np.uint16)
        weight = np.concatenate([c for _, c in parts]).astype(np.float64)
        length = K1 * (1 - B + B * np.array([len(d) for d in docs], np.float64) / max(mean, 1.0))
        weight *= (K1 + 1) / (weight + length[doc])
        weight *= np.log1p((total - df + 0.5) / (df + 0.5))[term]
        self.n, self.terms, self.held = len(docs), [t for t, _ in parts], np.arange(len(docs))
        common = np.flatnonzero(np.bincount(term, minlength=1 << 16) * DENSE >= len(docs))
        self.row = np.full(1 << 16, -1)
        self.row[common] = np.arange(len(common))
        own = self.row[term] >= 0
        self.dense = np.zeros((len(common), len(docs)))
        self.dense[self.row[term[own]], doc[own]] = weight[own]
        order = np.flatnonzero(~own)[np.argsort(term[~own], kind="stable")]
        self._keep(doc[order], weight[order], term[order])

    def _keep(self, doc: np.ndarray, weight: np.ndarray, term: np.ndarray) -> None:
        self.doc, self.weight, self.term = doc, weight, term
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=1 << 16))])

    def shrink(self, unused: np.ndarray) -> None:
        """Forgets used documents once a quarter of those held are used; no result depends on it."""
        left = unused[self.held]
        if left.sum() <= len(left) * 3 // 4:
            self.held, self.dense = self.held[left], self.dense[:, left]
            keep = unused[self.doc]
            self._keep(self.doc[keep], self.weight[keep], self.term[keep])

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """The unused documents that share a term with the seed, best first, ties by place."""
        terms = self.terms[seed].astype(np.int64)
        rows = self.row[terms]
        terms = terms[rows < 0]
        first, sizes = self.begin[terms], self.begin[terms + 1] - self.begin[terms]
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        score = np.bincount(self.doc[at], self.weight[at], self.n).astype(np.float64)
        score[self.held] += self.dense[rows[rows >= 0]].sum(0)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(docs: list[np.ndarray], df: np.ndarray, total: int, mean: float, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset), sequences numbered from 0; all but the last are full.

    A long document fills windows of its own first. The rest of a seed is then joined by its neighbours, best first, that fit
    whole; the best one that does not is cut, and what is left of it stays for later.
    """
    start = np.array([len(d) // window * window for d in docs])
    left = np.array([len(d) for d in docs]) - start
    sequence = 0
    for i, d in enumerate(docs):
        for k in range(len(d) // window):
            yield i, k * window, window, sequence, 0
            sequence += 1
    index = Index(docs, df, total, mean)
    unused, order, queue = left > 0, np.arange(len(docs)), 0
    while True:
        while queue < len(docs) and not unused[queue]:
            queue += 1
        if queue == len(docs):
            return
        seed, at = queue, 0

        def put(i: int, most: int):
            nonlocal at
            size = min(int(left[i]), most)
            piece = (i, int(start[i]), size, sequence, at)
            at += size
            start[i] += size
            left[i] -= size
            unused[i] = left[i] > 0
            return piece

        yield put(seed, window)
        if at < window:
            index.shrink(unused)
            found = index.neighbours(seed, unused)
            fits = found
            while at < window and len(fits := fits[left[fits] <= window - at]):
                yield put(int(fits[0]), window)
                fits = fits[1:]
        while at < window:
            rest = found[unused[found]]
            if not len(rest):
                rest = order[queue:][unused[queue:]][:1]
            if not len(rest):
                break
            yield put(int(rest[0]), window - at)
        sequence += 1


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset): every piece of every document, packed into windows.

    The ids are made once and stored, then the documents are dealt by content: in the order of their places(), whatever their files,
    alike documents lie together. Ranges of this order are the shards of the index, of which a task holds one at a time, with
    document counts over the whole corpus. A seed has neighbours in its own shard only. A null text is an empty document of one id,
    the end. Rows with equal or null keys are documents of their own; equal texts lie side by side, over several shards where they
    are many. Documents of any length are packed whole. Only the last sequence of a shard may be short. An empty table gives no
    pieces. Other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    held = stored(tokenized(docs, path, key, text), "packing-tokens")
    df = document_frequencies(held)
    count = held.where("kind = 'doc'").agg(F.count("*"), F.sum(F.length("ids") / 2)).first()
    shared = spark.sparkContext.broadcast((df, count[0], (count[1] or 0) / max(count[0], 1)))
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        frequencies, total, mean = shared.value
        sequence = TaskContext.get().partitionId() << 36
        keys: list[str | None] = []
        rows: list[np.ndarray] = []
        order: list[tuple[int, int]] = []

        def flush() -> pd.DataFrame:
            nonlocal sequence
            out, last = [], -1
            by = sorted(range(len(rows)), key=order.__getitem__)  # whatever order the rows came in
            keys[:], rows[:] = [keys[i] for i in by], [rows[i] for i in by]
            order.clear()
            for i, start, length, own, offset in pack_shard(rows, frequencies, total, mean):
                piece = rows[i][start : start + length].astype("<u4")
                out.append((keys[i], start, length, crc32(piece.tobytes()), len(rows[i]), sequence + own, offset))
                last = max(last, own)
            sequence += last + 1
            keys.clear()
            rows.clear()
            return pd.DataFrame(out, columns=names)

        size = 0
        for batch in batches:
            for own, ids, place, tie in zip(batch.key, batch.ids, batch.place, batch.tie, strict=True):
                keys.append(own)
                order.append((place, tie))
                rows.append(np.frombuffer(ids, np.uint16))
                size += len(rows[-1])
                if len(rows) >= SHARD_DOCS or size >= SHARD_TOKENS:
                    yield flush()
                    size = 0
        if rows:
            yield flush()

    parts = max(1, -(-count[0] // SHARD_DOCS))
    dealt = held.where("kind = 'doc'").select("key", "ids", "place", F.xxhash64("key", "ids").alias("tie")).repartitionByRange(parts, "place", "tie")
    pieces = dealt.mapInPandas(run, "key string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return pieces.select(F.col("key").cast(kind).alias(key), *names[1:])
