"""Sequence motifs: log-odds matrices, score thresholds and scans of whole sequences on both strands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celloom.session import ship

BASES = "ACGT"
#: The row that a letter other than a base reads (4), and the one between two sequences (5).
OTHER, GAP = 4, 5
#: Sequence letters that are scored at once.
CHUNK = 500_000

_CODE = np.full(256, OTHER, np.uint8)
for _i, _base in enumerate(BASES):
    _CODE[[ord(_base), ord(_base.lower())]] = _i


def background(sequences: DataFrame, sequence: str, pseudo: float = 1.0) -> DataFrame:
    """One row (a, c, g, t): the shares of the bases in either case over all sequences, each count raised by pseudo; 0.25 without bases."""
    upper = F.upper(F.col(sequence))
    counts = sequences.agg(*[F.coalesce(F.sum(F.length(upper) - F.length(F.replace(upper, F.lit(b)))), F.lit(0)).alias(b.lower()) for b in BASES])
    total = sum((F.col(b.lower()) for b in BASES), F.lit(0))
    return counts.select(*[F.when(total > 0, (F.col(b.lower()) + F.lit(pseudo)) / (total + F.lit(4 * pseudo))).otherwise(F.lit(0.25)).alias(b.lower()) for b in BASES])


def log_odds(pwm: np.ndarray, bg: np.ndarray | None = None, pseudo: float = 0.01) -> np.ndarray:
    """log2 odds (4 x width) of base frequencies (4 x width), smoothed by a share of the background (uniform). A base that the
    background lacks counts as very rare; a column without any frequency is all background share."""
    bg = np.full(4, 0.25) if bg is None else np.maximum(np.asarray(bg, float), 1e-9)
    total = np.sum(pwm, axis=0)
    share = np.asarray(pwm, float) / np.where(total > 0, total, 1.0)
    return np.log2((share + pseudo * bg[:, None]) / (1 + pseudo) / bg[:, None])


def relative_threshold(odds: np.ndarray, share: float = 0.8) -> float:
    """The score at this share of the way from the least to the greatest possible one."""
    return float(share * odds.max(0).sum() + (1 - share) * odds.min(0).sum())


def pvalue_threshold(odds: np.ndarray, p: float = 1e-4, bg: np.ndarray | None = None, bins: int = 1000) -> float:
    """The least score on a grid of bins that a random window of the background reaches with a probability of at most p.

    Each column's scores over its least one are rounded to bins and the columns' distributions convolved. The greatest score stands
    where no bin is rare enough or all scores are equal.
    """
    bg = np.full(4, 0.25) if bg is None else np.asarray(bg, float)
    low, high = odds.min(0).sum(), odds.max(0).sum()
    if not high > low:
        return float(high)
    step = (high - low) / bins
    chance = np.ones(1)
    for column in odds.T:
        at = np.rint((column - column.min()) / step).astype(int)
        chance = np.convolve(chance, np.bincount(at, bg))[: bins + 1]
    chance = np.pad(chance, (0, bins + 1 - len(chance)))
    rare = np.flatnonzero(np.cumsum((chance / chance.sum())[::-1])[::-1] <= p)
    return float(low + rare[0] * step) if len(rare) else float(high)


def window_scores(odds: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The score of every window; a letter other than a base scores its column's least value, a window over a gap -inf."""
    width = odds.shape[1]
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0)
    table = np.vstack([odds, odds.min(0), np.full(width, -np.inf)])
    total = np.zeros(n)
    for j in range(width):
        total += table[codes[j : j + n], j]
    return total


def encode(sequence: str) -> np.ndarray:
    return _CODE[np.frombuffer(sequence.encode("ascii", "replace"), np.uint8)]


def hits(odds: np.ndarray, sequence: str, threshold: float, both: bool = True) -> list[tuple[int, str, float]]:
    """(start, strand, score) of all windows that reach the threshold; on the minus strand starts count along that strand."""
    out, codes = [], encode(sequence)
    for strand, matrix in (("+", odds), ("-", odds[::-1, ::-1]))[: 2 if both else 1]:
        score = window_scores(matrix, codes)
        at = np.flatnonzero(score >= threshold)
        out += [(int(i) if strand == "+" else len(codes) - odds.shape[1] - int(i), strand, float(score[i])) for i in at]
    return out


def scan(sequences: DataFrame, motifs: dict[str, tuple[np.ndarray, float]], key: str, sequence: str, both: bool = True) -> DataFrame:
    """(key, motif, best, n_hits) for every sequence and motif: the best score of its hits (null: none) and their number.

    motifs: name -> (log odds, threshold); they are small and go to the tasks. Null sequences are empty, and sequences shorter than
    a motif have no hits. A palindrome counts on both strands. Repeated keys give repeated rows.
    """
    ship(sequences.sparkSession)
    held = sequences.select(F.col(key).alias("k"), F.coalesce(F.col(sequence), F.lit("")).alias("s"))
    kind = held.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            start, lengths = 0, batch.s.map(len).to_numpy()
            while start < len(batch):
                end = start + max(1, int(np.searchsorted(np.cumsum(lengths[start:]), CHUNK, side="right")))
                parts = [part for s in batch.s[start:end] for part in (encode(s), np.full(1, GAP, np.uint8))]
                codes = np.concatenate(parts)
                owner = np.repeat(np.arange(end - start), lengths[start:end] + 1)
                for name, (odds, threshold) in motifs.items():
                    best, n = np.full(end - start, -np.inf), np.zeros(end - start, np.int64)
                    for matrix in (odds, odds[::-1, ::-1])[: 2 if both else 1]:
                        score = window_scores(matrix, codes)
                        at = np.flatnonzero(score >= threshold)
                        np.maximum.at(best, owner[at], score[at])
                        n += np.bincount(owner[at], minlength=end - start)
                    yield pd.DataFrame({"k": batch.k[start:end].to_numpy(), "motif": name, "best": [float(b) if c else None for b, c in zip(best, n)], "n_hits": n})
                start = end

    return held.mapInPandas(run, f"k {kind}, motif string, best double, n_hits long").withColumnRenamed("k", key)
