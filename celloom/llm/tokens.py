"""Byte-level BPE ids of whole batches: numpy finds the pieces, and each distinct piece is encoded once."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from itertools import chain

import numpy as np
import pandas as pd

from celloom.llm.words import in_chunks, mix

#: Slots for encoded pieces that a worker keeps, as a power of two, and how many ids of them; beyond these it starts anew.
SLOTS, KEPT = 20, 4_000_000

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
#: The code points of the Unicode property White_Space.
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


class Encoder:
    """Ids as the tokenizers library gives them for the byte-level BPE vocabulary in the JSON file at path."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        as_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocabulary = told["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        ranks = {bytes(as_byte[c] for c in token): i for token, i in vocabulary.items() if all(c in as_byte for c in token) and token not in self.special}
        self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kinds = np.zeros(sys.maxunicode + 1, np.uint8)
        for c in range(sys.maxunicode + 1):
            first = unicodedata.category(chr(c))[0]
            self.kinds[c] = _LETTER if first == "L" else _NUMBER if first == "N" else _OTHER
        self.kinds[_SPACES] = _SPACE
        self.codes = mix(np.arange(1, sys.maxunicode + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.forget()

    def forget(self) -> None:
        """An empty table of encoded pieces: by the leading bits of a piece's key its whole key, where its ids lie in the pool, and how many."""
        self.held = np.zeros(1 << SLOTS, np.uint64)
        self.place, self.count = np.zeros(1 << SLOTS, np.int64), np.zeros(1 << SLOTS, np.int64)
        self.pool, self.used = np.zeros(KEPT, np.uint16), 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text, as 16-bit numbers. The text of a special token is its id, and parts the text around it."""
        if any(self.special_at.search(t) for t in texts):
            parts = [self.special_at.split(t) for t in texts]
            whole = self.encode([x for own in parts for x in own])
            ends = np.cumsum([len(own) for own in parts])
            between = ([[self.special[x]] for x in self.special_at.findall(t)] + [[]] for t in texts)
            return [np.concatenate([np.asarray(x, np.uint16) for pair in zip(whole[e - len(own) : e], gaps, strict=True) for x in pair]) for own, e, gaps in zip(parts, ends, between, strict=True)]
        out: list[np.ndarray] = []
        for a, b in in_chunks(texts, 200_000):
            out += self._encode(texts[a:b])
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        # contractions are pieces by an order of alternatives that runs of kinds don't show
        plain = [i for i, t in enumerate(texts) if t and "'" not in t]
        out = [np.zeros(0, np.uint16)] * len(texts)
        for i, t in enumerate(texts):
            if "'" in t:
                out[i] = np.array(self.encoding.encode_ordinary(t), np.uint16)
        if not plain:
            return out
        joined = "".join(texts[i] for i in plain)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(texts[i]) for i in plain])
        first = np.cumsum(sizes) - sizes
        starts, ends = self._pieces(code, first)
        keys = self._keys(code, starts, ends)
        begins, counts = self._encoded(joined, keys, starts, ends)
        places = np.arange(counts.sum()) + np.repeat(begins - np.cumsum(counts) + counts, counts)
        ids = self.pool[places]
        bounds = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, np.append(first, len(code)))]
        for i, a, b in zip(plain, bounds[:-1], bounds[1:], strict=True):
            out[i] = ids[a:b]
        return out

    def _encoded(self, joined: str, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool each piece's ids begin, and how many they are. Pieces that no slot holds are encoded, each distinct one once,
        and take the slots of those they meet there; ids stay in the pool until it is full."""
        if self.used > KEPT:
            self.forget()
        slots = (keys >> np.uint64(64 - SLOTS)).astype(np.int64)
        begins, counts = self.place[slots], self.count[slots]
        missed = np.flatnonzero((self.held[slots] != keys) | (counts == 0))
        if len(missed):
            which, distinct = pd.factorize(keys[missed])
            first = np.zeros(len(distinct), np.int64)
            first[which[::-1]] = missed[::-1]
            single = self.encoding._core_bpe.encode_single_piece
            made = [single(joined[a:b].encode("utf-8", "surrogatepass")) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            new = np.fromiter(chain.from_iterable(made), np.uint16, sizes.sum())
            if self.used + len(new) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], new, np.zeros(KEPT, np.uint16)])
            self.pool[self.used : self.used + len(new)] = new
            at = self.used + np.cumsum(sizes) - sizes
            self.used += len(new)
            begins[missed], counts[missed] = at[which], sizes[which]
            slots = slots[first]
            self.held[slots] = distinct
            last = self.held[slots] == distinct  # of those with one slot
            self.place[slots[last]], self.count[slots[last]] = at[last], sizes[last]
        return begins, counts

    def _pieces(self, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces are runs of one kind; a run takes the blank before it along, and of more white space the last one stands apart."""
        kind = self.kinds[code]
        start = np.ones(len(code), bool)
        start[1:] = kind[1:] != kind[:-1]
        start[first] = True
        behind = start.copy()
        behind[first] = False
        behind[1:] &= (kind[1:] != _SPACE) & (kind[:-1] == _SPACE)
        behind[0] = False
        at = np.flatnonzero(behind)
        start[at - 1] = True
        start[at[code[at - 1] == 32]] = False
        starts = np.flatnonzero(start)
        return starts, np.append(starts[1:], len(code))

    def _keys(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        from celloom.llm.words import sliced

        return sliced(self.codes[code], starts, ends)
