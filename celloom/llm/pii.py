"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds the spans they miss.

The field is trained from a small table of sentences labelled by hand (pii_table) and decoded by Viterbi in numpy, many windows at once.
Only tokens with a digit or an @ can be part of what it looks for, so it reads each such token with the words around it; the rest of a
text is outside by definition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from celloom.llm.pii_table import labelled_table
from celloom.session import ship

#: The kinds in the order in which spans are listed.
KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
#: Words on either side of a token that its window holds.
AROUND = 2
#: Padded tokens that one Viterbi pass decodes.
BATCH = 100_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD, _HINT = re.compile(r"\S+"), re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_NUMERIC = re.compile(r"[0-9()+./-]*[0-9][0-9()+./-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Each match holds one @, so the leftmost matches are found from the @s: what stands before one, and a domain behind it."""
    found, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind, without those that fail its check."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if "." in text:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def shape(word: str) -> str:
    """Digits as 9, letters as a or A, runs of over four shortened, other characters as they are."""
    plain = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1+", plain)


#: Words before personal data, whose presence is a feature.
CUES = frozenset("call phone tel telephone telefon mobile cell portable hotline reach text sms an llame fax ring dial contact card visa amex mastercard payment account ip host address server email mail e-mail write version isbn id no order invoice page room year price".split())


def _near(words: list[str], shapes: list[str], i: int) -> str:
    """The shape of a word with a digit or an @; any other one is plain, also if there is none."""
    return shapes[i] if 0 <= i < len(words) and _HINT.search(words[i]) else "plain"


def _digit_runs(words: list[str]) -> list[list[str]]:
    """For each word, what neighbours of digits and separators alone have together with it: words, digits, the check digit's fit."""
    bare = [bool(_NUMERIC.fullmatch(w.strip(".,;:!?*#$%&"))) for w in words]
    out: list[list[str]] = [[] for _ in words]
    i = 0
    while i < len(words):
        end = i
        while end < len(words) and bare[end]:
            end += 1
        if end > i:
            digits = _NOT_DIGIT.sub("", "".join(words[i:end]))
            fits = 13 <= len(digits) <= 19 and luhn(digits)
            for k in range(i, end):
                out[k] = [f"run={min(end - i, 6)}", f"all={min(len(digits), 20)}", f"sum={'short' if len(digits) < 7 else 'phone' if len(digits) < 13 else 'card' if len(digits) < 20 else 'long'}", f"fits={fits}", f"first={k == i}"]
        i = max(end, i + 1)
    return out


def features(words: list[str]) -> list[list[str]]:
    shapes = [shape(w) for w in words]
    runs = _digit_runs(words)
    lowers = [w.lower().strip(".,:;()") for w in words]
    out = []
    for i, w in enumerate(words):
        digits = sum(c.isdigit() for c in w)
        own = ["bias", f"s={shapes[i]}", f"d={min(digits, 16)}", f"core={shape(w.strip('.,;:!?*#$%&'))}", f"at={'@' in w}", f"dots={min(w.count('.'), 4)}", f"dash={min(w.count('-'), 4)}"]
        own += [f"p={_near(words, shapes, i - 1)}", f"n={_near(words, shapes, i + 1)}", f"few={digits < 7}", f"rare={bool(re.search('[^0-9A-Za-z@.()+ -]', w.strip('.,;:!?*#$%&')))}"]
        own += [f"c={re.sub(r'(.)\\1+', r'\\1', own[3])}", f"ends={shapes[i][:1]}{w[:1] in '(+0'}", *runs[i]]
        own += [f"cue={lowers[i - k]}" for k in (1, 2, 3) if i >= k and lowers[i - k] in CUES]
        if not any(c.isdigit() or c == "@" for c in w):
            own = ["plain"]
        out.append(own)
    return out


class Field:
    """A linear-chain conditional random field: weights of (feature, label) and of (label, label)."""

    def __init__(self, names: dict[str, int], unary: np.ndarray, pairs: np.ndarray):
        self.names, self.unary, self.pairs = names, unary, pairs

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(LABELS)))
        for i, own in enumerate(features(words)):
            known = [self.names[f] for f in own if f in self.names]
            if known:
                out[i] = self.unary[known].sum(0)
        return out

    def decode(self, windows: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each window by Viterbi, windows of like lengths together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(windows)
        order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
        at = 0
        while at < len(order):
            longest, end = len(windows[order[at]]), at
            while end < len(order) and (end - at + 1) * max(len(windows[order[end]]), 1) <= max(BATCH, len(windows[order[at]])):
                longest, end = len(windows[order[end]]), end + 1
            some = order[at:end]
            at = end
            scores = np.zeros((len(some), longest, len(LABELS)))
            for k, i in enumerate(some):
                scores[k, : len(windows[i])] = self.emissions(windows[i])
            sizes = np.array([len(windows[i]) for i in some])
            back = np.zeros((len(some), longest, len(LABELS)), np.int8)
            best = scores[:, 0] + _START
            last = best.copy()
            for t in range(1, longest):
                ways = best[:, :, None] + (self.pairs + _ALLOWED)[None]
                back[:, t] = ways.argmax(1)
                best = ways.max(1) + scores[:, t]
                last[sizes > t] = best[sizes > t]
            state = last.argmax(1)
            labels = np.zeros((len(some), longest), np.int64)
            for t in range(longest - 1, -1, -1):
                inside = sizes > t
                labels[inside, t] = state[inside]
                if t:
                    state = np.where(inside, back[np.arange(len(some)), t, state], state)
            for k, i in enumerate(some):
                out[i] = labels[k, : sizes[k]]
        return out


_NEVER = -1e4
_START = np.array([_NEVER if n.startswith("I-") else 0.0 for n in LABELS])
_ALLOWED = np.array([[_NEVER if b.startswith("I-") and a[2:] != b[2:] else 0.0 for b in LABELS] for a in LABELS])


def train(examples: list[tuple[list[str], list[str]]], rounds: int = 150, rate: float = 0.3, ridge: float = 1e-2) -> Field:
    """The field of the highest penalised likelihood that `rounds` steps of AdaGrad reach; without examples nothing is ever found."""
    examples = [e for e in examples if e[0]]
    names: dict[str, int] = {}
    told = [[[names.setdefault(f, len(names)) for f in own] for own in features(w)] for w, _ in examples]
    unary, pairs = np.zeros((max(len(names), 1), len(LABELS))), np.zeros((len(LABELS), len(LABELS)))
    sums = [np.full(unary.shape, 1e-8), np.full(pairs.shape, 1e-8)]
    if not examples:
        pairs[:, 0] = 1.0
        return Field(names, unary, pairs)
    longest, n = max(len(w) for w, _ in examples), len(examples)
    rows = [(k, t, f) for k, x in enumerate(told) for t, own in enumerate(x) for f in own]
    ek, et, ef = (np.array(x) for x in zip(*rows, strict=True))
    sizes = np.array([len(w) for w, _ in examples])
    truth = np.zeros((n, longest), np.int64)
    for k, (_, labels) in enumerate(examples):
        truth[k, : len(labels)] = [LABELS.index(x) for x in labels]
    inside = np.arange(longest)[None] < sizes[:, None]
    hot = np.eye(len(LABELS))[truth] * inside[..., None]

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))

    for _ in range(rounds):
        scores = np.zeros((n, longest, len(LABELS)))
        np.add.at(scores, (ek, et), unary[ef])
        move = pairs + _ALLOWED
        alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
        alpha[:, 0] = scores[:, 0] + _START
        for t in range(1, longest):
            step = log_sum(alpha[:, t - 1, :, None] + move[None], 1) + scores[:, t]
            alpha[:, t] = np.where(inside[:, t, None], step, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = log_sum(move[None] + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(inside[:, t + 1, None], step, beta[:, t + 1])
        z = log_sum(alpha[:, -1], 1)
        marginal = np.exp(alpha + beta - z[:, None, None]) * inside[..., None]
        gradient = [np.zeros_like(unary), np.zeros_like(pairs)]
        np.add.at(gradient[0], ef, (hot - marginal)[ek, et])
        for t in range(1, longest):
            both = np.exp(alpha[:, t - 1, :, None] + move[None] + (scores[:, t] + beta[:, t])[:, None, :] - z[:, None, None]) * inside[:, t, None, None]
            gradient[1] += hot[:, t - 1].T @ hot[:, t] - both.sum(0)
        for weights, g, s in zip((unary, pairs), gradient, sums, strict=True):
            g -= ridge * n * weights
            s += g * g
            weights += rate * g / np.sqrt(s)
    return Field(names, unary, pairs)


def windows(text: str) -> list[list[tuple[int, int]]]:
    """The words that are read: those with a digit or an @ and AROUND words on either side, in runs that touch or overlap."""
    if not _HINT.search(text):
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    out: list[list[tuple[int, int]]] = []
    end = 0
    for i, (a, b) in enumerate(words):
        if _HINT.search(text, a, b):
            if not out or i - AROUND > end:
                out.append([])
                end = max(i - AROUND, 0)
            upto = min(i + AROUND + 1, len(words))
            out[-1] += words[end:upto]
            end = max(end, upto)
    return out


def added_spans(texts: list[str], base: list[dict[str, list[tuple[int, int]]]], field: Field) -> list[dict[str, list[tuple[int, int]]]]:
    """Spans that the field finds and no base span touches; each must still have the digits or the @ of its kind."""
    spots = [(i, run) for i, text in enumerate(texts) for run in windows(text)]
    out: list[dict[str, list[tuple[int, int]]]] = [{k: [] for k in KINDS} for _ in texts]
    for (i, run), labels in zip(spots, field.decode([[texts[i][a:b] for a, b in run] for i, run in spots]), strict=True):
        taken = [s for own in base[i].values() for s in own if s[0] < run[-1][1] and s[1] > run[0][0]]
        k = 0
        while k < len(run):
            name = LABELS[labels[k]]
            end = k + 1
            if name[0] == "B":
                while end < len(run) and LABELS[labels[end]] == f"I-{name[2:]}":
                    end += 1
                span = _trimmed(texts[i], run[k][0], run[end - 1][1])
                if _sound(name[2:], texts[i][span[0] : span[1]]) and not any(a < span[1] and b > span[0] for a, b in taken):
                    out[i][name[2:]].append(span)
            k = end
    return out


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while end > start and not (text[end - 1].isalnum() and text[end - 1].isascii()):
        end -= 1
    while start < end and not (text[start].isalnum() and text[start].isascii() or text[start] in "(+"):
        start += 1
    return start, end


def _sound(kind: str, text: str) -> bool:
    digits = _NOT_DIGIT.sub("", text)
    if kind == "email":
        return 0 < text.find("@") < len(text) - 1
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if re.search(r"[^0-9+()./\s-]", text) or "\n" in text:
        return False
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15 and bool(re.search(r"[-().+/ ]", text)) and len(text.split(".")) != 4


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def _both(texts: list[str], field: Field) -> tuple[list[dict], list[dict]]:
    base = [base_spans(t) for t in texts]
    more = added_spans(texts, base, field)
    return base, [{k: sorted(b[k] + m[k]) for k in KINDS} for b, m in zip(base, more, strict=True)]


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", examples: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the base spans, and all spans.

    Offsets are code points, ends exclusive. Null texts are empty. Every row is read by itself, so repeats give equal rows and null
    keys are kept.
    """
    spark = docs.sparkSession
    ship(spark)
    field = spark.sparkContext.broadcast(train(labelled_table() if examples is None else examples))
    held = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = T.StructType(held.drop("__text").schema.fields + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            base, every = _both(list(batch["__text"]), field.value)
            counts = {f"n_{k}": [len(b[k]) for b in base] for k in KINDS}
            yield batch.drop(columns="__text").assign(**counts, base_sha256=[sha256(joined(b).encode()).hexdigest() for b in base], spans=[joined(s) for s in every])

    return held.mapInPandas(run, schema)


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars", examples: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """docs with each span replaced by its kind in brackets, overlapping ones by that of the first; length follows the new text.

    A null text stays null, as does its length. Texts without spans stay as they are.
    """
    spark = docs.sparkSession
    ship(spark)
    field = spark.sparkContext.broadcast(train(labelled_table() if examples is None else examples))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        known = [t if isinstance(t, str) else "" for t in texts]
        _, every = _both(known, field.value)
        out = []
        for t, raw, spans in zip(known, texts, every, strict=True):
            parts, at = [], 0
            for a, b, k in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
                if a >= at:
                    parts += [t[at:a], f"[{k.upper()}]"]
                at = max(at, b)
            out.append("".join([*parts, t[at:]]) if isinstance(raw, str) else None)
        return pd.Series(out, dtype=object)

    cleaned = docs.withColumn(text, clean(F.col(text)))
    return cleaned.withColumn(length, F.char_length(text).cast(docs.schema[length].dataType)) if length in docs.columns else cleaned
