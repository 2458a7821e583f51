"""Toxicity by noisy-channel deobfuscation and a linear model of words and word beginnings.

A token that looks disguised (digits or symbols among letters, letters thrice or more, single letters
with gaps) becomes a lattice of what its characters may stand for. Viterbi decoding under a character
trigram model of the whole corpus picks the likeliest reading, which is scored beside the token as
written. Features are whole words and word beginnings; a logistic model is fitted on the driver from
a bounded sample of labelled rows and their active features.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.scratch import Scratch
from tessella.llm.workers import give_back, lean

#: Labelled rows that the model is fitted on, at most: those of the lowest hash of their id.
MAX_ROWS = 20_000
#: Toxic rows of the sample that a feature must stand in.
MIN_ROWS = 5
#: The letters that a digit or symbol may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "#": "h", "%": "x", "*": "aeiou",
}
_GAPS = " ._-*~'`,/\\"
_STRIP = ".,;:!?\"'()[]{}<>|#*$%&-_=+~`«»¿¡…"
_SIGNS = re.escape("".join(LEET))
#: What the lattice can read: signs that stand for letters beside a letter, signs or gaps between letters, a letter thrice.
_SUSPECT = re.compile(rf"[{_SIGNS}][^\W\d_]|[^\W\d_][{_SIGNS}]|[^\W\d_][{_SIGNS}{re.escape(_GAPS)}]+[^\W\d_]|([^\W\d_])\1\1")
_THRICE = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
#: Marks at a token's ends that stand for no letter.
_MARKS = "".join(c for c in _STRIP if c not in LEET)
#: Character classes of the trigram model: 0 is a word's edge, 1 to 26 are a to z, the rest other letters by code.
CLASSES = 64
#: Tokens whose features a worker remembers.
_REMEMBER = 200_000
_CHARS_AT_ONCE = 1 << 17


def _class(c: str) -> int:
    k = ord(c) - 96
    if 1 <= k <= 26:
        return k
    return 27 + ord(c) % 37 if c.isalpha() else 0


def _class_table() -> np.ndarray:
    return np.array([_class(chr(k)) if not 0xD800 <= k < 0xE000 else 0 for k in range(0x3000)], np.int64)


def _classes(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    known = table[np.minimum(codes, len(table) - 1)]
    known[codes >= len(table)] = 0
    return known


def _add_trigrams(texts: list[str], table: np.ndarray, total: np.ndarray) -> None:
    """Add the trigrams of texts (none empty), each between two edges before and one after it."""
    codes = np.frombuffer(f"\0\0{'\0\0'.join(texts)}\0".encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(codes) - 2, _CHARS_AT_ONCE):
        known = _classes(codes[at : at + _CHARS_AT_ONCE + 2], table)
        total += np.bincount((known[:-2] * CLASSES + known[1:-1]) * CLASSES + known[2:], minlength=CLASSES**3)
    # Between two texts stand two edges, and so a trigram that neither has: the last character and both.
    ends = _classes(np.array([ord(t[-1]) for t in texts[:-1]], np.uint32), table)
    np.subtract.at(total, ends * CLASSES**2, 1)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of character-class trigrams over all texts, each partition summed before the shuffle; at most 64^3 rows reach the driver.

    Null and empty texts have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _class_table(), np.zeros(CLASSES**3, np.int64)
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                if low := (text.as_py() or "").lower():
                    held.append(low)
                    size += len(low)
                if size >= _CHARS_AT_ONCE:
                    _add_trigrams(held, table, total)
                    held, size = [], 0
        if held:
            _add_trigrams(held, table, total)
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["code", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(lean(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES**3)
    for code, n in rows:
        counts[code] = n
    return counts.reshape(CLASSES, CLASSES, CLASSES)


def _log_model(counts: np.ndarray) -> np.ndarray:
    """log p(c | a, b), backed off to pairs and single characters by a Dirichlet prior at each order."""
    one = (counts.sum((0, 1)) + 0.5) / (counts.sum() + 0.5 * CLASSES)
    pairs = counts.sum(0)
    two = (pairs + 8 * one) / (pairs.sum(1, keepdims=True) + 8)
    return np.log((counts + 8 * two) / (counts.sum(2, keepdims=True) + 8)).astype(np.float32)


@dataclass
class Model:
    """What scoring needs; small, and the same whatever the size of the corpus."""

    chars: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of a character the strings it may stand for, with their costs; a blank is a word's edge."""
    steps, i = [], 0
    while i < len(token):
        c, n = token[i], 1
        while i + n < len(token) and token[i + n] == c:
            n += 1
        if c.isalpha():
            steps.append([(c * n, 0.0)] if n < 3 else [(c, 0.5), (c * 2, 0.5)])
        else:
            options = [(x * k, 1.0 + 0.5 * (n - k)) for x in LEET.get(c, "") for k in range(1, min(n, 2) + 1)]
            if c in _GAPS:
                options.append(("", 0.5))
            steps.append([*options, (" ", 3.0 if c not in " " else 2.0)])
        i += n
    return steps


def restore(token: str, chars: np.ndarray) -> str:
    """The likeliest reading of a disguised token: words between blanks."""
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for options in lattice(token):
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in best.items():
            for piece, cost in options:
                x, y, s = a, b, score - cost
                for c in piece:
                    z = _class(c)
                    if not (z == 0 and y == 0):
                        s += float(chars[x, y, z])
                        x, y = y, z
                if (x, y) not in after or s > after[x, y][0]:
                    after[x, y] = (s, text + piece)
        best = after
    ended = ((s + float(chars[a, b, 0]) * (b != 0), text) for (a, b), (s, text) in best.items())
    return max(ended, key=lambda e: (e[0], e[1]))[1] if best else token


def _parts(word: str) -> list[str]:
    return [f"{word}$", *(word[:k] for k in range(3, min(7, len(word) + 1)))] if len(word) > 2 else []


_TWICE = "++"


def _disguised(token: str) -> bool:
    """Whether the lattice could read a token otherwise than it is written."""
    return bool(_THRICE.search(token) if token.isalpha() else _SUSPECT.search(token))


class _Reader:
    """Features of texts, remembering those of tokens. A beginning that two or more different tokens have is a feature of its own."""

    def __init__(self, chars: np.ndarray, wanted: dict[str, float] | None = None):
        self.chars, self.wanted = chars, wanted
        self.memory: dict[str, tuple[str, ...]] = {}
        self.nothing: set[str] = set()  # tokens without a wanted feature
        if wanted is not None:
            self.base = {f.removesuffix(_TWICE) for f in wanted}
            self.heads = {f[:3] for f in self.base}

    def _read(self, token: str) -> tuple[str, ...]:
        apart = " " in token
        words = set() if apart else {token.strip(_STRIP)}
        if apart or _disguised(token):
            # Signs at the ends may be letters or mere punctuation: both readings count.
            for form in {token.strip(_MARKS), token.strip(_MARKS + "("), token.strip(_STRIP)}:
                words |= {w.strip(_STRIP) for w in restore(form, self.chars).split()} if apart or _disguised(form) else {form}
        if self.wanted is not None:
            words = {w for w in words if w[:3] in self.heads}
        found = {f for w in words for f in _parts(w)}
        return tuple(found if self.wanted is None else found & self.base)

    def __call__(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        tokens = set(low.split())
        tokens.update(" ".join(x.split()) for x in _SPACED.findall(low))
        found: dict[str, int] = {}
        for token in tokens - self.nothing:
            known = self.memory.get(token)
            if known is None:
                if len(self.memory) + len(self.nothing) >= _REMEMBER:
                    self.memory.clear()
                    self.nothing.clear()
                known = self._read(token)
                if known:
                    self.memory[token] = known
                else:
                    self.nothing.add(token)
            for f in known:
                found[f] = found.get(f, 0) + 1
        every = found.keys() | {f + _TWICE for f, n in found.items() if n > 1}
        return every if self.wanted is None else every & self.wanted.keys()


def _fit(rows: list[tuple[list[int], int]], n: int, rounds: int = 600, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of active features with a squared penalty, by accelerated gradient steps."""
    y = np.array([t for _, t in rows], float)
    prior = (y.sum() + 1) / (len(y) + 2)
    w, bias = np.zeros(n), math.log(prior / (1 - prior))
    if not n or not 0 < y.sum() < len(y):
        return w, bias
    at = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    to = np.array([k for a, _ in rows for k in a], np.int64)
    v = np.ones(n)
    for _ in range(30):  # the largest curvature, by power iteration
        v /= np.linalg.norm(v)
        v = np.bincount(to, np.bincount(at, v[to], len(rows))[at], n)
    step = 1 / (0.25 * np.linalg.norm(v) + ridge)
    ahead, before, speed, b = w.copy(), w, 1.0, bias
    for _ in range(rounds):
        margin = b + np.bincount(at, ahead[to], len(rows))
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        w = ahead - step * (np.bincount(to, (p - y)[at], n) + ridge * ahead)
        b -= (p - y).sum() / (0.25 * len(y))
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        ahead, before, speed = w + (speed - 1) / faster * (w - before), w, faster
    return w, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, min_rows: int = MIN_ROWS) -> Model:
    """Learn from ``labels`` (doc_id, 0/1) of ``docs``; leave out rows that must not be learned from before.

    The character model covers all texts of ``docs``. Of the labels, at most ``max_rows`` are used,
    those of the lowest hash of their id; all else is made from this sample, and bounded by it. Every
    feature that stands in ``min_rows`` toxic rows and clearly oftener in toxic ones is used. Null
    labels and ids are ignored; an id with several labels is toxic if one says so. No label, or labels
    of one kind: a model of the base rate.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    model = Model(_log_model(trigram_counts(docs, text_col)))
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic")
    texts = scratch.table(texts, "texts")
    chars = model.chars

    def features(wanted: dict[str, float] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = _Reader(chars, wanted)
            for batch in batches:
                for at in range(0, batch.num_rows, 100):  # the features of a text take several times its size
                    part = batch.slice(at, 100)
                    yield pa.RecordBatch.from_arrays([pa.array([sorted(read(t.as_py())) for t in part.column(0)], pa.list_(pa.string())), part.column(1)], ["found", "toxic"])

        return lean(run)

    def counted(rows: DataFrame) -> DataFrame:
        clean = F.lit(1) - F.col("toxic")
        return rows.select("toxic", F.explode("found").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum(clean).alias("clean"))

    schema = "found array<string>, toxic int"
    seen = [r[0] for r in counted(texts.where("toxic = 1").mapInArrow(features(None), schema)).where(F.col("toxic") >= min_rows).select("feature").collect()]
    found = scratch.table(texts.mapInArrow(features(dict.fromkeys(seen, 0.0)), schema), "found")
    n_toxic, n_clean = (x or 0 for x in found.agg(F.sum("toxic"), F.sum(F.lit(1) - F.col("toxic"))).first())
    lift = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    names = sorted(r["feature"] for r in counted(found).where(lift > 1.5).collect())
    index = {f: k for k, f in enumerate(names)}
    # Only the chosen features of a row reach the driver.
    chosen = F.array_intersect("found", F.array(*map(F.lit, names)).cast("array<string>")) if names else F.array().cast("array<string>")
    learned = [([index[f] for f in a], t) for a, t in found.select(chosen, "toxic").collect()]
    learned.sort()
    scratch.drop("texts", "found")
    weights, model.bias = _fit(learned, len(names))
    model.weights = {f: float(w) for f, w in zip(names, weights) if abs(w) > 1e-4}
    return model


def _probability(model: Model, found: set[str]) -> float:
    margin = model.bias + sum(model.weights[f] for f in sorted(found))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, evidence) for every row: the probability of a toxic label, and the features that raise it.

    Null and empty texts have no features and score the base rate. Null ids and repeated rows pass
    through. Other columns are not read. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Reader(model.chars, model.weights)
        for batch in batches:
            scores, why = [], []
            for text in batch.column(1):
                found = read(text.as_py())
                scores.append(_probability(model, found))
                why.append(sorted(f for f in found if model.weights[f] > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(why, pa.list_(pa.string()))], ["doc_id", "score", "evidence"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, score double, evidence array<string>")


def score_column(model: Model, text: Column) -> Column:
    """The score of a text column, for use in any expression; null and empty texts score the base rate."""

    # Arrow arrays: a batch of whole texts becomes Python strings one at a time, not all at once.
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read = _Reader(model.chars, model.weights)
        for texts in batches:
            yield pa.array([_probability(model, read(t.as_py())) for t in texts], pa.float64())
        del read
        give_back()

    return run(text.cast("string"))


def keep_civil(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, unchanged: all columns, whatever their names, repeats and null ids.

    Null and empty texts score the base rate. An empty table gives an empty table.
    """
    return docs.where(score_column(model, F.col(f"`{text_col}`")) < limit)
