"""Document likelihood under a subword lattice.

Pieces of an existing vocabulary weigh all segmentations of a word: a first piece, further pieces, an
end; a forward recursion in log space sums them. Expected piece counts over the words of the training
texts re-estimate the weights from the vocabulary's own scores. Whole words that training texts hold
are arcs of the same lattice, with absolutely discounted counts; the discounted mass goes to the
pieces. Words never share pieces, so a document is a bag of word marginals:

    P(w) = max(c(w) - d, 0) / N + d V / N * sum over segmentations of prod p(piece)

Training texts may be of several kinds, such as languages; a kind's own counts back off to P by the
same formula, and a document's kind is marginalised, never read. A document's own frequencies are
marginalised too, by a Dirichlet prior with mean P and weight ``focus``: what a text has said it says again. The probability of its n tokens, w occurring n(w) times:

    prod over w of (focus P(w)) (focus P(w) + 1) ... (focus P(w) + n(w) - 1)  /  focus (focus + 1) ... (focus + n - 1)

Texts are read once, into blocks of documents with their distinct words. Words are dealt by hash in
compact lists, counted and scored once for each bucket, and the figures return to the blocks. No
table of words is broadcast or collected: the vocabulary of a corpus grows with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.scratch import Scratch

#: Kinds of training texts that the mixture tells apart; the texts of all rarer ones are learned as one kind.
KINDS = 16
#: Bytes of text, at most, whose words one bucket gets on average.
BUCKET_BYTES = 64 << 20
#: Tokens of a block, unless one document has more.
BLOCK_TOKENS = 750_000
_MARK = "▁"
_WORDS_AT_ONCE = 8192
_FEW = 24
#: Characters beyond which a word is summed alone, so many starts at a time.
_LONG_WORD, _STARTS = 256, 1 << 16


@dataclass
class Pieces:
    """A vocabulary: first pieces (without their mark; the bare mark is ""), further pieces, single bytes, and the end."""

    first: dict[str, int]
    further: dict[str, int]
    bytes: list[int]
    end: int
    prior: np.ndarray  # log weights; first pieces sum to one, all others sum to one
    key: str = ""

    @classmethod
    def read(cls, path: str) -> Pieces:
        """From a sentencepiece file. Scores that are no log-probabilities, but ranks, weigh as 1 / (1 + rank)."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        first, further, raw, scores = {}, {}, [-1] * 256, []
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                raw[int(piece[1:-1], 16)] = len(scores)
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or _MARK in piece[1:]:
                continue
            elif piece.startswith(_MARK):
                first[piece[1:]] = len(scores)
            else:
                further[piece] = len(scores)
            scores.append(model.get_score(k))
        return cls.made(first, further, raw, np.array(scores, float))

    @classmethod
    def made(cls, first: dict[str, int], further: dict[str, int], raw: list[int], scores: np.ndarray) -> Pieces:
        n = len(scores)
        logs = scores if 0.1 < np.exp(np.minimum(scores, 0)).sum() < 10 else -np.log1p(np.maximum(-scores, 0))
        known = [k for k in raw if k >= 0]
        logs[known] = logs.min() if n else 0.0
        logs, first = list(logs), dict(first)
        if "" not in first:  # every word must be reachable
            first[""] = len(logs)
            logs.append(min(logs, default=0.0))
        raw = list(raw)
        for b in range(256):
            if raw[b] < 0:
                raw[b] = len(logs)
                logs.append(min(logs))
        logs.append(max(logs))
        pieces = cls(first, further, raw, len(logs) - 1, np.array(logs))
        pieces.prior = pieces.normal(np.exp(pieces.prior))
        pieces.key = md5(repr((sorted(first.items()), sorted(further.items()))).encode(), usedforsecurity=False).hexdigest()
        return pieces

    def normal(self, weights: np.ndarray) -> np.ndarray:
        """Logs of weights that sum to one in each of the two groups."""
        out, heads = weights.astype(float), np.zeros(len(weights), bool)
        heads[list(self.first.values())] = True
        for group in (heads, ~heads):
            out[group] /= out[group].sum()
        return np.log(out)


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


class Lattice:
    """Forward and backward sums over the segmentations of words; vectorised over words of one length."""

    _made: dict[str, list] = {}  # one for each worker and vocabulary
    _MULTIPLY, _SLOT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, pieces: Pieces, logs: np.ndarray):
        self.pieces, self.logs = pieces, logs
        self.longest = max(map(len, [*pieces.first, *pieces.further]), default=1)
        if pieces.key not in self._made:
            self._made[pieces.key] = [self._table(pieces.first), self._table(pieces.further)]
        self.tables = self._made[pieces.key]

    def _hash(self, h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return (h ^ (codes + np.uint64(1))) * self._MULTIPLY

    def _table(self, names: dict[str, int]) -> tuple[np.ndarray, np.ndarray, int]:
        """An open-addressing table from the hash of each beginning of a piece to its id, -1 where it is no piece."""
        nodes: dict[int, int] = {}
        for name, k in names.items():
            h = np.zeros(1, np.uint64)
            for i, c in enumerate(name):
                h = self._hash(h, np.array([ord(c)], np.uint64))
                nodes.setdefault(int(h[0]), -1)
                if i == len(name) - 1:
                    nodes[int(h[0])] = k
        bits = max(4, (4 * len(nodes)).bit_length())
        keys, ids, mask = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -2, np.int32), (1 << bits) - 1
        for h, k in nodes.items():
            at = (h * int(self._SLOT) & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
            while ids[at] != -2:
                at = (at + 1) & mask
            keys[at], ids[at] = h, k
        return keys, ids, bits

    def _find(self, table: int, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashes: -1 for a mere beginning of pieces, -2 for none."""
        keys, ids, bits = self.tables[table]
        mask = (1 << bits) - 1
        at = ((h * self._SLOT) >> np.uint64(64 - bits)).astype(np.int64)
        out = ids[at]
        open_ = np.nonzero((keys[at] != h) & (out != -2))[0]
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            found = ids[at[open_]]
            out[open_] = found
            open_ = open_[(keys[at[open_]] != h[open_]) & (found != -2)]
        return out

    def _arcs(self, codes: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(from, to, rows, piece ids, log weights), by ascending start; starts in front of the mark are -1."""
        m, n = codes.shape
        every, arcs = np.arange(m), []
        bare = np.full(m, self.pieces.first[""])
        arcs.append((-1, 0, every, bare, self.logs[bare]))
        for table, starts in ((0, (0,)), (1, range(n))):
            for i in starts:
                rows, h = every, np.zeros(m, np.uint64)
                single = np.zeros(m, bool)
                for j in range(i, min(n, i + self.longest)):
                    h = self._hash(h, codes[rows, j])
                    ids = self._find(table, h)
                    hit = ids >= 0
                    if hit.any():
                        arcs.append((-1 if table == 0 else i, j + 1, rows[hit], ids[hit], self.logs[ids[hit]]))
                        if j == i:
                            single[rows[hit]] = True
                    alive = ids != -2
                    if not alive.any():
                        break
                    rows, h = rows[alive], h[alive]
                if table == 1 and not single.all():
                    for row in np.nonzero(~single)[0]:
                        arcs.append((i, i + 1, np.array([row]), *self._spelled(chr(int(codes[row, i])))))
        return arcs

    def _spelled(self, c: str) -> tuple[np.ndarray, np.ndarray]:
        """A character that is no piece, by its bytes: a negative code for the character, and the log weight."""
        return np.array([-1 - ord(c)]), np.array([sum(self.logs[self.pieces.bytes[b]] for b in c.encode("utf-8", "surrogatepass"))])

    def _add(self, counts: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        spelled = ids < 0
        if spelled.any():
            for k, x in zip(ids[spelled], n[spelled]):
                for b in chr(-1 - int(k)).encode("utf-8", "surrogatepass"):
                    counts[self.pieces.bytes[b]] += x
            ids, n = ids[~spelled], n[~spelled]
        np.add.at(counts, ids, n)

    def _group(self, words: list[str], counts: np.ndarray | None) -> np.ndarray:
        """Natural logs of the marginals of words of one length; adds expected piece counts to ``counts``."""
        m, n = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n).astype(np.uint64)
        arcs = self._arcs(codes)
        ahead = np.full((n + 1, m), -np.inf)
        for i, j, rows, _, w in arcs:
            ahead[j, rows] = np.logaddexp(ahead[j, rows], w if i < 0 else ahead[i, rows] + w)
        total = ahead[n] + self.logs[self.pieces.end]
        if counts is not None:
            back = np.full((n + 1, m), -np.inf)
            back[n] = self.logs[self.pieces.end]
            for i, j, rows, ids, w in reversed(arcs):
                after = back[j, rows] + w
                before = 0.0 if i < 0 else ahead[i, rows]
                self._add(counts, ids, np.exp(before + after - total[rows]))
                if i >= 0:
                    back[i, rows] = np.logaddexp(back[i, rows], after)
            counts[self.pieces.end] += m
        return total

    def _alone(self, word: str) -> float:
        """As ``_group`` for one word, piece by piece: for words of rare lengths."""
        n, logs, first, further = len(word), self.logs, self.pieces.first, self.pieces.further
        ahead = [-math.inf] * (n + 1)
        ahead[0] = logs[first[""]]
        for j in range(1, min(n, self.longest) + 1):
            if (k := first.get(word[:j])) is not None:
                ahead[j] = logs[k]
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                k = further.get(word[i:j])
                if k is not None:
                    w = logs[k]
                elif j == i + 1:
                    w = self._spelled(word[i])[1][0]
                else:
                    continue
                ahead[j] = _log_add(ahead[j], ahead[i] + w)
        return ahead[n] + logs[self.pieces.end]

    def _spans(self, codes: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece ids, log weights) of the further pieces of a word that start in [lo, hi), by ascending start."""
        at, h = np.arange(lo, hi), np.zeros(hi - lo, np.uint64)
        single, parts = np.zeros(hi - lo, bool), []
        for size in range(1, self.longest + 1):
            fits = at + size <= len(codes)
            at, h = at[fits], h[fits]
            if not len(at):
                break
            h = self._hash(h, codes[at + size - 1])
            ids = self._find(1, h)
            hit = ids >= 0
            parts.append((at[hit], at[hit] + size, ids[hit].astype(np.int64), self.logs[ids[hit]]))
            if size == 1:
                single[at[hit] - lo] = True
            alive = ids != -2
            at, h = at[alive], h[alive]
        for i in np.nonzero(~single)[0] + lo:
            parts.append((np.array([i]), np.array([i + 1]), *self._spelled(chr(int(codes[i])))))
        starts, ends, ids, w = (np.concatenate([x[k] for x in parts]) for k in range(4))
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order], ids[order], w[order]

    def _long(self, word: str, counts: np.ndarray | None) -> float:
        """As ``_group`` for one long word; its pieces are found for many starts at once and never held all."""
        n, codes = len(word), np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        heads = [(j, k) for j in range(min(n, self.longest) + 1) if (k := self.pieces.first.get(word[:j])) is not None]
        ahead = [-math.inf] * (n + 1)
        for j, k in heads:
            ahead[j] = float(self.logs[k])
        portions = range(0, n, _STARTS)
        for lo in portions:
            starts, ends, _, w = self._spans(codes, lo, min(n, lo + _STARTS))
            for i, j, x in zip(starts.tolist(), ends.tolist(), w.tolist()):
                ahead[j] = _log_add(ahead[j], ahead[i] + x)
        end = float(self.logs[self.pieces.end])
        total = ahead[n] + end
        if counts is not None:
            back = [-math.inf] * n + [end]
            for lo in reversed(portions):
                starts, ends, ids, w = self._spans(codes, lo, min(n, lo + _STARTS))
                weight = np.empty(len(starts))
                for at, (i, j, x) in enumerate(zip(starts[::-1].tolist(), ends[::-1].tolist(), w[::-1].tolist())):
                    weight[at] = ahead[i] + x + back[j]
                    back[i] = _log_add(back[i], x + back[j])
                self._add(counts, ids[::-1], np.exp(weight - total))
            for j, k in heads:
                counts[k] += math.exp(float(self.logs[k]) + back[j] - total)
            counts[self.pieces.end] += 1
        return total

    def marginals(self, words: list[str], counts: np.ndarray | None = None) -> np.ndarray:
        """log P of each word (none empty) over all its segmentations; adds expected piece counts to ``counts``."""
        out = np.empty(len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        cuts = np.nonzero(np.diff(sizes[order], prepend=-1))[0].tolist() + [len(words)]
        for lo, hi in zip(cuts, cuts[1:]):
            if sizes[order[lo]] > _LONG_WORD:
                for k in order[lo:hi]:
                    out[k] = self._long(words[k], counts)
                continue
            if counts is None and hi - lo < _FEW:
                for k in order[lo:hi]:
                    out[k] = self._alone(words[k])
                continue
            step = max(1, _WORDS_AT_ONCE * 16 // max(16, int(sizes[order[lo]])))
            for at in range(lo, hi, step):
                some = order[at : min(hi, at + step)]
                out[some] = self._group([words[k] for k in some], counts)
        return out


_BLOCKS = "block long, bucket int, words binary, counts binary, ids array<long>, kinds array<int>, ends array<long>, tokens array<long>, at binary, n binary"
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("at", pa.binary()), ("n", pa.binary())])


class _Block:
    """Documents as counts of the block's distinct words; words are numbered in the order of bucket and word."""

    def __init__(self, n_kinds: int):
        self.index: dict[bytes, int] = {}
        self.ids, self.kinds, self.tokens, self.at, self.n = [], [], [], [], []
        self.size, self.n_kinds = 0, n_kinds

    def add(self, doc_id: int | None, text: str | None, kind: int) -> None:
        """``kind`` is -1 for a text that nothing is learned from."""
        tokens = (text or "").encode().lower().split()
        index = self.index
        at, n = np.unique(np.fromiter((index.setdefault(w, len(index)) for w in tokens), np.int64, len(tokens)), return_counts=True)
        self.ids.append(doc_id)
        self.kinds.append(kind)
        self.tokens.append(len(tokens))
        self.at.append(at)
        self.n.append(n)
        self.size += len(tokens)

    def rows(self, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh32_intdigest

        words = list(self.index)
        dealt = np.fromiter((xxh32_intdigest(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(dealt, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        ends = np.cumsum([len(x) for x in self.at]) if self.at else np.zeros(0, np.int64)
        at = place[np.concatenate(self.at)] if words else np.zeros(0, np.int64)
        n = np.concatenate(self.n) if words else np.zeros(0, np.int64)
        kinds = np.repeat(self.kinds, np.diff(ends, prepend=0)) if len(ends) else np.zeros(0, np.int64)
        learned = kinds >= 0
        counts = np.bincount(at[learned] * self.n_kinds + kinds[learned], n[learned], len(words) * self.n_kinds).astype("<u4").reshape(-1, self.n_kinds)  # a block has fewer tokens than that
        rows = [{"block": block, "bucket": -1, "ids": self.ids, "kinds": self.kinds, "ends": ends.tolist(), "tokens": self.tokens, "at": at.astype("<u4").tobytes(), "n": n.astype("<u4").tobytes()}]
        bounds = np.searchsorted(dealt[order], np.arange(buckets + 1))
        for b in range(buckets):
            lo, hi = bounds[b], bounds[b + 1]
            if hi > lo:
                rows.append({"block": block, "bucket": b, "words": b"\n".join(words[k] for k in order[lo:hi]), "counts": counts[lo:hi].tobytes()})
        yield pa.RecordBatch.from_pylist(rows, _BLOCK_SCHEMA)


def _blocks(buckets: int, block_tokens: int, n_kinds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, block = TaskContext.get().partitionId() << 32, _Block(n_kinds)
        for batch in batches:
            for doc_id, text, kind in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                block.add(doc_id, text.as_py(), kind)
                if block.size >= block_tokens:
                    yield from block.rows(number, buckets)
                    number, block = number + 1, _Block(n_kinds)
        if block.ids:
            yield from block.rows(number, buckets)

    return run


def _merged(table: pa.Table, n_kinds: int) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """The distinct words of a bucket, the numbers of each row's words among them, and the training counts by word and kind."""
    index: dict[bytes, int] = {}
    lists = [np.fromiter((index.setdefault(w, len(index)) for w in words.as_py().split(b"\n")), np.int64) for words in table.column("words")]
    total = np.zeros((len(index), n_kinds), np.int64)
    for held, counts in zip(lists, table.column("counts")):
        total[held] += np.frombuffer(counts.as_py(), "<u4").reshape(-1, n_kinds)  # a row's words are distinct
    return list(index), lists, total


def _vocabulary(n_kinds: int):
    def run(table: pa.Table) -> pa.Table:
        words, _, total = _merged(table, n_kinds)
        counts = total.sum(1)
        learned = [words[k] for k in np.nonzero(counts)[0]]
        return pa.table({
            "words": pa.array([b"\n".join(learned)], pa.binary()), "n": pa.array([total.sum(0).tolist()]), "v": pa.array([(total > 0).sum(0).tolist()]),
            "distinct": pa.array([len(learned)]), "once": pa.array([int((counts == 1).sum())]), "twice": pa.array([int((counts == 2).sum())]),
        })

    return run


def _expected(pieces: Pieces, logs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, counts = Lattice(pieces, logs), np.zeros(len(logs))
        for batch in batches:
            for words in batch.column(0):
                if words.as_py():
                    lattice.marginals([w.decode() for w in words.as_py().split(b"\n")], counts)
        some = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.float64())], ["piece", "n"])

    return run


@dataclass
class Statistics:
    """Of the training tokens by kind, ends included: all, distinct, texts; distinct ones of all kinds; the discount."""

    n: np.ndarray
    v: np.ndarray
    texts: np.ndarray
    distinct: int
    discount: float

    def backed(self, counts: np.ndarray, n: float, v: float, log_behind: np.ndarray) -> np.ndarray:
        """log of (max(c - d, 0) + d v behind) / n; ``log_behind`` itself, at half its weight, where nothing is counted."""
        if not n:
            return log_behind + math.log(0.5)
        behind = log_behind + math.log(self.discount * v / n)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(np.maximum(counts - self.discount, 0) / n), behind)


def _scores(pieces: Pieces, logs: np.ndarray, s: Statistics):
    """ln P, the pieces' part of it, and the counts by kind, of each word, in the order of each block's list.

    Counts take four bytes where all of a row do, else eight.
    """

    def run(table: pa.Table) -> pa.Table:
        words, lists, total = _merged(table, len(s.n))
        spelled = Lattice(pieces, logs).marginals([w.decode() for w in words])
        p = s.backed(total.sum(1), s.n.sum(), s.distinct, spelled)
        kinds = ["<u4" if total[x].max(initial=0) < 1 << 32 else "<u8" for x in lists]
        return pa.table({
            "block": table.column("block"), "bucket": table.column("bucket"),
            "c": pa.array([total[x].astype(k).tobytes() for x, k in zip(lists, kinds)], pa.binary()), "p": pa.array([p[x].astype("<f8").tobytes() for x in lists], pa.binary()),
            "q": pa.array([spelled[x].astype("<f4").tobytes() for x in lists], pa.binary()),
        })

    return run


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x of 8 or more, by Stirling's series; good to 1e-10."""
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def _log_rising(logs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """ln of x (x + 1) ... (x + n - 1), for x given by its log, n of 1 or more."""
    out, x = logs.copy(), np.exp(logs)
    for k in range(1, 8):
        more = n > k
        if not more.any():
            return out
        out[more] += np.log(x[more] + k)
    more = n > 8
    out[more] += _log_gamma(x[more] + n[more]) - _log_gamma(x[more] + 8)
    return out


def _documents(s: Statistics, focus: float):
    def run(blocks: pa.Table, scores: pa.Table) -> pa.Table:
        scores = scores.sort_by("bucket")
        logs = [np.frombuffer(x.as_py(), "<f8") for x in scores.column("p")]
        counts = [np.frombuffer(x.as_py(), "<u4" if len(x.as_py()) == 4 * len(p) * len(s.n) else "<u8") for x, p in zip(scores.column("c"), logs)]
        counts = np.concatenate(counts or [np.zeros(0)]).astype(np.int64).reshape(-1, len(s.n))
        spelled = np.concatenate([np.frombuffer(x.as_py(), "<f4") for x in scores.column("q")] or [np.zeros(0)]).astype(float)
        logs = np.concatenate(logs or [np.zeros(0)])
        (row,) = blocks.select(["ids", "kinds", "ends", "tokens"]).to_pylist()
        at, n = (np.frombuffer(blocks.column(c)[0].as_py(), "<u4").astype(np.int64) for c in ("at", "n"))
        ends, tokens = np.array(row["ends"], np.int64), np.array(row["tokens"], np.int64)
        starts = np.concatenate(([0], ends[:-1]))
        some = ends > starts

        def per_document(x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(ends), x.dtype)
            if some.any():
                out[some] = np.add.reduceat(x, starts[some])
            return out

        every = counts.sum(1)
        all_n, all_texts = int(s.n.sum()), int(s.texts.sum())
        rate = math.log10(all_n + 0.5 * (s.distinct + 1))
        base = per_document(np.log10(every[at] + 0.5) * n) - rate * tokens + math.log10(all_texts + 0.5) - rate
        share = (all_texts + 0.5) / (all_n + 1)
        lattice = per_document(spelled[at] * n) + math.log1p(-share) * tokens + math.log(share)
        of = _log_rising(np.full(len(tokens), math.log(focus)), tokens + 1)
        end = s.backed(np.array([all_texts]), all_n, s.distinct, np.full(1, -np.inf)) if all_n else np.log([0.5])
        whole = np.full(len(tokens), -np.inf)
        for k in range(len(s.n)):
            if s.texts[k] or not all_n:
                words = s.backed(counts[:, k], s.n[k], s.v[k], logs) if all_n else logs
                stop = (s.backed(np.array([s.texts[k]]), s.n[k], s.v[k], end) if all_n else end)[0]
                own = per_document(_log_rising(words[at] + math.log(focus), n)) + stop + math.log(focus) - of
                whole = np.logaddexp(whole, own + (math.log(s.texts[k] / all_texts) if all_n else -math.log(len(s.n))))
        return pa.table({
            "doc_id": pa.array(row["ids"], pa.int64()), "learned": pa.array([k >= 0 for k in row["kinds"]], pa.bool_()), "n_tokens": pa.array(tokens + 1),
            "n_known": pa.array(per_document(n * (every[at] > 0)) + (all_texts > 0)), "train_tokens": pa.array(np.full(len(tokens), all_n)),
            "base_score": pa.array(base), "score": pa.array(whole / math.log(10)), "lattice_score": pa.array(lattice / math.log(10)),
        })

    return run


_RESULT = "doc_id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"


def score(
    docs: DataFrame, learn: Column, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", kind: Column | None = None, rounds: int = 2, prior: float = 1000.0, focus: float = 4000.0, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score, score and lattice_score (log10) for every row of ``docs``.

    ``lattice_score`` is that of the pieces alone: the sum over tokens of the words' marginals over all
    segmentations and the ends' share, without whole words, kinds or the document's own frequencies.
    ``rounds`` of re-estimation, none: the vocabulary's own weights.

    Rows where ``learn`` holds are the training texts; null counts as false. ``kind`` names the kind of
    a training text (null: a kind of its own); without it all are of one. Tokens are the words, A-Z
    lower-cased, and one end for each text. Null and empty texts are the end alone. Null ids and
    repeated rows pass through. No training text: pieces weigh as in the vocabulary, an end is as
    likely as a word. Other columns are not read. An empty table gives an empty table.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lm")
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    learn, kind = F.coalesce(learn, F.lit(False)), F.coalesce((F.lit("") if kind is None else kind).cast("string"), F.lit("\0"))
    names = [r[0] for r in docs.where(learn).groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(KINDS).collect()] or [""]
    number = F.lit(len(names) - 1)
    for k, name in enumerate(names[:-1]):
        number = F.when(kind == name, k).otherwise(number)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.when(learn, number).otherwise(-1).cast("int").alias("kind"))
    blocks = scratch.table(rows.mapInArrow(_blocks(buckets, block_tokens, len(names)), _BLOCKS), "blocks")
    held = blocks.where("bucket < 0").select(F.explode("kinds").alias("kind")).where("kind >= 0").groupBy("kind").count().collect()
    lists = blocks.where("bucket >= 0").select("block", "bucket", "words", "counts")
    vocabulary = lists.groupBy("bucket").applyInArrow(_vocabulary(len(names)), "words binary, n array<long>, v array<long>, distinct long, once long, twice long")
    vocabulary = scratch.table(vocabulary, "vocabulary")
    sums = vocabulary.agg(*(F.sum(F.get(c, k)) for c in ("n", "v") for k in range(len(names))), F.sum("distinct"), F.sum("once"), F.sum("twice")).first()
    *by_kind, distinct, once, twice = (x or 0 for x in sums)
    texts = np.zeros(len(names), np.int64)
    for k, n in held:
        texts[k] = n
    n, v = np.array(by_kind[: len(names)], np.int64), np.array(by_kind[len(names) :], np.int64)
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    s = Statistics(n + texts, v + (texts > 0), texts, distinct + int(texts.any()), discount)
    logs = pieces.prior
    for _ in range(rounds if distinct else 0):
        counts = np.exp(pieces.prior) * prior
        for piece, x in vocabulary.select("words").mapInArrow(_expected(pieces, logs), "piece int, n double").groupBy("piece").agg(F.sum("n")).collect():
            counts[piece] += x
        logs = pieces.normal(counts)
    scored = lists.groupBy("bucket").applyInArrow(_scores(pieces, logs, s), "block long, bucket int, c binary, p binary, q binary")
    return blocks.where("bucket < 0").groupBy("block").cogroup(scored.groupBy("block")).applyInArrow(_documents(s, focus), _RESULT)
