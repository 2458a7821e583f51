"""License scans by patience alignment of texts with license templates.

Words that stand once in a stretch of the text and once in a stretch of the template are anchors; the
longest increasing run of them holds, and the gaps between them are aligned in the same way. Coverage
is the share of a template's words that the alignment meets. Only stretches that hold enough of a
template's words, as a multiset, can reach the wanted coverage; others are not aligned.

Words that a template does not have can never meet it, so a text is reduced to the template's own
words first: comment marks, frames and text between its words cost nothing. Stretches of the reduced
text begin at every half of their size, and their sizes double up to the whole of it, so that a notice
lies whole in one of them however widely it is spread. Only short notices, a sentence, have a bound on
their spread: a few common words in order are no notice unless they stand together.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.templates import TEMPLATES

#: Words up to which a template is a short notice, and the multiple of its length, and more words, over which one may be spread.
SHORT, SPREAD, MORE = 20, 1.5, 2
_WORD = re.compile(r"[^\W_]+(?:[.\-/][^\W_]+)*")


def words(text: str) -> list[str]:
    """Lower-cased words of letters and digits, with inner points, dashes and strokes."""
    return _WORD.findall(text.lower())


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Ascending pairs (i, j) of equal words a[i] and b[j], by patience."""
    pairs, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        i, i_end, j, j_end = open_.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            pairs.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        anchors = _anchors(a, i, i_end, b, j, j_end)
        for at, (x, y) in enumerate(anchors):
            pairs.append((x, y))
            before = anchors[at - 1] if at else (i - 1, j - 1)
            open_.append((before[0] + 1, x, before[1] + 1, y))
        if anchors:
            open_.append((anchors[-1][0] + 1, i_end, anchors[-1][1] + 1, j_end))
    return sorted(pairs)


def _once(words: list[str], lo: int, hi: int) -> dict[str, int]:
    seen: dict[str, int] = {}
    for k in range(lo, hi):
        seen[words[k]] = -1 if words[k] in seen else k
    return {w: k for w, k in seen.items() if k >= 0}


def _anchors(a: list[str], i: int, i_end: int, b: list[str], j: int, j_end: int) -> list[tuple[int, int]]:
    """The longest run, increasing in both, of words that stand once in each stretch."""
    there = _once(b, j, j_end)
    both = [(k, there[w]) for w, k in _once(a, i, i_end).items() if w in there]
    both.sort()
    tops: list[int] = []  # smallest last b of a run of each length
    last: list[int] = []
    back: list[int] = []
    for n, (_, y) in enumerate(both):
        at = bisect_left(tops, y)
        back.append(last[at - 1] if at else -1)
        if at == len(tops):
            tops.append(y)
            last.append(n)
        else:
            tops[at], last[at] = y, n
    run, n = [], last[-1] if last else -1
    while n >= 0:
        run.append(both[n])
        n = back[n]
    return run[::-1]


class Scanner:
    """Templates, by name (license, naming words, text), prepared for scanning."""

    def __init__(self, templates: dict[str, tuple[str, str, str]], coverage: float = 0.8):
        self.coverage = coverage
        self.licenses = {name: t[0] for name, t in templates.items()}
        self.templates = {name: words(t[2]) for name, t in templates.items()}
        self.naming = {name: [self._only(name, w) for w in t[1].split()] for name, t in templates.items()}
        self.counts = {name: Counter(t) for name, t in self.templates.items()}
        self.least = {name: -int(-coverage * len(t) // 1) for name, t in self.templates.items()}  # ceiling
        # What a coverage leaves out is too little for all of a template's rarest words to miss.
        common = Counter(w for c in self.counts.values() for w in c)
        self.keys = {}
        for name, c in self.counts.items():
            missed = len(self.templates[name]) - self.least[name]
            keys, total = [], 0
            for w in sorted(c, key=lambda w: (common[w], len(w) < 5, w)):
                if total > missed:
                    break
                keys.append(w)
                total += c[w]
            self.keys[name] = set(keys)

    def _only(self, name: str, word: str) -> str:
        """The word of a template that a naming word is, or is part of."""
        return next(w for w in self.templates[name] if w == word or (len(word) > 4 and word in w))

    def scan(self, text: str | None) -> list[tuple[str, str, float, int, int, int]]:
        """(license, template, coverage, words met, first and last word in the text) of each place, by first word.

        Of overlapping places the one that meets most words stays, then the better covered, then the
        earlier, then that of the lesser name.
        """
        low = (text or "").lower()
        found, places = None, []
        for name, keys in self.keys.items():
            if all(w in low for w in self.naming[name]) and any(k in low for k in keys):
                found = words(low) if found is None else found
                places += ((-n, -c, first, name, last) for c, n, first, last in self._places(name, found))
        chosen: list[tuple[int, int, tuple]] = []  # disjoint, by first word
        for place in sorted(places):
            n, c, first, name, last = place
            at = bisect_left(chosen, (first,))
            if (at == 0 or chosen[at - 1][1] < first) and (at == len(chosen) or chosen[at][0] > last):
                chosen.insert(at, (first, last, (self.licenses[name], name, -c, -n, first, last)))
        return [row for *_, row in chosen]

    def _places(self, name: str, text: list[str]) -> Iterator[tuple[float, int, int, int]]:
        """(coverage, words met, first, last) of disjoint places of one template."""
        template, count, least = self.templates[name], self.counts[name], self.least[name]
        at = [k for k, w in enumerate(text) if w in count]
        own = [text[k] for k in at]
        if sum(min(n, count[w]) for w, n in Counter(own).items()) < least:
            return
        taken = [False] * len(own)
        if len(template) <= SHORT:
            yield from self._sentences(name, at, own, taken)
            return
        size = 2 * len(template)
        while True:
            step = max(1, size // 2)
            for lo in range(0, max(1, len(own) - step), step):
                yield from self._stretch(name, at, own, taken, lo, min(len(own), lo + size))
            if size >= len(own):
                break
            size *= 2

    def _enough(self, name: str, words: list[str]) -> bool:
        """Whether words can meet enough of a template, whatever their order."""
        held, count = Counter(words), self.counts[name]
        return sum(min(n, count[w]) for w, n in held.items()) >= self.least[name] and bool(self.keys[name] & held.keys())

    def _sentences(self, name: str, at: list[int], own: list[str], taken: list[bool]) -> Iterator[tuple[float, int, int, int]]:
        """The places of a short notice: around every key word all stretches are aligned that are not spread too widely."""
        template, reach = self.templates[name], len(self.templates[name]) * SPREAD + MORE
        for k, w in enumerate(own):
            if w not in self.keys[name] or taken[k]:
                continue
            lo, hi = bisect_left(at, at[k] - reach), bisect_left(at, at[k] + reach)
            while any(taken[lo:k]):
                lo += 1
            if not self._enough(name, own[lo:hi]):
                continue
            best: list[tuple[int, int]] = []
            for i in range(lo, k + 1):
                end = bisect_left(at, at[i] + reach)
                for j in range(max(k + 1, i + self.least[name]), end + 1):
                    met = [(x + i, y) for x, y in align(own[i:j], template)]
                    if len(met) > len(best) and self._named(name, met):
                        best = met
            if len(best) >= self.least[name]:
                first, last = best[0][0], best[-1][0]
                yield len(best) / len(template), len(best), at[first], at[last]
                taken[first : last + 1] = [True] * (last + 1 - first)

    def _stretch(self, name: str, at: list[int], own: list[str], taken: list[bool], lo: int, hi: int) -> Iterator[tuple[float, int, int, int]]:
        """The places in a stretch of the template's words, one after the other; their words are taken."""
        template = self.templates[name]
        open_ = [(lo, hi)]
        while open_:
            lo, hi = open_.pop()
            while lo < hi and taken[lo]:
                lo += 1
            inside = next((k for k in range(lo, hi) if taken[k]), None)
            if inside is not None:
                open_ += [(inside, hi), (lo, inside)]
                continue
            if not self._enough(name, own[lo:hi]):
                continue
            met = self._best(own, lo, hi, template, self.keys[name])
            if len(met) < self.least[name] or not self._named(name, met):
                continue
            first, last = met[0][0], met[-1][0]
            yield len(met) / len(template), len(met), at[first], at[last]
            taken[first : last + 1] = [True] * (last + 1 - first)
            open_ += [(lo, first), (last + 1, hi)]

    def _named(self, name: str, met: list[tuple[int, int]]) -> bool:
        """Whether an alignment meets every naming word."""
        there = {self.templates[name][j] for _, j in met}
        return all(w in there for w in self.naming[name])

    def _best(self, own: list[str], lo: int, hi: int, template: list[str], keys: set[str]) -> list[tuple[int, int]]:
        """The best alignment of the template with the whole stretch, or with a part of it that begins where the template would."""
        # In longer stretches these parts have been tried: each lies in a stretch of the first size.
        starts = {max(lo, k - j) for k in range(lo, hi) if own[k] in keys for j, w in enumerate(template) if w == own[k]} if hi - lo <= 2 * len(template) else ()
        best: list[tuple[int, int]] = []
        for start, end in [*((s, min(hi, s + len(template))) for s in sorted(starts)), (lo, hi)]:
            if end - start > len(best):
                met = [(i + start, j) for i, j in align(own[start:end], template)]
                if len(met) > len(best):
                    best = met
            if len(best) == len(template):
                break
        return best


_ROW = "doc_id long, license string, template string, coverage double, n_met int, first_word int, last_word int"


def scan(docs: DataFrame, templates: dict[str, tuple[str, str, str]] | None = None, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, template, coverage, n_met, first_word, last_word): a row for each place where a template is covered.

    Word positions count the words of the whole text from 0. Places do not overlap. Null and empty
    texts, and texts without a license, have no row; rows with a null id are scanned; repeated rows
    repeat. Other columns are not read. An empty table gives an empty table.
    """
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, coverage)
        for batch in batches:
            rows = [(doc_id, *place) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)) for place in scanner.scan(text.as_py())]
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _ROW.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _ROW)
