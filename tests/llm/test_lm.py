import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import lm
from tessella.llm.queries import _tokenizer


@pytest.fixture(scope="module")
def pieces():
    return lm.Pieces.made({"a": 0, "ab": 1, "": 2}, {"a": 3, "b": 4, "ba": 5, "bab": 6}, [-1] * 256, np.array([-1.0, -2, -3, -4, -5, -6, -7]))


def brute(pieces, logs, word):
    def rest(i):
        if i == len(word):
            return math.exp(logs[pieces.end])
        total = 0.0
        for j in range(i + 1, len(word) + 1):
            s = word[i:j]
            if s in pieces.further:
                total += math.exp(logs[pieces.further[s]]) * rest(j)
            elif j == i + 1:
                total += math.exp(sum(logs[pieces.bytes[b]] for b in s.encode())) * rest(j)
        return total

    return math.log(sum(math.exp(logs[pieces.first[word[:j]]]) * rest(j) for j in range(len(word) + 1) if word[:j] in pieces.first))


def test_marginal_is_the_sum_over_segmentations(pieces):
    lattice = lm.Lattice(pieces, pieces.prior)
    words = ["a", "b", "ab", "abab", "babab", "é", "aéb", "zz", "日a"]
    want = [brute(pieces, pieces.prior, w) for w in words]
    assert np.allclose(lattice.marginals(words), want)
    assert np.allclose([lattice._group([w] * 30, None)[3] for w in words], want)


def test_probabilities_sum_to_one_at_most(pieces):
    from itertools import product

    lattice = lm.Lattice(pieces, pieces.prior)
    words = ["".join(p) for n in range(1, 9) for p in product("ab", repeat=n)]
    assert np.exp(lattice.marginals(words)).sum() < 1


def test_expected_counts_are_derivatives(pieces):
    words, logs = ["abab", "bab", "aéb", "a"], pieces.prior
    counts = np.zeros(len(logs))
    lm.Lattice(pieces, logs).marginals(words, counts)
    for k in range(len(logs)):
        up = logs.copy()
        up[k] += 1e-5
        slope = (lm.Lattice(pieces, up).marginals(words).sum() - lm.Lattice(pieces, logs).marginals(words).sum()) / 1e-5
        assert abs(slope - counts[k]) < 1e-3


def test_rounds_raise_the_likelihood(pieces):
    words, logs, before = ["abab", "baba", "bab", "abba"] * 3, pieces.prior, -math.inf
    for _ in range(4):
        counts = np.full(len(logs), 1e-9)
        now = lm.Lattice(pieces, logs).marginals(words, counts).sum()
        assert now >= before - 1e-6
        before, logs = now, pieces.normal(counts)


def test_rising_factorials():
    x, n = np.array([1e-9, 0.3, 2.5, 40.0, 7.0]), np.array([1, 5, 12, 300, 8])
    want = [math.lgamma(a + b) - math.lgamma(a) for a, b in zip(x, n)]
    assert np.allclose(lm._log_rising(np.log(x), n), want, rtol=1e-9)


@pytest.mark.parametrize("block_tokens", [10, 1_000_000])
def test_counts_and_base(docs, corpus, pieces, block_tokens):
    learn = F.col("doc_id") % 5 != 1
    got = sorted((tuple(r) for r in lm.score(docs, learn, pieces, kind=F.col("lang"), block_tokens=block_tokens).collect()), key=repr)
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    counts = Counter(w for i, t, *_ in corpus if i is not None and i % 5 != 1 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(corpus)
    base = {}
    for i, t, *_ in corpus:
        base.setdefault((i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t))), sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)))
    for i, learned, size, known, total, b, s, spelled in got:
        assert learned == (i is not None and i % 5 != 1) and total == n
        assert abs(base[i, size, known] - b) < 1e-9 * size + 1e-9 and s < 0 and spelled < 0


def test_blocks_do_not_matter(docs, pieces):
    rows = [sorted((r.n_tokens, round(r.score, 6)) for r in lm.score(docs, F.col("doc_id") % 2 == 0, pieces, block_tokens=b).collect()) for b in (1, 100, 10**6)]
    assert rows[0] == rows[1] == rows[2]


def test_score_by_hand(spark, pieces):
    df = spark.createDataFrame([(0, "ab ab b"), (1, "ab ba")], "doc_id long, text string")
    rows = lm.score(df, F.col("doc_id") == 0, pieces, rounds=0, focus=10.0).collect()
    got = {r.doc_id: r.score for r in rows}
    d = 1 / (1 + 2 * 1)  # one word once, one twice
    n, v = 4, 3
    marginal = lambda w: math.exp(brute(pieces, pieces.prior, w))
    behind = lambda c, w: (max(c - d, 0) + d * v * marginal(w)) / n
    kind = lambda c, w: (max(c - d, 0) + d * v * behind(c, w)) / n
    end = (max(1 - d, 0) + d * v * ((1 - d) / n)) / n
    p = 10 * kind(2, "ab") * 10 * kind(0, "ba") * 10 * end / (10 * 11 * 12)
    assert abs(got[1] - math.log10(p)) < 1e-9
    share = 1.5 / 5
    alone = {r.doc_id: r.lattice_score for r in rows}
    assert abs(alone[1] - math.log10(marginal("ab") * marginal("ba") * (1 - share) ** 2 * share)) < 1e-5


def test_nothing_learned_and_empty(docs, none, clashing, pieces, corpus):
    rows = lm.score(docs, F.lit(False), pieces).collect()
    assert len(rows) == len(corpus) and all(r.n_known == 0 and r.train_tokens == 0 and abs(r.base_score) < 1e-9 and r.score < 0 for r in rows)
    assert lm.score(none, F.lit(True), pieces).count() == 0
    assert lm.score(clashing, F.col("doc_id") > 3, pieces).count() == len(corpus)


def test_public_vocabulary():
    pieces = lm.Pieces.read(_tokenizer("piece_bpe_32k.model"))
    assert len(pieces.first) > 10_000 and abs(np.exp(pieces.prior).sum() - 2) < 1e-6
    lattice = lm.Lattice(pieces, pieces.prior)
    words = ["the", "lattice", "naïve", "\U0001f600"]
    assert np.allclose(lattice.marginals(words), [brute(pieces, pieces.prior, w) for w in words])


@pytest.mark.parametrize("portion", [5, 1 << 16])
def test_long_words(pieces, portion, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcé日"), n, p=[0.4, 0.4, 0.1, 0.05, 0.05])) for n in (257, 300, 513)]
    lattice = lm.Lattice(pieces, pieces.prior)
    short, long_ = np.zeros(len(pieces.prior)), np.zeros(len(pieces.prior))
    want = np.concatenate([lattice._group([w], short) for w in words])
    monkeypatch.setattr(lm, "_STARTS", portion)
    assert np.allclose(lattice.marginals(words, long_), want) and np.allclose(lattice.marginals(words), want)
    assert np.allclose(short, long_)


def test_a_word_of_a_million_characters(pieces):
    lattice, counts = lm.Lattice(pieces, pieces.prior), np.zeros(len(pieces.prior))
    word = "ab" * 500_000
    total = lattice.marginals([word], counts)[0]
    # Every segmentation of a prefix is extended alike: the log grows in proportion to the length.
    half = lattice.marginals([word[:500_000]])[0]
    assert total < half < 0 and abs(total / half - 2) < 1e-3 and counts.sum() > 10_000
