from collections import defaultdict
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import packing as P


def padding(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_boundaries_are_optimal(histogram, k):
    lengths, counts = list(histogram), list(histogram.values())
    ends = P.boundaries(lengths, counts, k)
    top, rest = max(lengths), [n for n in lengths if n != max(lengths)]
    best = min(padding(lengths, counts, [*c, top]) for c in combinations(rest, min(k, len(lengths)) - 1))
    assert ends == sorted(ends) and padding(lengths, counts, ends) == best and len(ends) == min(k, len(lengths))


def test_no_length_no_bucket():
    assert P.boundaries([], [], 4) == []


@pytest.mark.parametrize("budget", [1, 100])
def test_batches(docs, corpus, budget):
    rows = P.pack(docs, P.word_count(F.col("text")), window=50, buckets=4, budget=budget).collect()
    whole = defaultdict(int)
    for r in rows:
        whole[r.doc_id] += r.n_tokens
        assert r.n_tokens <= r.bucket_len and r.n_tokens <= 50 and r.start == 50 * r.segment
    want = defaultdict(int)
    for i, t, *_ in corpus:
        want[i] += len((t or "").split())
    assert whole == want
    batches = defaultdict(list)
    for r in rows:
        batches[r.batch].append(r)
    assert sorted(batches) == list(range(len(batches)))
    for b in batches.values():
        room = max(1, budget // max(1, b[0].bucket_len))
        assert len({r.bucket for r in b}) == 1 and sorted(r.slot for r in b) == list(range(len(b))) and len(b) <= room
    last = {b[0].bucket: k for k, b in sorted(batches.items())}
    assert all(len(b) == max(1, budget // max(1, b[0].bucket_len)) for k, b in batches.items() if k not in last.values())


def test_empty_table_and_clashing_columns(none, clashing, corpus):
    assert P.pack(none, P.word_count(F.col("text"))).count() == 0
    assert P.pack(clashing, P.word_count(F.col("text"))).where("segment = 0").count() == len(corpus)
