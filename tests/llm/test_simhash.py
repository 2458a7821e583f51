import re

import numpy as np
import pytest
import xxhash

from tessella.llm import simhash as S
from tessella.llm.components import connected_components
from tessella.llm.scratch import Scratch


def plain(text):
    words = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, near):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_fingerprint_is_the_majority_of_bits():
    for text in (None, "", " \n", "One", "one TWO", "É é Straße one", "a b c " * 50, "x\x0by\x0cz\x1fq"):
        assert S.fingerprint(text) == plain(text)


def test_pieces_of_long_texts_agree(monkeypatch):
    text = " ".join(str(k % 97) for k in range(3000))
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "PIECE", 100)
    assert S.fingerprint(text) == whole == plain(text)


def test_components_against_all_pairs(docs, corpus):
    prints = {}
    for i, t, *_ in corpus:
        if i is not None:
            prints[i] = plain(t)
    want = classes(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = S.near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is not None:
            assert r.fp & (2**64 - 1) == prints[r.doc_id] and r.component_id == want[r.doc_id]


@pytest.mark.parametrize("block", [3, 4096])
def test_links_of_dense_groups(spark, block):
    rng = np.random.default_rng(0)
    base = int(rng.integers(0, 1 << 63))
    prints = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))} | {int(x) for x in rng.integers(0, 1 << 63, 60)}
    signed = [(p - (1 << 64) if p >> 63 else p, k) for k, p in enumerate(sorted(prints))]
    rows = spark.createDataFrame(signed, "fp long, rep long")
    edges = S.links(rows, 2, block)
    scratch = Scratch(spark, "test")
    got = {r.node: r.component for r in connected_components(edges, scratch).collect()}
    value = {k: p & (2**64 - 1) for p, k in signed}
    want = classes(value, lambda a, b: (value[a] ^ value[b]).bit_count() <= 2)
    assert {k: got.get(k, k) for k in value} == want


def test_components_of_chains_stars_and_loops(spark):
    rows = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


def test_one_of_each_component_stays(docs, clashing, none, corpus):
    kept = S.keep_one(docs).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    named = {r.doc_id: r.component_id for r in S.near_duplicates(docs).collect() if r.doc_id is not None}
    assert sorted(ids) == sorted(set(named.values()))
    assert sum(r.doc_id is None for r in kept) == 2
    assert S.keep_one(clashing).columns == clashing.columns and S.keep_one(clashing).count() == len(kept)
    assert S.near_duplicates(none).count() == S.keep_one(none).count() == 0
