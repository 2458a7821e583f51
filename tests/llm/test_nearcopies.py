import random

import corpus_pipeline as P
import pytest

from tessella.llm import nearcopies as N
from tessella.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = N.normal(text).split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0


@pytest.fixture(scope="module")
def rows():
    """Texts with copies that have one to four words replaced, odd texts, and a large group."""
    rng = random.Random(5)
    texts = []
    for k in range(40):
        words = [f"w{rng.randrange(2000)}" for _ in range(rng.randint(60, 400))]
        for edits in (0, 1, 2, 3, 4):
            copy = list(words)
            for p in rng.sample(range(len(copy)), edits):
                copy[p] = f"n{k}e{edits}"
            texts.append(" ".join(copy))
    base = [f"g{k}" for k in range(200)]
    for k in range(150):
        texts.append(" ".join(base[:50] + [f"own{k}"] + base[51:]))
    texts += ["", None, "  \n", "one", "one", "One\t", "two words"]
    return [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + [(None, texts[0], None, None, 1)]


def stay(rows):
    """The smallest id of each component, by all pairs."""
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    low = {i: i for i in sets}
    near = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    for _ in range(len(near)):
        before = dict(low)
        for a, b in near:
            low[a] = low[b] = min(low[a], low[b])
        if before == low:
            break
    return {i for i in low if low[i] == i}


@pytest.mark.parametrize("block", [20, N.BLOCK])
def test_against_all_pairs(spark, rows, block):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = N.keep_one(df, block=block)
    assert got.columns == df.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(stay(rows)) and ids.count(None) == 1
    assert N.keep_one(df.limit(0)).count() == 0


def test_stage_removes_pairs_that_fingerprints_miss(spark, rows):
    rows = [r for r in rows if r[0] is not None and r[0] < 200]
    first = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    left = {r.doc_id for r in dict(P.STAGES)["near dedup"](spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert left == stay([r for r in rows if r[0] in first]) and len(left) < len(first)
