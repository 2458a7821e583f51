import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import sketch as S


def chain(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<Q", v), h)
    return h - 2**64 if h >= 2**63 else h


def hashes(text):
    w = [xxhash.xxh64_intdigest(x.encode(), 42) for x in re.split(r"[ \t-\r]+", (text or "").lower()) if x]
    return {chain(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {chain(w)} if w else set()


def likeness(a, b, k):
    union = sorted(set(a) | set(b))[:k]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


def test_edited_against_plain_python(docs, corpus):
    k = 20
    texts = sorted({(i, t or "") for i, t, *_ in corpus}, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    single = [r for r in texts if r[0] is not None]
    got = {r.doc_id: r for r in S.edited(docs, k=k).where("doc_id is not null").collect()}
    assert len(got) == len(single)
    assert S.edited(docs, k=k).count() == len(corpus)
    for at, (i, t) in enumerate(single[:-1]):  # the last is followed by the rows without an id
        nxt, half = single[at + 1][1], len(t) // 2
        e, r = t[: len(t) - half] + nxt[:half], got[i]
        assert (r.n_chars, r.edited_text) == (len(t), e)
        assert (r.sketch, r.edited_sketch, r.next_sketch) == tuple(sorted(hashes(x))[:k] for x in (t, e, nxt))


def test_one_document_follows_itself(spark):
    r = S.edited(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert r.edited_text == "abcabc" and r.sketch == r.next_sketch


def test_order_is_a_cycle_over_sparse_ids(spark):
    ids = [10**k for k in range(15)] + [-5, 0, 7, 8]
    rows = S.edited(spark.createDataFrame([(i, f"{i:020d}") for i in ids], "doc_id long, text string").repartition(7)).collect()
    order = sorted(ids, reverse=True)
    for r in rows:
        assert r.edited_text[10:] == f"{order[(order.index(r.doc_id) + 1) % len(order)]:020d}"[:10]


def test_estimates(spark):
    a = [chain([k]) for k in range(3000)]
    b = [chain([k]) for k in range(1500, 3500)]
    df = spark.createDataFrame([(sorted(a)[:400], sorted(b)[:400])], "a array<bigint>, b array<bigint>")
    r = df.select(S.resemblance(F.col("a"), F.col("b"), 400).alias("j"), S.containment(F.col("b"), F.col("a"), 400).alias("c"), S.distinct(F.col("a"), 400).alias("n")).first()
    assert abs(r.j - 1500 / 3500) < 0.08 and abs(r.c - 0.75) < 0.12 and abs(r.n / 3000 - 1) < 0.15
    small = spark.createDataFrame([([1, 2, 3], [2, 3, 4, 5], [])], "a array<bigint>, b array<bigint>, z array<bigint>")
    r = small.select(S.resemblance(F.col("a"), F.col("b")).alias("j"), S.containment(F.col("a"), F.col("b")).alias("c"), S.distinct(F.col("b")).alias("n"), S.resemblance(F.col("z"), F.col("z")).alias("e"), S.resemblance(F.col("z"), F.col("a")).alias("o")).first()
    assert (r.j, r.n, r.e, r.o) == (0.4, 4.0, 1.0, 0.0) and abs(r.c - 2 / 3) < 1e-12


@pytest.mark.parametrize("fan", [2, 64])
def test_parts_merge_to_the_whole(docs, fan):
    sketches = S.fingerprints(docs, k=16).join(docs.select("doc_id", "source"), "doc_id")
    got = {r.source: r.sketch for r in S.merge_groups(sketches, "source", k=16, fan=fan).collect()}
    want = {}
    for r in docs.where("doc_id is not null").collect():
        want.setdefault(r.source, set()).update(hashes(r.text))
    assert got == {k: sorted(v)[:16] for k, v in want.items()}


def test_empty_and_clashing(none, clashing, docs, corpus):
    assert S.edited(none).count() == S.fingerprints(none).count() == 0
    assert S.fingerprints(clashing).count() == len(corpus)
    assert S.edited(clashing).count() == S.edited(docs).count()
    text = S.edited(docs).select(F.sha2("edited_text", 256).alias("h")).collect()
    assert all(len(r.h) == len(hashlib.sha256().hexdigest()) for r in text)


def test_every_row_has_a_result(spark):
    low = -(2**63)
    rows = [(3, "a b c"), (3, "a b c"), (3, "otherwise"), (None, "n"), (None, "n"), (None, None), (low, "least"), (7, "x y")]
    got = S.edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in got) == sorted((i is not None, i or 0, len(t or "")) for i, t in rows)
    equal = [r for r in got if r.doc_id == 3 and r.n_chars == 5]
    assert len(equal) == 2 and equal[0] == equal[1]
    same = S.edited(spark.createDataFrame([(1, "abcd")] * 3, "doc_id long, text string")).collect()
    assert [r.edited_text for r in same] == ["abab"] * 3
