import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.llm import linededup as L


def plain(rows, width=7, similarity=0.8):
    """Text of each id after removal, by comparing all pairs of lines."""
    texts = {i: t for i, t, *_ in rows if i is not None}
    places = defaultdict(list)
    for i, t in texts.items():
        for p, line in enumerate((t or "").split("\n")):
            if key := L.normal(line):
                places[key].append((i, p))
    keys = sorted(places)
    sets = {k: L.shingles(k, width) for k in keys}
    up = {k: k for k in keys}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for n, a in enumerate(keys):
        for b in keys[:n]:
            shared = len(sets[a] & sets[b])
            if shared >= similarity * (len(sets[a]) + len(sets[b]) - shared):
                up[root(a)] = root(b)
    groups = defaultdict(list)
    for k in keys:
        groups[root(k)] += places[k]
    gone = {p for v in groups.values() for p in set(v) - {min(v)}}
    return {i: t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in texts.items()}


@pytest.fixture(scope="module")
def similar(spark):
    """Groups of near copies of lines among others."""
    rng = random.Random(6)
    line = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    rows = []
    for k in range(12):
        base = line(120)
        for _ in range(6):
            at = rng.randrange(110)
            rows.append((len(rows), base[:at] + rng.choice("xyz") + base[at + 1 :] + "\n" + line(90), None, "s", 0))
    return rows


@pytest.mark.parametrize("block", [2, 5, 512])
def test_against_all_pairs(spark, similar, corpus, block):
    rows = similar + [(10_000 + r[0], *r[1:]) for r in corpus if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    # Many bands: recall near enough to one for an exact comparison.
    got = {r.doc_id: r.clean_text for r in L.dedup_lines(df, bands=40, rows=3, block=block).collect()}
    assert got == plain(rows)


def test_recall_of_the_default_bands(spark, similar):
    df = spark.createDataFrame(similar, "doc_id long, text string, lang string, source string, n_chars long")
    want, got = plain(similar), {r.doc_id: r.clean_text for r in L.dedup_lines(df).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_signatures_do_not_depend_on_company():
    rng = random.Random(1)
    lines = ["".join(rng.choice("abc de") for _ in range(rng.randint(1, 60))).strip() or "x" for _ in range(200)] + ["y" * 5000, "é", "日本語"]
    signer = L._Signer(7, 5, 3)
    together = signer.keys(lines)
    assert all((signer.keys([x])[0] == k).all() for x, k in zip(lines, together))


def test_hashes_count_shingles():
    for line in ("a", "abcdefg", "abcdefgh", "aaaaaaaaaa", "日本語テキストです", "x" * 100 + "y"):
        assert len(L.shingle_sets([line], 7)[0]) == len(L.shingles(line, 7))


def test_shared_shingles_of_sets_and_arrays(monkeypatch):
    lines = ["ab", "ab\0", "a line of some length", "a line of that length", "short"]
    small = L.shingle_sets(lines, 7)
    monkeypatch.setattr(L, "_SET", 3)
    mixed = L.shingle_sets(lines, 7)
    for i, a in enumerate(lines):
        for j, b in enumerate(lines):
            want = len(L.shingles(a, 7) & L.shingles(b, 7))
            assert L._shared(small[i], small[j]) == L._shared(mixed[i], mixed[j]) == want


def test_forest_keeps_the_components():
    rng = random.Random(8)
    for _ in range(50):
        edges = [(bytes([rng.randrange(30)]), bytes([rng.randrange(30)])) for _ in range(rng.randrange(40))]
        star = L._forest(edges)
        reach = {bytes([k]): bytes([k]) for k in range(30)}
        for _ in range(30):
            for a, b in edges:
                reach[a] = reach[b] = min(reach[a], reach[b])
        assert dict(star) == {x: r for x, r in reach.items() if x != r}


def test_a_document_of_very_many_lines(spark):
    n = 1_000_000
    df = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("line "), i)), "\n").alias("text"))
    gone = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i % 3 > 0)
    got = df.select(L.without(F.col("text"), gone).alias("t")).first().t
    assert got == "\n".join(f"line {i}" for i in range(0, n, 3))
    rng = random.Random(6)
    lines = ["the line that is here again and again" if i % 2 else "".join(rng.choice("abcdefghijklmnop ") for _ in range(40)) for i in range(20_000)]
    again = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    r = L.dedup_lines(again).first()
    assert (r.n_lines, r.n_removed) == (20_000, 9_999)


def test_first_occurrence_stays(spark):
    rows = [(3, "Same line\nother"), (1, "b\nsame  LINE"), (2, "same line"), (2, "same line"), (None, "same line"), (4, None), (5, ""), (6, "\n \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_lines, r.n_removed, r.clean_text) for r in L.dedup_lines(df).fillna("-", "clean_text").collect())
    assert got == [(0, 1, 0, "same line"), (1, 2, 0, "b\nsame  LINE"), (2, 1, 1, ""), (2, 1, 1, ""), (3, 2, 1, "other"), (4, 0, 0, "-"), (5, 0, 0, ""), (6, 0, 0, "\n \n")]


def test_stage_keeps_columns(clashing, none, corpus):
    kept = L.keep_first(clashing)
    assert kept.columns == clashing.columns and kept.count() == len(corpus)
    assert all(r.n_chars is None or r.n_chars == len(r.text) for r in kept.collect())
    assert L.keep_first(none).count() == L.dedup_lines(none).count() == 0


def test_joins_beyond_the_broadcast_limit(spark, similar, monkeypatch):
    df = spark.createDataFrame(similar, "doc_id long, text string, lang string, source string, n_chars long")
    want = {r.doc_id: r.clean_text for r in L.dedup_lines(df).collect()}
    monkeypatch.setattr(L, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(L, "HOT", 2)
    assert {r.doc_id: r.clean_text for r in L.dedup_lines(df).collect()} == want
