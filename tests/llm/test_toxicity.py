import random

import numpy as np
import pytest

from tessella.llm import toxicity as T
from tessella.llm.queries import QUERIES

BAD = ["scoundrel", "blockhead", "rotter"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice(["an", "ter", "ing", "ou", "st", "re", "lo", "mi"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for k in range(600):
        words = [rng.choice(vocabulary) for _ in range(60)]
        if k % 6 == 0:
            for _ in range(2):
                words.insert(rng.randrange(60), rng.choice(BAD))
        rows.append((k, " ".join(words), int(k % 6 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


@pytest.fixture(scope="module")
def model(labelled):
    return T.fit(labelled.select("doc_id", "text"), labelled.where("doc_id % 4 <> 2").select("doc_id", "toxic"))


def test_held_out_rows(labelled, model):
    rows = T.score(labelled, model).join(labelled, "doc_id").where("doc_id % 4 = 2").collect()
    assert all((r.score >= 0.3) == bool(r.toxic) for r in rows)


@pytest.mark.parametrize("form", ["sc0undr3l", "s c o u n d r e l", "scoundrellll", "$coundrel", "b.l.o.c.k.h.e.a.d", "bl0ckhe@d", "r-o-t-t-e-r", "r0tt3r!!", "blooockhead"])
def test_disguises(spark, model, form):
    clean = " ".join(["an", "tering", "oust", "relo"] * 12)
    rows = [(1, f"{clean} {form} {clean} {form}"), (2, clean)]
    a, b = (r.score for r in T.score(spark.createDataFrame(rows, "doc_id long, text string"), model).orderBy("doc_id").collect())
    assert a >= 0.3 > b


def test_viterbi_finds_the_best_path(model):
    def paths(steps):
        if not steps:
            return [("", 0.0)]
        return [(p + q, c + d) for p, c in steps[0] for q, d in paths(steps[1:])]

    def cost(text):
        total, a, b = 0.0, 0, 0
        for c in [*text, " "]:
            z = T._class(c)
            if z == 0 and b == 0:
                continue
            total += float(model.chars[a, b, z])
            a, b = b, z
        return total

    for token in ("sc0und", "b1ad", "aa@b", "r.o.t"):
        best = max(cost(p) - c for p, c in paths(T.lattice(token)))
        found = T.restore(token, model.chars)
        assert abs(max(cost(p) - c for p, c in paths(T.lattice(token)) if p == found) - best) < 1e-4


def test_trigrams_cover_every_text(spark):
    df = spark.createDataFrame([("ab c",), (None,), ("",), ("Éあx",)], "text string").repartition(3)
    counts = T.trigram_counts(df)
    a, b, c = (T._class(x) for x in "abc")
    assert counts[0, 0, a] == 1 and counts[a, b, 0] == 1 and counts[b, 0, c] == 1
    assert counts.sum() == 5 + 4


def test_nulls_empty_and_no_labels(docs, none, clashing, corpus, spark):
    bare = T.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    rows = T.score(docs, bare).collect()
    assert len(rows) == len(corpus) and len({r.score for r in rows}) == 1 and all(0 <= r.score <= 1 for r in rows)
    nulls = spark.createDataFrame([(None, 1), (3, None), (4, 0)], "doc_id long, toxic int")
    assert T.score(none, T.fit(none, nulls)).count() == 0
    kept = T.keep_civil(clashing, bare, limit=0.9)
    assert kept.columns == clashing.columns and kept.count() == len(corpus)


def test_fit_separates_on_features():
    rows = [([0, 1], 1)] * 20 + [([1], 0)] * 60 + [([], 0)] * 20
    w, b = T._fit(rows, 2)
    p = lambda *a: 1 / (1 + np.exp(-(b + sum(w[k] for k in a))))
    assert p(0, 1) > 0.8 and p(1) < 0.1 and p() < 0.2


def test_query(spark, data):
    rows = QUERIES["op5_toxicity"](spark, data).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


@pytest.mark.parametrize("form", ["s,c,o,u,n,d,r,e,l", "r/o/t/t/e/r", "r\\o\\t\\t\\e\\r", "b'l'o'c'k'h'e'a'd", "r`o`t`t`e`r", "(oundrel", "#eadblock", "|diot", "idio+", "s  c  o  u  n  d  r  e  l", "r\no\nt\nt\ne\nr", "r \t o t\n\nt e r"])
def test_gate_lets_through_what_the_lattice_reads(model, form):
    word = {"(oundrel": "coundrel", "#eadblock": "headblock", "|diot": "idiot", "idio+": "idiot"}.get(form) or "".join(c for c in form if c.isalpha())
    chars = model.chars + 0
    # Sequences of this word are made likely, so that the reading depends on the gate alone.
    for a, b, c in zip(" " + word, word, word[1:] + " "):
        chars[T._class(a), T._class(b), T._class(c)] = -0.1
    chars[0, 0, T._class(word[0])] = -0.1
    assert f"{word}$" in T._Reader(chars)(f"and {form} ing")


@pytest.mark.parametrize("sign", list(T.LEET))
def test_every_sign_is_let_through_at_any_position(sign):
    for token in (f"{sign}ord", f"wor{sign}", f"w{sign}rd", f"'{sign}ord,"):
        assert T._SUSPECT.search(token)
