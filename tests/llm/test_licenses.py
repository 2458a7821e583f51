import random
from functools import lru_cache

import pytest

from tessella.llm import licenses as L

FILL = "some other prose stands here and says nothing of the matter at all ".split()


def found(text, **how):
    return {license for license, *_ in L.Scanner(L.TEMPLATES, **how).scan(text)}


@pytest.mark.parametrize("name", list(L.TEMPLATES))
def test_each_template_is_found_whole_and_once(name):
    rng = random.Random(len(name))
    noise = lambda: " ".join(rng.choice(FILL) for _ in range(80))
    license, _, text = L.TEMPLATES[name]
    size = len(L.words(text))
    assert L.Scanner(L.TEMPLATES).scan(f"{noise()}\n{text}\n{noise()}") == [(license, name, 1.0, size, 80, 79 + size)]


@pytest.mark.parametrize("name", [n for n, t in L.TEMPLATES.items() if len(L.words(t[2])) > L.SHORT])
@pytest.mark.parametrize("between", [1, 4, 10, 60])
def test_notices_are_found_however_widely_spread(name, between):
    rng = random.Random(between)
    license, _, text = L.TEMPLATES[name]
    spread = " ".join(f"{w} {' '.join(rng.choice(['//', 'other', 'prose', 'stands', 'here']) for _ in range(between))}" for w in text.split())
    got = L.Scanner(L.TEMPLATES).scan(f"{' '.join(FILL)} {spread} {' '.join(FILL)}")
    assert [(p[0], p[1]) for p in got] == [(license, name)] and got[0][2] > 0.9  # "other" is a word of some templates
    assert got[0][2] == 1.0 or "other" in L.words(text)


def test_edits_up_to_the_coverage():
    rng, template = random.Random(2), L.words(L.TEMPLATES["GPL-3.0-notice"][2])
    for drop, want in ((4, True), (12, True), (30, False)):
        kept = sorted(rng.sample([k for k, w in enumerate(template) if w not in ("gnu", "3")], len(template) - drop - 4))
        kept = sorted({*kept, *(k for k, w in enumerate(template) if w in ("gnu", "3"))})
        text = []
        for k in kept:
            text += [template[k], *(["inserted"] if k % 17 == 0 else [])]
        assert ("GPL-3.0" in found(" ".join(FILL + text + FILL))) == want


def test_repeated_notices_are_separate_places():
    text = L.TEMPLATES["MIT-sentence"][2]
    places = L.Scanner(L.TEMPLATES).scan(" ".join([text] * 4))
    assert [(p[0], p[4], p[5]) for p in places] == [("MIT", 0, 4), ("MIT", 5, 9), ("MIT", 10, 14), ("MIT", 15, 19)]
    notice = L.TEMPLATES["ISC"][2]
    assert [p[2] for p in L.Scanner(L.TEMPLATES).scan(" some words between ".join([notice] * 3))] == [1.0] * 3


@pytest.mark.parametrize(
    "text,want",
    [
        ("Released under the BSD License.", set()),
        ("Released under the ISC License.", set()),
        ("Released under the Artistic License.", set()),
        ("Licensed under the Eclipse Public License, Version 2.0.", {"EPL-2.0"}),
        ("Licensed under the Mozilla Public License, Version 2.0.", {"MPL-2.0"}),
        ("Licensed under the Academic Free License, Version 2.0.", set()),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", {"LGPL-3.0"}),
        ("This work is licensed under the GNU Affero General Public License, version 3.", {"AGPL-3.0"}),
        ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
        ("This work is licensed under the GNU Free Documentation License, version 3.", set()),
        ("Licensed under CC BY-SA 4.0.", set()),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"CC-BY-SA-4.0"}),
    ],
)
def test_the_license_named_is_the_one_reported(text, want):
    assert found(text) == want and found(" ".join(FILL) + " " + text + " " + " ".join(FILL)) == want


def test_scan_against_every_stretch():
    rng = random.Random(12)
    chosen = {n: L.TEMPLATES[n] for n in ("MIT-sentence", "GPL-3.0-sentence", "LGPL-2.1-sentence", "EPL-2.0-notice", "ISC-terms")}
    hits = 0
    for _ in range(60):
        name = rng.choice(list(chosen))
        text = [w for w in L.words(chosen[name][2]) if rng.random() < rng.choice((0.75, 0.9, 1.0))]
        for _ in range(rng.randrange(12)):
            text.insert(rng.randrange(len(text) + 1), rng.choice([*FILL, "the", "license", "under"]))
        text = [*(rng.choice(FILL) for _ in range(5)), *text, *(rng.choice(FILL) for _ in range(5))]
        for other, template in chosen.items():
            scanner, words = L.Scanner({other: template}), L.words(template[2])
            want = False
            for i in range(len(text)):
                for j in range(i + scanner.least[other], len(text) + 1):
                    met = L.align(text[i:j], words)
                    near = len(words) > L.SHORT or (met and met[-1][0] - met[0][0] < len(words) * L.SPREAD + L.MORE)
                    want |= len(met) >= scanner.least[other] and bool(near) and scanner._named(other, met)
            assert bool(scanner.scan(" ".join(text))) == want, (other, text)
            hits += want
    assert hits > 20


def test_prose_and_mere_words_are_not_licenses():
    assert not found(" ".join(FILL * 200)) and not found("") and not found(None)
    assert not found("the license of MIT was released under pressure " + " ".join(FILL * 5))


def test_alignment_is_common_and_ascending():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 14))]
        b = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 14))]
        pairs = L.align(a, b)

        @lru_cache(None)
        def lcs(i, j):
            if i == len(a) or j == len(b):
                return 0
            return 1 + lcs(i + 1, j + 1) if a[i] == b[j] else max(lcs(i + 1, j), lcs(i, j + 1))

        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) <= lcs(0, 0)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert len(pairs) > 0 or not set(a) & set(b)


def test_anchors_of_distinct_words_are_longest():
    a, b = list("cabdefg"), list("abcdgef")
    assert len(L.align(a, b)) == 5


def test_query_form(docs, none, clashing, spark):
    text = "x " * 300 + L.TEMPLATES["Apache-2.0-sentence"][2] + " y" * 300
    more = spark.createDataFrame([(900, text), (900, text), (None, text)], "doc_id long, text string")
    rows = L.scan(docs.select("doc_id", "text").unionByName(more)).collect()
    assert sorted((r.doc_id or -1, r.license, r.first_word) for r in rows) == [(-1, "Apache-2.0", 300), (900, "Apache-2.0", 300), (900, "Apache-2.0", 300)]
    assert L.scan(none).count() == 0 and L.scan(clashing).count() == 0
