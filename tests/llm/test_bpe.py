import hashlib
import random

import pytest
from tokenizers import Tokenizer

from tessella.llm import bpe as B
from tessella.llm.queries import _tokenizer

PATH = _tokenizer("byte_bpe_50k.json")
TEXTS = ["", " ", "a" * 3000, "<|endoftext|>" * 60, "x<|endoftext|> y" * 90, "日本語テキスト" * 150, "it's  we'll\n\n ok\t" * 80, " " * 900 + "x", "é" * 700, "12 345,6 " * 200, "🙂 a" * 200]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".", ",", "!\n"]) for _ in range(n))


def test_chunk_reuse_changes_nothing(reference):
    codec, rng = B.Codec.load(PATH), random.Random(1)
    for text in [*TEXTS, prose(1, 3000)]:
        for bits, least in ((10, 256), (4, 5), (2, 1)):
            raw, at, known = text.encode(), 0, {}
            saved, B.chunk_ends.__defaults__ = B.chunk_ends.__defaults__, (bits, least)
            try:
                for end in B.chunk_ends(raw):
                    if rng.random() < 0.7:
                        known[B._name(raw[at:end])] = codec.encode(raw[at:end].decode())
                    at = end
                ids = B.encode_with(codec, text, known)
            finally:
                B.chunk_ends.__defaults__ = saved
            assert ids == reference.encode(text, add_special_tokens=False).ids
            assert codec.decode(ids) == text


def test_chunks_follow_content():
    shared = prose(5, 2000)
    a, b = (x + shared for x in (prose(6, 40), prose(7, 90)))
    names = [{raw[s:e] for raw, s, e in B._chunks(t)} for t in (a, b)]
    assert len(names[0] & names[1]) >= len(names[0]) - 4


def test_query_form(spark, docs, corpus, reference):
    passage = prose(9, 1500)
    more = spark.createDataFrame([(1000 + k, prose(20 + k, 30) + " " + passage + " " + prose(40 + k, 30)) for k in range(12)] + [(2000 + k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    got = sorted(tuple(r) for r in B.digests(every, PATH).fillna(-1).collect())
    want = []
    for i, t in every.fillna(-1, "doc_id").collect():
        ids = reference.encode(t or "", add_special_tokens=False).ids
        text = reference.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)


def test_round_trip_and_empty(docs, none, clashing):
    ids = B.encode(docs, PATH)
    back = sorted(repr(tuple(r)) for r in B.decode(ids, PATH).collect())
    assert back == sorted(repr((r.doc_id, r.text or "")) for r in docs.select("doc_id", "text").collect())
    assert B.encode(none, PATH).count() == B.digests(none, PATH).count() == 0
    assert B.encode(clashing, PATH).count() == docs.count()


def test_other_vocabularies_use_the_library():
    path = _tokenizer("word_bpe_49k.json")
    codec, slow = B.Codec, Tokenizer.from_file(path)
    spec_plain = codec._plain
    import json

    spec = json.load(open(path, encoding="utf-8"))
    assert not spec_plain(spec, spec["model"]["vocab"], {x["content"]: x for x in spec["added_tokens"]})
    assert slow.encode("Hello", add_special_tokens=False).ids
