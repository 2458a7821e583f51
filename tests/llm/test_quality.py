from collections import Counter, defaultdict

from tessella.llm import quality as Q
from tessella.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"


def split(text):
    out, word = [], ""
    for c in text + " ":
        if c in SPACE:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def plain(rows, min_docs=20, share=0.1):
    texts = defaultdict(set)
    for _, t, _, s, _ in rows:
        texts[s].add(t or "")
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in " ".join(split(line)))
    common = {}
    for s, held in texts.items():
        n = Counter(k for t in held for k in {key(x) for x in t.split("\n") if split(x)})
        common[s] = {k for k, c in n.items() if c > min_docs and c > share * len(held)}
    for i, t, _, s, _ in rows:
        t = t or ""
        w, lines = split(t), [x for x in t.split("\n") if split(x)]
        at = defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        repeat = len({p + d for v in at.values() if len(v) > 1 for p in v for d in range(3)})
        failed = len(w) < 50 or 100 * repeat > 50 * len(w)
        left = sum(len(split(x)) for x in lines if key(x) not in common[s])
        clean = "\n".join(x for x in t.split("\n") if not split(x) or key(x) not in common[s])
        yield (i, len(w), sum(map(len, w)), sum(c in Q.SYMBOLS for c in t), len(lines) - len(set(lines)), repeat, failed, left, clean, not failed and left >= 0.5 * len(w))


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_against_plain_python(docs, corpus):
    assert order(Q.assess(docs, with_text=True).collect()) == order(plain(corpus))
    assert any(r[7] != r[1] for r in plain(corpus)), "the corpus has common lines"


def test_depleted_documents_go(spark):
    line = "The same words stand here on every page of this host again and again. " * 5
    rows = [(k, f"{line}\nown {k}", "en", "h", 1) for k in range(40)] + [(k, " ".join(f"w{k}x{j}" for j in range(60)), "en", "h", 1) for k in range(40, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.kept for r in Q.assess(df, repeat_percent=100).collect()}
    assert not any(got[k] for k in range(40)) and all(got[k] for k in range(40, 60))
    copies = df.selectExpr("doc_id", "if(doc_id < 40, repeat('a b c d e f ', 10), text) text", "lang", "source", "n_chars")
    assert all(r.kept for r in Q.assess(copies, repeat_percent=100).collect()), "copies of one text count once"


def test_repeats_ties_and_windows(spark):
    for text in ("a a a a", "a b c a b c", "a b c d a b c", "a b", "a b c", "x y x y x y z", "a b c x a b c y a b c"):
        got = Q.assess(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
        (want,) = plain([(1, text, None, "s", 0)])
        assert got.n_repeat_words == want[5], text


def test_stage_keeps_columns(clashing, none, docs):
    kept = Q.keep_good(clashing)
    assert kept.columns == clashing.columns and kept.count() == Q.assess(docs).where("kept").count()
    assert all(r.n_chars == len(r.text) for r in kept.collect())
    assert Q.assess(none).count() == Q.keep_good(none).count() == 0


def test_query(spark, data):
    assert QUERIES["op10_quality"](spark, data).count() == spark.read.parquet(f"{data}/documents.parquet").count()


def test_limit_does_not_grow_with_the_host(spark, monkeypatch):
    """A line in 15 of 400 texts, another in five of a host's 20, one in three of them."""
    import corpus_pipeline as P

    prose = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(k, ("Shared here\n" if k < 15 else "") + prose(k), "en", "large", 1) for k in range(400)]
    rows += [(400 + k, ("Shared there\n" if k < 5 else "A line of three\n" if k < 8 else "") + prose(400 + k), "en", "small", 1) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    for bound in (Q.BROADCAST_ROWS, 0):
        monkeypatch.setattr(Q, "BROADCAST_ROWS", bound)
        got = {r.doc_id: r.text for r in P.quality_rules(spark, df, "").collect()}
        assert len(got) == 420 and not any("Shared" in t for t in got.values())
        assert sum("A line of three" in t for t in got.values()) == 3
    assert all(r.n_left == r.n_words for r in Q.assess(df).collect())
