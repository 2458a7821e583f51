import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, SCHEMA + extra)


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and long texts, copies, near copies, repeated rows and common lines."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]

    def prose(n):
        out = []
        while n > 0:
            k = min(n, rng.randint(4, 14))
            out.append(" ".join(rng.choice(vocabulary) for _ in range(k)))
            n -= k
        return "\n".join(out)

    texts = [prose(rng.randint(1, 160)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[7] + " tail", texts[9].replace("a", "A", 2), "", None, "   \n\t ", "one", "two words", prose(6000)]
    texts += ["Shared line of every page here\n" + prose(60) for _ in range(80)]
    rows = [(k, t, "en" if k % 3 else None, None if k % 11 == 0 else f"s{k % 2}", len(t) if t is not None else None) for k, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "a text without an id", None, None, 20), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return frame(spark, corpus).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def clashing(spark, corpus):
    """The corpus with further columns named as operators name theirs."""
    names = ["words", "host", "common", "fp", "component_id", "gone", "row", "tile", "score", "key", "line", "kept", "bucket"]
    return frame(spark, [(*r, *range(len(names))) for r in corpus], "".join(f", {n} int" for n in names))
