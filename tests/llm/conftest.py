import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, dedup string, graded string, sig string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ru", "té", "Sa"]) for _ in range(r.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Null, empty, blank, one word, copies, near copies, shared passages, a long text, odd white space, marks."""
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    passage = prose(2, 60)
    return [
        None, "", " \n\t ", "word", "two words", base, base, near, base.upper(),
        prose(3, 40) + "\n" + passage + "\n" + prose(4, 30),
        prose(5, 10) + " " + passage,
        passage,
        "ha " * 90,
        "same line here\n" * 30,
        prose(6, 20_000),
        "a b\x1cc\x0bd e　f g\r\nh",
        "it's 12% #off# | <b> don't, 'll 3.5! <|endoftext|>",
        "x" * 5000,
        prose(7, 200),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """All texts with nulls in every column, a repeated row, a shared id, a null id, and columns of clashing names."""
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else "s", len(t or ""), "x", None, "y", "z", "q") for i, t in enumerate(texts)]
    rows += [rows[5], (3, prose(8, 70), "en", "s", 1, "x", "x", "x", "x", "x"), (None, texts[18], None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]
