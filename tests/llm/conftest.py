import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(rows, extra=()):
    return [(i, t, lang, src, len(t) if t is not None else None, *extra) for i, t, lang, src in rows]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, and repeated rows."""
    r = random.Random(5)
    word = lambda: "".join(r.choice(("the", "on", "ti", "ré", "Sh", "ing", "é", "or")) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    base = text(120)
    rows = [(i, text(r.randint(1, 150)), "en", f"src{i % 3}") for i in range(40)]
    rows += [(100, base, "en", "src0"), (101, base, "fr", "src0"), (102, base.replace(" ", "\n", 3), "en", "src1"), (103, base + " one", None, "src2")]
    rows += [(104, "", "en", "src0"), (105, None, "en", None), (106, " \n\t ", None, None), (107, "word", "xx", "src1"), (108, "a b", "en", "src1")]
    rows += [(109, text(30_000), "en", "src0"), (110, "x" * 300_000, "en", "src2"), (111, "é中\U0001f600 <|endoftext|>  \x00 it's", "de", "src2")]
    rows += [(100, base, "en", "src0"), (7, "another text of seven", "en", "src1"), (None, base, "en", "src0"), (None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """With columns that have the names the operators use within."""
    names = ["_row", "size", "cls", "node", "part", "taken", "held", "score", "_h", "count", "label", "target", "_times", "a.b"]
    return spark.createDataFrame(make(odd_rows, range(len(names))), DOCS + "".join(f", `{x}` long" for x in names)).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
