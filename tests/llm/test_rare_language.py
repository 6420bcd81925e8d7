"""A language of few rows is a class however large the table is."""

from lexgrove.llm import language


def test_a_rare_language_in_a_large_table(spark):
    en, fr = "the ring of thing and other with hand ", "le mont de la eau ère ôté que les "
    rows = [(i, en * 2, "en", "h") for i in range(9_990)] + [(10_000 + i, fr * 10, "fr", "h") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = {x["doc_id"]: (x["language"], x["kept"]) for x in language.documents(docs).filter("doc_id >= 9980").collect()}
    assert got == {i: ("en", True) for i in range(9_980, 9_990)} | {10_000 + i: ("fr", True) for i in range(6)}


def test_many_declared_values(spark, monkeypatch):
    monkeypatch.setattr(language, "HELD", 2)
    words = [("".join(chr(97 + (i * 7 + j * 3 + k) % 26) for k in range(5)) + " ") for i in range(40) for j in range(1)]
    rows = [(i, words[i % 40] * 60, f"l{i % 40:02}", f"h{i % 40}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)
    names, logs = language.learn(docs.selectExpr("text", "lang as declared"))
    assert len(names) == 40 and logs.shape == (41, language.BUCKETS)
