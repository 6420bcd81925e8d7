"""A repeated doc_id must not crowd the other class out of the training rows."""

from lexgrove.llm import quality


def test_a_repeated_bad_document_leaves_the_good_ones(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 20)
    rows = [(i, f"some words of number {i} and more of them" if i % 2 else f"BUY!! NOW {i}!! $$$ CHEAP!!") for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows + [(i, f"BUY!! NOW {i} {j}!! $$$") for i in range(0, 80, 2) for j in range(20)], "doc_id long, text string")
    got = quality.score(docs, labels).collect()
    assert all(x["predicted"] == x["doc_id"] % 2 for x in got)
    assert len(got) == 880
