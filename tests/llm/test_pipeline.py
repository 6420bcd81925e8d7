import collections

import corpus_pipeline
from lexgrove.llm.common import materialise, table


def test_stages_in_turn(spark, sf):
    docs = table(spark, sf, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), "test")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert counts[0] >= counts[1] >= counts[2] > counts[3]
    rows = corpus_pipeline.run(spark, sf).collect()
    assert len(rows) == counts[-1]
    size = collections.Counter()
    for x in rows:
        size[x["sequence_id"]] += x["length"]
    assert all(n & (n - 1) == 0 and n <= 2048 for n in size.values())


def test_odd_and_empty_tables(spark, odd, nothing, tmp_path):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd), ("nothing", nothing)):
        path = str(tmp_path / name)
        docs.write.parquet(f"{path}/documents.parquet")
        labels.write.parquet(f"{path}/labels.parquet")
        rows = corpus_pipeline.run(spark, path).count()
        assert rows == 0 if name == "nothing" else rows > 0


def test_one_of_each_group_stays(spark, odd):
    left = corpus_pipeline.remove_near_duplicates(spark, odd, "").collect()
    ids = [x["doc_id"] for x in left if x["doc_id"] is not None]
    assert sorted(x for x in ids if ids.count(x) > 1) == [7, 7]  # two texts
    assert 100 in ids and not {101, 102} & set(ids)


def test_rows_of_one_doc_id_are_judged_each(spark):
    en, fr = "the ring of thing and other with hand ", "le mont de la eau ère ôté que les "
    rows = [(i, (en if i % 2 else fr) * 9, "en" if i % 2 else "fr", f"h{i % 2}", 0) for i in range(200)]
    rows += [(7, "中文字" * 60, None, "new", 0), (None, "中文字" * 60, None, "new", 0), (None, en * 9, "en", "h1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.identify_language(spark, docs, "").collect()
    assert len(left) == 201 and all("中" not in x["text"] for x in left)
