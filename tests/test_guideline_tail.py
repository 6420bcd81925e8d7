from lexgrove.sources import guideline


def test_a_last_section_is_whole_where_nothing_follows_it(spark):
    text = "".join(f"1.{i} Name {i}\nFirst.\n\n" for i in range(1, 8)) + "".join(f"Topic {x}{y}. Supplier is meant. More of it.\n" for x in "abcdefghijklmnopqrst" for y in "abcdefghij")
    texts = spark.createDataFrame([("g", text)], "file string, text string")
    assert guideline.subtopics(texts, None)[0].count() == 200
    assert guideline.subtopics(texts)[0].count() < 200
