import os

from pyspark.sql import functions as F

from lexgrove.operators import hierarchy

NODES = "id string, parent string, n int"


def test_known_levels_are_folded_without_keeping_anything(spark):
    rows = [("a", None, 1), ("b", None, 0), ("a1", "a", 2), ("a2", "a", 1), ("b1", "b", 0), ("x", "a2", 3), ("y", "a2", 2)]
    frame = lambda r: spark.createDataFrame(r, NODES)
    shared = spark.sparkContext.getCheckpointDir() or hierarchy.kept(spark.range(1)) and spark.sparkContext.getCheckpointDir()
    before = sorted(os.listdir(shared.removeprefix("file:")))
    got = sorted(map(tuple, hierarchy.folded([frame(rows[:2]), frame([*rows[2:5], ("lost", "gone", 0)]), frame(rows[5:])], "id", "parent", ["n"], F.struct("id")).collect()))
    assert sorted(os.listdir(shared.removeprefix("file:"))) == before
    assert got == sorted(map(tuple, hierarchy.nested(frame(rows).repartition(3), "id", "parent", ["n"], F.struct("id")).collect()))
    assert got[0] == ("a", '{"id":"a","children":[{"id":"a2","children":[{"id":"y"},{"id":"x"}]},{"id":"a1"}]}')
