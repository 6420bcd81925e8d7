import json
import os
import time

from pyspark.sql import functions as F

from lexgrove.functions.text import normalised
from lexgrove.operators import joins
from lexgrove.sources import files
from lexgrove.streaming import joins as stream_joins
from lexgrove.streaming import limits, logs


def test_the_last_record_counts_over_many_splits_and_files(spark, tmp_path):
    line = lambda item, text: json.dumps({"strategy": "s", "item_id": item, "answer_text": text})
    (tmp_path / "b.jsonl").write_text("\n".join(line(f"i{n % 7}", f"old {n}") for n in range(3000)))
    time.sleep(0.05)
    (tmp_path / "a.jsonl").write_text("\n\n".join(line(f"i{n % 5}", f"new {n}") for n in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = files.results(spark, str(tmp_path))
        assert logs.ordered(spark, str(tmp_path), "item_id string").rdd.getNumPartitions() > 40
        assert {x["item_id"]: x["answer_text"] for x in found.collect()} == {**{f"i{n}": f"new {1995 + n}" for n in range(5)}, "i5": "old 2994", "i6": "old 2995"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, n int, v string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    write([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")])
    run = lambda: logs.append_batches(spark.readStream.schema(schema).parquet(source), sink, str(tmp_path / "cp"), ["k"], ["n"])
    run()
    write([("b", 0, "late but last"), ("c", 5, "w")])
    run()
    read = lambda: sorted((x["k"], x["v"]) for x in logs.merged(spark, sink, ["k"]).collect())
    want = [("a", "y"), ("b", "late but last"), ("c", "w")]
    assert read() == want
    logs.merge_batch(spark.createDataFrame([("b", 0, "late but last"), ("c", 5, "w")], schema), 1, sink, ["k"], ["n"])
    logs.merge_batch(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], schema), 0, sink, ["k"], ["n"])
    assert read() == want and sorted(x for x in os.listdir(sink) if x.startswith("batch")) == ["batch=0", "batch=1"]


CALLS = "id int, user string, ts timestamp"


def test_streams_join_as_tables_do_and_drop_what_is_late(spark, tmp_path):
    at = lambda minute: f"2024-01-01 00:{minute:02d}:00"
    frame = lambda rows: spark.createDataFrame(rows, "id int, user string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    left, right = [(1, "u", at(0)), (2, "v", at(5)), (3, "u", at(20))], [(11, "u", at(4)), (12, "v", at(4)), (13, "u", at(11)), (14, "u", at(25)), (15, None, at(0))]
    for name, rows in (("l", left), ("r", right)):
        frame(rows).coalesce(1).write.parquet(str(tmp_path / name))
    join = lambda a, b, late: stream_joins.interval_join(a, b, ["user"], "ts", "ts", "10 minutes", late).select("id", "user", "r_id")
    table = sorted(map(tuple, join(frame(left), frame(right), None).collect()))
    stream = lambda n: spark.readStream.schema(CALLS).parquet(str(tmp_path / n))

    def run():
        join(stream("l"), stream("r"), "1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))

    assert table == [(1, "u", 11), (3, "u", 14)] and run() == table
    frame([(4, "u", at(59))]).coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
    frame([(16, "w", at(59))]).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    assert run() == table  # the watermark is at 58 minutes now
    frame([(17, "u", at(2))]).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    assert run() == table


def test_a_counter_closes_its_windows(spark, tmp_path):
    schema = "user string, ts timestamp"
    source, out = str(tmp_path / "in"), []

    def put(rows):
        spark.createDataFrame(rows, "user string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)

    def run():
        counted = limits.counted(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "ts", "user")
        query = counted.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, _: out.extend(tuple(x) for x in b.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else None

    put([("a", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:00:09"), (None, "2024-01-01 00:00:30")])
    run()
    assert sorted((x[0], x[1].minute, x[2], x[3]) for x in out) == [("a", 0, 2, False), ("anonymous", 0, 1, False)]
    out.clear()
    put([("a", "2024-01-01 00:01:05")])
    run()
    got = sorted((x[0], x[1].minute, x[2], x[3]) for x in out)
    assert ("a", 0, 2, True) in got and ("a", 1, 1, False) in got
    out.clear()
    put([("a", "2024-01-01 00:00:20"), ("b", "2024-01-01 00:09:00")])  # a's minute is over
    put([("c", "2024-01-01 00:30:00")])
    left = run()
    closed = {(x[0], x[1].minute, x[2]) for x in out if x[3]}
    assert {("anonymous", 0, 1), ("a", 1, 1), ("b", 9, 1)} - closed <= {("anonymous", 0, 1)} and not any(x[0] == "a" and x[1].minute == 0 for x in out) and left == 1


def test_first_match_and_order(spark):
    rows = spark.createDataFrame([("g", "x", 3), ("g", "y", 1), ("g", "x", 0), ("g", "z", 2), ("h", None, 1)], "g string, v string, n int")
    got = sorted((x["g"], x["place"], x["v"], x["total"]) for x in joins.distinct_in_order(rows, "g", "v", ["n"], 2).collect())
    assert got == [("g", 1, "x", 3), ("g", 2, "y", 3), ("h", 1, None, 1)]
    one, two = spark.createDataFrame([("x", 1), ("x", 0)], "id string, a int"), spark.createDataFrame([("x", 9), ("y", 7)], "id string, a int")
    asked = spark.createDataFrame([("x",), ("y",), ("q",)], "id string")
    got = {x["id"]: (x["source"], x["a"]) for x in joins.first_match(asked, [("one", one), ("two", two)], "id", ["a"]).collect()}
    assert got == {"x": ("one", 0), "y": ("two", 7), "q": (None, None)}


def test_normalised(spark):
    cases = {" Health­Care ": "healthcare", "ＬＡＷ​": "law", "Straße": "strasse", "ﬁn²": "fin2", "　​": None, "": None, "İ": "i̇", "рolice": "рolice"}
    got = spark.createDataFrame([*((x,) for x in cases), (None,)], "x string").select("x", normalised(F.col("x")).alias("y")).collect()
    assert {x["x"]: x["y"] for x in got} == {**cases, None: None}
