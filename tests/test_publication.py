import concurrent.futures
import os

import pytest
from pyspark.sql import functions as F

from lexgrove.operators import gates, publication


def none(spark):
    return spark.createDataFrame([], "gate string, id string")


def test_versions_and_two_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "p")
    assert publication.current(spark, path) is None
    with concurrent.futures.ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda i: publication.publish({"a": spark.range(i + 1), "b": spark.range(2)}, none(spark), path), range(6)))
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    for i, version in enumerate(got):
        assert publication.read(spark, path, "a", version).count() == i + 1
    assert publication.current(spark, path)["version"] == 6 and publication.current(spark, path)["tables"]["b"] == 2


def test_a_failed_or_half_written_build_is_never_seen(spark, tmp_path):
    path = str(tmp_path / "p")
    publication.publish({"a": spark.range(3)}, none(spark), path)
    with pytest.raises(Exception, match="broken"):
        publication.publish({"a": spark.range(3), "b": spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))}, none(spark), path)
    (tmp_path / "p" / "versions" / "000000000002.json").write_text('{"version": 2, "build": "nowhere"')  # its writer died
    assert publication.current(spark, path)["version"] == 1 and gates_count(spark, path) == 3
    assert publication.publish({"a": spark.range(4)}, none(spark), path) == 3 and gates_count(spark, path) == 4
    os.utime(tmp_path / "p" / "versions" / "000000000001.json", None)  # times don't matter
    assert gates_count(spark, path) == 4
    with pytest.raises(ValueError, match="nothing is published"):
        publication.read(spark, str(tmp_path / "q"), "a")


def gates_count(spark, path):
    return publication.read(spark, path, "a").count()


NORMS = "norm_id string, source_span_id string, source_node_id string, judge_run_id string, judge_verdict string, review_status string, condition_ids array<string>, exception_ids array<string>"
ALIGNED = "id string, source_norm_id string, target_id string, mapping_run_id string, judge_run_id string, judge_verdict string, review_status string, source_evidence_span_ids array<string>, target_evidence_span_ids array<string>"


def test_layers_are_released_together(spark, tmp_path):
    base = spark.createDataFrame([("art", "Article", 1), ("hleg", "Requirement", 3), ("run", "JudgeRun", 2), ("c1", "Condition", 2)], "id string, type string, layer int")
    norms = spark.createDataFrame([("norm:1", "s1", "art", "run", "accepted", "auto", ["c1", "c-missing"], None), ("norm:2", None, "art", "run", "accepted", "auto", None, None)], NORMS)
    aligned = spark.createDataFrame([("align:1", "norm:1", "hleg", "map", "run", "accepted", "auto", ["s1"], ["t1"])], ALIGNED)
    chain = spark.createDataFrame([("norms", "00")], "role string, sha string")
    decide = lambda *x: spark.createDataFrame([*x], "item_id string, decision string")
    path = str(tmp_path / "r")
    with pytest.raises(ValueError, match="G3"):
        publication.release_layers(base, norms, aligned, decide(), chain, path, "b1")
    with pytest.raises(ValueError, match="no such item"):
        publication.release_layers(base, norms, aligned, decide(("norm:9", "rejected")), chain, path, "b1")
    assert publication.current(spark, path) is None
    got = publication.release_layers(base, norms, aligned, decide(("norm:2", "rejected"), ("align:1", "accepted")), chain, path, "b1").collect()
    assert {x["gate"]: x["n"] for x in got} == {"P1": 0, "P2": 0, "P3": 0, "P4": 0, "P5": 0} and {x["version"] for x in got} == {1}
    edges = {(x["src"], x["edge_type"], x["dst"]) for x in publication.read(spark, path, "edges").collect()}
    assert edges == {
        ("norm:1", "DERIVED_FROM", "art"), ("norm:1", "JUDGED_BY", "run"), ("norm:1", "HAS_CONDITION", "c1"), ("norm:2", "DERIVED_FROM", "art"), ("norm:2", "JUDGED_BY", "run"),
        ("align:1", "ASSERTS_ALIGNMENT_OF", "norm:1"), ("align:1", "ASSERTS_ALIGNMENT_TO", "hleg"), ("align:1", "JUDGED_BY", "run"),
    }
    assert {x["norm_id"]: x["review_status"] for x in publication.read(spark, path, "norms").collect()} == {"norm:1": "auto", "norm:2": "human_reviewed"}
    assert publication.read(spark, path, "nodes").count() == 3 and gates.publish(spark.range(2), none(spark), path) == 2
