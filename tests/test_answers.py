"""Configuration, dumps that may be missing, publication, and the gates around a build."""

import json

import pytest
from pyspark.sql import functions as F

from lexgrove.operators import evidence, gates
from lexgrove.plans import requirements
from lexgrove.sources import config


def test_prompts_settings_and_constraints(tmp_path):
    (tmp_path / "judge_v2.md").write_text("Judge this.")
    text, sha = config.prompt(str(tmp_path), "judge", "v2")
    assert text == "Judge this." and len(sha) == 64
    record = "# of record\njudge:\n  model: a-1\n  prompt: 'v2'\nseed: 7\n"
    assert config.settings(record, ("judge.model", "judge.prompt", "seed")) == {"judge.model": "a-1", "judge.prompt": "v2", "seed": "7"}
    with pytest.raises(ValueError, match="judge.top"):
        config.settings(record, ("judge.top",))
    assert config.constraints("// all\nCREATE a;\n\nCREATE b; // second") == ["CREATE a", "CREATE b"]
    config.guarded({"model": "a"}, {"model": "a"}, {"LIVE": "1"}, "LIVE")
    with pytest.raises(PermissionError):
        config.guarded({}, {}, {}, "LIVE")
    with pytest.raises(ValueError):
        config.guarded({"model": "a"}, {"model": "b"}, {"LIVE": "1"}, "LIVE")


def test_a_dump_that_is_missing_or_broken_is_none(spark, tmp_path):
    (tmp_path / "ok.json").write_text(json.dumps({"nodes": ["a"]}))
    (tmp_path / "bad.json").write_text("{nodes: [")
    assert config.dump(spark, str(tmp_path / "ok.json"), "nodes array<string>").first()["nodes"] == ["a"]
    assert config.dump(spark, str(tmp_path / "bad.json"), "nodes array<string>") is None
    assert config.dump(spark, str(tmp_path / "none.json"), "nodes array<string>") is None


def test_tags_and_decisions(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("# DEC-01 and DEC-02\n# DEC-01\n")
    (tmp_path / "src" / "b.txt").write_text("DEC-09")
    assert {(x["tag"], x["n"]) for x in config.tags(spark, str(tmp_path / "src"), "DEC-[0-9]+").collect()} == {("DEC-01", 2), ("DEC-02", 1)}
    path = str(tmp_path / "decisions.json")
    config.write_decisions(spark.createDataFrame([("b", "accepted"), ("a", "rejected")], "item_id string, decision string"), path)
    assert list(json.load(open(path))) == ["a", "b"]


def test_what_is_published_stays_until_the_next_build_is_whole(spark, tmp_path):
    path, none = str(tmp_path / "graph"), spark.createDataFrame([], "gate string, id string")
    assert gates.publish(spark.range(3), none, path) == 3
    broken = spark.range(5).withColumn("x", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        gates.publish(broken, none, path)
    with pytest.raises(ValueError, match="G1"):
        gates.publish(spark.range(5), spark.createDataFrame([("G1", "n")], "gate string, id string"), path)
    assert gates.published(spark, path).count() == 3
    assert gates.publish(spark.range(7), none, path) == 7 and gates.published(spark, path).count() == 7


def test_release(spark, tmp_path):
    schema = "id string, judge_verdict string, review_status string, source_evidence_span_ids array<string>, target_evidence_span_ids array<string>"
    rows = spark.createDataFrame([("a", "accepted", "x", ["s"], ["t"]), ("b", "accepted", "x", ["s"], [])], schema)
    decide = lambda x: spark.createDataFrame([("b", x)], "item_id string, decision string")
    edges, chain = spark.createDataFrame([("b1",), ("b0",)], "build_id string"), spark.createDataFrame([("norms", "00"), ("graph", "11")], "role string, sha string")
    with pytest.raises(ValueError, match="G4"):
        gates.release(rows, decide("accepted"), edges, chain, str(tmp_path / "a"), "b1")
    got = gates.release(rows, decide("rejected"), edges, chain, str(tmp_path / "b"), "b1").collect()
    assert {x["gate"]: x["n"] for x in got} == {"P1": 0, "P2": 0, "P3": 0, "P4": 0, "P5": 1} and len({x["chain_id"] for x in got}) == 1


def test_body_gates(spark):
    rows = [(0, "ARTICLE", {}, []), (1, "PARAG", {"IDENTIFIER": "006.002"}, ["ARTICLE"]), (2, "PARAG", {"IDENTIFIER": "6.2"}, ["ARTICLE"]), (3, "PARAG", {"IDENTIFIER": "007.001"}, ["ARTICLE"]), (4, "NP", {}, ["ARTICLE"]), (5, "NP", {}, ["ARTICLE", "PARAG"]), (6, "ARTICLE", {}, ["QUOT.S"])]
    elems = spark.createDataFrame(rows, "elem int, tag string, attrs map<string,string>, tags array<string>")
    known = spark.createDataFrame([("r:article-6:paragraph-2",)], "id string")
    assert {tuple(x) for x in gates.body_gates(elems, known, "r", 1).collect()} == {("identifier", "6.2"), ("paragraph", "r:article-7:paragraph-1"), ("stray_point", "4")}
    assert ("articles", "1") in {tuple(x) for x in gates.body_gates(elems, known, "r", 113).collect()}


def test_a_status_outside_the_vocabulary_is_an_error(spark):
    with pytest.raises(Exception, match="no such status"):
        spark.range(1).select(evidence.envelope(F.lit("x"), F.lit("fine"), "g").alias("e")).collect()
    got = spark.range(1).select(evidence.envelope(F.lit("x"), F.lit("applicable"), "g").alias("e")).first()["e"]
    assert len(got) == 12 and got["source_nodes"] == [] and got["generated_at"].endswith("+00:00")


def test_actors(spark):
    names = {
        "providers of high-risk AI systems": "provider", "the deployers of such general-purpose AI models, where needed": "deployer", "European Commission": "commission", "that system": None, "office": None, "": None,
        "Notified Bodies": "notified_body", "an importer,": "importer", "operators of the market": None, "the": None, None: None,
    }
    rows = spark.createDataFrame([(x,) for x in names], "raw string").withColumn("x", requirements.canonical_actor(F.col("raw"))).select("raw", "x.actor", "x.method").collect()
    assert {x["raw"]: x["actor"] for x in rows} == names
    assert {x["raw"]: x["method"] for x in rows}["office"] == "ambiguous" and {x["raw"]: x["method"] for x in rows}[None] == "empty"
