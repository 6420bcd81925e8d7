import itertools
import json

import pytest
from pyspark.sql import functions as F

from lexgrove.operators import model
from lexgrove.plans import tools
from lexgrove.sinks import files as sinks
from lexgrove.streaming import metering


@pytest.fixture()
def keep(spark, tmp_path):
    n = itertools.count()

    def write(df):
        path = str(tmp_path / f"kept-{next(n)}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    return write


SCORES = {x: 1.0 for x in model.DIMENSIONS}
ACCEPT = json.dumps({"verdict": "accepted", "scores": SCORES | {"completeness": 7}, "rationale": "fine"})


def test_norms_and_alignments(spark, keep):
    norms_reply = "```json\n" + json.dumps({"norms": [{"deontic_type": "obligation", "action": "keep logs", "conditions": ["if"]}, {"deontic_type": "bogus"}, {"deontic_type": "obligation", "actor_inferred": "provider"}]}) + "\n```"
    units = spark.createDataFrame([("r:article-9:paragraph-1", "Providers shall keep logs"), ("r:article-10", "nothing")], "id string, text string")
    norms = model.extract_norms(units, lambda: model.ScriptedClient([("keep logs", norms_reply)], "not json"), lambda: model.ScriptedClient([], ACCEPT), ("g", "j"), keep)
    rows = norms.collect()
    assert [(x["norm_id"], x["judge_verdict"], x["final_score"]) for x in rows] == [("norm:article-9:paragraph-1:n1", "accepted", 1.0)]
    reply = json.dumps({"alignments": [
        {"target_id": "t:1", "relation_type": "supports", "source_quote": "keep  logs", "target_quote": "traceable"}, {"target_id": "t:9", "relation_type": "supports", "source_quote": "keep", "target_quote": "x"},
        {"target_id": "t:1", "relation_type": "supports", "source_quote": "made up", "target_quote": "traceable"}, {"target_id": "t:1", "relation_type": "supports", "source_quote": "keep", "target_quote": "traceable"},
    ]})
    targets = spark.createDataFrame([("t:1", "systems should be traceable")], "id string, description string")
    got = model.align(norms.withColumn("source_text", F.col("text")), targets, lambda: model.ScriptedClient([], reply), lambda: model.ScriptedClient([], ACCEPT), ("g", "j"), keep).orderBy("id").collect()
    assert {(x["id"], x["judge_verdict"], x["reject_reason"]) for x in got} == {
        ("align:article-9:paragraph-1:n1:1:1", "accepted", None), ("align:article-9:paragraph-1:n1:9:2", "rejected", "unknown_target"), ("align:article-9:paragraph-1:n1:1:3", "rejected", "source_quote"),
    }
    assert {x["n_candidates"] for x in got} == {4}


def failing():
    class Client:  # within a function, so that workers get it by value
        def complete(self, system, user):
            raise RuntimeError("down")

    return Client


def test_failures_belong_to_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "i int, q string")
    got = {x["i"]: x for x in model.ask(rows, failing(), "s", "q").collect()}
    assert got[1]["reply"] is None and got[1]["reply_error"] == "RuntimeError: down" and got[2]["reply_error"] is None
    judged = model.judged(rows, failing(), "s", "q").collect()
    assert {(x["i"], x["judge_verdict"]) for x in judged} == {(1, "needs_human_review"), (2, "rejected")}


def test_evidence(spark, keep):
    reply = lambda quote: json.dumps({"assessment": "sufficient", "quotes": [quote], "confidence": 2})
    pairs = spark.createDataFrame([("n1", "keep logs", "we keep logs daily"), ("n2", "be open", "we keep nothing")], "norm_id string, norm_text string, content string")
    got = model.evidence(pairs, lambda: model.ScriptedClient([("daily", reply("keep logs"))], reply("invented")), lambda: model.ScriptedClient([], ACCEPT), ("g", "j"), keep)
    assert {(x["norm_id"], x["assessment"], x["status"], x["confidence"]) for x in got.collect()} == {("n1", "sufficient", "satisfied_by_evidence", 1.0), ("n2", "cannot_assess", "requires_human_review", 1.0)}
    refused = model.evidence(pairs, lambda: model.ScriptedClient([], reply("we keep")), lambda: model.ScriptedClient([], "?"), ("g", "j"), keep)
    assert {x["status"] for x in refused.collect()} == {"requires_human_review"}


def test_backlog_elicitation_and_harness(spark, keep):
    items = spark.createDataFrame([(1, "t", "d", ["n1"]), (2, "", "d", ["n1"]), (3, "t", "d", []), (4, "t", "d", ["zz", "n1"]), (5, "t", "d", None)], "ord int, title string, description string, norm_ids array<string>")
    assert {x["ord"]: x["reason"] for x in model.backlog(items, spark.createDataFrame([("n1",)], "norm_id string")).collect()} == {1: None, 2: "title", 3: "no_norms", 4: "unknown_norms", 5: "no_norms"}
    reply = json.dumps({"flags": {"a": True, "b": "maybe", "z": True, "c": False}, "domain": "health"})
    x = model.elicit(spark.createDataFrame([("i", "text")], "id string, description string"), lambda: model.ScriptedClient([], reply), "p", ["a", "b", "c"], keep).first()
    assert x["flags"] == {"a": True, "c": False} and x["missing"] == ["b"]
    questions = spark.createDataFrame([("i1", "q1"), ("i2", "q2")], "item_id string, question string")
    got = model.evaluate(questions, {"plain": model.prompted(model.StubClient, "s"), "down": model.prompted(failing(), "s")}).collect()
    assert {(x["strategy"], x["answer_text"], x["error"]) for x in got} == {("plain", "offline", None), ("down", None, "RuntimeError: down")}
    assert model.artifact_name("b", ["y", "x"]) == model.artifact_name("b", ["x", "y"])
    model.independent("gen-1", "judge-2")
    with pytest.raises(ValueError):
        model.independent("gen-1", "GEN-2")


def test_tools(spark):
    nodes = spark.createDataFrame([("r:article-9", "Article", "text of nine", "s")], "id string, type string, text string, source_span string")
    assert {(x["id"], x["status"]) for x in tools.source_trace(nodes, spark.createDataFrame([("r:article-9",), ("zz",)], "id string")).collect()} == {("r:article-9", "applicable"), ("zz", "rejected_as_unsupported")}
    norms = spark.createDataFrame([("n1", "r:article-9", "keep AI system logs", "for risk", "accepted"), ("n2", "r:article-10", "x", "y", "needs_human_review"), ("n3", "r:annex-i", "x", "y", "accepted")], "norm_id string, source_node_id string, action string, object string, judge_verdict string")
    assertions = spark.createDataFrame([("x1", "n1", "t1", "m1", "j1", "accepted"), ("x2", "n9", "t2", "m0", "j1", "rejected")], "id string, source_norm_id string, target_id string, mapping_run_id string, judge_run_id string, judge_verdict string")
    got = {x["norm_id"]: (x["source_text"], x["terms"], x["n_alignments"]) for x in tools.explain(norms, nodes, spark.createDataFrame([("AI system",), ("risk",)], "term string"), assertions).collect()}
    assert got["n1"] == ("text of nine", ["AI system", "risk"], 1) and got["n2"] == (None, [], 0)
    runs, judges = spark.createDataFrame([("m1", "g")], "id string, generator_model string"), spark.createDataFrame([("j1", "j", "r")], "id string, judge_model string, rationale string")
    traced = {x["asked"]: (x["assertion_id"], x["status"]) for x in tools.trace_alignment(assertions, runs, judges, spark.createDataFrame([("n1",), ("t2",), ("none",)], "id string")).collect()}
    assert traced == {"n1": ("x1", "applicable"), "t2": ("x2", "requires_human_review")}
    assert [x["group"] for x in tools.requirements_by_article(norms).collect()] == ["article-9", "article-10"]
    assert tools.coverage(nodes, norms).first()["complete"] is False
    board = tools.board(spark.createDataFrame([("n1", "article-9"), ("n2", "article-9")], "norm_id string, group string"), spark.createDataFrame([("n1", "satisfied_by_evidence")], "norm_id string, status string"), ["satisfied_by_evidence", "applicable_missing_evidence"]).first()
    assert (board["satisfied_by_evidence"], board["applicable_missing_evidence"]) == (1, 1)


def test_sinks(spark, tmp_path):
    units = spark.createDataFrame([("a",), ("b",)], "u string")
    path = str(tmp_path / "units")
    work = lambda df: df.withColumn("done", F.lit(1))
    assert [sinks.write_units(spark, x, "u", work, path) for x in (units.limit(1), units, units)] == [1, 1, 0]
    sinks.append_events(spark.createDataFrame([("key sk-abcdefgh1234",)], "m string"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).first()["m"] == "key [redacted]"
    sinks.write_triples(spark.createDataFrame([("<a> <b> <c> .",)], "line string"), str(tmp_path / "nt"))
    assert spark.read.text(str(tmp_path / "nt")).count() == 1
    assert "| a |" in sinks.markdown(units.orderBy("u"), "Units") and "more than" in sinks.markdown(units, "Units", 1)


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = metering.event_stream(spark, str(tmp_path / "in"), events.schema)
    metering.drain_latest(metering.per_minute(stream, "ts", "user_id", "0 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.json(str(tmp_path / "out")).groupBy("minute", "client").agg(F.max("n").alias("n"))
    assert got.agg(F.sum("n")).first()[0] == events.count()
    metering.drain(stream.select("event_id", "user_id"), str(tmp_path / "copy"), str(tmp_path / "cp2"))
    metering.drain(stream.select("event_id", "user_id"), str(tmp_path / "copy"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == events.count()
    assert metering.sliding(events, "ts", "10 minutes", "5 minutes").agg(F.sum("n")).first()[0] == 2 * events.count()
    assert metering.sessions(events, "ts", "user_id", "1 hour").agg(F.sum("n")).first()[0] == events.count()
