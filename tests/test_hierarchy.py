import json
import random

from pyspark.sql import functions as F

from lexgrove.operators import hierarchy, strategies

NODES = "id string, parent string, n int, title string"


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    known = {r[0] for r in rows}

    def one(r):
        inner = [one(x) for x in sorted(by.get(r[0], []), key=lambda x: (x[2], x[0]))]
        return {"id": r[0], "title": r[3]} | ({"parts": inner} if inner else {})

    return {r[0]: one(r) for r in rows if r[1] is None or r[1] not in known}


def test_trees_of_any_depth(spark):
    r = random.Random(2)
    rows = [(f"n{i}", None if i < 3 else f"n{r.randrange(max(0, i - 6), i)}", r.randrange(4), f'T "{i}" \\ é') for i in range(60)] + [("lost", "gone", 1, "orphan"), ("x", "y", 0, "cycle"), ("y", "x", 0, "cycle")]
    got = {x["id"]: json.loads(x["json"]) for x in hierarchy.nested(spark.createDataFrame(rows, NODES).repartition(5), "id", "parent", ["n"], F.struct("id", "title"), "parts").collect()}
    assert got == plain(rows[:-2])
    assert hierarchy.nested(spark.createDataFrame([], NODES), "id", "parent", ["n"], F.struct("id")).count() == 0
    bare = spark.createDataFrame([("a", None, 0, None), ("b", "a", 0, None)], NODES)
    assert [x["json"] for x in hierarchy.nested(bare, "id", "parent", ["n"], F.struct("title")).collect()] == ['{"children":[{}]}']


ITEMS, TEXTS, NORMS = "item_id long, question string", "id string, text string", "norm_id string, text string, source_node_id string, judge_verdict string"


def tables(spark):
    items = spark.createDataFrame([(1, "who logs records"), (2, "unrelated zebra")], ITEMS)
    passages = spark.createDataFrame([("a", "logs of records are kept"), ("b", "b" * 30), ("c", "c" * 10), ("d", "zebra"), ("e", "")], TEXTS)
    norms = spark.createDataFrame([("n1", "provider logs records", "a", "accepted"), ("n2", "deployer logs", "c", "rejected"), ("n3", "nothing", "d", "accepted")], NORMS)
    edges = spark.createDataFrame([("a", "b"), ("c", "a"), ("a", "e"), ("d", "d")], "src string, dst string")
    return items, passages, norms, edges


def test_five_strategies(spark):
    items, passages, norms, edges = tables(spark)
    got = {s: sorted(tuple(x)[1:] for x in strategies.contexts(s, items, passages, norms, edges, 70).collect()) for s in strategies.STRATEGIES}
    assert got["plain_llm"] == [] and got["vector_rag"] == [(1, 1, "a", 24), (2, 1, "d", 5)]
    assert got["graph_no_judge"] == [(1, 1, "a", 24), (1, 2, "b", 54), (1, 3, "c", 64)]
    assert got["graph_build_judge"] == got["graph_full"] == [(1, 1, "a", 24), (1, 2, "b", 54), (1, 3, "c", 64)]
    assert [x["id"] for x in strategies.contexts("graph_no_judge", items, passages, norms, edges, 53).collect()] == ["a"]
    text = strategies.prompts(strategies.contexts("vector_rag", items, passages, norms, edges, 70), passages).filter("item_id = 1").first()["context"]
    assert text == "[a] logs of records are kept"


def test_citations_that_do_not_resolve_are_withheld(spark):
    answers = spark.createDataFrame([(1, ["a", "x", "a", "b"]), (2, ["a"]), (3, []), (4, None)], "item_id long, citations array<string>")
    nodes = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    got = {x["item_id"]: (x["citations"], x["withheld"], x["status"]) for x in strategies.resolved(answers, nodes).collect()}
    assert got == {1: (["a", "b"], ["x"], "requires_human_review"), 2: (["a"], [], "answered"), 3: ([], [], "requires_human_review"), 4: ([], [], "requires_human_review")}
