"""Small cases with results computed by hand."""

import pytest
from pyspark.sql import functions as F

from lexgrove.functions import text as X
from lexgrove.operators import dedup, gates, graph, joins, metrics, references, review, windows
from lexgrove.plans import requirements


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, X.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    assert one(spark, X.jaccard(F.array(F.lit("a")), F.array(F.lit("b")))) == 0.0
    assert one(spark, X.ratio(F.lit(3), F.lit(0))) == 0.0
    assert one(spark, X.visible(F.lit("<p>a &amp;lt; <b>b</b>\n c</p>"))) == "a &lt; b c"
    assert one(spark, X.slug(F.lit("  High-risk AI: System! "))) == "high-risk-ai-system"
    assert [one(spark, X.roman(F.lit(n))) for n in (1, 4, 9, 13, 40, 1994)] == ["I", "IV", "IX", "XIII", "XL", "MCMXCIV"]
    assert [one(spark, X.from_roman(F.lit(x))) for x in ("I", "IV", "IX", "XIII", "XL", "MCMXCIV")] == [1, 4, 9, 13, 40, 1994]
    assert one(spark, X.suffix(F.lit("norm:a:b"))) == "a:b" and one(spark, X.suffix(F.lit("plain"))) == "plain"
    assert one(spark, X.ancestors(F.lit("r:a:b"))) == ["r", "r:a", "r:a:b"]
    assert one(spark, X.literal(F.lit('a"b\\c\nd'))) == '"a\\"b\\\\c\\nd"'
    assert one(spark, X.scrubbed(F.lit("key sk-abcdefgh12 and Bearer abc.def-ghij"))) == "key [redacted] and [redacted]"
    assert one(spark, X.quoted_in(F.lit(" a  b"), F.lit("x a\nb y"))) and not one(spark, X.quoted_in(F.lit(" "), F.lit("x")))
    assert one(spark, X.json_object(F.lit('```json\n{"k": 3}\n```'), "k int")["k"]) == 3 and one(spark, X.json_object(F.lit("no"), "k int")) is None
    cut = one(spark, X.excerpt(F.lit("a  bc d"), 4))
    assert (cut["excerpt"], cut["truncated"]) == ("a bc", True)


def test_near_duplicates(spark):
    a = "establish and maintain a risk management system"
    rows = [(1, a, "p"), (2, "establish and maintain the risk management system", "p"), (3, a, "q"), (4, a, "p"), (5, "", "p"), (6, "", "p"), (7, a, None), (8, a, None)]
    got = {(x["id_a"], x["id_b"]): (x["n_shared"], x["n_union"], x["band"]) for x in dedup.near_duplicate_pairs(spark.createDataFrame(rows, "id int, t string, actor string"), "id", F.col("t"), ["actor"]).collect()}
    assert got == {(1, 2): (6, 8, "review"), (1, 4): (7, 7, "near_duplicate"), (2, 4): (6, 8, "review"), (7, 8): (7, 7, "near_duplicate")}


def test_scores(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("a", "a"), ("b", "a"), ("a", "b"), ("a", None)], "g string, p string")
    got = {x["label"]: x for x in metrics.scores_by_class(df, "g", "p", ["a", "b", "c"]).collect()}
    assert (got["a"]["precision"], got["a"]["recall"], got["a"]["f1"]) == (0.75, 0.6, 2 / 3)
    assert (got["c"]["precision"], got["c"]["recall"], got["c"]["f1"]) == (0.0, 0.0, 0.0)
    assert metrics.accuracy(df, "g", "p").first()["n_correct"] == 3


def test_completeness_and_hallucination(spark):
    items = spark.createDataFrame([("i1", ["a"], ["a"]), ("i2", ["a", "b"], ["a"]), ("i3", [], ["x"]), ("i4", ["z"], None)], "i string, g array<string>, p array<string>")
    x = metrics.completeness(items, "g", "p").first()
    assert (x["n_items"], x["n_found"], x["n_wanted"], x["micro"], x["macro"]) == (3, 2, 4, 0.5, 0.5)
    cited = spark.createDataFrame([("1", "a"), ("1", "fake1"), ("2", "b"), ("2", "b"), ("3", "fake2")], "i string, c string")
    y = metrics.hallucination(cited, "i", "c", spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), "id").first()
    assert (y["n_cited"], y["n_unknown"], y["rate"]) == (4, 2, 0.5)


@pytest.mark.parametrize(("cells", "kappa"), [({("y", "y"): 20, ("y", "n"): 5, ("n", "y"): 10, ("n", "n"): 15}, 0.4), ({("a", "a"): 5}, 1.0), ({("a", "b"): 5, ("b", "a"): 5}, -1.0), ({("a", "a"): 5, ("a", "b"): 5, ("b", "a"): 5, ("b", "b"): 5}, 0.0)])
def test_kappa(spark, cells, kappa):
    rows = [k for k, n in cells.items() for _ in range(n)]
    assert metrics.agreement(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()["kappa"] == pytest.approx(kappa)
    with pytest.raises(Exception, match="no item"):
        metrics.agreement(spark.createDataFrame([("x", None)], "a string, b string"), "a", "b").collect()


def test_judge_errors(spark):
    rows = [("accepted", "accept"), ("rejected", "accept"), ("accepted", "accept"), ("accepted", "reject"), ("rejected", "reject"), ("needs_human_review", "accept")]
    x = metrics.judge_errors(spark.createDataFrame(rows, "v string, g string"), "v", "g").first()
    assert (x["n_scored"], x["n_abstained"], x["false_accept_rate"], x["false_reject_rate"]) == (5, 1, 0.5, 1 / 3)


def test_allocation():
    assert windows.allocate({"a": 100, "b": 4, "c": 4}, 20, 3) == {"a": 14, "b": 3, "c": 3}
    got = windows.allocate({"na": 339, "nh": 41, "nr": 54, "aa": 475, "ar": 145}, 50, 3)
    assert sum(got.values()) == 50 and got == {"na": 16, "nh": 3, "nr": 3, "aa": 22, "ar": 6}
    assert windows.allocate({}, 10, 3) == {}


def test_ordered_operators(spark):
    df = spark.createDataFrame([(1, 1, 10, "a"), (2, 4, 20, None), (3, 3, 30, None), (4, 2, 40, "b"), (5, 1, 50, None)], "pos int, r int, start int, v string")
    closed = {x["pos"]: x["stop"] for x in windows.next_of_rank(df.withColumn("g", F.lit(1)), ["g"], ["pos"], "r", "start", [1, 2, 3, 4], F.lit(99), "stop").collect()}
    assert closed == {1: 50, 2: 30, 3: 40, 4: 50, 5: 99}
    carried = {x["pos"]: x["c"] for x in windows.carried(df.withColumn("g", F.lit(1)), ["g"], ["pos"], F.col("v"), "c").collect()}
    assert carried == {1: "a", 2: "a", 3: "a", 4: "b", 5: "b"}


def test_actors(spark):
    names = ["providers of high-risk AI systems", "European Commission", "that system", "office", "  ", None, "the Notified Bodies", "a deployer,"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "i int, raw string").select("i", requirements.canonical_actor(F.col("raw")).alias("x"))
    got = [(x["x"]["actor"], x["x"]["method"]) for x in rows.orderBy("i").collect()]
    assert got == [("provider", "rule"), ("commission", "rule"), (None, "unresolved"), (None, "ambiguous"), (None, "empty"), (None, "empty"), ("notified_body", "rule"), ("deployer", "rule")]
    with pytest.raises(ValueError):
        requirements.acts(F.lit("x"), F.lit("y"), "nobody")


def test_cross_references(spark):
    nodes = spark.createDataFrame([(f"r:article-{n}",) for n in (*range(1, 20),)] + [("r:article-6:paragraph-2",), ("r:annex-iii",), ("r:chapter-iv",)], "id string")
    texts = {
        "a": "see Article 6", "b": "see Article 6(2)", "c": "see Article 6(9)", "d": "Article 4(2) of Regulation (EU) 2016/679", "e": "Article 999", "f": "Articles 8 to 10, and Annex III",
        "g": "Regulation (EC) No 300/2008, Article 5", "h": "Article 7 of this Regulation", "i": "Annex Implementation", "j": "Chapters IV and é Article 6(2) and 7", "k": None,
        "l": "Articles 6(2) and 6(9)", "m": "Article 8, points (a) and (b), of Directive 2006/42/EC. Article 9", "n": "Articles 10 to 8", "o": "Regulation (EC) No. 300/2008 and Article 5", "p": "Regulation (EU) 2016/679; Article 5",
    }
    edges, queue = references.resolve(spark.createDataFrame(list(texts.items()), "id string, t string"), "id", "t", nodes, "r")
    got = {}
    for x in edges.collect():
        got.setdefault(x["from_id"], set()).add(x["target"].removeprefix("r:"))
    assert got == {
        "a": {"article-6"}, "b": {"article-6:paragraph-2"}, "c": {"article-6"}, "f": {"article-8", "article-9", "article-10", "annex-iii"}, "h": {"article-7"}, "j": {"chapter-iv", "article-6:paragraph-2", "article-7"},
        "l": {"article-6:paragraph-2", "article-6"}, "m": {"article-9"}, "n": {"article-10", "article-8"}, "p": {"article-5"},
    }
    assert {(x["from_id"], x["reason"]) for x in queue.collect()} == {("d", "external_instrument"), ("e", "unresolved_target"), ("g", "external_instrument"), ("m", "external_instrument"), ("o", "external_instrument")}
    assert {x["mention"] for x in queue.collect()} >= {"Article 8, points (a) and (b), of Directive 2006/42/EC", "Regulation (EC) No. 300/2008 and Article 5", "Article 4(2) of Regulation (EU) 2016/679"}
    ids = [x["edge_id"] for x in references.numbered(edges, "xref-").collect()]
    assert sorted(ids, key=lambda x: int(x[5:])) == [f"xref-{i + 1}" for i in range(len(ids))]


def test_recitals(spark):
    nodes = spark.createDataFrame([("r:article-5",), ("r:article-16",)], "id string")
    texts = {"a": "Article 16 TFEU", "b": "Article 5 of this Regulation and of the Treaty", "c": "Article 5 of the Charter", "d": "Article 5(1) of that Directive", "e": "Article 77", "f": "Article 5, Article 5 and Protocol"}
    edges, queue = references.context_edges(spark.createDataFrame(list(texts.items()), "id string, t string"), "id", "t", nodes, "r")
    assert {(x["from_id"], x["target"], x["edge_type"]) for x in edges.collect()} == {("b", "r:article-5", "CONTEXT_FOR"), ("f", "r:article-5", "CONTEXT_FOR")}
    assert {(x["from_id"], x["reason"]) for x in queue.collect()} == {("a", "external_instrument"), ("c", "external_instrument"), ("d", "external_instrument"), ("e", "unresolved_target")}


def test_roman_numerals():
    assert [references.roman_value(x) for x in ("I", "IV", "XIII", "XLIX", "MCMXCIV", "IIII", "VX", "", "Implementation", "IC")] == [1, 4, 13, 49, 1994, None, None, None, None, None]


def test_sources_of_references(spark):
    edges = spark.createDataFrame([("r:article-6:paragraph-2",), ("r:x:p",), ("r:annex-i",)], "from_id string")
    parents = spark.createDataFrame([("r:article-9", "r:x:p")], "src string, dst string")
    assert {x["from_id"]: x["source"] for x in references.article_source(edges, parents).collect()} == {"r:article-6:paragraph-2": "r:article-6", "r:x:p": "r:article-9", "r:annex-i": "r:annex-i"}


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    got = {x["id"]: x["depth"] for x in graph.reachable(edges, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    assert len(graph.statements(edges.limit(1).union(edges.limit(1)), F.col("src"), F.lit("p"), F.col("dst")).collect()) == 4


def test_joins(spark):
    terms = spark.createDataFrame([("risk",), ("AI system",)], "term string")
    texts = spark.createDataFrame([(1, "a Risk of ai  system use"), (2, "brisk AI systems"), (3, "")], "i int, t string")
    assert {(x["i"], x["term"]) for x in joins.mentioned(terms, "term", texts, "t").collect()} == {(1, "risk"), (1, "AI system")}
    assert joins.mentioned(terms.limit(0), "term", texts, "t").count() == 0
    points = spark.createDataFrame([(1,), (5,), (9,)], "p int")
    spans = spark.createDataFrame([("s", 1, 9), ("t", 5, 6)], "n string, a int, b int")
    assert {(x["p"], x["n"]) for x in joins.contained(points, F.col("p"), spans, "a", "b", 4).collect()} == {(1, "s"), (5, "s"), (5, "t")}


NODE = "id string, layer int, type string, binding boolean, legal_status string, span_sha256 string"


def build(spark, change=None):
    nodes = [("reg", 1, "Regulation", True, None, "h"), ("art", 1, "Article", True, None, "h"), ("rec", 1, "Recital", False, None, "h"), ("amend-doc", 0, "SourceDocument", None, "adopted_not_yet_applicable", None)]
    edges = [("e1", "HAS_ARTICLE", "reg", "art"), ("e2", "HAS_RECITAL", "reg", "rec")]
    norms, assertions = [("n1", "span:1")], [("x1", "accepted", ["s"], ["t"]), ("x2", "rejected", [], [])]
    if change == "G1":
        edges.pop(0)
    if change == "G2":
        nodes[1] = ("art", 1, "Article", True, None, "other")
    if change == "G3":
        norms = [("n1", None)]
    if change == "G4":
        assertions = [("x1", "accepted", ["s"], [])]
    if change == "G5":
        nodes[2] = ("rec", 1, "Recital", True, None, "h")
    if change == "G6":
        nodes[3] = ("amend-doc", 0, "SourceDocument", None, "in_force", None)
    return gates.build_gates(
        spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, "edge_id string, edge_type string, src string, dst string"), spark.createDataFrame([("h",)], "sha256 string"),
        spark.createDataFrame(norms, "norm_id string, source_span_id string"), spark.createDataFrame(assertions, "id string, judge_verdict string, source_evidence_span_ids array<string>, target_evidence_span_ids array<string>"),
    )


@pytest.mark.parametrize("change", [None, "G1", "G2", "G3", "G4", "G5", "G6"])
def test_gates(spark, change):
    assert {x["gate"] for x in build(spark, change).collect()} == ({change} if change else set())


def test_publish(spark, tmp_path):
    df = spark.range(5)
    assert gates.publish(df, build(spark), str(tmp_path / "ok")) == 5
    with pytest.raises(ValueError):
        gates.publish(df, build(spark, "G3"), str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_decisions(spark):
    rows = spark.createDataFrame([("a", "accepted", "auto"), ("b", "rejected", "auto")], "id string, judge_verdict string, review_status string")
    out = review.decided_over(rows, spark.createDataFrame([("b", "accepted")], "item_id string, decision string"), "id")
    assert {(x["id"], x["judge_verdict"], x["review_status"]) for x in out.collect()} == {("a", "accepted", "auto"), ("b", "accepted", "human_reviewed")}
    with pytest.raises(ValueError):
        review.decided_over(rows, spark.createDataFrame([("zz", "accepted")], "item_id string, decision string"), "id")


def test_units_and_leaves(spark):
    nodes = spark.createDataFrame([(x,) for x in ("r:article-5", "r:article-5:paragraph-1", "r:article-50", "r:annex-i:point-1", "r:annex-i:point-1:a")], "id string")
    assert {x["id"] for x in joins.expanded(spark.createDataFrame([("r:article-5",)], "id string"), nodes).collect()} == {"r:article-5", "r:article-5:paragraph-1"}
    assert {x["id"] for x in joins.leaves(nodes).collect()} == {"r:article-5:paragraph-1", "r:article-50", "r:annex-i:point-1:a"}


def test_norms_as_graph(spark):
    schema = "norm_id string, source_node_id string, judge_run_id string, judge_verdict string, actor_explicit string, actor_inferred string, conditions array<string>, exceptions array<string>"
    norms = spark.createDataFrame([("n1", "a", "j1", "accepted", "Providers", None, ["If  x", "if x", " "], None), ("n2", "a", None, "rejected", "", "deployer", ["IF X"], ["unless y"])], schema)
    named, nodes = review.clauses(norms)
    got = {x["norm_id"]: (x["actor_canonical"], len(x["condition_ids"]), len(x["exception_ids"])) for x in named.collect()}
    assert got == {"n1": ("provider", 1, 0), "n2": ("deployer", 1, 1)}
    assert {(x["type"], x["text"]) for x in nodes.collect()} == {("Condition", "If  x"), ("Exception", "unless y")}
    _, edges = graph.of_norms(named, "b")
    assert sorted((x["src"], x["edge_type"], x["provenance_class"]) for x in edges.collect()) == [
        ("n1", "DERIVED_FROM", "LLM_ACCEPTED"), ("n1", "HAS_CONDITION", "LLM_ACCEPTED"), ("n1", "JUDGED_BY", "LLM_ACCEPTED"), ("n2", "DERIVED_FROM", "LLM_REJECTED"), ("n2", "HAS_CONDITION", "LLM_REJECTED"), ("n2", "HAS_EXCEPTION", "LLM_REJECTED"),
    ]
    assertions = spark.createDataFrame([("x1", "n1", "t1", "m1", "j1", "accepted")], "id string, source_norm_id string, target_id string, mapping_run_id string, judge_run_id string, judge_verdict string")
    assert graph.of_alignments(assertions, "b")[1].count() == 4
    recorded, live = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "role string, sha string"), spark.createDataFrame([("a", "1"), ("b", "9")], "role string, sha string")
    assert {x["role"]: x["matches"] for x in review.chain_matches(recorded, live).collect()} == {"a": True, "b": False, "c": False}
