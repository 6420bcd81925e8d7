import hashlib
import json

import pytest
from pyspark.errors import PySparkException

from lexgrove.sources import anchors, files, formex, guideline

ANNEX = """<ANNEX><TITLE><TI><P>ANNEX VIII</P></TI></TITLE><CONTENTS>
<GR.SEQ><TITLE><TI><P>Section A</P></TI></TITLE><NP><NO.P>1.</NO.P><TXT>First &amp; main:</TXT><P><LIST TYPE="alpha"><ITEM><NP><NO.P>(a)</NO.P><TXT>inner é</TXT></NP></ITEM></LIST></P></NP></GR.SEQ>
<GR.SEQ><TITLE><TI><NP><NO.P>2.</NO.P><TXT>Headed</TXT></NP></TI></TITLE><NP><NO.P>2.1.</NO.P><TXT>Under</TXT></NP></GR.SEQ>
<LIST TYPE="DASH"><ITEM><P>dash one</P></ITEM><ITEM><P>dash two</P></ITEM></LIST><QUOT.S><NP><NO.P>9.</NO.P><TXT>quoted</TXT></NP></QUOT.S></CONTENTS></ANNEX>"""
BODY = """<ACT><ARTICLE><PARAG IDENTIFIER="003.001"><ALINEA>Terms:<LIST><ITEM><NP><NO.P>(1)</NO.P><TXT><QUOT.START/>AI system<QUOT.END/> means x;</TXT></NP></ITEM></LIST></ALINEA></PARAG>
<PARAG IDENTIFIER="005.002"><ALINEA>One<NP><NO.P>(a)</NO.P><TXT>x</TXT></NP></ALINEA><ALINEA>Two<NP><NO.P>(a)</NO.P><TXT>y</TXT><P><NP><NO.P>(i)</NO.P><TXT>z</TXT></NP></P></NP></ALINEA></PARAG></ARTICLE></ACT>"""


@pytest.fixture(scope="module")
def elems(spark):
    return formex.elements(spark.createDataFrame([("annex.xml", ANNEX), ("body.xml", BODY)], "file string, text string")).cache()


def test_elements_carry_offsets(elems):
    for x in elems.filter("tag = 'NP'").collect():
        text = {"annex.xml": ANNEX, "body.xml": BODY}[x["file"]]
        assert text[x["start"] : x["stop"]].startswith("<NP>") and text[x["start"] : x["stop"]].endswith("</NP>")
    with pytest.raises(ValueError):
        formex.parse("<a><b></a>")


def test_annex_items(elems):
    got = {x["id"]: (x["parent_id"], x["marker"], x["text"]) for x in formex.annex_items(elems.filter("file = 'annex.xml'"), "r").collect()}
    a = "r:annex-viii"
    assert got == {
        f"{a}:section-a:point-1": (a, "1", "First & main: (a) inner é"), f"{a}:section-a:point-1:a": (f"{a}:section-a:point-1", "a", "inner é"),
        f"{a}:point-2": (a, "2", "Headed"), f"{a}:point-2:2.1": (f"{a}:point-2", "2.1", "Under"), f"{a}:item-1": (a, "-", "dash one"), f"{a}:item-2": (a, "-", "dash two"),
    }


def test_points_subparagraphs_and_definitions(elems):
    body = elems.filter("file = 'body.xml'")
    got = {x["id"]: x["parent_id"] for x in formex.points(body, "r").collect()}
    p = "r:article-5:paragraph-2"
    assert got == {"r:article-3:paragraph-1:point-1": "r:article-3:paragraph-1", f"{p}:subparagraph-1:point-a": p, f"{p}:subparagraph-2:point-a": p, f"{p}:subparagraph-2:point-a:i": f"{p}:subparagraph-2:point-a"}
    assert [(x["id"], x["k"]) for x in formex.subparagraphs(body, "r").collect()] == [(f"{p}:subparagraph-2", 2)]
    spans = body.filter("tag = 'NP'").selectExpr("'r:article-3:paragraph-1:point-1' as id", "inner")
    assert [(x["id"], x["term"]) for x in formex.definitions(spans, "r").collect()] == [("r:definition:ai-system", "AI system")]


PAGE = """<html><div id="rct_1">Recital é one</div><div id="cpt_I"><p id="cpt_I.tit_1">T</p><div id="art_1"><p id="art_1.tit_1">Scope</p><div id="001.001">1. a</div><div id="001.002">2. b</div></div>
</div><div id="cpt_II"><div id="cpt_II.sct_1"><div id="art_2">Body only</div></div><div id="art_3"><div id="003.001">x</div><div id="009.001">quoted</div></div></div><div id="anx_I">Annex</div></html>"""


def test_html_structure(spark):
    texts = spark.createDataFrame([("p.html", "h" * 64, PAGE)], "file string, sha256 string, text string")
    nodes, edges = anchors.nodes_and_edges(texts, "r", "b")
    got = {x["id"]: x for x in nodes.collect()}
    assert set(got) == {f"r:{x}" for x in ("recital-1", "chapter-i", "article-1", "article-1:paragraph-1", "article-1:paragraph-2", "chapter-ii", "chapter-ii:section-1", "article-2", "article-2:paragraph-1", "article-3", "article-3:paragraph-1", "annex-i")}
    assert got["r:recital-1"]["binding"] is False and got["r:recital-1"]["text"] == "Recital é one"
    parent = {x["dst"]: x["src"] for x in edges.collect()}
    assert (parent["r:article-2"], parent["r:article-3"], parent["r:article-1:paragraph-2"], parent["r:annex-i"]) == ("r:chapter-ii:section-1", "r:chapter-ii:section-1", "r:article-1", "r")
    span = got["r:article-1"]["source_span"]
    assert PAGE[span["start"] : span["stop"]].startswith('<div id="art_1">') and '<div id="cpt_II">' not in PAGE[span["start"] : span["stop"]]
    lone = spark.createDataFrame([("p.html", "h", '<div id="art_1">x</div>')], "file string, sha256 string, text string")
    with pytest.raises(PySparkException):
        anchors.nodes_and_edges(lone, "r", "b")[0].collect(), anchors.nodes_and_edges(lone, "r", "b")[1].collect()


def test_guideline(spark):
    text = "intro\n" + "".join(f"1.{i} Name {i}\nFirst line\nof {i}.\n\nFundamental rights. Some text here. More.\nAnd, a thing. No heading\nThis one has far too many words to be any heading. Text\n\n" for i in range(1, 8))
    texts = spark.createDataFrame([("g.txt", text)], "file string, text string")
    rows = guideline.sections(texts).orderBy("ord").collect()
    assert [(x["ord"], x["name"], x["description"]) for x in rows] == [(i, f"Name {i}", f"First line of {i}.") for i in range(1, 8)]
    accepted, rejected = guideline.subtopics(texts)
    assert {(x["ord"], x["slug"], x["description"]) for x in accepted.collect()} == {(i, "fundamental-rights", "Some text here.") for i in range(1, 8)}
    assert {x["reason"] for x in rejected.collect()} == {"punctuation", "words"}
    with pytest.raises(PySparkException):
        guideline.sections(spark.createDataFrame([("g", "1.1 A\n")], "file string, text string")).collect()


def test_snapshots_spans_and_manifest(spark, tmp_path):
    raw = "line é one\r\nline two".encode()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_bytes(raw)
    sha = hashlib.sha256(raw).hexdigest()
    (tmp_path / "m.json").write_text(json.dumps({"snapshots": [{"file": "d/a.txt", "sha256": sha, "source_document": "eu-ai-act"}]}))
    listed, found = files.manifest(spark, str(tmp_path / "m.json")), files.snapshots(spark, str(tmp_path / "d/*.txt"))
    assert files.verified(found, listed).first()["text"] == raw.decode()
    wanted = spark.createDataFrame([("s", "a.txt", sha, 5, 12), ("t", "a.txt", "bad", 0, 1), ("u", "a.txt", sha, 3, 999), ("v", "zz", sha, 0, 1)], "span_id string, file string, snapshot_sha256 string, start int, stop int")
    assert {x["span_id"]: (x["text"], x["reason"]) for x in files.spans(found, wanted).collect()} == {"s": (raw.decode()[5:12], None), "t": (None, "checksum_mismatch"), "u": (None, "bad_offsets"), "v": (None, "missing_snapshot")}
    nodes, edges = files.registry(spark, listed, "b")
    assert nodes.count() == 3 and {x["edge_type"] for x in edges.collect()} == {"AMENDS", "HAS_VERSION"}
    (tmp_path / "d" / "a.txt").write_bytes(raw + b"!")
    with pytest.raises(PySparkException):
        files.verified(files.snapshots(spark, str(tmp_path / "d/*.txt")), listed).collect()


def test_logs_results_and_gold(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts": "1", "verdict": "accepted"}\n\n{"ts": "2", "log_kind": "x"}\n')
    assert [x["log_kind"] for x in files.events(spark, str(tmp_path / "log.jsonl"), "ts string, verdict string", "judge").orderBy("ts").collect()] == ["judge", "x"]
    assert files.events(spark, str(tmp_path / "none.jsonl"), "ts string", "judge").count() == 0
    (tmp_path / "r.jsonl").write_text('{"strategy": "s", "item_id": "i", "answer_text": "old"}\n{"strategy": "s", "item_id": "i", "answer_text": "new"}\n')
    assert [x["answer_text"] for x in files.results(spark, str(tmp_path / "r.jsonl")).collect()] == ["new"]
    item = {"id": "g1", "kind": "qa", "question": "q", "gold": {"answer_text": "a"}, "gold_citations": ["c"]}
    (tmp_path / "g.json").write_text(json.dumps({"items": [item]}))
    assert files.gold_items(spark, str(tmp_path / "g.json")).first()["id"] == "g1"
    (tmp_path / "b.json").write_text(json.dumps({"items": [item | {"kind": "other"}]}))
    with pytest.raises(PySparkException):
        files.gold_items(spark, str(tmp_path / "b.json")).collect()


def test_files_of_one_regulation_do_not_hide_each_other(spark):
    """An article's own paragraphs are those of its file."""
    texts = spark.createDataFrame([("a", "h", '<div id="cpt_I"><div id="art_1"><div id="001.001">1. a</div></div></div>'), ("b", "h", '<div id="cpt_I"><div id="art_1">body</div></div>')], "file string, sha256 string, text string")
    got = {(x["source_span"]["snapshot_file"], x["text"]) for x in anchors.nodes_and_edges(texts, "r", "b1")[0].filter("type = 'Paragraph'").collect()}
    assert got == {("a", "1. a"), ("b", "body")}


def test_scenarios_and_questions_are_items_of_one_table(spark):
    risk = {"high": "high_risk", "low": "minimal_or_none"}
    scenarios = spark.createDataFrame([(1, "high", "r", "u", "t", "i", "d", [5, 6])], "benchmark_index int, risk_level string, role string, intended_use string, system_type string, input_data string, domain string, related_articles array<int>")
    pairs = spark.createDataFrame([(2, "Q?", "A.", 9)], "benchmark_index int, question string, answer string, relevant_article int")
    got = {x["id"]: x for x in files.scenario_items(scenarios, risk, "r").unionByName(files.qa_items(pairs, "r")).collect()}
    assert got["bench:scenario:1"]["gold_citations"] == ["r:article-5", "r:article-6"] and got["bench:scenario:1"]["risk_category"] == "high_risk"
    assert got["bench:scenario:1"]["system_text"] == "Role: r. Intended use: u. System type: t. Input data: i. Domain: d." and got["bench:qa:2"]["question"] == "Q?"
    with pytest.raises(PySparkException, match="no such risk level"):
        files.scenario_items(scenarios.selectExpr("* except (risk_level)", "'odd' as risk_level"), risk, "r").collect()


def test_defined_terms_are_edges_or_errors(spark):
    spans = lambda *x: spark.createDataFrame([*x], "id string, inner string")
    term = lambda x: f"<QUOT.START/>{x}<QUOT.END/> means"
    nodes, edges = formex.defined_terms(spans(("p1", term("AI system")), ("p2", term("risk"))), "r", "b")
    assert {(x["src"], x["dst"]) for x in edges.collect()} == {("p1", "r:definition:ai-system"), ("p2", "r:definition:risk")} and nodes.count() == 2
    with pytest.raises(PySparkException, match="no quoted term: p2"):
        formex.defined_terms(spans(("p1", term("a")), ("p2", "none")), "r", "b")[1].collect()
    with pytest.raises(PySparkException, match="another point defines"):
        formex.defined_terms(spans(("p1", term("AI system")), ("p2", term("ai-system"))), "r", "b")[0].collect()


def test_files_derive_from_their_documents(spark):
    listed = spark.createDataFrame([("formex/a.xml", "omnibus"), ("b.html", None)], "file string, source_document string")
    assert {tuple(x) for x in files.derived_edges(listed, "b").select("src", "dst", "edge_type").collect()} == {("file:formex/a.xml", "omnibus", "DERIVED_FROM_SOURCE"), ("file:b.html", "eu-ai-act", "DERIVED_FROM_SOURCE")}
