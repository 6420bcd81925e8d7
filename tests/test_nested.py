import random
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from lexgrove.operators import nested
from lexgrove.sources import anchors, formex

XML = "file string, text string"


def tree(r, depth=0):
    tag = r.choice(("A", "NP", "QUOT.S", "TI", "P"))
    inner = "".join(r.choice(("é ", "x", "<!-- <NP> -->")) + tree(r, depth + 1) for _ in range(r.randint(0, 3 if depth < 5 else 0)))
    return f"<{tag}>{inner}t</{tag}>"


def walk(e):
    for child in e:
        yield child
        yield from walk(child)


def roots(e, tag, skip):
    out = []
    for child in e:
        if child.tag in skip:
            continue
        out += [child] if child.tag == tag else roots(child, tag, skip)
    return out


def test_walks_of_well_formed_trees(spark):
    r = random.Random(6)
    files = {f"f{i}": f"<A>{''.join(tree(r) for _ in range(3))}</A>" for i in range(12)}
    texts = spark.createDataFrame(list(files.items()), XML)
    elems = nested.elements(texts, ["file"]).cache()
    parsed = formex.elements(texts)
    spans = lambda df: sorted(map(tuple, df.select("file", F.lower("tag"), "start", "stop").collect()))
    assert spans(elems) == spans(parsed)
    starts = {(x["file"], x["elem"]): x["start"] for x in parsed.collect()}
    first, top, second = set(), set(), set()
    for file, text in files.items():
        whole = list(ET.fromstring(text).iter())
        number = {e: starts[file, i] for i, e in enumerate(whole)}
        for e in whole:
            found = next((x for x in walk(e) if x.tag == "NP"), None)
            first.add((file, number[e], None if found is None else number[found]))
            if e.tag == "A":
                top |= {(file, number[e], number[x]) for x in roots(e, "NP", {"QUOT.S", "TI"})}
                inner = [x for x in walk(e) if x.tag == "P"]
                second |= {(file, number[e], inner[1])} if len(inner) > 1 else set()
    assert {tuple(x) for x in nested.first_inside(elems, ["file"], "np").select("file", "start", "inner_start").collect()} == first
    assert {tuple(x) for x in nested.top_level(elems, ["file"], "a", "np", ("quot.s", "ti")).select("file", "root", "start").collect()} == top
    assert {(x["file"], x["root"]) for x in nested.nth_inside(elems, ["file"], "a", "p", 2).collect()} == {x[:2] for x in second}


def test_broken_markup_has_intervals(spark):
    rows = [("a", "<b>x<p>y</b>z</p></i><p>open"), ("b", ""), ("c", None), ("d", "no markup < here"), ("e", "<script>var t='<p>'</script><P CLASS='x'>q</P><br><img src=x/>")]
    got = {(x["file"], x["tag"], x["start"], x["stop"]) for x in nested.elements(spark.createDataFrame(rows, XML), ["file"]).collect()}
    assert got == {("a", "b", 0, 12), ("a", "p", 4, 17), ("a", "p", 21, 28), ("e", "p", 28, 46)}
    assert nested.elements(spark.createDataFrame([], XML), ["file"]).count() == 0


def test_first_close(spark):
    rows = [("a", "<div>T &amp; x<p>y</p></div><div>no end<p>"), ("b", "<div><div>in</div>out</div>")]
    got = {(x["file"], x["start"], x["title"]) for x in nested.first_close(spark.createDataFrame(rows, XML), ["file"], "div").collect()}
    assert got == {("a", 0, "T & x y"), ("a", 28, ""), ("b", 0, "in"), ("b", 5, "in")}


PAGE = """<html><div id="cpt_I"><div id="cpt_I.tit_1"><p>General &amp; <span>é parts</span></p></div><div id="art_1"><div id="art_1.tit_1">Scope</div><div id="001.001">1. a</div></div>
<div id="cpt_I.sct_2"><div id="cpt_I.sct_2.tit_1">Sect</div><div id="art_2">Body</div></div></div>
<div id="anx_I"><p class="oj-doc-ti">ANNEX I</p><p id="x" class="oj-doc-ti">List <b>of</b> acts</p></div><div id="anx_II"><p class="oj-doc-ti">ANNEX II</p></div></html>"""


def test_titles(spark):
    texts = spark.createDataFrame([("p.html", "h" * 64, PAGE)], "file string, sha256 string, text string")
    got = {x["id"]: x["title"] for x in anchors.nodes_and_edges(texts, "r", "b")[0].collect()}
    assert got == {
        "r:chapter-i": "General & é parts", "r:article-1": "Scope", "r:article-1:paragraph-1": None, "r:chapter-i:section-2": "Sect", "r:article-2": "", "r:article-2:paragraph-1": None, "r:annex-i": "List of acts", "r:annex-ii": "",
    }
