"""One pass over each text gives what joins of its elements give, and the parser what it is."""

import random
import re

import pytest

from lexgrove.operators import gates
from lexgrove.sources import formex


def markup(r, depth=0):
    tag = r.choice(("NP", "NP", "P", "ALINEA", "PARAG", "LIST", "ITEM", "QUOT.S", "GR.SEQ", "TITLE", "TI"))
    attrs = {"PARAG": f' IDENTIFIER="00{r.randint(1, 2)}.0{r.randint(1, 2)}"', "LIST": r.choice(('', " TYPE='DASH'", ' TYPE="alpha"'))}.get(tag, "")
    head = f"<NO.P>({r.choice('abc')})</NO.P>" if tag == "NP" and r.random() < 0.9 else r.choice(("", "<TI>Section <B>B</B></TI>", "<NP><NO.P>3.</NO.P></NP>")) if tag == "TITLE" else ""
    inner = "".join(r.choice(("é &amp; ", "x&#233;", "&nbsp;", "<IE/>", "")) + markup(r, depth + 1) for _ in range(r.randint(0, 3 if depth < 5 else 0)))
    more = "<ALINEA>one<NP><NO.P>(a)</NO.P>x</NP></ALINEA><ALINEA>two &lt;</ALINEA>" * r.randint(0, 2) if tag == "PARAG" else ""
    return f"<{tag}{attrs}>{head}{inner}{more}t</{tag} >"


def files(r, n, plain=True):
    odd = "" if plain else "<!-- <NP> -->"
    return {f"f{i}": f"<ANNEX>{odd}<TITLE><TI>ANNEX  {'IVX'[i % 3]}</TI></TITLE><CONTENTS>{''.join(markup(r) for _ in range(4))}</CONTENTS></ANNEX>\n" for i in range(n)}


def test_scanned_texts_are_parsed_texts():
    r = random.Random(1)
    ends = ("", " ", "x", "<a/>", "</ANNEX>", "&x;", "﻿", "<!-- c -->", "<", ">", "]]>", "&", "&#0;", "&#x2019;", "\x01", "￿", "<b c='>'/>", "<b c='1' c='2'/>", '<?x y?>', "<![CDATA[<NP>]]>", "é")
    for i, text in enumerate([*files(r, 40).values(), *files(r, 10, False).values(), "", "<a/>", "<a b='&lt;\n'></a>", "<a>&am<b/>p;</a>", "<é>x</é>", "<x:a>1</x:a>", "<a></b>"]):
        for end in ends if i % 5 == 0 or len(text) < 20 else ends[:1]:
            at = text.find(">") + 1
            for whole in (text + end, end + text, text[:at] + end + text[at:]):
                try:
                    want = [[e["tag"], e["attrs"], -1 if e["parent"] is None else e["parent"], e["start"], e["stop"], e["inner"]] for e in formex.parse(whole)]
                except ValueError:
                    with pytest.raises(ValueError):
                        formex.scan(whole)
                    continue
                shape, at = formex.scan(whole)
                assert [[*e[:3], at[e[3]], at[e[5]] + e[7], whole[at[e[3]] + e[4] : at[e[5]] + e[6]]] for e in shape.elements] == want


def same(a, b):
    one = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert one(a) == one(b) and one(a)


def flat(text):
    """Paragraphs don't hold paragraphs."""
    depth, out = 0, []
    for piece in re.split('(<[^<>]*>)', text):
        inner = piece.startswith("<PARAG") and depth
        depth += piece.startswith("<PARAG") - piece.startswith("</PARAG")
        out.append("<P>" if inner else "</P>" if piece.startswith("</PARAG") and depth else piece)
    return "".join(out)


def test_one_pass_gives_what_joins_give(spark):
    r = random.Random(3)
    texts = spark.createDataFrame([(k, flat(v)) for k, v in (files(r, 25) | {f"o{k}": v for k, v in files(r, 5, False).items()}).items()], "file string, text string")
    elems = formex.elements(texts).cache()
    same(formex.points_of(texts, "r"), formex.points(elems, "r"))
    same(formex.subparagraphs_of(texts, "r"), formex.subparagraphs(elems, "r"))
    same(formex.annex_items_of(texts, "r"), formex.annex_items(elems, "r"))
    claims = gates.claims(elems, "r")
    same(formex.claims_of(texts, "r").drop("file"), claims)
    same(formex.elements(texts, ("elem", "tag", "inner"), ("NP", "PARAG")), elems.filter("tag in ('NP', 'PARAG')").select("file", "elem", "tag", "inner"))


def test_gates_read_a_body_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for x in batches:
            reads.add(x.num_rows)
            yield x

    elems = formex.elements(spark.createDataFrame([("a", '<ACT><ARTICLE><NP/><PARAG IDENTIFIER="1.2"><NP/></PARAG></ARTICLE></ACT>')], "file string, text string"), ("elem", "tag", "attrs", "tags"))
    known = spark.createDataFrame([("r:article-9:paragraph-9",)], "id string")
    got = gates.body_gates(elems.coalesce(1).mapInArrow(seen, elems.schema), known, "r", 2).collect()
    assert {tuple(x) for x in got} == {("articles", "1"), ("identifier", "1.2"), ("paragraph", "r:article-1:paragraph-2"), ("stray_point", "2")} and reads.value == 5
