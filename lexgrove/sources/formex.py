"""Offset-carrying XML elements, and the points and annex items they hold.

A tokenizer over Arrow batches gives a row for each element with its ancestors; everything after that is joins by (file, element).
"""

from __future__ import annotations

import functools
import html
import itertools
import re
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.functions.text import slug

ELEMENTS = "file string, elem int, parent int, tag string, attrs map<string,string>, start int, stop int, depth int, path array<int>, tags array<string>, inner string"


def parse(text: str) -> list[dict]:
    """Elements of one file in document order, with code-point offsets; what isn't well-formed is an error. A start or end tag reaches up to
    the byte where the parser reports what comes next."""
    raw = text.encode()
    place = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])  # code points before each byte
    out: list[dict] = []
    stack: list[dict] = []
    waiting: list[tuple[dict, str]] = []
    reader = expat.ParserCreate("utf-8")
    reader.UseForeignDTD(True)  # names of characters that only a DTD would define are left alone

    def here(*_) -> None:
        at = int(place[reader.CurrentByteIndex])
        while waiting:
            element, field = waiting.pop()
            element[field] = at

    def opens(tag: str, attrs: dict) -> None:
        here()
        e = {"elem": len(out), "parent": stack[-1]["elem"] if stack else None, "tag": tag, "attrs": attrs, "start": int(place[reader.CurrentByteIndex]), "depth": len(stack)}
        e |= {"path": [x["elem"] for x in stack], "tags": [x["tag"] for x in stack]}
        waiting.append((e, "begin"))
        out.append(e)
        stack.append(e)

    def closes(tag: str) -> None:
        e = stack.pop()
        e["close"] = int(place[reader.CurrentByteIndex])
        if e["close"] > e["start"]:
            here()
        waiting.append((e, "stop"))

    reader.StartElementHandler, reader.EndElementHandler = opens, closes
    reader.CharacterDataHandler = reader.CommentHandler = reader.ProcessingInstructionHandler = reader.DefaultHandler = here
    reader.StartCdataSectionHandler = reader.EndCdataSectionHandler = here
    try:
        reader.Parse(raw, True)
    except expat.ExpatError as problem:
        raise ValueError(f"not well-formed: {problem}") from problem
    for element, field in waiting:
        element[field] = len(text)
    for e in out:
        close = e.pop("close")
        e["inner"] = text[e["begin"] : close] if close > e["start"] else ""
    return out


#: What in plain markup is left to the parser: control characters, and references but for names and usual numbers.
ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
REFERENCE = re.compile("&(?!(?:[A-Za-z][A-Za-z0-9]*|#[1-9][0-9]{2,3}|#x[1-9A-C][0-9A-Fa-f]{3});)")
CLOSING = re.compile("/([A-Za-z_][A-Za-z0-9._-]*)[ \t\r\n]*")
OPENING = re.compile("[A-Za-z_][A-Za-z0-9._-]*")
#: The most tags, and other short texts, that a worker remembers.
REMEMBERED = 20_000


@functools.lru_cache(REMEMBERED)
def _read(tag: str) -> tuple | None:
    """(name, attributes, whether it opens, whether it closes) of a tag, without its brackets, as the parser reads it by itself; None if it is no plain tag."""
    if closing := CLOSING.fullmatch(tag):
        return closing[1], None, False, True
    if opening := OPENING.match(tag):
        both = tag.endswith("/")
        try:
            (alone,) = parse(f"<{tag}>" if both else f"<{tag}></{opening[0]}>")
            return alone["tag"], alone["attrs"], True, both
        except ValueError:
            pass
    return None


class Shape:
    """What texts of the same tags in the same order have in common: elements (tag, attrs, parent, i, begin, j, close, stop), with parent -1 at the root. An element starts at the
    i-th of a text's places and its content begins so many characters after it; close and stop are counted from the j-th place."""

    def __init__(self, elements: list[tuple]):
        self.elements = elements

    def above(self, n: int) -> list[int]:
        """An element's ancestors, the nearest first."""
        out = []
        while (n := self.elements[n][2]) >= 0:
            out.append(n)
        return out

    @functools.cached_property
    def paths(self) -> list[list[int]]:
        return [self.above(n)[::-1] for n in range(len(self.elements))]

    def under(self, tag: str) -> list[bool]:
        """Of each element whether one of this tag holds it."""
        out: list[bool] = []
        for e in self.elements:
            out.append(e[2] >= 0 and (out[e[2]] or self.elements[e[2]][0] == tag))
        return out

    @functools.cached_property
    def quoted(self) -> list[bool]:
        return self.under("QUOT.S")

    @functools.cached_property
    def numbers(self) -> dict[int, int]:
        """The first number (NO.P) in each element that holds one, outside quoted acts."""
        out: dict[int, int] = {}
        for n, e in enumerate(self.elements):
            if e[0] == "NO.P" and not self.quoted[n]:
                over = e[2]
                while over >= 0 and over not in out:
                    out[over] = n
                    over = self.elements[over][2]
        return out

    @functools.cached_property
    def ordinals(self) -> dict[int, int]:
        """The places of ALINEA elements among those of their PARAG, from 1."""
        counts: dict[int, int] = {}
        out = {}
        for n, e in enumerate(self.elements):
            if e[0] == "ALINEA" and e[2] >= 0 and self.elements[e[2]][0] == "PARAG":
                out[n] = counts[e[2]] = counts.get(e[2], 0) + 1
        return out

    @functools.cached_property
    def body(self) -> list[tuple]:
        """(element, tag, identifier) of articles, paragraphs, and points of articles outside paragraphs, none of them quoted."""
        inside, outside = self.under("ARTICLE"), self.under("PARAG")
        live = [(n, e[0], e[1].get("IDENTIFIER")) for n, e in enumerate(self.elements) if not self.quoted[n]]
        return [x for x in live if x[1] in ("ARTICLE", "PARAG") or x[1] == "NP" and inside[x[0]] and not outside[x[0]]]

    @functools.cached_property
    def points(self) -> list[tuple]:
        """(element, numbers of the points around it and its own, ordinal of its ALINEA, identifier) of each numbered NP in a PARAG."""
        own = {n for n, e in enumerate(self.elements) if e[0] == "NP" and n in self.numbers and not self.quoted[n]}
        out = []
        for n in sorted(own):
            path = self.paths[n]
            steps = [self.numbers[x] for x in [*path, n] if x in own]
            k = min((self.ordinals[x] for x in path if x in self.ordinals), default=1)
            out += [(n, steps, k, self.elements[x][1].get("IDENTIFIER")) for x in path if self.elements[x][0] == "PARAG"]
        return out

    @functools.cached_property
    def items(self) -> list[tuple]:
        """(element, kind, what holds its label, what holds its text, marks from the outermost to itself) of what is marked in the contents: numbered paragraphs outside titles, sequences by
        their titles, dash entries."""
        tag = lambda n: self.elements[n][0] if n >= 0 else None
        contents = self.under("CONTENTS")
        inside = [n for n in range(len(self.elements)) if contents[n] and not self.quoted[n]]
        titles: dict[int, int] = {}
        np, held = [], set()
        for n in inside:
            if tag(n) == "TITLE":
                titles.setdefault(self.elements[n][2], n)
            elif tag(n) == "NP" and n in self.numbers:
                np.append(n)
                held.update(self.paths[n])
        marks: dict[int, tuple] = {}
        for n in np:
            over = self.elements[n][2]
            if not (tag(over) == "TITLE" or tag(over) == "TI" and tag(self.elements[over][2]) == "TITLE"):  # a title's paragraph numbers the sequence around it
                marks[n] = ("item", self.numbers[n], n)
        dashes = 0
        for n in inside:
            over = self.elements[n][2]
            if tag(n) == "GR.SEQ" and n in titles:
                head = titles[n]
                marks[n] = ("item", self.numbers[head], head) if head in self.numbers else ("section", head, head)
            elif tag(n) == "ITEM" and n not in held and tag(over) == "LIST" and self.elements[over][1].get("TYPE") == "DASH":
                dashes += 1
                marks[n] = ("dash", dashes, n)
        return [(n, *mark, [x for x in [*self.paths[n], n] if x in marks]) for n, mark in marks.items()]


def _shape(tags: tuple[str, ...]) -> Shape | None:
    """The shape of a text of these tags, which are the places; None if they are not plain or not matched."""
    out: list = []
    stack: list[tuple] = []
    above = -1
    for i, tag in enumerate(tags):
        known = _read(tag)
        if known is None:
            return None
        name, attrs, opens, closes = known
        if opens:
            if above < 0 and out:
                return None  # a second root
            one, width = (name, attrs, above, i, len(tag) + 2), len(tag) + 2
            if closes:
                out.append((*one, i, width, width))
            else:
                stack.append(one)
                above = len(out)
                out.append(None)
        else:
            if not stack or stack[-1][0] != name:
                return None
            e = stack.pop()
            out[above] = (*e, i, 0, len(tag) + 2)
            above = e[2]
    return None if stack or not out else Shape(out)


#: How many shapes a worker remembers, and of how many tags at most.
SHAPES, LENGTH = 2_000, 400
_remembered = functools.lru_cache(SHAPES)(_shape)


def scan(text: str) -> tuple[Shape, list[int]]:
    """What parse gives, as a shape and the places: plain markup is cut at its tags, each different tag is read by the parser once, and tags are matched once for each
    order of tags that is remembered; any other text is parsed as a whole."""
    pieces = text.split("<")
    # as many ">" as "<", one in each piece: brackets stand around tags alone
    if not pieces[0] and text.count(">") == len(pieces) - 1 and not REFERENCE.search(text) and (text.isascii() and text.isprintable() or not ODD.search(text)):
        del pieces[0]
        parts = [x.partition(">") for x in pieces]
        if parts and all([x[1] for x in parts]) and not parts[-1][2].strip(" \t\r\n"):
            tags = tuple([x[0] for x in parts])
            shape = _remembered(tags) if len(tags) <= LENGTH else _shape(tags)
            if shape:
                return shape, list(itertools.accumulate([len(x) + 1 for x in pieces], initial=0))
    out, places = [], []
    for n, e in enumerate(parse(text)):
        close = e["begin"] + len(e["inner"])
        out.append((e["tag"], e["attrs"], -1 if e["parent"] is None else e["parent"], 2 * n, e["begin"] - e["start"], 2 * n + 1, 0, e["stop"] - close))
        places += [e["start"], close]
    return Shape(out), places


#: The kinds of element columns besides file.
KINDS = {
    "elem": pa.int32(), "parent": pa.int32(), "tag": pa.string(), "attrs": pa.map_(pa.string(), pa.string()), "start": pa.int32(), "stop": pa.int32(), "depth": pa.int32(), "path": pa.list_(pa.int32()),
    "tags": pa.list_(pa.string()), "inner": pa.string(),
}
#: Rows of a batch that goes back to Spark, and the characters they hold at most, but for what one file adds.
ROWS, CHARS = 10_000, 4_000_000


def _by_file(texts: DataFrame, make, kinds: dict) -> DataFrame:
    """make(text) of each file: rows of what kinds names, with the file before them. Batches hold many files."""

    def run(batches):
        files, rows, held = [], [], 0

        def flush():
            cols = list(zip(*rows, strict=True)) or [[] for _ in kinds]
            return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), *[pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)]], names=["file", *kinds])

        for batch in batches:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = make(text)
                rows += found
                files += [file] * len(found)
                held += len(text)
                if len(rows) >= ROWS or held >= CHARS:
                    yield flush()
                    files, rows, held = [], [], 0
        if rows:
            yield flush()

    names = {pa.int32(): "int", pa.string(): "string", KINDS["attrs"]: "map<string,string>", KINDS["path"]: "array<int>", KINDS["tags"]: "array<string>"}
    return texts.select("file", "text").mapInArrow(run, ", ".join(["file string", *[f"{k} {names[t]}" for k, t in kinds.items()]]))


def elements(texts: DataFrame, columns: tuple[str, ...] = tuple(KINDS), only: tuple[str, ...] = ()) -> DataFrame:
    """texts (file, text) as element rows (see ELEMENTS), of these columns; with only, rows of elements of these tags."""
    kept_tags = frozenset(only)

    def make(text: str) -> list[tuple]:
        shape, at = scan(text)
        found = shape.elements
        out = []
        for n, (tag, attrs, parent, i, begin, j, close, stop) in enumerate(found):
            if not kept_tags or tag in kept_tags:
                path = shape.paths[n]
                one = {"elem": n, "parent": parent if parent >= 0 else None, "tag": tag, "attrs": list(attrs.items()), "start": at[i], "stop": at[j] + stop, "depth": len(path), "path": path}
                if "tags" in columns:
                    one["tags"] = [found[x][0] for x in path]
                if "inner" in columns:
                    one["inner"] = text[at[i] + begin : at[j] + close]
                out.append(tuple([one[c] for c in columns]))
        return out

    return _by_file(texts, make, {c: KINDS[c] for c in columns})


def visible(inner: Column) -> Column:
    """Markup as spaces, references resolved (in Python, as the whole table of names is needed), white space collapsed."""

    @F.pandas_udf("string")
    def read(s):
        return s.map(lambda x: None if x is None else " ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()))

    return read(inner)


def marker(inner: Column) -> Column:
    """(a) -> a, 1. -> 1, 3.1. -> 3.1; any other shape is an error."""
    bare = F.btrim(F.regexp_replace(inner, r"(?U)<[^>]+>|\s", ""), F.lit("()."))
    plain = F.translate(F.lower(bare), "abcdefghijklmnopqrstuvwxyz0123456789.", "") == ""
    return F.when(plain & (bare != ""), F.lower(bare)).when(inner.isNotNull(), F.raise_error(F.concat(F.lit("no such marker: "), inner)))


def _first_inside(elems: DataFrame, tag: str, out: str) -> DataFrame:
    """(file, elem, out): the inner text of each element's first descendant of this tag."""
    inside = elems.filter(F.col("tag") == tag).select("file", F.explode("path").alias("elem"), F.struct("start", "inner").alias("x"))
    return inside.groupBy("file", "elem").agg(F.min("x").alias("x")).select("file", "elem", F.col("x.inner").alias(out))


def annex_order(elems: DataFrame) -> DataFrame:
    """(file, n, member): the annex files in the order of the publication document."""
    subs = elems.filter("tag = 'DOC.SUB.PUB' and attrs['TYPE'] = 'ANNEX'").select("file", "elem", "start")
    refs = elems.filter("tag = 'REF.PHYS'").select("file", F.explode("path").alias("elem"), F.struct("start", F.col("attrs")["FILE"].alias("f")).alias("x")).groupBy("file", "elem").agg(F.min("x").alias("x"))
    return subs.join(refs, ["file", "elem"]).select("file", F.row_number().over(Window.partitionBy("file").orderBy("start")).alias("n"), F.col("x.f").alias("member"))


def annex_items(elems: DataFrame, root: str) -> DataFrame:
    """(file, id, parent_id, marker, text, start, stop) of annex items.

    An item is a numbered paragraph (NP) outside quoted acts and titles, a sequence (GR.SEQ) whose title is numbered, or an
    unnumbered dash entry. A sequence with a section heading gives its items' ids a section part but is no parent.
    """
    live = elems.filter(~F.array_contains("tags", "QUOT.S"))
    titles = live.filter("tag = 'TI'").select("file", "start", F.regexp_extract("inner", r"(?U)ANNEX\s+([IVXLC]+)", 1).alias("roman")).filter("roman <> ''")
    annex = titles.groupBy("file").agg(F.min_by("roman", "start").alias("roman")).withColumn("annex_id", F.concat(F.lit(f"{root}:annex-"), F.lower("roman")))
    inside = live.filter(F.array_contains("tags", "CONTENTS"))
    numbers = _first_inside(live, "NO.P", "no")
    parents = elems.select("file", F.col("elem").alias("parent"), F.col("tag").alias("parent_tag"), F.col("parent").alias("over"))
    over = elems.select("file", F.col("elem").alias("over"), F.col("tag").alias("over_tag"))
    np = inside.filter("tag = 'NP'").join(parents, ["file", "parent"], "left").join(over, ["file", "over"], "left").join(numbers, ["file", "elem"])
    in_title = (F.col("parent_tag") == "TITLE") | ((F.col("parent_tag") == "TI") & (F.col("over_tag") == "TITLE"))
    # a title's paragraph numbers the sequence around it
    numbered = np.filter(~in_title).select("file", "elem", F.lit("item").alias("kind"), marker(F.col("no")).alias("label"), "start", "stop", F.col("inner").alias("body"), "no")
    sequences = inside.filter("tag = 'GR.SEQ'").select("file", "elem", "start", "stop")
    heads = inside.filter("tag = 'TITLE'").select("file", F.col("parent").alias("elem"), F.col("elem").alias("title"), F.col("inner").alias("head"), F.col("start").alias("_t"))
    first = Window.partitionBy("file", "elem").orderBy("_t")
    heads = heads.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r", "_t")
    seq = sequences.join(heads, ["file", "elem"]).join(numbers.select("file", F.col("elem").alias("title"), "no"), ["file", "title"], "left")
    section = F.regexp_extract(F.trim(F.regexp_replace("head", "<[^>]+>", " ")), r"(?iU)^\s*Section\s+([A-Za-z0-9]+)", 1)
    labelled = seq.select("file", "elem", F.when(F.col("no").isNotNull(), "item").otherwise("section").alias("kind"), F.when(F.col("no").isNotNull(), marker(F.col("no"))).otherwise(F.lower(section)).alias("label"), "start", "stop", F.col("head").alias("body"), "no")
    lists = elems.filter("tag = 'LIST' and attrs['TYPE'] = 'DASH'").select("file", F.col("elem").alias("parent"))
    held = np.select("file", F.explode("path").alias("elem")).distinct()
    dashes = inside.filter("tag = 'ITEM'").join(lists, ["file", "parent"], "left_semi").join(held, ["file", "elem"], "left_anti")
    dash = dashes.withColumn("_k", F.row_number().over(Window.partitionBy("file").orderBy("start"))).select("file", "elem", F.lit("dash").alias("kind"), F.col("_k").cast("string").alias("label"), "start", "stop", F.col("inner").alias("body"), F.lit(None).cast("string").alias("no"))
    marks = numbered.unionByName(labelled).unionByName(dash)
    chain = marks.join(elems.select("file", "elem", F.concat("path", F.array("elem")).alias("chain")), ["file", "elem"]).select("file", F.col("elem").alias("self"), F.explode("chain").alias("elem"))
    steps = chain.join(marks.select("file", "elem", "kind", "label", "start"), ["file", "elem"]).groupBy("file", F.col("self").alias("elem")).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "label"))).alias("steps"))
    whole = marks.filter("kind <> 'section'").join(steps, ["file", "elem"]).join(annex, "file")

    def written(s: Column) -> Column:
        items = F.filter(s, lambda x: x["kind"] == "item")
        one = lambda x: F.when(x["kind"] == "section", F.concat(F.lit("section-"), x["label"])).when(x["kind"] == "dash", F.concat(F.lit("item-"), x["label"]))
        return F.concat_ws(":", F.col("annex_id"), F.array_join(F.transform(s, lambda x: one(x).otherwise(F.when(x["start"] == F.get(items, F.lit(0))["start"], F.concat(F.lit("point-"), x["label"])).otherwise(x["label"]))), ":"))

    outer = F.slice("steps", 1, F.size("steps") - 1)
    last_item = F.size(F.filter(outer, lambda x: x["kind"] == "item"))
    position = F.when(last_item > 0, F.size(outer) - F.array_position(F.reverse(F.transform(outer, lambda x: (x["kind"] == "item").cast("int"))), 1) + 1)
    parent = F.when(last_item > 0, written(F.slice("steps", 1, F.greatest(position.cast("int"), F.lit(1))))).otherwise(F.col("annex_id"))
    bare = F.when(F.col("no").isNotNull(), F.regexp_replace("body", r"(?s)^(.*?)<NO\.P\b[^>]*>.*?</NO\.P>", "$1 ")).otherwise(F.col("body"))
    return whole.select("file", written(F.col("steps")).alias("id"), parent.alias("parent_id"), F.when(F.col("kind") == "dash", "-").otherwise(F.col("label")).alias("marker"), visible(bare).alias("text"), "start", "stop")


def points(elems: DataFrame, root: str) -> DataFrame:
    """(file, id, paragraph_id, parent_id, marker, text, start, stop) of the numbered points of paragraphs (PARAG IDENTIFIER=aaa.ppp).

    Where markers repeat within a paragraph, ids of its outer points name the subparagraph (ALINEA) that holds them.
    """
    live = elems.filter(~F.array_contains("tags", "QUOT.S"))
    paragraphs = live.filter("tag = 'PARAG'").select("file", F.col("elem").alias("parag"), F.split(F.col("attrs")["IDENTIFIER"], r"\.").alias("n"))
    paragraphs = paragraphs.select("file", "parag", F.concat(F.lit(f"{root}:article-"), F.col("n")[0].cast("int").cast("string"), F.lit(":paragraph-"), F.col("n")[1].cast("int").cast("string")).alias("paragraph_id"))
    numbers = _first_inside(live, "NO.P", "no")
    np = live.filter("tag = 'NP'").join(numbers, ["file", "elem"]).withColumn("label", marker(F.col("no")))
    held = np.select("file", "elem", F.explode("path").alias("parag")).join(paragraphs, ["file", "parag"])
    alineas = alinea_ordinals(elems)
    inside = np.select("file", "elem", F.explode("path").alias("alinea")).join(alineas.select("file", F.col("elem").alias("alinea"), "k"), ["file", "alinea"]).groupBy("file", "elem").agg(F.min("k").alias("k"))
    base = np.join(held.select("file", "elem", "paragraph_id"), ["file", "elem"]).join(inside, ["file", "elem"], "left")
    chain = base.select("file", F.col("elem").alias("self"), F.explode(F.concat("path", F.array("elem"))).alias("elem"))
    steps = chain.join(np.select("file", "elem", "label", "start"), ["file", "elem"]).groupBy("file", F.col("self").alias("elem")).agg(F.array_sort(F.collect_list(F.struct("start", "label"))).alias("steps"))
    whole = base.join(steps, ["file", "elem"])
    outer = whole.filter(F.size("steps") == 1).groupBy("file", "paragraph_id", "label").agg(F.count("*").alias("n"))
    collides = outer.groupBy("file", "paragraph_id").agg((F.max("n") > 1).alias("collides"))
    whole = whole.join(collides, ["file", "paragraph_id"], "left")
    labels = F.transform("steps", lambda x: x["label"])
    scope = F.when(F.col("collides"), F.concat(F.col("paragraph_id"), F.lit(":subparagraph-"), F.coalesce("k", F.lit(1)).cast("string"))).otherwise(F.col("paragraph_id"))
    name = F.concat(scope, F.lit(":point-"), F.array_join(labels, ":"))
    above = F.when(F.size("steps") == 1, F.col("paragraph_id")).otherwise(F.concat(scope, F.lit(":point-"), F.array_join(F.slice(labels, 1, F.size("steps") - 1), ":")))
    body = F.regexp_replace("inner", r"(?s)^(.*?)<NO\.P\b[^>]*>.*?</NO\.P>", "$1 ")
    return whole.select("file", name.alias("id"), "paragraph_id", above.alias("parent_id"), F.col("label").alias("marker"), visible(body).alias("text"), "start", "stop")


def alinea_ordinals(elems: DataFrame) -> DataFrame:
    """(file, elem, parag, k, inner, start, stop): the direct ALINEA children of each PARAG, counted from 1."""
    parag = elems.filter("tag = 'PARAG'").select("file", F.col("elem").alias("parent"))
    own = elems.filter("tag = 'ALINEA'").join(parag, ["file", "parent"], "left_semi")
    return own.select("file", "elem", F.col("parent").alias("parag"), F.row_number().over(Window.partitionBy("file", "parent").orderBy("start")).alias("k"), "inner", "start", "stop")


def subparagraphs(elems: DataFrame, root: str) -> DataFrame:
    """(file, id, paragraph_id, k, text): ALINEA children from the second on."""
    numbers = elems.filter("tag = 'PARAG'").select("file", F.col("elem").alias("parag"), F.split(F.col("attrs")["IDENTIFIER"], r"\.").alias("n"))
    name = F.concat(F.lit(f"{root}:article-"), F.col("n")[0].cast("int").cast("string"), F.lit(":paragraph-"), F.col("n")[1].cast("int").cast("string"))
    return alinea_ordinals(elems).filter("k > 1").join(numbers, ["file", "parag"]).select("file", F.concat(name, F.lit(":subparagraph-"), F.col("k").cast("string")).alias("id"), name.alias("paragraph_id"), "k", visible(F.col("inner")).alias("text"))


def definitions(spans: DataFrame, root: str) -> DataFrame:
    """spans (id, inner) of defining points: (id, term, source_id) by the first quoted term of each."""
    term = F.regexp_extract("inner", r"(?s)<QUOT\.START[^>]*/>(.*?)<QUOT\.END[^>]*/>", 1)
    found = spans.withColumn("term", F.trim(F.regexp_replace(F.regexp_replace(term, "<[^>]+>", " "), r"\s+", " "))).filter("term <> ''")
    return found.select(F.concat(F.lit(f"{root}:definition:"), slug(F.col("term"))).alias("id"), "term", F.col("id").alias("source_id"))


def defined_terms(spans: DataFrame, root: str, build_id: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of defining points (id, inner): a Definition (id, type, layer, term) for each and the DEFINES_TERM edge that leads to it. A point without a quoted term,
    and two terms that have the same id, fail the job: nothing is guessed."""
    found = spans.select("id").join(definitions(spans, root).withColumnRenamed("id", "definition_id"), F.col("id") == F.col("source_id"), "left")
    alone = F.count("*").over(Window.partitionBy("definition_id")) == 1
    fails = lambda text: F.raise_error(F.concat(F.lit(text), F.col("id"))).cast("string")
    name = F.when(F.col("definition_id").isNull(), fails("no quoted term: ")).when(~F.col("alone"), fails("a term that another point defines: ")).otherwise(F.col("definition_id"))
    checked = found.withColumn("alone", alone).select(name.alias("dst"), "term", F.col("id").alias("src"))
    nodes = checked.select(F.col("dst").alias("id"), F.lit("Definition").alias("type"), F.lit(1).alias("layer"), "term")
    edges = checked.select(F.concat(F.lit("edge:defines_term:"), "dst").alias("edge_id"), F.lit("DEFINES_TERM").alias("edge_type"), "src", "dst", F.lit("EXTRACTED_SOURCE").alias("provenance_class"), F.lit(build_id).alias("build_id"))
    return nodes, edges


# The same questions asked of each file's text in one pass where it is parsed, so that nothing but the texts is brought together. They give what the joins above give of elements(texts).

_NUMBER = re.compile(r"^(.*?)<NO\.P\b[^>]*>.*?</NO\.P>", re.S)
_MARKUP = re.compile(r"<[^>]+>")
_SPACED = re.compile(r"<[^>]+>|\s")
_LABEL = re.compile(r"[a-z0-9.]+")
_ANNEX = re.compile(r"ANNEX\s+([IVXLC]+)")
_SECTION = re.compile(r"^\s*Section\s+([A-Za-z0-9]+)", re.I)


def _visible(inner: str) -> str:
    return " ".join(html.unescape(_MARKUP.sub(" ", inner)).split())


@functools.lru_cache(REMEMBERED)
def _marker(inner: str) -> str:
    found = _SPACED.sub("", inner).strip("().").lower()
    if not _LABEL.fullmatch(found):
        raise ValueError(f"no such marker: {inner}")
    return found


@functools.lru_cache(REMEMBERED)
def _paragraph(name: str | None, root: str) -> str | None:
    """An identifier aaa.ppp as a node's id; null without one, and parts that are no numbers are an error."""
    if name is None:
        return None
    parts = name.split(".")
    if len(parts) < 2 or not all(re.fullmatch(r"\s*[+-]?[0-9]+\s*", x) for x in parts[:2]):
        raise ValueError(f"no such paragraph: {name}")
    return f"{root}:article-{int(parts[0])}:paragraph-{int(parts[1])}"


def _inner(text: str, at: list[int], e: tuple) -> str:
    return text[at[e[3]] + e[4] : at[e[5]] + e[6]]


POINTS = {"id": pa.string(), "paragraph_id": pa.string(), "parent_id": pa.string(), "marker": pa.string(), "text": pa.string(), "start": pa.int32(), "stop": pa.int32(), "inner": pa.string()}


def points_of(texts: DataFrame, root: str, columns: tuple[str, ...] = tuple(POINTS)[:-1]) -> DataFrame:
    """points(elements(texts)), of these columns; inner is a point's markup."""
    def make(text: str) -> list[tuple]:
        shape, at = scan(text)
        found = shape.elements
        rows, outer, collides = [], set(), set()
        for n, steps, k, name in shape.points:
            labels = [_marker(_inner(text, at, found[x])) for x in steps]
            paragraph = _paragraph(name, root)
            rows.append((n, labels, k, paragraph))
            if len(labels) == 1:
                if (paragraph, labels[0]) in outer:
                    collides.add(paragraph)
                outer.add((paragraph, labels[0]))
        out = []
        for n, labels, k, paragraph in rows:
            e = found[n]
            inner = _inner(text, at, e)
            one = {"paragraph_id": paragraph, "marker": labels[-1], "start": at[e[3]], "stop": at[e[5]] + e[7], "inner": inner, "id": None, "parent_id": None}
            if paragraph is not None:
                scope = f"{paragraph}:subparagraph-{k}" if paragraph in collides else paragraph
                one["id"] = f"{scope}:point-{':'.join(labels)}"
                one["parent_id"] = f"{scope}:point-{':'.join(labels[:-1])}" if len(labels) > 1 else paragraph
            if "text" in columns:
                one["text"] = _visible(_NUMBER.sub(r"\1 ", inner, count=1))
            out.append(tuple([one[c] for c in columns]))
        return out

    return _by_file(texts, make, {c: POINTS[c] for c in columns})


def subparagraphs_of(texts: DataFrame, root: str) -> DataFrame:
    """subparagraphs(elements(texts))."""

    def make(text: str) -> list[tuple]:
        shape, at = scan(text)
        out = []
        for n, k in shape.ordinals.items():
            if k > 1:
                e = shape.elements[n]
                name = _paragraph(shape.elements[e[2]][1].get("IDENTIFIER"), root)
                out.append((None if name is None else f"{name}:subparagraph-{k}", name, k, _visible(_inner(text, at, e))))
        return out

    return _by_file(texts, make, {"id": pa.string(), "paragraph_id": pa.string(), "k": pa.int32(), "text": pa.string()})


def annex_items_of(texts: DataFrame, root: str) -> DataFrame:
    """annex_items(elements(texts))."""

    def make(text: str) -> list[tuple]:
        shape, at = scan(text)
        found = shape.elements
        inner = lambda n: _inner(text, at, found[n])
        roman = next((m[1] for n, e in enumerate(found) if e[0] == "TI" and not shape.quoted[n] and (m := _ANNEX.search(inner(n)))), None)
        if roman is None:
            return []
        annex = f"{root}:annex-{roman.lower()}"
        kinds, names = {}, {}  # names: as the outermost item, and within one
        for n, kind, label, _, _ in shape.items:
            kinds[n] = kind
            if kind == "item":
                names[n] = _marker(inner(label))
            elif kind == "section":
                section = _SECTION.search(_MARKUP.sub(" ", inner(label)).strip(" "))
                names[n] = f"section-{section[1].lower() if section else ''}"
            else:
                names[n] = f"item-{label}"

        def written(steps: list[int]) -> str:
            outermost = next((x for x in steps if kinds[x] == "item"), None)
            return ":".join([annex, *["point-" + names[x] if x == outermost else names[x] for x in steps]])

        out = []
        for n, kind, label, body, steps in shape.items:
            if kind != "section":
                last = max((i for i, x in enumerate(steps[:-1]) if kinds[x] == "item"), default=-1)
                parent = written(steps[: last + 1]) if last >= 0 else annex
                bare = _NUMBER.sub(r"\1 ", inner(body), count=1) if kind == "item" else inner(body)
                out.append((written(steps), parent, "-" if kind == "dash" else names[n], _visible(bare), at[found[n][3]], at[found[n][5]] + found[n][7]))
        return out

    return _by_file(texts, make, {"id": pa.string(), "parent_id": pa.string(), "marker": pa.string(), "text": pa.string(), "start": pa.int32(), "stop": pa.int32()})


@functools.lru_cache(REMEMBERED)
def _claimed(name: str | None, root: str) -> list[tuple]:
    shown, parts = name or "", (name or "").split(".")
    out = [] if re.fullmatch(r"[0-9]{3}\.[0-9]{3}", shown) else [("identifier", shown)]
    numbers = [int(x) if re.fullmatch(r"\s*[+-]?[0-9]{1,9}\s*", x) else None for x in parts[:2]]
    return out if len(numbers) < 2 or None in numbers else [*out, ("paragraph", f"{root}:article-{numbers[0]}:paragraph-{numbers[1]}")]


def claims_of(texts: DataFrame, root: str) -> DataFrame:
    """(file, gate, id): what a main body's gates ask of elements(texts) (see gates.claims)."""

    def make(text: str) -> list[tuple]:
        shape, _ = scan(text)
        out = []
        for n, tag, name in shape.body:
            if tag == "PARAG":
                out += _claimed(name, root)
            else:
                out.append(("articles", None) if tag == "ARTICLE" else ("stray_point", str(n)))
        return out

    return _by_file(texts, make, {"gate": pa.string(), "id": pa.string()})
