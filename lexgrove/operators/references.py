"""Cross-references in legal text: mentions with their offsets, whether they point outside, the targets they name, and resolution.

A text is cut into words, numbers and marks; a small reader walks over these from each keyword. Everything after that is joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.text import roman
from lexgrove.operators.windows import positions

# The words of citations.
KINDS = {"Article": "article", "Articles": "article", "Annex": "annex", "Annexes": "annex", "Chapter": "chapter", "Chapters": "chapter"}
INSTRUMENTS = ("Regulation", "Directive", "Decision")
OWN_PARTS = ("Regulation", "Article", "Chapter", "Section", "Annex", "paragraph")
JOINING = ("and", "or", "to")
DETAIL = (",", *JOINING, "point", "points", "paragraph", "paragraphs", "subparagraph", "subparagraphs", "first", "second", "third", "fourth", "fifth")
UNIONS = ("EU", "EC", "EEC")
RECITAL_ONLY = ("Treaty", "Treaties", "Charter", "Protocol")
TREATIES = ("TFEU", "TEU")
#: Code points after and before a mention that are looked at.
WINDOW, RECITAL_WINDOW = 60, 90

ORDER = ("article", "annex", "chapter")
MENTION = "kind string, rule int, start int, stop int, mention string, named array<struct<n:int,paragraph:string>>, external string, recital_external boolean"
_PIECE = re.compile("[A-Za-z]+|[0-9]+|[^\\s]")
_SIGNS = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_value(word: str) -> int | None:
    """Value of a Roman numeral in its usual form; None for any other word."""
    if not word or set(word) - _SIGNS.keys():
        return None
    values = [_SIGNS[x] for x in word]
    total = sum(-v if v < max(values[i + 1 :], default=0) else v for i, v in enumerate(values))
    written, left = "", total
    for value, form in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        written += form * (left // value)
        left %= value
    return total if written == word else None


class Citations:
    """The pieces of a text and what is cited in it."""

    def __init__(self, text: str):
        self.text = text
        self.pieces = [(m[0], m.start(), m.end()) for m in _PIECE.finditer(text)]

    def word(self, i: int) -> str:
        return self.pieces[i][0] if 0 <= i < len(self.pieces) else ""

    def apart(self, i: int) -> bool:
        """Whether white space stands between a piece and the one before it."""
        return 0 < i < len(self.pieces) and self.pieces[i][1] > self.pieces[i - 1][2]

    def closed(self, i: int) -> int:
        """Where a bracket that opens at piece i and holds one short name has ended; i if there is none."""
        if self.word(i) == "(":
            for j in (i + 2, i + 3):
                if self.word(j) == ")" and all(self.word(k).isalnum() for k in range(i + 1, j)):
                    return j + 1
        return i

    def item(self, i: int, kind: str) -> tuple[int, str | None, int] | None:
        """(number, paragraph, next piece) if a number of this kind is at i."""
        if kind != "article":
            value = roman_value(self.word(i))
            return None if value is None else (value, None, i + 1)
        if not self.word(i).isdecimal():
            return None
        if self.word(i + 1) == "(" and self.word(i + 2).isdecimal() and self.word(i + 3) == ")" and not any(map(self.apart, (i + 1, i + 2, i + 3))):
            return int(self.word(i)), self.word(i + 2), i + 4
        return int(self.word(i)), None, i + 1

    def mentions(self) -> Iterator[tuple[str, int, int, list]]:
        """(kind, first piece, piece after the last, numbers) of each list of numbers after a keyword; `to` stands for all between if
        it goes up."""
        i = 0
        while i < len(self.pieces):
            kind, found = KINDS.get(self.word(i)), None
            if kind and self.apart(i + 1):
                found = self.item(i + 1, kind)
            if not found:
                i += 1
                continue
            named, begin, i = [found[:2]], i, found[2]
            while True:
                link = self.word(i)
                fits = link == "," or link in JOINING and self.apart(i) and self.apart(i + 1)
                found = self.item(i + 1, kind) if fits else None
                if not found:
                    break
                if link == "to":
                    named += [(n, None) for n in range(named[-1][0] + 1, found[0])]
                named.append(found[:2])
                i = found[2]
            yield kind, begin, i, named

    def instrument(self, i: int) -> int | None:
        """The piece after the name and number of an instrument that begins at i."""
        if self.word(i) not in INSTRUMENTS:
            return None
        i += 1
        if self.word(i) == "(" and self.word(i + 1) in UNIONS:
            end = next((j for j in range(i + 2, i + 5) if self.word(j) == ")"), None)
            i = i if end is None else end + 1
        if self.word(i) == "No":
            i += 1 + (self.word(i + 1) == ".")
        if self.word(i).isdecimal() and self.word(i + 1) == "/" and self.word(i + 2).isdecimal():
            i += 3
            if self.word(i) == "/" and self.word(i + 1) in UNIONS:
                i += 2
        return i

    def external(self, begin: int, end: int) -> str | None:
        """The citation if a mention's pieces [begin, end) belong to another instrument: one that follows after its details, or one that
        stands before it in the same clause."""
        start, stop = self.pieces[begin][1], self.pieces[end - 1][2]
        i = end
        while self.word(i) in DETAIL or self.closed(i) > i:
            i = max(self.closed(i), i + 1)
        if self.word(i) == "of" and self.pieces[i][2] <= stop + WINDOW:
            if self.word(i + 1) == "this" and self.word(i + 2) in OWN_PARTS:
                return None
            after = self.instrument(i + 1 + (self.word(i + 1) == "the"))
            if after is not None:
                return self.text[start : self.pieces[after - 1][2]]
        first, i = None, begin - 1
        while i >= 0 and self.pieces[i][1] >= start - WINDOW and (self.word(i) not in (".", ";") or self.word(i - 1) == "No"):
            after = self.instrument(i)
            if after is not None and (self.word(after - 1).isdecimal() or self.word(after - 1) in UNIONS):
                first = i
            i -= 1
        return None if first is None else self.text[self.pieces[first][1] : stop]

    def of_recital(self, end: int) -> bool:
        """Whether, of the marks after a recital's mention, one that points outside comes before one that points inside."""
        stop = self.pieces[end - 1][2] + RECITAL_WINDOW
        for i in range(end, len(self.pieces)):
            if self.pieces[i][2] > stop:
                break
            if self.word(i) in TREATIES:
                return True
            if self.word(i) == "of":
                what = self.word(i + 1)
                if what == "this" and self.word(i + 2) == "Regulation":
                    return False
                if what in INSTRUMENTS or what == "Protocol" or what in ("that", "Council") and self.word(i + 2) in INSTRUMENTS or what == "the" and self.word(i + 2) in RECITAL_ONLY:
                    return True
        return False


def mentions(units: DataFrame, key: str, text: str) -> DataFrame:
    """(key, MENTION): offsets count code points, which no built-in gives together with the match, so the reader runs over Arrow batches;
    named holds the numbers in order, each once."""
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.struct([("n", pa.int32()), ("paragraph", pa.string())])), pa.string(), pa.bool_()]
    names = [key, "kind", "rule", "start", "stop", "mention", "named", "external", "recital_external"]

    def run(batches):
        for batch in batches:
            rows, out = [], []
            for i, x in enumerate(batch.column(text).to_pylist()):
                if not x or not any(word in x for word in ("Article", "Annex", "Chapter")):
                    continue
                read = Citations(x)
                for kind, begin, end, named in read.mentions():
                    start, stop, external = read.pieces[begin][1], read.pieces[end - 1][2], read.external(begin, end)
                    rows.append(i)
                    out.append((kind, ORDER.index(kind), start, stop, x[start:stop], [{"n": n, "paragraph": p} for n, p in dict.fromkeys(named)], external, external is not None or read.of_recital(end)))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), *(pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds))], names=names)

    return units.select(key, text).mapInArrow(run, f"{key} {units.schema[key].dataType.simpleString()}, {MENTION}")


def targets(found: DataFrame, root: str) -> DataFrame:
    """A row for each named target, in order: target, and precise, the paragraph that an article's number names. A mention that names nothing has one
    row, without them."""
    named = found.select("*", F.posexplode_outer("named").alias("ord", "x")).drop("named")
    number = F.when(F.col("kind") == "article", F.col("x.n").cast("string")).otherwise(F.lower(roman(F.col("x.n"))))
    target = F.concat(F.lit(root + ":"), F.col("kind"), F.lit("-"), number)
    return named.withColumn("target", target).withColumn("precise", F.concat("target", F.lit(":paragraph-"), F.col("x.paragraph"))).drop("x")


def _present(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """named with hit: the paragraph if it exists, else its article, annex or chapter if that does, else null."""
    ids = nodes.select("id").distinct()
    named = named.join(ids.select(F.col("id").alias("target"), F.lit(True).alias("_t")), "target", "left")
    named = named.join(ids.select(F.col("id").alias("precise"), F.lit(True).alias("_p")), "precise", "left")
    return named.withColumn("hit", F.when(F.col("_t"), F.when(F.col("_p"), F.col("precise")).otherwise(F.col("target")))).drop("_t", "_p")


def resolve(units: DataFrame, key: str, text: str, nodes: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(edges, queue). edges: from_id, target (the paragraph if it exists, else what holds it), mention, first of each (from, target) in
    the order of the text; queue: from_id, mention, reason, each once."""
    named = _present(targets(mentions(units, key, text).withColumnRenamed(key, "from_id"), root), nodes)
    first = F.min(F.struct("rule", "start", "ord", "mention")).alias("x")
    edges = named.filter("external is null and hit is not null").groupBy("from_id", F.col("hit").alias("target")).agg(first)
    # one plan for both reasons, so each text is read once
    reason = F.when(F.col("external").isNotNull(), "external_instrument").when(F.col("hit").isNull() & F.col("target").isNotNull(), "unresolved_target")
    queue = named.select("from_id", F.coalesce("external", "mention").alias("mention"), reason.alias("reason")).filter("reason is not null").distinct()
    return edges.select("from_id", "target", "x.mention", "x.rule", "x.start", "x.ord"), queue


def context_edges(recitals: DataFrame, key: str, text: str, nodes: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(edges, queue) of recitals: CONTEXT_FOR edges (from_id, target, mention) to articles they mention, each pair once; mentions that the
    stricter test finds outside, or whose article doesn't exist, are queued."""
    found = mentions(recitals, key, text).withColumnRenamed(key, "from_id").filter("kind = 'article'")
    named = targets(found, root).join(nodes.select(F.col("id").alias("target"), F.lit(True).alias("_t")).distinct(), "target", "left")
    outside = F.col("recital_external")
    reason = F.when(outside, "external_instrument").when(F.col("_t").isNull() & F.col("target").isNotNull(), "unresolved_target")
    queue = named.select("from_id", F.when(outside, F.coalesce("external", "mention")).otherwise(F.col("mention")).alias("mention"), reason.alias("reason")).filter("reason is not null").distinct()
    edges = named.filter("_t and not recital_external").groupBy("from_id", "target").agg(F.min(F.struct("start", "mention")).alias("x")).select("from_id", "target", "x.mention", F.lit("CONTEXT_FOR").alias("edge_type"))
    return edges, queue


def article_source(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """edges (from_id, ...) with source: the article that a paragraph's identifier names, else its parent by parents (src, dst), else itself."""
    held = parents.groupBy(F.col("dst").alias("from_id")).agg(F.min("src").alias("_parent"))
    named = F.nullif(F.regexp_extract("from_id", r"^(.*:article-[0-9]+):paragraph-[0-9]+$", 1), F.lit(""))
    return edges.join(held, "from_id", "left").withColumn("source", F.coalesce(named, "_parent", "from_id")).drop("_parent")


def numbered(edges: DataFrame, prefix: str) -> DataFrame:
    """edges with edge_id in document order, counted without gaps."""
    return positions(edges, ["from_id", "rule", "start", "ord"], "_n").withColumn("edge_id", F.concat(F.lit(prefix), (F.col("_n") + 1).cast("string"))).drop("_n")
