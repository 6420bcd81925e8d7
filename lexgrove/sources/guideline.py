"""Sections and subtopics of a guideline text by its headings."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.functions.text import collapsed, slug

SECTIONS = 7
TAIL, WORDS, CHARS, DESCRIPTION = 6000, 7, 60, 600


def _matches(texts: DataFrame, pattern: str) -> DataFrame:
    """(file, n, start, one, two): matches of a multi-line pattern with their offsets in code points."""

    def run(batches):
        rule = re.compile(pattern, re.M)
        for batch in batches:
            rows = [(f, n, m.start(), m[1], m[2]) for f, t in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True) for n, m in enumerate(rule.finditer(t))]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "n", "start", "one", "two"])

    return texts.select("file", "text").mapInArrow(run, "file string, n int, start int, one string, two string")


def sections(texts: DataFrame, tail: int | None = TAIL) -> DataFrame:
    """(file, ord, name, description, start, stop): exactly seven headings `1.n title`, or the job fails; the last ends `tail` after it starts, as
    other chapters follow it, or with the text where tail is None."""
    found = _matches(texts, r"^1\.([1-7])\.?\s+(\S[^\n]*)$")
    counts = found.groupBy("file").agg(F.count("*").alias("found"))
    checked = found.join(counts, "file").withColumn("start", F.when(F.col("found") == SECTIONS, F.col("start")).otherwise(F.raise_error(F.lit("not seven headings")).cast("int")))
    joined = checked.join(texts, "file").withColumn("stop", F.coalesce(F.lead("start").over(Window.partitionBy("file").orderBy("start")), F.length("text") if tail is None else F.least(F.col("start") + tail, F.length("text"))))
    body = F.regexp_replace(F.expr("substring(text, start + 1, stop - start)"), r"^[^\n]*\n", "")
    return joined.select("file", F.col("one").cast("int").alias("ord"), F.trim("two").alias("name"), collapsed(F.regexp_extract(body, r"(?s)^\s*(.*?)(?:\n[ \t]*\n|$)", 1)).alias("description"), "start", "stop")


def subtopics(texts: DataFrame, tail: int | None = TAIL) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) candidate headings within sections: a line's start up to its first period, at most WORDS words and CHARS
    characters without punctuation or digits, with a capital after it. A subtopic ends at the next one or with its section."""
    found = _matches(texts, r"^([A-Z][^\n]*?)\.[ \t]+(\S)").select("file", F.col("start").alias("at"), F.col("one").alias("heading"), F.col("two").alias("tail"))
    within = found.join(sections(texts, tail).select("file", "ord", "start", "stop"), "file").filter("start <= at and at < stop")  # seven sections a file
    n = F.size(F.filter(F.split("heading", r"\s+"), lambda x: x != ""))
    reason = F.when((n < 1) | (n > WORDS), "words").when(F.length("heading") > CHARS, "length").when(F.col("heading").rlike(r"[,;:()\d]"), "punctuation").when(~F.col("tail").rlike(r"^\p{Lu}"), "no_sentence")
    judged = within.withColumn("reason", reason)
    good = judged.filter("reason is null").withColumn("until", F.coalesce(F.lead("at").over(Window.partitionBy("file", "ord").orderBy("at")), "stop")).join(texts, "file")
    after = F.expr("substring(text, at + length(heading) + 2, until - at - length(heading) - 1)")
    sentence = F.substring(F.regexp_extract(collapsed(after), r"^(.*?\.(?=\s+[A-Z0-9(])|.*$)", 1), 1, DESCRIPTION)
    accepted = good.select("file", "ord", F.row_number().over(Window.partitionBy("file", "ord").orderBy("at")).alias("k"), "heading", slug(F.col("heading")).alias("slug"), sentence.alias("description"), F.col("at").alias("start"), F.col("until").alias("stop"))
    return accepted, judged.filter("reason is not null").select("file", "ord", "heading", F.col("at").alias("start"), "reason")
