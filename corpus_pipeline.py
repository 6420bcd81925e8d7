"""A training corpus from `documents` in five stages.

Language identification and the quality ranking drop what they reject, one document of each group of near-duplicates (shingles of
five words, similarity 0.8) stays, sources are mixed to their target weights (documents may repeat, and the last of a source may
be cut) and put in the schedule's order, and the mix is packed into windows, whose ids are returned. Every stage but the last returns the columns of documents.

Columns other than doc_id, text, lang and source are carried along; columns with names of the operators' own don't reach them, as
each reads only the columns it needs.

Defined results: rows with null doc_id are judged like any by language and quality, and stay beside near-duplicates, as nothing
orders them; null and empty texts have no text evidence of language, are scored like any text, are near-duplicates of nothing,
and drop out in the mix, which takes words; rows of equal doc_id are judged each, and of those whose texts are near-duplicates, or
the same, one stays; very long texts are treated whole; an empty table passes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexgrove.llm import chosen_path, language, mixing, packing, quality
from lexgrove.llm.common import materialise, table
from lexgrove.llm.encoders import tokenizer_path

#: The mix depends on hashes, ranks and models that SQL doesn't express; tests hold the stages against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.kept(docs)


def rank_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.representatives(docs, 5, 80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", rank_quality),
    ("near-duplicates", remove_near_duplicates),
    ("source mixing", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
