"""The queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from lexgrove.llm import bpe_count, chosen_path, fingerprints, html_text, language, merkle, mixing, packing, quality, repair, secrets, va_file, whitening
from lexgrove.llm.common import table
from lexgrove.llm.encoders import tokenizer_path

QUERIES = {
    "op1_quality": lambda spark, d: quality.score(table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_mixing": lambda spark, d: mixing.digest(table(spark, d, "documents")),
    "op3_language_id": lambda spark, d: language.documents(table(spark, d, "documents")),
    "op4_token_counts": lambda spark, d: bpe_count.token_counts(table(spark, d, "documents"), tokenizer_path("byte_bpe_50k.json")),
    "op5_token_files": lambda spark, d: repair.digest(table(spark, d, "documents"), tokenizer_path("byte_bpe_50k.json")),
    "op6_packing": lambda spark, d: packing.digest(table(spark, d, "documents"), tokenizer_path("word_bpe_49k.json")),
    "op7_top_k": lambda spark, d: va_file.search(table(spark, d, "embeddings")),
    "op8_fingerprints": lambda spark, d: fingerprints.fingerprints(table(spark, d, "documents")),
    "op9_main_text": lambda spark, d: html_text.extract(table(spark, d, "pages")),
    "op10_near_duplicates": lambda spark, d: chosen_path.near_duplicates(table(spark, d, "documents")),
    "op11_secrets": lambda spark, d: secrets.digest(table(spark, d, "documents")),
    "op12_manifest": lambda spark, d: merkle.verify(table(spark, d, "documents")),
    "op13_whitening": lambda spark, d: whitening.whitened(table(spark, d, "embeddings")),
    "language_id_pages": lambda spark, d: language.pages(table(spark, d, "pages")),
}
