"""Checksummed snapshots, dumps, logs and gold items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.functions.text import excerpt
from lexgrove.operators.schemas import invalid
from lexgrove.streaming.logs import last_of, ordered


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, text) of whole files; bytes are decoded without touching line ends, so offsets count code points of the text."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))


def manifest(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """(file, sha256, ...) of the snapshots that a manifest lists, or of those in one of its folders."""
    listed = spark.read.schema("snapshots array<struct<file string, sha256 string, source_document string, celex string, eli string, manifestation string, language string, retrieved_at string, legal_status string, notes string>>").json(path, multiLine=True)
    found = listed.select(F.explode("snapshots").alias("x")).select("x.*")
    return found.filter(F.col("file").startswith(f"{folder}/")) if folder else found


def verified(found: DataFrame, listed: DataFrame) -> DataFrame:
    """found, each with the manifest's row; a file that isn't listed, or whose checksum differs, fails the job."""
    known = listed.select(F.element_at(F.split("file", "/"), -1).alias("file"), F.col("sha256").alias("_listed"))
    joined = found.join(known, "file", "left")
    same = F.coalesce(F.col("sha256") == F.col("_listed"), F.lit(False))
    return joined.withColumn("text", F.when(same, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("not a listed snapshot: "), F.col("file"))))).drop("_listed")


def spans(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (span_id, file, snapshot_sha256, start, stop) with the text they cut, half-open in code points; a wrong checksum or
    offsets outside the text give a reason instead."""
    joined = wanted.join(texts.select("file", "sha256", "text"), "file", "left")
    reason = F.when(F.col("text").isNull(), "missing_snapshot").when(F.col("sha256") != F.col("snapshot_sha256"), "checksum_mismatch")
    reason = reason.when((F.col("start") < 0) | (F.col("stop") < F.col("start")) | (F.col("stop") > F.length("text")), "bad_offsets")
    cut = F.when(reason.isNull(), F.expr("substring(text, start + 1, stop - start)"))
    return joined.select("span_id", cut.alias("text"), reason.alias("reason"))


def trace(nodes: DataFrame, most: int = 500) -> DataFrame:
    """nodes (id, text, ...) with the excerpt that a source trace shows."""
    cut = excerpt(F.col("text"), most)
    return nodes.withColumn("excerpt", cut["excerpt"]).withColumn("truncated", cut["truncated"])


DOCUMENTS = "id string, type string, layer int, legal_status string"


def registry(spark: SparkSession, listed: DataFrame, build_id: str) -> tuple[DataFrame, DataFrame]:
    """Layer 0: source documents and files, and the edges between them."""
    documents = spark.createDataFrame([("eu-ai-act", "SourceDocument", 0, "in_force"), ("eu-ai-act-amendment", "SourceDocument", 0, "adopted_not_yet_applicable")], DOCUMENTS)
    files = listed.select(F.concat(F.lit("file:"), "file").alias("id"), F.lit("SourceFile").alias("type"), F.lit(0).alias("layer"), "legal_status", "file", "sha256", "source_document")
    nodes = documents.unionByName(files, allowMissingColumns=True)
    versions = files.select(F.lit("HAS_VERSION").alias("edge_type"), F.col("source_document").alias("src"), F.col("id").alias("dst"))
    amends = spark.createDataFrame([("AMENDS", "eu-ai-act-amendment", "eu-ai-act")], "edge_type string, src string, dst string")
    edges = versions.filter("src is not null").unionByName(amends).withColumn("edge_id", F.concat_ws(":", F.lit("edge"), F.lower("edge_type"), "dst")).withColumn("build_id", F.lit(build_id))
    return nodes, edges


def derived_edges(listed: DataFrame, build_id: str) -> DataFrame:
    """DERIVED_FROM_SOURCE edges from each listed file to its document, the base act where the manifest names none."""
    src, dst = F.concat(F.lit("file:"), "file"), F.coalesce("source_document", F.lit("eu-ai-act"))
    edges = listed.select(F.lit("DERIVED_FROM_SOURCE").alias("edge_type"), src.alias("src"), dst.alias("dst"))
    return edges.withColumn("edge_id", F.concat(F.lit("edge:"), "src", F.lit("-derived-from-"), "dst")).withColumn("build_id", F.lit(build_id))


def events(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    """A log of JSON lines, blank ones skipped; rows without a kind get this one. A missing file is an empty log."""
    full = schema if "log_kind" in schema else f"{schema}, log_kind string"
    try:
        lines = spark.read.schema(full).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        lines = spark.createDataFrame([], full)
    return lines.withColumn("log_kind", F.coalesce("log_kind", F.lit(kind)))


def results(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoint lines (strategy, item_id, ...), of which the last of each strategy and item counts, however the files are split."""
    lines = ordered(spark, path, "strategy string, item_id string, answer_text string, citations array<string>, risk_category string, error string, latency_s double")
    return last_of(lines, ["strategy", "item_id"])


GOLD = "id string, kind string, question string, system_text string, gold map<string,string>, gold_citations array<string>"


def gold_items(spark: SparkSession, path: str) -> DataFrame:
    """Gold items of known kinds with an id and a gold answer; anything else fails the job."""
    items = spark.read.schema(f"items array<struct<{GOLD.replace(' string', ':string').replace(' map', ':map').replace(' array', ':array')}>>").json(path, multiLine=True).select(F.explode("items").alias("x")).select("x.*")
    good = F.col("id").isNotNull() & F.col("kind").isin("classification", "retrieval", "qa") & F.col("gold").isNotNull()
    return items.withColumn("id", F.when(F.coalesce(good, F.lit(False)), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("not a gold item: "), F.coalesce("id", F.lit("?"))))))


#: What a gold item must be like, by its kind.
GOLD_ITEM = {
    "type": "object", "required": ["id", "kind", "gold", "gold_citations"], "properties": {"id": {"type": "string"}, "kind": {"enum": ["classification", "retrieval", "qa"]}},
    "allOf": [
        {"if": {"properties": {"kind": {"const": "classification"}}, "required": ["kind"]}, "then": {"required": ["system_features"]}},
        {"if": {"properties": {"kind": {"enum": ["retrieval", "qa"]}}, "required": ["kind"]}, "then": {"required": ["question"], "properties": {"question": {"type": "string", "minLength": 1}}}},
    ],
}


def gold_failures(items: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, keyword) of what items, as JSON texts, lack for their kind."""
    return invalid(items, key, text, GOLD_ITEM)


def scenario_items(scenarios: DataFrame, risk: dict[str, str], root: str) -> DataFrame:
    """scenarios (benchmark_index, risk_level, role, intended_use, system_type, input_data, domain, related_articles) as classification items: the
    description is put together as text and no features are made up. An unknown risk level fails the job."""
    names = F.create_map(*[F.lit(x) for pair in risk.items() for x in pair])
    known = F.coalesce(names[F.col("risk_level")], F.raise_error(F.concat(F.lit("no such risk level: "), F.coalesce("risk_level", F.lit("null")))).cast("string"))
    said = F.concat(F.lit("Role: "), "role", F.lit(". Intended use: "), "intended_use", F.lit(". System type: "), "system_type", F.lit(". Input data: "), "input_data", F.lit(". Domain: "), "domain", F.lit("."))
    none = F.lit(None).cast("string")
    return scenarios.select(
        F.concat(F.lit("bench:scenario:"), F.col("benchmark_index").cast("string")).alias("id"), F.lit("classification").alias("kind"), none.alias("question"), said.alias("system_text"), known.alias("risk_category"), none.alias("answer_text"),
        F.transform("related_articles", lambda a: F.concat(F.lit(f"{root}:article-"), a.cast("string"))).alias("gold_citations"),
    )


def qa_items(pairs: DataFrame, root: str) -> DataFrame:
    """pairs (benchmark_index, question, answer, relevant_article) as items of the same columns as scenario_items, to be united with these."""
    none = F.lit(None).cast("string")
    return pairs.select(
        F.concat(F.lit("bench:qa:"), F.col("benchmark_index").cast("string")).alias("id"), F.lit("qa").alias("kind"), "question", none.alias("system_text"), none.alias("risk_category"), F.col("answer").alias("answer_text"),
        F.array(F.concat(F.lit(f"{root}:article-"), F.col("relevant_article").cast("string"))).alias("gold_citations"),
    )


def benchmark_items(payload: DataFrame, risk: dict[str, str], root: str) -> DataFrame:
    """payload (data array of structs: risk_level, system, related_articles) as items with an ordinal, a category and cited ids."""
    rows = payload.select(F.posexplode("data").alias("benchmark_index", "x")).select("benchmark_index", "x.*")
    names = F.create_map(*[F.lit(x) for pair in risk.items() for x in pair])
    cited = F.transform("related_articles", lambda a: F.concat(F.lit(f"{root}:article-"), a.cast("string")))
    return rows.select("benchmark_index", F.format_string("bench:%04d", "benchmark_index").alias("id"), names[F.col("risk_level")].alias("risk_category"), F.col("system").alias("system_text"), cited.alias("gold_citations"))
