"""Answers with their evidence: the envelope, requirement rows, checked citations, digests, and what may stand in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.functions.text import segment
from lexgrove.plans.requirements import STATUSES, article_number

# Labels, edge types and the types of passages.
NODE_LABELS = (
    "SourceDocument", "SourceFile", "BuildRun", "Regulation", "Chapter", "Section", "Article", "Paragraph", "Subparagraph", "Point", "Recital", "Annex", "AnnexItem", "Definition",
    "CrossReference", "Condition", "Exception", "NormativeStatement", "HLEGRequirement", "HLEGRequirementSubtopic", "AlignmentAssertion", "MappingRun", "JudgeRun",
)
EDGE_TYPES = (
    "HAS_CHAPTER", "HAS_SECTION", "HAS_ARTICLE", "HAS_PARAGRAPH", "HAS_SUBPARAGRAPH", "HAS_POINT", "HAS_RECITAL", "HAS_ANNEX", "HAS_ANNEX_ITEM", "DEFINES_TERM", "CONTEXT_FOR", "HAS_SUBTOPIC",
    "REFERS_TO", "HAS_CROSS_REFERENCE", "RESOLVES_TO", "HAS_CONDITION", "HAS_EXCEPTION", "AMENDS", "HAS_VERSION", "DERIVED_FROM_SOURCE", "DERIVED_FROM", "ASSERTS_ALIGNMENT_OF",
    "ASSERTS_ALIGNMENT_TO", "PRODUCED_BY_MAPPING_RUN", "JUDGED_BY",
)
BANNED = ("compliant", "certified", "legally approved")
DETERMINISTIC = "not_applicable_deterministic"
#: What every answer says about itself.
NOTICE = "This is support for engineering and documentation. It certifies nothing and replaces no legal review, conformity assessment or reading by an authority."


def iso(moment: Column) -> Column:
    """A moment in UTC, as ISO 8601 writes it."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def envelope(answer: Column, status: Column, graph_version: str, confidence: Column | None = None, nodes: Column | None = None, spans: Column | None = None, subgraph: Column | None = None,
             notes: Column | None = None, missing: Column | None = None, verdict: Column | None = None, at: Column | None = None) -> Column:
    """The twelve fields of every answer; a status outside the vocabulary is an error."""
    none = F.array().cast("array<string>")
    known = F.when(status.isin(*STATUSES), status).otherwise(F.raise_error(F.concat(F.lit("no such status: "), F.coalesce(status, F.lit("null")))).cast("string"))
    given = {
        "answer": answer, "status": known, "confidence": F.lit(1.0) if confidence is None else confidence, "source_nodes": none if nodes is None else F.coalesce(nodes, none),
        "source_spans": none if spans is None else F.coalesce(spans, none), "graph_evidence_subgraph": F.lit("{}") if subgraph is None else F.coalesce(subgraph, F.lit("{}")),
        "legal_status_notes": none if notes is None else F.coalesce(notes, none), "missing_facts": none if missing is None else F.coalesce(missing, none),
        "judge_verdict": F.lit(DETERMINISTIC) if verdict is None else verdict, "generated_at": iso(F.current_timestamp() if at is None else at),
        "graph_version": F.lit(graph_version), "non_legal_advice_notice": F.lit(NOTICE),
    }
    return F.struct(*(value.alias(name) for name, value in given.items()))


def requirement(explicit: Column, inferred: Column, conditions: Column, exceptions: Column) -> Column:
    """(actor, actor_source, conditions, exceptions) of a norm: the explicit actor wins, and empty lists are null, so JSON leaves them out."""
    said = F.nullif(explicit, F.lit(""))
    some = lambda x: F.when(F.size(x) > 0, x)
    return F.struct(F.coalesce(said, inferred).alias("actor"), F.when(said.isNotNull(), "explicit").otherwise("inferred").alias("actor_source"), some(conditions).alias("conditions"), some(exceptions).alias("exceptions"))


def checked(df: DataFrame, key: str, cited: str, nodes: DataFrame) -> DataFrame:
    """(key, source_nodes, missing_facts): cited identifiers that exist, in order, and a missing fact for each of the others."""
    each = df.select(key, F.posexplode_outer(cited).alias("_i", "_id"))
    found = each.join(nodes.select(F.col("id").alias("_id"), F.lit(True).alias("_there")).distinct(), "_id", "left")
    item = F.struct("_i", "_id")
    there = F.sort_array(F.collect_list(F.when(F.col("_there"), item)))
    lost = F.sort_array(F.collect_list(F.when(F.col("_id").isNotNull() & F.col("_there").isNull(), item)))
    return found.groupBy(key).agg(there.alias("a"), lost.alias("b")).select(key, F.col("a._id").alias("source_nodes"), F.transform("b._id", lambda x: F.concat(F.lit("not in the graph: "), x)).alias("missing_facts"))


def flat_nodes(nodes: DataFrame) -> DataFrame:
    """nodes with the fields of source_span as columns."""
    parts = nodes.schema["source_span"].dataType.fieldNames()
    named = lambda x: x if x.startswith("span_") else f"span_{x}"
    return nodes.select(*(x for x in nodes.columns if x != "source_span"), *(F.col(f"source_span.{x}").alias(named(x)) for x in parts))


def flat_edges(edges: DataFrame) -> DataFrame:
    """edges' own properties, without their ends."""
    return edges.drop("src", "dst", "from", "to")


def refused(df: DataFrame, name: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose label or type isn't a plain identifier of the list."""
    return df.filter(~F.coalesce(F.col(name).isin(*allowed) & F.col(name).rlike("^[A-Za-z][A-Za-z0-9_]*$"), F.lit(False)))


def usage_candidate(node: Column) -> Column:
    """Whether a node belongs to the core of high-risk rules: articles 5 to 27, 50, 72 and 73, and all annex items."""
    group = segment(node, 1)
    n = article_number(group)
    return F.coalesce(n.between(5, 27) | n.isin(50, 72, 73), F.lit(False)) | (group.startswith("annex-") & segment(node, 2).isNotNull())


def norm_digest(actor: Column, modal: Column, action: Column, target: Column) -> Column:
    """One line for prompts and sheets; what isn't known is "?"."""
    return F.concat_ws(" ", *(F.coalesce(F.nullif(x, F.lit("")), F.lit("?")) for x in (actor, modal, action, target)))


def finite(value: Column) -> Column:
    """null in place of what JSON has no number for."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def claims(text: Column) -> Column:
    """Whether a text of the system's own claims what it may not."""
    return F.coalesce(F.lower(text).rlike("|".join(BANNED)), F.lit(False))


def without_quotes(answer: Column, quoted: tuple[str, ...]) -> Column:
    """A struct less its fields of quoted text, which the scan for claims leaves alone."""
    return answer.dropFields(*quoted)


def passages(nodes: DataFrame, types: tuple[str, ...]) -> DataFrame:
    return nodes.filter(F.col("type").isin(*types) & (F.coalesce("text", F.lit("")) != "")).select("id", "text")


def over_classified(results: DataFrame, items: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(item_id, gold, predicted, trigger) where (gold, predicted) is one of the patterns; the trigger is what the rationale names."""
    known = F.array(*(F.lit(f"{a}>{b}") for a, b in pairs))
    joined = results.join(items, "item_id").filter(F.array_contains(known, F.concat_ws(">", "gold", "predicted")))
    return joined.select("item_id", "gold", "predicted", F.nullif(F.regexp_extract("rationale", r"trigger[s]?: *([a-z_]+)", 1), F.lit("")).alias("trigger"))


def output_sizes(outputs: DataFrame, groups: list[str], text: str, price: float) -> DataFrame:
    """Mean output of each group in tokens of four characters, a quarter less and more, and what all of them cost at a price a million tokens."""
    mean = outputs.groupBy(*groups).agg(F.avg(F.length(text)).alias("mean_chars"), F.count("*").alias("n"))
    tokens = F.bround(F.col("mean_chars") / 4)
    return mean.select(*groups, "n", tokens.alias("tokens"), F.bround(tokens * 0.75).alias("low"), F.bround(tokens * 1.25).alias("high"), (tokens * F.col("n") * price / 1e6).alias("cost"))


def most_common(df: DataFrame, value: str, first: str) -> DataFrame:
    """(value, n, place): values by how often they stand, ties by where they stand first."""
    counted = df.groupBy(value).agg(F.count("*").alias("n"), F.min(first).alias("_first"))  # a row for each value
    return counted.select(value, "n", F.row_number().over(Window.orderBy(F.desc("n"), "_first")).alias("place"))


def unresolved(actors: DataFrame) -> DataFrame:
    """(raw, n) of actor names (raw, method) that map to none, most first."""
    return actors.filter(F.col("method").isin("unresolved", "ambiguous")).groupBy("raw").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "raw")


def file_slug(ids: Column, root: str) -> Column:
    """A short file name for a list of identifiers: the first two, how many more, and eight digits of the SHA-1 of all."""
    short = F.transform(F.slice(ids, 1, 2), lambda x: F.replace(F.when(x.startswith(root + ":"), F.substring(x, F.lit(len(root) + 2), F.length(x))).otherwise(x), F.lit(":"), F.lit("-")))
    more = F.when(F.size(ids) > 2, F.concat(F.lit("plus"), (F.size(ids) - 2).cast("string")))
    return F.concat_ws("_", F.array_join(short, "_"), more, F.substring(F.sha1(F.array_join(ids, ",").cast("binary")), 1, 8))


def drafts(nodes: DataFrame, kind: str, limit: int) -> DataFrame:
    """(item_id, kind, question, gold_citation): gold items to be reviewed, of the first leaves in document order (nodes: id, text, ord)."""
    named = nodes.filter(F.coalesce("text", F.lit("")) != "").orderBy("ord", "id").limit(limit)
    n = F.row_number().over(Window.orderBy("ord", "id"))  # over at most `limit` rows
    return named.select(F.concat(F.lit(f"gold:{kind}-"), F.lpad(n.cast("string"), 2, "0")).alias("item_id"), F.lit(kind).alias("kind"), F.concat(F.lit("Which provision says: "), F.substring("text", 1, 80)).alias("question"), F.col("id").alias("gold_citation"))
