"""The tool surface: questions over published tables, each a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.text import excerpt
from lexgrove.operators.joins import first_match, mentioned
from lexgrove.operators.metrics import count_of
from lexgrove.plans.requirements import article_number, group_of, is_requirement
from lexgrove.sources.files import spans


def coverage(nodes: DataFrame, norms: DataFrame | None = None, articles: int = 113, recitals: int = 180, annexes: int = 13) -> DataFrame:
    """One row: what the graph holds against what the regulation has."""
    t = F.col("type")
    out = nodes.agg(count_of(t == "Article").alias("n_articles"), count_of(t == "Recital").alias("n_recitals"), count_of(t == "Annex").alias("n_annexes"), count_of(t == "Paragraph").alias("n_paragraphs"))
    out = out.withColumn("complete", (F.col("n_articles") == articles) & (F.col("n_recitals") == recitals) & (F.col("n_annexes") == annexes) & (F.col("n_paragraphs") > 0))
    if norms is None:
        return out
    verdicts = norms.agg(*[count_of(F.col("judge_verdict") == v).alias(f"n_norms_{v}") for v in ("accepted", "rejected", "needs_human_review")])
    return out.join(F.broadcast(verdicts))  # one row each


def source_trace(nodes: DataFrame, ids: DataFrame, most: int = 500) -> DataFrame:
    """ids (id) with type, excerpt and span of their node; unknown ids have a status."""
    cut = excerpt(F.col("text"), most)
    found = nodes.select("id", "type", cut["excerpt"].alias("excerpt"), cut["truncated"].alias("truncated"), "source_span", F.lit(True).alias("_known"))
    return ids.join(found, "id", "left").withColumn("status", F.when(F.col("_known"), "applicable").otherwise("rejected_as_unsupported")).drop("_known")


def resolve_spans(texts: DataFrame, nodes: DataFrame, extra: DataFrame, ids: DataFrame) -> DataFrame:
    """(span_id, source, text, reason) of asked ids (span_id): the span of the first node that names it, among nodes before extra ones, cut from its snapshot
    if that has the checksum (see files.spans). nodes and extra: span_id, file, snapshot_sha256, start, stop; an id that none names has reason unknown_span."""
    order = ["file", "start", "stop"]
    found = first_match(ids.distinct(), [("graph", nodes), ("extra", extra)], "span_id", order)
    cut = spans(texts, found.filter("source is not null"))
    joined = found.select("span_id", "source").join(cut, "span_id", "left")
    return joined.withColumn("reason", F.when(F.col("source").isNull(), "unknown_span").otherwise(F.col("reason"))).select("span_id", "source", "text", "reason")


def trace_alignment(assertions: DataFrame, mapping_runs: DataFrame, judge_runs: DataFrame, ids: DataFrame) -> DataFrame:
    """Assertions of each id as source norm, or if there are none as target, with their two runs; a run that isn't there is a missing fact."""
    asked, rest = ids.select(F.col("id").alias("asked")), assertions.withColumnRenamed("id", "assertion_id")
    names = ["asked", "assertion_id", "source_norm_id", "target_id", "mapping_run_id", "judge_run_id", "judge_verdict"]
    by_source = asked.join(rest.withColumn("asked", F.col("source_norm_id")), "asked").select(names)
    lone = asked.join(rest.select(F.col("source_norm_id").alias("asked")).distinct(), "asked", "left_anti")
    rows = by_source.unionByName(lone.join(rest.withColumn("asked", F.col("target_id")), "asked").select(names))
    rows = rows.join(mapping_runs.select(F.col("id").alias("mapping_run_id"), "generator_model"), "mapping_run_id", "left").join(judge_runs.select(F.col("id").alias("judge_run_id"), "judge_model", "rationale"), "judge_run_id", "left")
    missing = F.array_compact(F.array(F.when(F.col("generator_model").isNull(), F.lit("mapping_run")), F.when(F.col("judge_model").isNull(), F.lit("judge_run"))))
    return rows.withColumn("missing", missing).withColumn("status", F.when(F.size("missing") > 0, "requires_human_review").otherwise("applicable"))


def explain(norms: DataFrame, nodes: DataFrame, definitions: DataFrame, assertions: DataFrame) -> DataFrame:
    """norms with their source's text, the defined terms that their action and object name, and how many accepted alignments they have."""
    text = nodes.select(F.col("id").alias("source_node_id"), F.col("text").alias("_node_text"))
    base = norms.join(text, "source_node_id", "left")
    named = mentioned(definitions.select("term"), "term", norms.select("norm_id", F.concat_ws(" ", "action", "object").alias("_t")), "_t")
    terms = named.groupBy("norm_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    accepted = assertions.filter("judge_verdict = 'accepted'").groupBy(F.col("source_norm_id").alias("norm_id")).agg(F.count("*").alias("n_alignments"))
    out = base.join(terms, "norm_id", "left").join(accepted, "norm_id", "left")
    return out.select("norm_id", F.col("_node_text").alias("source_text"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), F.coalesce("n_alignments", F.lit(0)).alias("n_alignments"))


def explained(norms: DataFrame, nodes: DataFrame, definitions: DataFrame, assertions: DataFrame, spans: DataFrame, ids: DataFrame) -> DataFrame:
    """(norm_id, found, status, source_type, source_text, terms, accepted, n_not_accepted, span_text, span_reason, missing) of each asked id (norm_id).

    norms: norm_id, source_node_id, source_span_id, judge_verdict, action, object; nodes: id, type, text; definitions: term; assertions: id, source_norm_id,
    target_id, judge_verdict; spans: span_id, text, reason (see files.spans). An id that no norm has isn't an error but a missing fact; a norm that wasn't accepted is
    explained and needs review, like one whose source or span can't be had. accepted: (assertion, target) in order.
    """
    asked = ids.distinct().join(norms, "norm_id", "left")
    base = asked.join(nodes.select(F.col("id").alias("source_node_id"), F.col("type").alias("source_type"), F.col("text").alias("source_text")), "source_node_id", "left")
    base = base.join(spans.select(F.col("span_id").alias("source_span_id"), F.col("text").alias("span_text"), F.col("reason").alias("span_reason")), "source_span_id", "left")
    named = mentioned(definitions.select("term"), "term", norms.join(ids.distinct(), "norm_id", "left_semi").select("norm_id", F.concat_ws(" ", "action", "object").alias("_t")), "_t")
    terms = named.groupBy("norm_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    taken = F.col("judge_verdict") == "accepted"
    by_norm = assertions.groupBy(F.col("source_norm_id").alias("norm_id")).agg(
        F.array_sort(F.collect_list(F.when(taken, F.struct(F.col("id").alias("assertion"), F.col("target_id").alias("target"))))).alias("accepted"), count_of(~F.coalesce(taken, F.lit(False))).alias("n_not_accepted"))
    out = base.join(terms, "norm_id", "left").join(by_norm, "norm_id", "left")
    found = F.col("source_span_id").isNotNull() | F.col("source_node_id").isNotNull() | F.col("judge_verdict").isNotNull()
    missing = F.array_compact(F.array(F.when(~found, "norm"), F.when(found & F.col("source_text").isNull(), "source"), F.when(found & F.col("span_text").isNull(), "span")))
    whole = out.withColumn("found", found).withColumn("missing", missing)
    status = F.when(~F.col("found"), "not_applicable").when((F.col("judge_verdict") == "accepted") & (F.size("missing") == 0), "satisfied_by_evidence").otherwise("requires_human_review")
    empty = F.array().cast("array<string>")
    return whole.select(
        "norm_id", "found", status.alias("status"), "source_type", "source_text", F.coalesce("terms", empty).alias("terms"), F.coalesce("accepted", F.array().cast("array<struct<assertion: string, target: string>>")).alias("accepted"),
        F.coalesce("n_not_accepted", F.lit(0)).alias("n_not_accepted"), "span_text", "span_reason", "missing",
    )


def requirements_by_article(norms: DataFrame) -> DataFrame:
    """(group, n_accepted, n_review) of requirement groups; articles first, by number."""
    grouped = norms.withColumn("group", group_of(F.col("source_node_id"))).filter(is_requirement(F.col("group")))
    out = grouped.groupBy("group").agg(count_of(F.col("judge_verdict") == "accepted").alias("n_accepted"), count_of(F.col("judge_verdict") == "needs_human_review").alias("n_review"))
    return out.orderBy(article_number(F.col("group")).asc_nulls_last(), "group")


def board(requirements: DataFrame, statuses: DataFrame, columns: list[str]) -> DataFrame:
    """Requirements per group in each status column; those without evidence are in the column for missing evidence."""
    joined = requirements.join(statuses, "norm_id", "left").withColumn("status", F.coalesce("status", F.lit("applicable_missing_evidence")))
    return joined.groupBy("group").pivot("status", columns).count().na.fill(0)
