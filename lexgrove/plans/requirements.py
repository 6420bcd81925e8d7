"""Requirements that apply to classified systems, and the tables behind explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.text import segment

# Closed vocabularies.
STATUSES = ("applicable", "potentially_applicable", "not_applicable", "satisfied_by_evidence", "applicable_missing_evidence", "requires_human_review", "rejected_as_unsupported")
SEVERITY = ("rejected_as_unsupported", "requires_human_review", "applicable_missing_evidence", "potentially_applicable", "satisfied_by_evidence", "not_applicable")
NO_REQUIREMENTS = ("article-5", "article-6", "article-7")
ACTORS = (
    "provider", "deployer", "importer", "distributor", "authorised_representative", "product_manufacturer", "operator", "notified_body",
    "national_competent_authority", "market_surveillance_authority", "commission", "ai_office", "member_state",
)
SYNONYMS = {
    "european commission": "commission", "the eu ai office": "ai_office", "member states": "member_state",
    "national competent authorities": "national_competent_authority", "market surveillance authorities": "market_surveillance_authority",
    "authorised representatives": "authorised_representative", "product manufacturers": "product_manufacturer", "notified bodies": "notified_body",
}
AMBIGUOUS = ("office",)


def group_of(source: Column) -> Column:
    return segment(source, 1)


def article_number(group: Column) -> Column:
    """The number of an article's group, null for others; articles sort by it, before all others."""
    return F.regexp_extract(group, r"^article-([0-9]+)$", 1).try_cast("int")


def is_requirement(group: Column) -> Column:
    return ~group.isin(*NO_REQUIREMENTS) & ~group.startswith("annex-")


#: Words that may stand before "ai system" in what follows an actor's name.
FILLERS = ("such", "the", "high-risk", "general-purpose")


def canonical_actor(raw: Column) -> Column:
    """(actor, method). The name's words are taken without a leading article and without what follows an "of" that leads, but for fillers, to
    AI systems or models; synonyms and plurals are folded."""
    words = F.filter(F.split(F.lower(raw), r"[ \t\r\n]+"), lambda x: x != "")
    text = _once(words, lambda w: _once(F.when(F.get(w, F.lit(0)).isin("the", "a", "an") & (F.size(w) > 1), F.slice(w, 2, F.size(w))).otherwise(w), _name))
    synonyms = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    known = lambda c: F.when(c.isin(*ACTORS), c)

    def resolved(t: Column) -> Column:
        bare = F.replace(t, F.lit(" "), F.lit("_"))
        single = F.when(bare.endswith("s"), F.substring(bare, F.lit(1), F.length(bare) - 1))
        actor = F.when(~t.isin(*AMBIGUOUS), F.coalesce(synonyms[t], known(bare), known(single)))
        return F.struct(actor.alias("actor"), F.when(t.isin(*AMBIGUOUS), "ambiguous").when(actor.isNull(), "unresolved").otherwise("rule").alias("method"))

    empty = F.coalesce(F.trim(raw), F.lit("")) == ""
    return F.when(empty, F.struct(F.lit(None).cast("string").alias("actor"), F.lit("empty").alias("method"))).otherwise(_once(text, resolved))


def _once(value: Column, function) -> Column:
    """function(value), where value is computed once however often the function names it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _name(words: Column) -> Column:
    """The words up to an "of" that leads to AI systems or models."""

    def leads(i: Column) -> Column:
        told = F.filter(F.slice(words, i + 2, F.size(words)), lambda x: ~x.isin(*FILLERS))
        what = F.get(told, F.lit(1))
        return (F.get(words, i) == "of") & (F.get(told, F.lit(0)) == "ai") & (what.startswith("system") | what.startswith("model"))

    place = F.filter(F.sequence(F.lit(0), F.size(words)), leads)
    return F.btrim(F.array_join(F.slice(words, 1, F.coalesce(F.get(place, F.lit(0)), F.size(words))), " "), F.lit(" ,."))


def acts(explicit: Column, inferred: Column, actor: str) -> Column:
    """Whether a norm addresses the actor."""
    if actor not in ACTORS:
        raise ValueError(f"no such actor: {actor}")
    return F.coalesce(inferred == actor, F.lit(False)) | F.coalesce(F.contains(F.lower(explicit), F.lit(actor.replace("_", " "))), F.lit(False))


def applicable(systems: DataFrame, norms: DataFrame, key: str) -> DataFrame:
    """(system, norm) rows: high-risk systems get all accepted norms of requirement groups, transparency-only ones those of Article 50,
    others none. norms has source_node_id, norm_id, judge_verdict. The two sides meet by equal scope, each norm being in two at most."""
    scopes = F.array_compact(F.array(F.when(is_requirement(F.col("norm_group")), F.lit("high_risk")), F.when(F.col("norm_group") == "article-50", F.lit("transparency_only"))))
    accepted = norms.filter("judge_verdict = 'accepted'").withColumn("norm_group", group_of(F.col("source_node_id")))
    scoped = accepted.withColumn("risk_category", F.explode(scopes)).select("risk_category", "norm_id", "norm_group")
    return systems.select(key, "risk_category", (F.col("status") == "requires_human_review").alias("provisional")).join(scoped, "risk_category")


def worst_status(df: DataFrame, groups: list[str], status: str, severity: tuple[str, ...], others: list[Column]) -> DataFrame:
    """Of each group the status that comes first in severity."""
    place = F.array_position(F.array(*[F.lit(x) for x in severity]), F.col(status))
    return df.groupBy(*groups).agg(F.min_by(status, F.when(place > 0, place)).alias("worst_status"), *others)


def backlog_gate(norms: DataFrame, system: str, order: list[str], most: int, shown: int = 20) -> DataFrame:
    """(system, status, n_norms, refused, n_refused, used, truncated): whether a backlog may be generated for each system from its norms (norm_id, judge_verdict). One norm
    that isn't accepted refuses the whole: `refused` lists the first of them, `used` is empty. Else the first `most` norms by order are used, and `truncated` tells
    whether that leaves any out."""
    from lexgrove.operators.windows import first_per_group

    bad = ~F.coalesce(F.col("judge_verdict") == "accepted", F.lit(False))
    counts = norms.groupBy(system).agg(F.count("*").alias("n_norms"), F.count(F.when(bad, 1)).alias("n_refused"))
    lost = first_per_group(norms.filter(bad), [system], ["norm_id"], shown).groupBy(system).agg(F.array_sort(F.collect_list("norm_id")).alias("refused"))
    first = first_per_group(norms, [system], order, most).groupBy(system).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("norm_id").alias("_id")))), lambda x: x["_id"]).alias("_used"))
    joined = counts.join(first, system).join(lost, system, "left")
    refuses, none = F.col("n_refused") > 0, F.array().cast("array<string>")
    return joined.select(
        system, F.when(refuses, "refused").otherwise("applicable_missing_evidence").alias("status"), "n_norms", F.coalesce("refused", none).alias("refused"), "n_refused",
        F.when(refuses, none).otherwise(F.col("_used")).alias("used"), (~refuses & (F.col("n_norms") > most)).alias("truncated"),
    )


def priorities(items: DataFrame, norms: DataFrame, key: str) -> DataFrame:
    """items (key, norm_ids, ...) with priority, whatever they said themselves: must if one of their norms (norm_id, deontic_type, conditions) is an obligation or a
    prohibition without conditions, else should."""
    binding = norms.filter(F.col("deontic_type").isin("obligation", "prohibition") & (F.coalesce(F.size("conditions"), F.lit(0)) < 1)).select("norm_id").distinct()
    must = items.select(key, F.explode("norm_ids").alias("norm_id")).join(binding, "norm_id", "left_semi").select(key, F.lit("must").alias("_must")).distinct()
    return items.drop("priority").join(must, key, "left").withColumn("priority", F.coalesce("_must", F.lit("should"))).drop("_must")


def surfaced(gated: DataFrame, verdicts: DataFrame, system: str) -> DataFrame:
    """gated with the judge's verdict (system, judge_verdict) on each generated backlog: one that isn't accepted goes to people; refused ones stay refused."""
    joined = gated.join(verdicts.select(system, F.col("judge_verdict").alias("_verdict")), system, "left")
    status = F.when((F.col("status") != "refused") & ~F.coalesce(F.col("_verdict") == "accepted", F.lit(False)), "requires_human_review").otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("_verdict")


def merged_evidence(items: DataFrame, order: str, norms: str, evidence: str) -> DataFrame:
    """(norm_set, evidence): what merged items name as evidence, items in order and each name once, where it first comes."""
    keyed = items.withColumn("norm_set", F.array_join(F.array_sort(F.array_distinct(norms)), ","))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(evidence, F.array().cast("array<string>")).alias("e")))), lambda x: x["e"])
    return keyed.groupBy("norm_set").agg(F.array_distinct(F.flatten(listed)).alias("evidence"))


def merged_backlog(items: DataFrame, order: str, title: str, norms: str, priority: str) -> DataFrame:
    """One item for each set of norms: the first title, how many were merged, and 'must' if any says so."""
    keyed = items.withColumn("norm_set", F.array_join(F.array_sort(F.array_distinct(norms)), ","))
    return keyed.groupBy("norm_set").agg(F.min_by(title, order).alias("title"), F.count("*").alias("n_merged"), F.when(F.max(F.col(priority) == "must"), "must").otherwise("should").alias("priority"))
