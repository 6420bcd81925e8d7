"""The review queue, human decisions, provenance and checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.text import excerpt


def pending(pools: list[tuple[str, DataFrame]], decided: DataFrame) -> DataFrame:
    """(kind, item_id, text, truncated) of all pools (item_id, text), in the order given, less decided (item_id)."""
    parts = []
    for n, (kind, df) in enumerate(pools):
        cut = excerpt(F.col("text"), 280)
        parts.append(df.select(F.lit(n).alias("pool"), F.lit(kind).alias("kind"), "item_id", cut["excerpt"].alias("text"), cut["truncated"].alias("truncated")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.join(decided.select("item_id").distinct(), "item_id", "left_anti").select("pool", "kind", "item_id", "text", "truncated")


def decided_over(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """rows with human decisions (item_id, decision) laid over judge_verdict and review_status; a decision on no row is an error."""
    lost = decisions.join(rows.select(F.col(key).alias("item_id")), "item_id", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"no such item: {lost[0]['item_id']}")
    d = decisions.select(F.col("item_id").alias(key), "decision")
    joined = rows.join(d, key, "left")
    verdict = F.coalesce(F.col("decision"), F.col("judge_verdict"))
    status = F.when(F.col("decision").isNotNull(), "human_reviewed").otherwise(F.col("review_status"))
    return joined.withColumn("judge_verdict", verdict).withColumn("review_status", status).drop("decision")


def provenance(human: Column, verdict: Column) -> Column:
    """The provenance class of a judged item; a human decision wins."""
    by_human = F.when(human == "accepted", "HUMAN_ACCEPTED").when(human == "rejected", "HUMAN_REJECTED")
    by_judge = F.when(verdict == "accepted", "LLM_ACCEPTED").when(verdict == "rejected", "LLM_REJECTED").otherwise("LLM_PROPOSED")
    return F.coalesce(by_human, by_judge)


def chain_id(parts: DataFrame, role: str, sha: str) -> DataFrame:
    """The first 12 hex digits of the sha256 of {"role":"sha",...}, sorted by role and without spaces; a row for each role exists."""
    pair = F.concat(F.lit('"'), F.col(role), F.lit('":"'), F.col(sha), F.lit('"'))
    rows = parts.select(F.struct(F.col(role).alias("r"), pair.alias("p")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    text = F.concat(F.lit("{"), F.array_join(F.col("xs.p"), ","), F.lit("}"))
    return rows.select(F.substring(F.sha2(text.cast("binary"), 256), 1, 12).alias("chain_id"))


def upsert(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """base with rows in place of those of equal key."""
    return base.join(rows.select(key), key, "left_anti").unionByName(rows)


def landing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose two ends exist."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def consolidated(logs: list[tuple[str, DataFrame]]) -> DataFrame:
    """(log_kind, ts, verdict, model) of all logs; a row's own log_kind wins."""
    out = None
    for kind, df in logs:
        own = F.coalesce(F.col("log_kind"), F.lit(kind)) if "log_kind" in df.columns else F.lit(kind)
        part = df.select(own.alias("log_kind"), "ts", "verdict", "model")
        out = part if out is None else out.unionByName(part)
    return out


def audit_counts(events: DataFrame) -> DataFrame:
    """(log_kind, verdict, model, prompt, n): events by kind, by kind and verdict, and by model and prompt, in one aggregation."""
    sets = [["log_kind"], ["log_kind", "verdict"], ["model", "prompt"]]
    counted = events.groupingSets(sets, "log_kind", "verdict", "model", "prompt").agg(F.grouping_id().alias("_set"), F.count("*").alias("n"))
    return counted.withColumn("by", F.when(F.col("_set") == 7, "kind").when(F.col("_set") == 3, "verdict").otherwise("model")).drop("_set")


def judged(runs: DataFrame, artifacts: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """(runs with the last artifact that names them, runs that no artifact names). artifacts hold run, n and others; the greatest n is the last."""
    others = [c for c in artifacts.columns if c not in (run, "n")]
    last = artifacts.filter(F.col(run).isNotNull()).groupBy(run).agg(F.max_by(F.struct(*others), "n").alias("_x"))
    return runs.join(last, run).select(*runs.columns, "_x.*"), runs.join(last, run, "left_anti")


def clauses(norms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(norms with actor_canonical, condition_ids and exception_ids; clause nodes id, type, text), clauses of equal normalised text being one."""
    from lexgrove.functions.text import clause_id
    from lexgrove.plans.requirements import canonical_actor

    named = norms.withColumn("actor_canonical", canonical_actor(F.coalesce(F.nullif("actor_explicit", F.lit("")), F.col("actor_inferred")))["actor"])
    nodes = None
    for kind, column, label in (("cond", "conditions", "Condition"), ("exc", "exceptions", "Exception")):
        texts = F.filter(F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
        named = named.withColumn(f"{column[:-1]}_ids", F.array_distinct(F.transform(texts, _clause(kind))))
        part = norms.select("norm_id", F.posexplode(texts).alias("_i", "text")).withColumn("id", clause_id(kind, F.col("text")))
        first = part.groupBy("id").agg(F.min_by("text", F.struct("norm_id", "_i")).alias("text")).select("id", F.lit(label).alias("type"), "text")
        nodes = first if nodes is None else nodes.unionByName(first)
    return named, nodes


def _clause(kind: str):
    from lexgrove.functions.text import clause_id

    return lambda x: clause_id(kind, x)


def chain_matches(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """(role, matches) of recorded (role, sha) against live (role, sha); a role that isn't there doesn't match."""
    joined = recorded.join(live.select("role", F.col("sha").alias("_live")), "role", "left")
    return joined.select("role", F.coalesce(F.col("sha") == F.col("_live"), F.lit(False)).alias("matches"))
