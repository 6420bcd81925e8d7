"""Publication gates: each is a table of violations, and a build is published only if all are empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.functions.text import roman
from lexgrove.operators import publication
from lexgrove.operators.graph import reachable
from lexgrove.operators.store import kept


def failures(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(id, errors) of the rows that break a rule; a rule that is null is broken."""
    errors = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return df.select(F.col(key).alias("id"), errors.alias("errors")).filter(F.size("errors") > 0)


def report(violations: DataFrame, most: int = 20, special: dict[str, int] | None = None) -> DataFrame:
    """(gate, ids, n_more): of each gate's violations (gate, id) the first `most` ids in order, or as many as special says, and how many more there are. Ids
    beyond a gate's share go before anything is gathered."""
    from lexgrove.operators.windows import capped

    cut = F.lit(most)
    for gate, n in (special or {}).items():
        cut = F.when(F.col("gate") == gate, n).otherwise(cut)
    rows = capped(violations.withColumn("id", F.coalesce("id", F.lit(""))), ["gate"], ["id"], max(most, *(special or {}).values(), 0), "total", "place").filter(F.col("place") <= cut)
    listed = rows.groupBy("gate").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.max("total").alias("total"))
    return listed.select("gate", "ids", (F.col("total") - F.size("ids")).alias("n_more"))


def mistyped(df: DataFrame, key: str, properties: str, types: dict[str, str]) -> DataFrame:
    """(id, property) of properties (a JSON object) whose value isn't of the type that JSON Schema calls so; absent ones are fine."""
    from lexgrove.operators.schemas import failures as failing

    schema = {"type": "object", "properties": {k: {"type": v} for k, v in types.items()}}
    return df.select(F.col(key).alias("id"), F.explode(failing(schema, F.col(properties))).alias("x")).select("id", F.col("x.path").alias("property"))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes (id) that no containment edge leads to."""
    return nodes.select("id").join(reachable(edges, roots).select("id"), "id", "left_anti")


#: Containment, by which every node of the legal layer must hang on a root.
CONTAINMENT = (
    "HAS_CHAPTER", "HAS_SECTION", "HAS_ARTICLE", "HAS_PARAGRAPH", "HAS_POINT", "HAS_SUBPARAGRAPH", "HAS_RECITAL", "HAS_ANNEX", "HAS_ANNEX_ITEM",
    "DEFINES_TERM", "HAS_CROSS_REFERENCE",
)


def build_gates(nodes: DataFrame, edges: DataFrame, manifest: DataFrame, norms: DataFrame | None = None, assertions: DataFrame | None = None) -> DataFrame:
    """(gate, id) of all violations of G1 to G6.

    nodes: id, layer, type, binding, legal_status, span_sha256; edges: edge_id, edge_type, src, dst; manifest: sha256;
    norms: norm_id, source_span_id; assertions: id, judge_verdict, source_evidence_span_ids, target_evidence_span_ids.
    """
    at = lambda gate, df, key: df.select(F.lit(gate).alias("gate"), F.col(key).alias("id"))
    legal = nodes.filter("layer = 1")
    held = edges.filter(F.col("edge_type").isin(*CONTAINMENT))
    found = [
        at("G1", orphans(legal, held, legal.filter("type = 'Regulation'").select("id")), "id"),
        at("G2", nodes.filter("span_sha256 is not null").join(manifest.select(F.col("sha256").alias("span_sha256")), "span_sha256", "left_anti"), "id"),
        at("G5", nodes.filter("type = 'Recital' and not (binding <=> false)"), "id"),
        at("G6", nodes.filter("type = 'SourceDocument' and id like '%amend%' and legal_status = 'in_force'"), "id"),
    ]
    if norms is not None:
        found.append(at("G3", norms.filter("source_span_id is null or source_span_id = ''"), "norm_id"))
    if assertions is not None:
        one_sided = (F.coalesce(F.size("source_evidence_span_ids"), F.lit(0)) < 1) | (F.coalesce(F.size("target_evidence_span_ids"), F.lit(0)) < 1)
        found.append(at("G4", assertions.filter((F.col("judge_verdict") == "accepted") & one_sided), "id"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def publish(df: DataFrame, violations: DataFrame, path: str, partitions: list[str] | None = None) -> int:
    """Publish df as the next version if there is no violation, else raise with the first of them (see publication). Returns the rows written."""
    version = publication.publish({"data": df}, violations, path, {"data": partitions} if partitions else None)
    return publication.versions(df.sparkSession, path).filter(F.col("version") == version).first()["tables"]["data"]


def published(spark: SparkSession, path: str) -> DataFrame:
    """What was published last."""
    return publication.read(spark, path, "data")


def post_load(norms: DataFrame, expected: int, assertions: DataFrame, expected_assertions: int, edges: DataFrame, build_id: str) -> DataFrame:
    """(gate, n) of the gates P1 to P5 on what was written: counts as they were sent, accepted norms with a span, accepted assertions with
    evidence on both sides, and no edge of another build."""
    accepted = F.col("judge_verdict") == "accepted"
    n = norms.agg(F.abs(F.count("*") - expected).alias("P1"), F.count(F.when(accepted & (F.coalesce("source_span_id", F.lit("")) == ""), 1)).alias("P3"))
    sided = (F.coalesce(F.size("source_evidence_span_ids"), F.lit(0)) > 0) & (F.coalesce(F.size("target_evidence_span_ids"), F.lit(0)) > 0)
    a = assertions.agg(F.abs(F.count("*") - expected_assertions).alias("P2"), F.count(F.when(accepted & ~sided, 1)).alias("P4"))
    e = edges.agg(F.count(F.when(~F.col("build_id").eqNullSafe(F.lit(build_id)), 1)).alias("P5"))
    rows = [x.unpivot([], [x.columns[0]] if len(x.columns) == 1 else x.columns, "gate", "n") for x in (n, a, e)]
    return rows[0].union(rows[1]).union(rows[2]).select("gate", F.col("n").cast("long").alias("n")).orderBy("gate")


def claims(elems: DataFrame, root: str) -> DataFrame:
    """(gate, id): each article of a main body's elements, each paragraph's identifier that isn't of three digits each, each paragraph by its id, and each numbered
    point of an article outside a paragraph; nothing of quoted acts."""
    name = F.col("attrs")["IDENTIFIER"]
    parts = F.split(name, r"\.")
    parag, shown = F.col("tag") == "PARAG", F.coalesce(name, F.lit(""))
    path = F.concat(F.lit(f"{root}:article-"), F.get(parts, F.lit(0)).try_cast("int").cast("string"), F.lit(":paragraph-"), F.get(parts, F.lit(1)).try_cast("int").cast("string"))
    says = lambda when, gate, key: F.when(when, F.struct(F.lit(gate).alias("gate"), key.alias("id")))
    outside = (F.col("tag") == "NP") & ~F.array_contains("tags", "PARAG") & F.array_contains("tags", "ARTICLE")
    each = F.array(
        says(F.col("tag") == "ARTICLE", "articles", F.lit(None).cast("string")), says(parag & ~shown.rlike(r"^[0-9]{3}\.[0-9]{3}$"), "identifier", shown),
        says(parag & path.isNotNull(), "paragraph", path), says(outside, "stray_point", F.col("elem").cast("string")),
    )
    return elems.filter(~F.array_contains("tags", "QUOT.S")).select(F.explode(F.array_compact(each)).alias("x")).select("x.*")


def body_gates(elems: DataFrame, paragraphs: DataFrame, root: str, articles: int) -> DataFrame:
    """(gate, id) of a main body's elements: as many articles as there must be, paragraph identifiers of three digits each that name an
    existing paragraph, and no numbered point outside a paragraph."""
    return violated(claims(elems, root), paragraphs, articles)


def violated(said: DataFrame, paragraphs: DataFrame, articles: int) -> DataFrame:
    """(gate, id) of a body's claims (gate, id). What they come from is read once, as claims are narrow."""
    found = kept(said)
    count = found.agg(F.count(F.when(F.col("gate") == "articles", 1)).alias("n")).filter(F.col("n") != articles).select(F.lit("articles").alias("gate"), F.col("n").cast("string").alias("id"))
    lost = found.filter("gate = 'paragraph'").join(paragraphs.select("id"), "id", "left_anti").select("gate", "id")
    return count.union(found.filter("gate in ('identifier', 'stray_point')")).union(lost)


def annex_gates(annexes: DataFrame) -> DataFrame:
    """(gate, id) of annexes (n, numeral) in publication order: the n-th bears the n-th numeral."""
    return annexes.filter(~roman(F.col("n")).eqNullSafe(F.col("numeral"))).select(F.lit("annex_order").alias("gate"), F.coalesce("numeral", F.lit("")).alias("id"))


def release(assertions: DataFrame, decisions: DataFrame, edges: DataFrame, chain: DataFrame, path: str, build_id: str) -> DataFrame:
    """Decisions, gate, chain id, publication and the gates after it: assertions with human decisions laid over are published if accepted
    ones have evidence on both sides; what was written is held against what was sent. Returns the gates after the load with the chain id."""
    from lexgrove.operators.review import chain_id, decided_over

    decided = kept(decided_over(assertions, decisions, "id"))
    one_sided = (F.coalesce(F.size("source_evidence_span_ids"), F.lit(0)) < 1) | (F.coalesce(F.size("target_evidence_span_ids"), F.lit(0)) < 1)
    sent = publish(decided, decided.filter((F.col("judge_verdict") == "accepted") & one_sided).select(F.lit("G4"), "id"), path)
    spark = assertions.sparkSession
    norms = spark.createDataFrame([], "judge_verdict string, source_span_id string")
    return post_load(norms, 0, published(spark, path), sent, edges, build_id).withColumn("chain_id", F.lit(chain_id(chain, "role", "sha").first()[0]))
