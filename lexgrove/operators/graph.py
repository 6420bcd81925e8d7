"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.text import literal
from lexgrove.operators.store import kept


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, depth) of all that edges (src, dst) reach from roots (id); the least depth, so cycles end. Frontiers are joined, not collected,
    until one is empty; what was seen is kept as one table, so a deep graph's plan doesn't grow with its depth."""
    pairs = kept(edges.select("src", "dst").distinct())
    seen = front = kept(roots.select("id").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while not front.isEmpty():
        depth += 1
        further = front.select(F.col("id").alias("src")).join(pairs, "src").select(F.col("dst").alias("id")).distinct()
        front = kept(further.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.union(front)
        if depth % 16 == 0:
            seen = kept(seen)
    return seen


def reified(edges: DataFrame, node: Column, relations: tuple[str, str]) -> DataFrame:
    """Edges (src, dst) as nodes: src -> node and node -> dst with the two relations."""
    ends = F.array(F.struct(F.col("src").alias("from_id"), F.lit(relations[0]).alias("relation"), node.alias("to_id")), F.struct(node.alias("from_id"), F.lit(relations[1]).alias("relation"), F.col("dst").alias("to_id")))
    return edges.select(F.explode(ends).alias("x")).select("x.*").distinct()


def triples(df: DataFrame, subject: Column, predicate: Column, value: Column, iri: Column) -> DataFrame:
    """N-Triples lines; iri says whether the value is an identifier."""
    mark = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    return df.select(F.concat_ws(" ", mark(subject), mark(predicate), F.when(iri, mark(value)).otherwise(literal(value)), F.lit(".")).alias("line"))


def statements(df: DataFrame, subject: Column, predicate: Column, value: Column) -> DataFrame:
    """Reified statements: four triples for each distinct (subject, predicate, value), named by a digest of them."""
    from lexgrove.functions.text import digest

    name = F.concat(F.lit("urn:stmt:"), digest(F.concat_ws("|", subject, predicate, value), 20))
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    parts = F.array(
        F.struct(F.lit(rdf + "type").alias("p"), F.lit(rdf + "Statement").alias("o")),
        F.struct(F.lit(rdf + "subject").alias("p"), subject.alias("o")),
        F.struct(F.lit(rdf + "predicate").alias("p"), predicate.alias("o")),
        F.struct(F.lit(rdf + "object").alias("p"), value.alias("o")),
    )
    rows = df.select(name.alias("s"), F.explode(parts).alias("x")).distinct()
    return triples(rows, F.col("s"), F.col("x.p"), F.col("x.o"), F.lit(True))


def neighbourhood(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, relation, other, outward) of each node's edges either way; a node without edges has one row of nulls."""
    out = edges.select(F.col("src").alias("id"), F.col("edge_type").alias("relation"), F.col("dst").alias("other"), F.lit(True).alias("outward"))
    back = edges.select(F.col("dst").alias("id"), F.col("edge_type").alias("relation"), F.col("src").alias("other"), F.lit(False).alias("outward"))
    return nodes.select("id").join(out.union(back), "id", "left")


def layer(identifier: Column) -> Column:
    """The layer that an identifier's prefix tells."""
    return F.when(identifier.startswith("file:"), 0).when(identifier.startswith("norm:") | identifier.startswith("cond:") | identifier.startswith("exc:"), 2).when(identifier.startswith("align:") | identifier.startswith("hleg:"), 3).otherwise(1)


def subgraph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of evidence edges (src, dst, via, relation), each once."""
    kept = edges.dropDuplicates(["src", "dst", "via"])
    return kept.select(F.col("src").alias("id")).union(kept.select("dst")).distinct(), kept


def of_norms(norms: DataFrame, build_id: str) -> tuple[DataFrame, DataFrame]:
    """Graph rows of norms (norm_id, source_node_id, judge_run_id, judge_verdict, condition_ids, exception_ids)."""
    from lexgrove.operators.review import provenance

    nodes = norms.select(F.col("norm_id").alias("id"), F.lit("NormativeStatement").alias("type"), F.lit(2).alias("layer"))
    proof = provenance(F.lit(None).cast("string"), F.col("judge_verdict"))
    one = lambda kind, target: F.array(F.struct(F.lit(kind).alias("edge_type"), target.alias("dst")))
    many = lambda kind, column: F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("edge_type"), x.alias("dst")))
    every = F.concat(one("DERIVED_FROM", F.col("source_node_id")), one("JUDGED_BY", F.col("judge_run_id")), many("HAS_CONDITION", F.col("condition_ids")), many("HAS_EXCEPTION", F.col("exception_ids")))
    edges = norms.select(F.col("norm_id").alias("src"), proof.alias("provenance_class"), F.explode(every).alias("e")).select("src", "e.dst", "e.edge_type", "provenance_class").filter("dst is not null")
    return nodes, edges.withColumn("edge_id", F.concat_ws(":", F.lit("edge"), F.lower("edge_type"), "src", "dst")).withColumn("build_id", F.lit(build_id))


def of_alignments(assertions: DataFrame, build_id: str) -> tuple[DataFrame, DataFrame]:
    """Graph rows of assertions (id, source_norm_id, target_id, mapping_run_id, judge_run_id, judge_verdict)."""
    from lexgrove.operators.review import provenance

    nodes = assertions.select("id", F.lit("AlignmentAssertion").alias("type"), F.lit(3).alias("layer"))
    proof = provenance(F.lit(None).cast("string"), F.col("judge_verdict"))
    kinds = (("ASSERTS_ALIGNMENT_OF", "source_norm_id"), ("ASSERTS_ALIGNMENT_TO", "target_id"), ("PRODUCED_BY_MAPPING_RUN", "mapping_run_id"), ("JUDGED_BY", "judge_run_id"))
    every = F.array(*[F.struct(F.lit(k).alias("edge_type"), F.col(c).alias("dst")) for k, c in kinds])
    edges = assertions.select(F.col("id").alias("src"), proof.alias("provenance_class"), F.explode(every).alias("e")).select("src", "e.dst", "e.edge_type", "provenance_class").filter("dst is not null")
    return nodes, edges.withColumn("edge_id", F.concat_ws(":", F.lit("edge"), F.lower("edge_type"), "src", "dst")).withColumn("build_id", F.lit(build_id))
