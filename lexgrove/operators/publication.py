"""Publication in two phases: tables are written beside what is published, then one small file of the next number names them all.

A version is a file versions/<n>.json that is created exclusively: of two writers of one number the file system lets one win and the other
takes the next. A reader sees the highest version whose file is whole, so a failed or half-written build is never seen, ties of clocks don't matter,
and earlier versions can still be read. Nothing that was published is overwritten.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.operators import graph, review
from lexgrove.operators.store import kept

_VERSION = "version long, build string, tables map<string,long>, complete boolean"


def _files(spark: SparkSession, path: str):
    """(file system, path) of the session's store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, build, tables, complete) of all whole versions; tables: rows by table."""
    files, at = _files(spark, f"{path}/versions")
    if not files.exists(at):
        return spark.createDataFrame([], _VERSION)
    return spark.read.schema(_VERSION).json(f"{path}/versions").filter("complete")


def current(spark: SparkSession, path: str) -> dict | None:
    """The highest whole version."""
    last = versions(spark, path).orderBy(F.desc("version")).first()
    return last.asDict() if last else None


def stage(tables: dict[str, DataFrame], path: str, partitions: dict[str, list[str]] | None = None) -> tuple[str, dict[str, int]]:
    """(build, rows by table): tables written under a new name that no reader looks for. A task that fails fails the whole of it."""
    spark, build = next(iter(tables.values())).sparkSession, f"{path}/builds/{uuid.uuid4().hex}"
    counts = {}
    for name, df in tables.items():
        by = (partitions or {}).get(name)
        (df.write.partitionBy(*by) if by else df.write).parquet(f"{build}/{name}")
        counts[name] = spark.read.parquet(f"{build}/{name}").count()
    return build, counts


def commit(spark: SparkSession, path: str, build: str, counts: dict[str, int]) -> int:
    """The number under which a staged build is published."""
    last = current(spark, path)
    n = last["version"] + 1 if last else 1
    while True:
        files, at = _files(spark, f"{path}/versions/{n:012d}.json")
        try:
            out = files.create(at, False)
        except Py4JJavaError as taken:
            if "already exists" not in str(taken.java_exception):
                raise
            n += 1
            continue
        try:
            out.write(bytearray(json.dumps({"version": n, "build": build, "tables": counts, "complete": True}), "utf-8"))
        finally:
            out.close()
        return n


def publish(tables: dict[str, DataFrame], violations: DataFrame, path: str, partitions: dict[str, list[str]] | None = None) -> int:
    """The version under which all tables are published together; with any violation (gate, id) nothing is written and the first 20 are raised."""
    bad = violations.limit(20).collect()  # a report
    if bad:
        raise ValueError(f"not published: {[tuple(x) for x in bad]}")
    build, counts = stage(tables, path, partitions)
    return commit(next(iter(tables.values())).sparkSession, path, build, counts)


def read(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """A published table, of the current version unless another is named."""
    found = versions(spark, path)
    found = found.filter(F.col("version") == version) if version is not None else found.orderBy(F.desc("version"))
    row = found.first()
    if row is None:
        raise ValueError(f"nothing is published: {path}")
    return spark.read.parquet(f"{row['build']}/{name}")


def release_layers(base_nodes: DataFrame, norms: DataFrame, assertions: DataFrame, decisions: DataFrame, chain: DataFrame, path: str, build_id: str) -> DataFrame:
    """Publish layers 2 and 3 over a base layer (id, type, layer) and hold what was written against what was sent: (gate, n, version, chain_id).

    Human decisions are laid over norms (norm_id, source_span_id, source_node_id, judge_run_id, judge_verdict, review_status, condition_ids, exception_ids) and
    assertions (id, source_norm_id, target_id, mapping_run_id, judge_run_id, judge_verdict, review_status, source_evidence_span_ids, target_evidence_span_ids).
    Gates before: G3 (an accepted norm has a span), G4 (an accepted assertion has evidence on both sides). Norms, assertions, graph nodes and the graph edges
    whose ends exist are one version.
    """
    from lexgrove.operators.gates import post_load

    of = lambda rows, key: decisions.join(rows.select(F.col(key).alias("item_id")), "item_id", "left_semi")
    known = norms.select(F.col("norm_id").alias("item_id")).union(assertions.select("id"))
    lost = decisions.join(known, "item_id", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"no such item: {lost[0]['item_id']}")
    norms, assertions = kept(review.decided_over(norms, of(norms, "norm_id"), "norm_id")), kept(review.decided_over(assertions, of(assertions, "id"), "id"))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    accepted = F.col("judge_verdict") == "accepted"
    bad = norms.filter(accepted & (F.coalesce("source_span_id", F.lit("")) == "")).select(F.lit("G3").alias("gate"), F.col("norm_id").alias("id"))
    bad = bad.union(assertions.filter(accepted & (empty("source_evidence_span_ids") | empty("target_evidence_span_ids"))).select(F.lit("G4"), "id"))
    (n2, e2), (n3, e3) = graph.of_norms(norms, build_id), graph.of_alignments(assertions, build_id)
    nodes = n2.unionByName(n3)
    everything = base_nodes.select("id", "type", "layer").unionByName(nodes)
    edges = review.landing(e2.unionByName(e3), everything)
    spark = norms.sparkSession
    version = publish({"norms": norms, "assertions": assertions, "nodes": nodes, "edges": edges}, bad, path)
    sent = norms.count(), assertions.count()
    written = {x: read(spark, path, x, version) for x in ("norms", "assertions", "edges")}
    gates = post_load(written["norms"], sent[0], written["assertions"], sent[1], written["edges"], build_id)
    return gates.withColumn("version", F.lit(version)).withColumn("chain_id", F.lit(review.chain_id(chain, "role", "sha").first()[0]))
