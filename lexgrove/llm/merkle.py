"""A dataset manifest as Merkle trees in an external-memory node store; DataFrame operations only.

Every row is a leaf, a digest of its fields. Leaves are sorted into runs by (lang, doc_id), numbered within their tree and written
as level 0 of a Parquet folder; each level is read once, in order, and every RUN consecutive nodes of a tree become a node of the
next level=k folder, until each tree is one node, its subroot. The subroots are the leaves of one more tree, whose last node is the
root. A node's coordinates are (tree, level, place). Proofs are read from the top down by merging each level with the paths of the
level above, run by run: a path is the list of what stands left and right of the nodes on the way to the root. Only
digests are shuffled, once a level, and no tree, level or path is ever in one task as a whole.

Defined results: a null field is "-"; null lang is a tree of its own, the first; within a tree null doc_ids come first and equal doc_ids are
ordered by leaf, so rows that are equal in all fields share what they return; a sole leaf is its own subroot and a sole
subroot the root, with no siblings there; empty and very long texts are fields like any other; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrove.llm.common import materialise, shared_dir, with_small

#: Nodes that become one node, and the fields of a leaf in order.
RUN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def lowered(text: Column) -> Column:
    """text with A to Z in lower case."""
    return F.translate(text, _UPPER, _LOWER)


def tampered(docs: DataFrame) -> Column:
    """Whether a row is tampered with by the check: its doc_id's checksum is divisible by 3."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0, F.lit(False))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with place: their number from 0 within their tree by order. Rows are sorted into runs over all trees at once, so a tree that holds most
    of them is in many runs; rows equal in all of order are split as well. rows is a written table."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order, "tie"]
    runs = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("tie")
    runs = materialise(runs.withColumn("at", F.monotonically_increasing_id()).withColumn("run", F.spark_partition_id()), "merkle-runs")
    parts = runs.groupBy("tree", "run").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("tree", "run", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))  # a row for each tree in each run
    return with_small(runs, base, ["tree", "run"]).withColumn("place", F.col("at") + F.col("base")).drop("at", "run", "base")


class Store:
    """Nodes (tree, place, digest) of a forest, in a folder level=k for each level."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.levels = spark, path, 0

    def level(self, k: int) -> DataFrame:
        return self.spark.read.schema("tree string, place long, digest string").parquet(f"{self.path}/level={k}")

    def add(self, nodes: DataFrame) -> None:
        nodes.select("tree", "place", "digest").write.parquet(f"{self.path}/level={self.levels}")
        self.levels += 1

    def runs(self, k: int) -> DataFrame:
        """(tree, parent, digests): nodes of level k that become one, in order."""
        return self.level(k).groupBy("tree", F.expr(f"place div {RUN}").alias("parent")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]).alias("digests")
        )

    def build(self, leaves: DataFrame) -> None:
        """Write all levels. A tree of one node has no further level."""
        self.add(leaves)
        while self.level(self.levels - 1).filter("place > 0").take(1):
            sole = (F.col("parent") == 0) & (F.size("digests") == 1)  # a first run of one node has no run after it
            above = self.runs(self.levels - 1).filter(~sole)
            self.add(above.select("tree", F.col("parent").alias("place"), F.sha2(F.array_join("digests", ""), 256).alias("digest")))

    def tops(self) -> DataFrame:
        """(tree, height, digest): each tree's last node."""
        found = None
        for k in range(self.levels):
            some = self.level(k).groupBy("tree").agg(F.max("place").alias("last"), F.min_by("digest", "place").alias("digest")).filter("last = 0").select("tree", F.lit(k).alias("height"), "digest")
            found = some if found is None else found.union(some)
        return found

    def paths(self, tops: DataFrame, down_to: int = 0) -> DataFrame:
        """(tree, place, root, path) of the nodes of level down_to: from a node to what tops (tree, height, root, path) say of its tree's last node."""
        found = None
        for k in range(self.levels - 1, down_to - 1, -1):
            mine = tops.filter(F.col("height") == k).select("tree", F.lit(0).cast("long").alias("place"), "root", "path")
            if found is not None:
                mine = mine.unionByName(below(self.runs(k), found))
            found = materialise(mine, f"merkle-paths-{k}")
        return found


def below(runs: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, place, root, path) of the nodes in runs, from the paths of the nodes that they became."""
    joined = runs.join(paths.withColumnRenamed("place", "parent").hint("merge"), ["tree", "parent"])
    return joined.select("tree", "parent", "digests", "root", "path", F.posexplode("digests").alias("i", "digest")).select(
        "tree", (F.col("parent") * RUN + F.col("i")).alias("place"), "root", step(F.col("digests"), F.col("i"), F.col("path")).alias("path")
    )


def step(digests: Column, i: Column, path: Column) -> Column:
    """The path of the i-th of digests, given that of the node which they became."""
    near = F.struct(F.array_join(F.slice(digests, F.lit(1), i), "").alias("left"), F.array_join(F.slice(digests, i + 2, F.lit(RUN)), "").alias("right"))
    return F.concat(F.array(near), path)


NO_PATH = "cast(array() as array<struct<left: string, right: string>>)"


def siblings(path: Column) -> Column:
    """The digests of a path, one after the other."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, digest, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


class Manifest:
    """The trees of a table by lang, and the tree of their subroots."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        where = f"{shared_dir(spark)}/merkle-{uuid.uuid4().hex}"
        fields = [docs[x] for x in FIELDS]
        changed = [*fields[:-1], lowered(docs["text"])]
        # a tree's name keeps the order of lang: null first, then by bytes
        tree = F.coalesce(F.concat(F.lit("="), docs["lang"]), F.lit("")).alias("tree")
        rows = docs.select(docs["doc_id"], tree, leaf(fields).alias("leaf"), F.when(tampered(docs), leaf(changed)).alias("other"))
        self.leaves = materialise(numbered(materialise(rows, "merkle-rows"), ["doc_id", "leaf"]), "merkle-leaves")
        self.trees, self.top = Store(spark, f"{where}/trees"), Store(spark, f"{where}/top")
        self.trees.build(self.leaves.withColumnRenamed("leaf", "digest"))
        self.subroots = materialise(self.trees.tops(), "merkle-subroots")
        numbers = numbered(materialise(self.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "height", "digest"), "merkle-names"), ["name"])
        self.names = materialise(numbers, "merkle-places")
        self.top.build(self.names)
        last = self.top.tops().first()
        self.root: str | None = last["digest"] if last else None

    def proofs(self) -> DataFrame:
        """(tree, place, doc_id, leaf, other, subroot, path) of every leaf; path leads from the leaf to the root."""
        ways = self.top.paths(self.top.tops().select("tree", "height", F.col("digest").alias("root"), F.expr(NO_PATH).alias("path")))
        tops = self.names.join(ways.select("place", "path"), "place").select(F.col("name").alias("tree"), "height", F.col("digest").alias("root"), "path")
        tops = materialise(tops, "merkle-ways")
        sole = tops.filter("height = 0").select("tree", F.lit(0).cast("long").alias("parent"), F.lit(True).alias("sole"), "root", "path")
        if self.trees.levels > 1:
            above = self.trees.paths(tops.filter("height > 0"), 1)
            sole = sole.unionByName(above.select("tree", F.col("place").alias("parent"), F.lit(False).alias("sole"), "root", "path"))
        members = F.array_sort(F.collect_list(F.struct("place", "doc_id", "leaf", "other"))).alias("members")
        runs = self.leaves.groupBy("tree", F.expr(f"place div {RUN}").alias("parent")).agg(members).join(sole.hint("merge"), ["tree", "parent"])
        runs = runs.withColumn("digests", F.transform("members", lambda x: x["leaf"]))
        each = runs.select("tree", "digests", "root", "path", "sole", F.posexplode("members").alias("i", "x"))
        whole = F.when(F.col("sole"), F.col("path")).otherwise(step(F.col("digests"), F.col("i"), F.col("path")))
        return each.select("tree", "x.*", F.col("root").alias("subroot"), whole.alias("path"))


def verify(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, lang, place) of every row, a third of which is tampered with after the
    manifest was made: folded_root is what its leaf then and its proof give."""
    manifest = Manifest(docs)
    found = manifest.proofs().withColumn("root", F.lit(manifest.root).cast("string")).withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("path")))
    lang = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias("lang")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), lang, "place")
