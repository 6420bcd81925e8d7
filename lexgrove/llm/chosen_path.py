"""Near-duplicates by a chosen-path similarity join on sets of word shingles.

1. Equal sets are one class, named by a cryptographic digest. A class gets TREES x DEPTH minwise tokens, whose low bytes are its sketch.
2. In each of TREES independent trees the root branches by START minwise tokens and a node by the next one as long as it holds more than LEAF of
   them. Leaves compare their sketches exhaustively; sets that may be similar become neighbours (a spanning forest of them is kept).
   What is still in a larger node at DEPTH shares DEPTH tokens and becomes neighbours of one of them without comparison.
3. Neighbours' components are put together with their whole texts, whose words and shingles are compared as such and not by hashes. A
   component of more than NODE sets, or SHINGLES shingles, is again dealt to the nodes of the trees, which are as small as long as tokens tell
   their sets apart. Within a node, sets outside the largest cluster are held against all sets of the node, so every link between two
   clusters is found without comparing all pairs. A part beyond that size that DEPTH tokens don't tell apart is compared in blocks that
   share some sets; then every set outside the part's largest cluster is held against all blocks of the part, so nothing of a part stays
   uncompared, whatever its size.
4. Exact links' components are the result.

Two sets of similarity s share a leaf of depth d in one of the trees with probability 1 - (1 - s**d)**TREES: for s = 0.85 above
0.99999 at depth 2 and 0.999 at depth 4. Depths beyond 2 occur where many sets are alike, and there one link of many is enough.

Defined results: null and empty texts have the empty set, linked with nothing; a row with null doc_id takes no part (component_id
null, kept true); rows of equal doc_id are classes by their texts and share the least component_id of these; an empty table
gives no rows; other columns are ignored by the digest and kept by the pipeline stage, which of rows of equal doc_id keeps those whose texts
are near-duplicates of nothing that is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm import chunks, shingles
from lexgrove.llm.common import columns, give_back, map_arrow, materialise, with_few
from lexgrove.llm.graph import components

TREES = 10
DEPTH = 7
START = 2
LEAF = 256
#: The most sets, and shingles in all, that are compared as one group.
NODE = 2048
SHINGLES = 1 << 21
#: About so many sets of a part are in all its blocks; they tie its clusters, so that few sets are left to hold against all blocks.
HEADS = 32
#: Candidates' sketches agree in the similarity less this share of their bytes.
SLACK = 0.22
#: Bytes of text whose words are numbered together.
TEXTS = 1 << 22


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, h, n_shingles, cls, sig, sketch); h is a hash of the text, cls names the set and is null for the empty one."""

    def make():
        def call(batch: pa.RecordBatch):
            data, at = chunks.utf8(batch.column("text"))
            for i, j in chunks.steps(at):
                values, off, names = shingles.sets(data[at[i] : at[j]], at[i : j + 1] - at[i], k)
                least = shingles.minwise(values, off, TREES * DEPTH)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("h").slice(i, j - i), pa.array(np.diff(off)), pa.array(names, pa.binary()), _binary(least.astype(">u4")), _binary((least & 0xFF).astype(np.uint8))],
                    names=["doc_id", "h", "n_shingles", "cls", "sig", "sketch"],
                )

        return call

    return map_arrow(docs.select("doc_id", "text", text_hash().alias("h")), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, n_shingles long, cls binary, sig binary, sketch binary")


def text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def nodes(sets: DataFrame, limit: int, shingles: int | None, name: str) -> tuple[DataFrame, DataFrame]:
    """sets (cls, sig, n_shingles, ...) dealt to the trees' nodes: (leaves, rest), each a row for each tree with column node. Leaves' nodes hold
    `limit` sets and as many shingles at most; rest is what DEPTH tokens don't tell apart."""
    rows = sets.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
    leaves = []
    for depth in range(START, DEPTH + 1):
        part = F.expr(f"substring(sig, tree * {4 * DEPTH} + 1, {4 * depth})")
        rows = rows.withColumn("node", F.xxhash64("tree", part))
        size = rows.groupBy("node").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("all"))
        over = F.col("n") > limit
        if shingles is not None:
            over = over | (F.col("all") > shingles) & (F.col("n") > 1)
        large = materialise(size.filter(over).select("node"), f"{name}-large")
        if large.isEmpty():
            leaves.append(rows)
            rows = rows.limit(0)
            break
        leaves.append(rows.join(large, "node", "left_anti"))
        rows = materialise(rows.join(large, "node", "left_semi"), f"{name}-rows")  # else each level would branch all those above it again
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    return out, rows


def runs(batches):
    """Tables of whole groups of rows of equal node from batches sorted by node."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        node = table.column("node").to_numpy()
        edge = np.flatnonzero(node[1:] != node[:-1]) + 1
        if held and node[0] != last:
            edge = np.concatenate([[0], edge])
        last = node[-1]
        if not len(edge):
            held.append(table)
            continue
        stop = int(edge[-1])
        whole = pa.concat_tables([*held, table.slice(0, stop)])
        held = [table.slice(stop)]
        if whole.num_rows:
            yield whole.combine_chunks()
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return data.reshape(len(column), -1).view(kind) if len(column) else np.zeros((0, 1), kind)


class Forest:
    """Disjoint sets of small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def neighbours(leaves: DataFrame, share: float) -> DataFrame:
    """(a, b): a spanning forest, in each leaf, of the pairs whose sketches agree in `share` of their bytes."""

    def make(batches):
        for table in runs(batches):
            node = table.column("node").to_numpy()
            sketch, cls = _matrix(table.column("sketch"), np.uint8), table.column("cls").to_pylist()
            start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            size = np.diff(np.append(start, len(node)))
            left, right = [], []
            for n in np.unique(size[size > 1]).tolist():
                i, j = np.triu_indices(n, 1)
                begin = start[size == n]
                for a in range(0, len(begin), max(1, 200_000 // len(i))):
                    base = begin[a : a + max(1, 200_000 // len(i)), None]
                    x, y = (base + i).ravel(), (base + j).ravel()
                    near = (sketch[x] == sketch[y]).sum(1) >= share * sketch.shape[1]
                    left.append(x[near])
                    right.append(y[near])
            if left and sum(map(len, left)):
                forest = Forest(len(node))
                kept = [(x, y) for x, y in zip(np.concatenate(left).tolist(), np.concatenate(right).tolist(), strict=True) if cls[x] != cls[y] and forest.join(x, y)]
                yield pa.RecordBatch.from_arrays([pa.array([cls[x] for x, _ in kept], pa.binary()), pa.array([cls[y] for _, y in kept], pa.binary())], names=["a", "b"])
        give_back()

    n = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return leaves.select("node", "cls", "sketch").repartition(n, "node").sortWithinPartitions("node").mapInArrow(make, "a binary, b binary")


def solve(values: np.ndarray, at: np.ndarray, percent: int, asked: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges that span the components of the sets' graph: links where 100 * intersection >= percent * union. With asked, of the graph
    that has only the links of these sets."""
    n, size = len(at) - 1, np.diff(at)
    word, token = np.unique(values, return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(token, kind="stable")
    posting, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(word)))])
    forest, edges = Forest(n), []

    def query(i: int) -> None:
        tokens = token[at[i] : at[i + 1]]
        begin, count = first[tokens], first[tokens + 1] - first[tokens]
        ends = np.cumsum(count)
        shared = np.bincount(posting[np.repeat(begin - ends + count, count) + np.arange(int(ends[-1]))], minlength=n)
        linked = np.flatnonzero((100 * shared >= percent * (size + size[i] - shared)) & (shared > 0))
        edges.extend((i, j) for j in linked.tolist() if j != i and forest.join(i, j))

    if asked is not None:
        for i in asked:
            query(i)
        return edges
    done = set()
    for i in (0, n // 2, n - 1):  # a few sets, to find the largest cluster
        if i not in done:
            done.add(i)
            query(i)
    roots = [forest.root(i) for i in range(n)]
    largest = max(set(roots), key=roots.count)
    for i in range(n):
        if i not in done and forest.root(i) != forest.root(largest):
            query(i)
    return edges


def links(grouped: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): exact links that span the components within each node of grouped (node, cls, text). If grouped has a column asked, only
    the links of the sets where it is true."""
    some = "asked" in grouped.columns

    def make(batches):
        for table in runs(batches):
            node, cls, text = table.column("node").to_numpy(), table.column("cls").to_pylist(), table.column("text").to_pylist()
            asks = {(x, y) for x, y, z in zip(node.tolist(), cls, table.column("asked").to_pylist(), strict=True) if z} if some else None
            start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])).tolist()
            groups = [sorted({cls[i]: i for i in range(a, b)}.values(), key=lambda i: cls[i]) for a, b in zip(start, [*start[1:], len(node)], strict=True)]
            out, held, size = [], [], 0

            def close():
                values, at = shingles.exact([text[i] for mine in held for i in mine], k)
                end = 0
                for mine in held:
                    begin, end = end, end + len(mine)
                    asked = [i for i, j in enumerate(mine) if (int(node[j]), cls[j]) in asks] if some else None
                    out.extend((cls[mine[i]], cls[mine[j]]) for i, j in solve(values[at[begin] : at[end]], at[begin : end + 1] - at[begin], percent, asked))
                held.clear()

            for mine in groups:
                if len(mine) > 1:
                    held.append(mine)
                    size += sum(len(text[i]) for i in mine)
                    if size > TEXTS:
                        close()
                        size = 0
            if held:
                close()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], names=["a", "b"])
        give_back()

    n = int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grouped.select("node", "cls", F.encode("text", "UTF-8").alias("text"), *(["asked"] if some else [])).repartition(n, "node").sortWithinPartitions("node").mapInArrow(make, "a binary, b binary")


def blocks(rest: DataFrame) -> DataFrame:
    """rest (node, cls, n_shingles) with n, the sets of the part, and block: each part is dealt to blocks of well under half of a node's most."""
    n = rest.groupBy("node").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("all"))
    many = F.ceil(F.greatest(F.col("n") / (NODE * 3 / 8), F.col("all") / (SHINGLES * 3 / 8)))
    return rest.join(n, "node").select("node", "cls", "n_shingles", "n", F.pmod(F.xxhash64("cls"), many).alias("block"))


def within(split: DataFrame) -> DataFrame:
    """(cls, node): the blocks of split, each with the heads of its part."""
    heads = split.filter(F.pmod(F.xxhash64("cls", F.lit(1)), F.ceil(F.col("n") / HEADS)) == 0).select("node", "cls")
    everywhere = heads.join(split.select("node", "block").distinct(), "node").select("node", "cls", "block")
    return split.select("node", "cls", "block").union(everywhere).select("cls", F.xxhash64("node", "block").alias("node")).distinct()


def across(split: DataFrame, linked: DataFrame) -> DataFrame:
    """(cls, node, asked): every set outside the largest cluster of its part, by linked (v, root), is asked beside each block of the part."""
    named = split.join(linked.withColumnRenamed("v", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = materialise(named, "path-parts")
    largest = named.groupBy("node", "root").count().groupBy("node").agg(F.max_by("root", F.struct("count", "root")).alias("largest"))
    outside = named.join(largest, "node").filter("root != largest").select("node", "cls", "n_shingles")
    outside = materialise(blocks(outside).select("node", "cls", F.col("block").alias("asker")), "path-outside")
    pairs = outside.select("node", "asker").distinct().join(split.select("node", "block").distinct(), "node")
    name = F.xxhash64("node", "asker", "block").alias("node")
    asking = pairs.join(outside, ["node", "asker"]).select("cls", name, F.lit(True).alias("asked"))
    return asking.union(pairs.join(split.select("node", "block", "cls"), ["node", "block"]).select("cls", name, F.lit(False).alias("asked")))


def grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, h, n_shingles, cls, first) of every row: first is the least (doc_id, h) of its component."""
    signed = materialise(signatures(docs, k), "path-signatures")
    known = signed.filter("cls is not null and doc_id is not null")
    least = known.groupBy(F.col("cls").alias("_cls")).agg(F.min(F.struct("doc_id", "h")).alias("least"))
    sets = known.join(least, (known["cls"] == least["_cls"]) & (known["doc_id"] == least["least.doc_id"]) & (known["h"] == least["least.h"]), "left_semi")
    sets = materialise(sets.dropDuplicates(["cls"]), "path-sets")
    leaves, rest = nodes(sets, LEAF, None, "path-leaves")
    heads = rest.groupBy("node").agg(F.min("cls").alias("a"))
    stuck = rest.join(heads, "node").select("a", F.col("cls").alias("b"))
    clusters = materialise(components(neighbours(leaves, percent / 100 - SLACK).union(stuck), "path-near"), "path-clusters")
    placed = materialise(clusters.withColumnRenamed("v", "cls").join(sets.select("cls", "sig", "doc_id", "h", "n_shingles"), "cls"), "path-placed")
    big = placed.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("all")).filter((F.col("n") > NODE) | (F.col("all") > SHINGLES) & (F.col("n") > 2))
    big = materialise(big.select("root"), "path-big")
    at_once = placed.join(big, "root", "left_anti").select("cls", F.xxhash64("root").alias("node"))
    split = None
    if not big.isEmpty():
        inner, rest = nodes(placed.join(big, "root", "left_semi"), NODE, SHINGLES, "path-nodes")
        at_once = at_once.union(inner.select("cls", "node"))
        if not rest.isEmpty():
            split = materialise(blocks(rest), "path-split")
            at_once = at_once.union(within(split))
    texts = with_few(docs.select("doc_id", "text", text_hash().alias("h")), placed.select("doc_id", "h", "cls"), ["doc_id", "h"]).select("cls", "text").dropDuplicates(["cls"])
    exact = links(at_once.join(texts, "cls"), k, percent)
    if split is not None:
        exact = materialise(exact, "path-exact")
        exact = exact.union(links(across(split, components(exact, "path-blocks")).join(texts, "cls"), k, percent))
    linked = materialise(components(exact, "path-links"), "path-linked")
    named = least.join(linked.withColumnRenamed("v", "_cls"), "_cls", "left").withColumn("root", F.coalesce("root", "_cls"))
    first = named.groupBy("root").agg(F.min("least").alias("first"))
    labels = named.join(first, "root").select(F.col("_cls").alias("cls"), "first")
    return signed.select("doc_id", "h", "n_shingles", "cls").join(labels, "cls", "left").withColumn("first", F.when(F.col("doc_id").isNotNull(), F.col("first")))


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    own = F.coalesce("first.doc_id", "doc_id")
    return grouped(docs, k, percent).select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs, with all columns, less all rows of a component but its least (doc_id, text); of rows that agree in both, one stays. Rows
    without words or doc_id stay."""
    found = materialise(grouped(docs, k, percent), "path-grouped").filter("first is not null")
    gone = found.filter("doc_id <> first.doc_id or h <> first.h").select("doc_id", "h").distinct()
    named = docs.withColumns({"_h" + "_" * len("".join(docs.columns)): text_hash()})
    h = named.columns[-1]
    left = with_few(named, gone.withColumnRenamed("h", h), ["doc_id", h], "left_anti")
    again = materialise(found.filter("doc_id = first.doc_id and h = first.h").groupBy("doc_id", "h").count().filter("count > 1").select("doc_id", F.col("h").alias(h)), "path-again")
    if again.isEmpty():
        return left.select(columns(docs))
    row = F.struct(*columns(docs))
    once = with_few(left, again, ["doc_id", h], "left_semi").groupBy("doc_id", h).agg(F.min_by(row, F.xxhash64(row)).alias("row")).select("row.*")
    return with_few(left, again, ["doc_id", h], "left_anti").select(columns(docs)).union(once.select(columns(docs)))
