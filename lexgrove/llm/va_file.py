"""Exact top-k inner products by a vector-approximation file.

Equal vectors are one class with its TOP + 1 least vec_ids (a query skips its own row, so no more can be among its TOP). Each
component is quantised to one of CELLS cells; the classes' codes are a file apart from the vectors. Blocks of at most about BLOCK
distinct queries scan the codes: a cell's middle and width bound the product from both sides. What is below the (TOP + 1)-th
greatest lower bound goes; the rest is read exactly, in the order of the upper bounds, until no bound reaches the results.

Defined results: rows with null vec_id, or a vector that is null, empty, of another length than the most usual one (of those, the
shortest), or holds null or non-finite components, take no part; a query skips all rows of its own vec_id; rows that agree in
vec_id and vector are one, and of several vectors of one vec_id the least is asked and each may be found; ties go to the smaller vec_id; fewer candidates give fewer ranks; an empty table gives no rows;
other columns are ignored. Products must fit in 53 bits.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.llm.common import map_arrow, materialise

TOP = 10
EVERY = 100
SCALE = 1024.0
CELLS = 256
BLOCK = 8192
#: Codes that a task scans at once.
ROWS = 4096
#: Tasks that a query's candidates are read by.
PARTS = 8


def vectors(df: DataFrame) -> DataFrame:
    """(vec_id, vec, dim): integer components as little-endian 64-bit numbers."""

    def make():
        def call(batch: pa.RecordBatch):
            column = batch.column("embedding")
            ids, out = batch.column("vec_id").to_pylist(), []
            for i, x in enumerate(column):
                if x.is_valid and ids[i] is not None and len(x.values) and not x.values.null_count:
                    v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if np.isfinite(v).all():
                        out.append((ids[i], np.floor(v * SCALE).astype("<i8").tobytes(), len(v)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.int32())], names=["vec_id", "vec", "dim"])

        return call

    return map_arrow(df.select("vec_id", "embedding"), make, "vec_id long, vec binary, dim int")


def _rows(column: pa.Array, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def bounds(classes: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Least component and cell width of each dimension."""

    def make():
        def call(batch: pa.RecordBatch):
            if batch.num_rows:
                x = _rows(batch.column("vec"), "<i8", dim)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(x.min(0)), pa.array(x.max(0))], names=["d", "lo", "hi"])

        return call

    found = map_arrow(classes.select("vec"), make, "d long, lo long, hi long").groupBy("d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()  # a row for each dimension
    low, high = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
    for d, a, b in found:
        low[d], high[d] = a, b
    return low, (high - low) // CELLS + 1


def encode(classes: DataFrame, low: np.ndarray, width: np.ndarray) -> DataFrame:
    """(cid, code): the approximation file."""

    def make():
        def call(batch: pa.RecordBatch):
            if batch.num_rows:
                code = ((_rows(batch.column("vec"), "<i8", len(low)) - low) // width).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array([x.tobytes() for x in code], pa.binary())], names=["cid", "code"])

        return call

    return map_arrow(classes.select("cid", "vec"), make, "cid long, code binary")


def scan(codes: DataFrame, queries: list, low: np.ndarray, width: np.ndarray, k: int) -> DataFrame:
    """(qid, cid, upper, slack), written, for (qid, vector) pairs against all codes: what a task's own k-th lower bound doesn't rule out.
    slack is a query's upper less lower bound. The driver holds one block of queries at a time."""
    spark = codes.sparkSession
    dim = len(low)
    block = spark.sparkContext.broadcast((np.array([q for q, _ in queries], np.int64), np.frombuffer(b"".join(bytes(v) for _, v in queries), "<i8").reshape(-1, dim)))

    def run(batches):
        ids, exact = block.value
        q = exact.astype(np.float64)
        slack = np.abs(q) @ (width - 1.0)
        best = np.full((len(ids), k), -np.inf)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            cids = batch.column("cid").to_numpy()
            code = _rows(batch.column("code"), "u1", dim)
            for a in range(0, len(cids), ROWS):
                middle = code[a : a + ROWS] * width.astype(np.float64) + (low + (width - 1) / 2)
                for b in range(0, len(ids), 512):
                    mid = q[b : b + 512] @ middle.T
                    both = np.concatenate([best[b : b + 512], mid], 1)
                    best[b : b + 512] = np.partition(both, both.shape[1] - k, 1)[:, -k:]
                    i, j = np.nonzero(mid >= (best[b : b + 512].min(1) - slack[b : b + 512])[:, None])
                    kept.append((i + b, cids[a + j], mid[i, j]))
                if sum(len(x[0]) for x in kept) > 4 * k * len(ids) + 100_000:
                    kept = [pruned(kept, best, slack)]
        if kept:
            i, c, mid = pruned(kept, best, slack)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(c), pa.array(mid + slack[i] / 2), pa.array(slack[i])], names=["qid", "cid", "upper", "slack"])

    def pruned(kept, best, slack):
        i, c, mid = (np.concatenate(x) for x in zip(*kept, strict=True))
        stays = mid >= best.min(1)[i] - slack[i]
        return i[stays], c[stays], mid[stays]

    found = materialise(codes.mapInArrow(run, "qid long, cid long, upper double, slack double"), "va-found")
    block.unpersist()
    return found


def read(pairs: DataFrame, k: int) -> DataFrame:
    """(qid, cid, score): exact products of pairs (qid, cid, upper, qvec, vec) in the order of falling upper until the k-th is certain. A
    query's pairs are dealt to PARTS, each of which finds k of its own, so no query's candidates are all in one task."""

    def run(batches):
        at, query, found, out = None, None, [], []  # found: a heap of the k best (score, -cid)

        def close():
            out.extend((query, -c, s) for s, c in found)

        for batch in batches:
            for qid, part, cid, upper, qvec, vec in zip(*(batch.column(x).to_pylist() for x in ("qid", "part", "cid", "upper", "qvec", "vec")), strict=True):
                if (qid, part) != at:
                    if query is not None:
                        close()
                    at, query, found = (qid, part), qid, []
                if len(found) < k:
                    heapq.heappush(found, (int(np.frombuffer(qvec, "<i8") @ np.frombuffer(vec, "<i8")), -cid))
                elif upper >= found[0][0]:
                    heapq.heappushpop(found, (int(np.frombuffer(qvec, "<i8") @ np.frombuffer(vec, "<i8")), -cid))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["qid", "cid", "score"])
            out.clear()
        if query is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["qid", "cid", "score"])

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("cid"), F.lit(PARTS))).repartition(n, "qid", "part")
    return dealt.sortWithinPartitions("qid", "part", F.desc("upper"), "cid").mapInArrow(run, "qid long, cid long, score long")


def search(df: DataFrame, top: int = TOP, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score)."""
    k = top + 1
    every_row = materialise(vectors(df), "va-vectors")
    usual = every_row.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim = usual["dim"] if usual else 1
    rows = every_row.filter(F.col("dim") == dim)
    least = Window.partitionBy("vec").orderBy("vec_id")
    members = materialise(rows.select("vec", "vec_id").distinct().withColumn("r", F.row_number().over(least)).filter(F.col("r") <= k).select("vec", "vec_id", "r"), "va-members")
    classes = members.filter("r = 1").select(F.col("vec_id").alias("cid"), "vec")
    classes = materialise(classes, "va-classes")
    low, width = bounds(classes, dim)
    codes = materialise(encode(classes, low, width), "va-codes")
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec"))
    asked = materialise(asked.join(classes.withColumnRenamed("cid", "qid"), "vec").select("query_id", "qid", "vec"), "va-queries")
    queries = asked.select("qid", "vec").dropDuplicates(["qid"])
    blocks = max(1, -(-queries.count() // BLOCK))
    found = None
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect()  # about BLOCK rows
        part = scan(codes, [(x["qid"], x["vec"]) for x in block], low, width, k)
        found = part if found is None else found.union(part)
    by_bound = Window.partitionBy("qid").orderBy(F.desc("upper"), "cid")
    edge = found.withColumn("r", F.row_number().over(by_bound)).filter(F.col("r") <= k).groupBy("qid").agg(F.min(F.col("upper") - F.col("slack")).alias("least"), F.count("*").alias("n"))
    likely = found.join(edge, "qid").filter((F.col("upper") >= F.col("least")) | (F.col("n") < k)).select("qid", "cid", "upper")
    pairs = likely.join(classes, "cid").join(queries.withColumnRenamed("vec", "qvec"), "qid")
    scored = read(pairs, k)
    ids = members.select("vec", "vec_id").join(classes, "vec").select("cid", F.col("vec_id").alias("other"))
    rows_of = scored.join(ids, "cid")
    ordered = Window.partitionBy("qid").orderBy(F.desc("score"), "other")
    firsts = rows_of.select("qid", "score", "other").distinct().withColumn("r", F.row_number().over(ordered)).filter(F.col("r") <= k)
    ranked = asked.select("query_id", "qid").join(firsts, "qid").filter(F.col("other") != F.col("query_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "other")
    return ranked.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= top).select("query_id", "rank", F.col("other").alias("vec_id"), "score")
