"""Embedding whitening by a one-sided Jacobi SVD.

Entries become integers x = floor(1024 c) + 100000, so counts, sums and deviations are exact. Each task reduces its centred rows block by
block to a triangular factor R (QR of R on top of the next block), and factors are merged FAN at a time in Spark until few are left: what
one place ever holds is a few matrices of the dimension. Plane rotations then make R's columns orthogonal; the accumulated rotations
are the components and the columns' norms, over sqrt(n), their standard deviations, small ones as accurate as large ones.

Defined results: rows whose vector is null, empty, of another length than the most usual one (of those, the shortest), or holds a null, a
non-finite entry or one beyond 2**40 take no part; null and repeated vec_ids are rows like any other; components without variance (fewer
different vectors than dimensions, sole and equal rows) are left out, as nothing can be whitened along them; a deviation that a long can't hold is null;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import map_arrow, materialise

SCALE, SHIFT = 1024.0, 100_000
LARGEST = 2.0**40
COMPONENTS = 8
#: Rows of a block, and factors that are merged at a time.
ROWS = 4096
FAN = 16


def vectors(df: DataFrame) -> DataFrame:
    """(vec_id, vec, dim): integer entries as little-endian 64-bit numbers."""

    def make():
        def call(batch: pa.RecordBatch):
            column, keep, out = batch.column("embedding"), [], []
            for i, x in enumerate(column):
                if x.is_valid and len(x.values) and not x.values.null_count:
                    v = np.floor(SCALE * x.values.to_numpy(zero_copy_only=False).astype(np.float64))
                    if (np.abs(v) <= LARGEST * SCALE).all():  # false for what isn't finite
                        keep.append(i)
                        out.append(v.astype("<i8") + SHIFT)
            ids = batch.column("vec_id").take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([x.tobytes() for x in out], pa.binary()), pa.array(map(len, out), pa.int32())], names=["vec_id", "vec", "dim"])

        return call

    return map_arrow(df.select("vec_id", "embedding"), make, "vec_id long, vec binary, dim int")


def _rows(batch: pa.RecordBatch, dim: int):
    """Blocks of (first row, integer vectors)."""
    column = batch.column("vec")
    for a in range(0, len(column), ROWS):
        yield a, np.frombuffer(b"".join(column[a : a + ROWS].to_pylist()), "<i8").reshape(-1, dim)


def sums(rows: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """(n, S): the number of vectors and the exact sum of each dimension."""

    def run(batches):
        n, total = 0, np.zeros(dim, object)
        for batch in batches:
            for _, x in _rows(batch, dim):
                n, total = n + len(x), total + x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array([n] * dim, pa.int64()), pa.array([str(x) for x in total])], names=["d", "n", "s"])

    found = rows.select("vec").mapInArrow(run, "d long, n long, s string").groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(28,0)")).alias("s")).collect()  # a row for each dimension
    total = np.zeros(dim, object)
    for d, _, s in found:
        total[d] = int(s)
    return (found[0]["n"] if found else 0), total


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """(x - S / n, the exact squared length of n x - S for each row). Numbers of 64 bits where they surely suffice, else Python's."""
    widest = max(int(np.abs(x).max()), 1) * n + max(abs(int(s)) for s in total)
    if widest < 2**63 and (most := int(np.abs(diff := n * x - total.astype(np.int64)).max())) ** 2 * x.shape[1] < 2**63:
        return diff / n, (diff * diff).sum(1).tolist()
    diff = n * x.astype(object) - total
    squares = (diff * diff).sum(1)
    return (diff / n).astype(np.float64), [int(s) if s < 2**63 else None for s in squares]


def triangle(rows: DataFrame, n: int, total: np.ndarray) -> np.ndarray:
    """R of the centred rows, up to the signs of its rows. The driver gets at most FAN factors."""
    dim = len(total)

    def reduce(batches):
        r = np.zeros((0, dim))
        for batch in batches:
            for _, x in _rows(batch, dim):
                r = np.linalg.qr(np.concatenate([r, _centred(x, n, total)[0]]), mode="r")
        if len(r):
            yield factor(TaskContext.get().partitionId(), r)

    def merge(batches):
        at, r = None, None
        for batch in batches:
            for part, name, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                block = np.frombuffer(data, np.float64).reshape(-1, dim)
                if part != at:
                    if at is not None:
                        yield factor(at, r)
                    at, r = part, np.zeros((0, dim))
                r = np.linalg.qr(np.concatenate([r, block]), mode="r")
        if at is not None:
            yield factor(at, r)

    def factor(part, r):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    found = materialise(rows.select("vec").mapInArrow(reduce, "part long, r binary"), "whitening-factors")
    while (left := found.count()) > FAN:
        dealt = found.select(F.expr(f"part div {FAN}").alias("part"), F.col("part").alias("name"), "r").repartition(-(-left // FAN), "part").sortWithinPartitions("part", "name")
        found = materialise(dealt.mapInArrow(merge, "part long, r binary"), "whitening-factors")
    blocks = [np.frombuffer(bytes(x["r"]), np.float64).reshape(-1, dim) for x in found.orderBy("part").collect()]
    return np.linalg.qr(np.concatenate([np.zeros((dim, dim)), *blocks]), mode="r")


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of a square matrix, by falling value: rotations of pairs of columns, a round of disjoint
    pairs at a time, until all columns are orthogonal to working precision."""
    d = r.shape[1]
    a, v = r.astype(np.float64).copy(), np.eye(d)
    ring = np.arange(d + d % 2)
    half = len(ring) // 2
    tiny = np.finfo(np.float64).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = ring[:half], ring[half:][::-1]
            real = (p < d) & (q < d)
            p, q = p[real], q[real]
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            some = np.abs(gamma) > tiny * np.sqrt(alpha) * np.sqrt(beta)
            if not some.any():
                continue
            turned = True
            p, q, x, y = p[some], q[some], x[:, some], y[:, some]
            zeta = (beta[some] - alpha[some]) / (2 * gamma[some])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            x, y = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    sigma = np.sqrt((a * a).sum(0))
    order = np.argsort(-sigma, kind="stable")
    return sigma[order], v[:, order]


def moments(parts: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, centred products) of the union of blocks that are given so."""
    n, mean, m2 = 0, np.zeros(k), np.zeros((k, k))
    for b, mu, co in parts:
        if b:
            delta = mu - mean
            m2 = m2 + co + np.outer(delta, delta) * (n * b / (n + b))
            mean = mean + delta * (b / (n + b))
            n += b
    return n, mean, m2


class Whitening:
    """What is fitted: n, sums, components (columns), standard deviations, explained shares."""

    def __init__(self, rows: DataFrame, dim: int, components: int = COMPONENTS):
        self.dim = dim
        self.n, self.sums = sums(rows, dim)
        sigma, v = jacobi(triangle(rows, self.n, self.sums)) if self.n else (np.zeros(dim), np.eye(dim))
        real = int((sigma > sigma.max(initial=0) * dim * np.finfo(np.float64).eps * 8).sum())
        self.k = min(components, real)
        self.v, self.deviation = v[:, : self.k], sigma[: self.k] / np.sqrt(max(self.n, 1))
        self.explained = sigma[: self.k] ** 2 / max((sigma**2).sum(), np.finfo(np.float64).tiny)

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """(whitened coordinates, deviations) of integer vectors."""
        centred, deviation = _centred(x, self.n, self.sums)
        return centred @ self.v / self.deviation, deviation

    def error(self, rows: DataFrame) -> float:
        """Largest absolute entry of the whitened rows' covariance minus the identity. Blocks are centred by themselves and then put together; the driver
        gets k * k numbers of each part of the rows after they were put together FAN at a time."""
        k, dim = self.k, self.dim

        def block(n, mean, m2, part):
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([mean.tobytes()], pa.binary()), pa.array([m2.tobytes()], pa.binary())], names=["part", "n", "mean", "m2"])

        def of_rows(batches):
            held = (0, np.zeros(k), np.zeros((k, k)))
            for batch in batches:
                for _, x in _rows(batch, dim):
                    w = self.apply(x)[0]
                    mu = w.mean(0)
                    held = moments([held, (len(w), mu, (w - mu).T @ (w - mu))], k)
            if held[0]:
                yield block(*held, TaskContext.get().partitionId())

        def of_parts(batches):
            held, at = (0, np.zeros(k), np.zeros((k, k))), None
            for batch in batches:
                for part, n, mean, m2 in zip(*(batch.column(x).to_pylist() for x in ("part", "n", "mean", "m2")), strict=True):
                    if part != at and at is not None:
                        yield block(*held, at)
                        held = (0, np.zeros(k), np.zeros((k, k)))
                    at = part
                    held = moments([held, (n, np.frombuffer(mean), np.frombuffer(m2).reshape(k, k))], k)
            if at is not None:
                yield block(*held, at)

        kind = "part long, n long, mean binary, m2 binary"
        found = materialise(rows.select("vec").mapInArrow(of_rows, kind), "whitening-moments")
        while (left := found.count()) > FAN:
            dealt = found.withColumn("name", F.col("part")).withColumn("part", F.expr(f"part div {FAN}")).repartition(-(-left // FAN), "part").sortWithinPartitions("part", "name")
            found = materialise(dealt.mapInArrow(of_parts, kind), "whitening-moments")
        n, _, m2 = moments([(x["n"], np.frombuffer(bytes(x["mean"])), np.frombuffer(bytes(x["m2"])).reshape(k, k)) for x in found.orderBy("part").collect()], k)
        return float(np.abs(m2 / n - np.eye(k)).max()) if n and k else 0.0


def whitened(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    every_row = materialise(vectors(df), "whitening-vectors")
    usual = every_row.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim = usual["dim"] if usual else 1
    rows = every_row.filter(F.col("dim") == dim).select("vec_id", "vec")
    fit = Whitening(rows, dim, components)
    error, k = fit.error(rows), fit.k
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def make():
        def call(batch: pa.RecordBatch):
            for a, x in _rows(batch, dim):
                if not k:
                    return
                w, deviation = fit.apply(x)
                m = len(x)
                ids = batch.column("vec_id")[a : a + m].take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n, np.int64)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(w.ravel()), pa.array(np.tile(fit.explained, m)), pa.array(np.full(m * k, error)),
                ], names=names)

        return call

    return map_arrow(rows, make, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
