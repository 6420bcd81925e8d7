"""Quality scores by Bradley-Terry ranking of document pairs.

A document is a vector of text statistics. Every pair of a good and a bad labelled document is a preference; logistic loss on the
differences of their vectors (Newton steps with a ridge) gives weights, and a document's worth is its weighted sum. The cut is the
quantile of the training worths at the training share of bad labels; a worth at the cut scores CUT.

All labelled rows that aren't held out teach, and all their pairs: a pair's loss depends on two worths alone, so Spark sums vectors by
points of a grid of worths (a vector counts at the two points beside its worth, by nearness), and the pairs of points stand for the pairs
of rows. The error of a chance is below STEP ** 2 / 30. A step takes two passes over the training vectors; sums are decimals, so they
don't depend on the order of rows. A row is held out, and teaches nothing, if crc32(doc_id as text) mod 5 is 0.

Defined results: null text is empty; empty texts have a score like any other; a null doc_id counts as '' for the fold; labels
that are null, other than 0 and 1, or contradict each other for one doc_id are not used; without labels of both classes every score
is 0.5; rows of equal doc_id are scored each, and the one with the least vector teaches; an empty table gives no rows; very long texts
are read whole; other columns are never inputs, whatever their names, and are kept by the pipeline stage.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm import chunks, shingles
from lexgrove.llm.common import map_arrow, materialise, running_sum

CUT = 0.3
#: Nothing is sampled: no query reads this. The name stays because a test sets it.
SAMPLE = None
#: Pairs that Ranking draws from rows in memory; `fit` takes all pairs of all rows.
PAIRS = 40_000
RIDGE = 1e-3
#: Distance of the grid's points, and the most Newton steps, halved ones included.
STEP = 1 / 32
STEPS = 30
FOLDS = 5
_MARKS = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, features) of texts given as (bytes, offsets)."""
    word, first = shingles.words(data, at)
    word = word[:, 0]
    out = []
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        count = np.bincount(data[a:b], minlength=256)
        w = word[first[i] : first[i + 1]]
        n, size = len(w), b - a
        lower, upper, digits, wide = count[97:123].sum(), count[65:91].sum(), count[48:58].sum(), count[128:].sum()
        letters = lower + upper + wide
        kinds = len(np.unique(w))
        again = np.count_nonzero(w[1:] == w[:-1]) / max(n - 1, 1)
        pairs = w[1:] * np.uint64(3) + w[:-1]
        pair_kinds = len(np.unique(pairs)) / max(len(pairs), 1)
        marks = count[_MARKS]
        out.append([
            math.log1p(n), math.log1p(size), upper / (letters + 1), digits / (size + 1), wide / (size + 1), letters / (size + 1),
            marks.sum() / (size + 1), count[10] / (n + 1), math.log1p(kinds) / math.log(n + 2), kinds / (n + 1), again, math.sqrt(again), pair_kinds,
            (letters / n if n else 0.0) / 10, *np.sqrt(marks / (n + 1)).tolist(),
        ])
    return np.array(out, np.float64).reshape(len(at) - 1, -1)


def _scored(batch: pa.RecordBatch, function) -> np.ndarray:
    data, at = chunks.utf8(batch.column("text"))
    parts = [function(statistics(data[at[i] : at[j]], at[i : j + 1] - at[i])) for i, j in chunks.steps(at)]
    return np.concatenate(parts) if parts else np.zeros(0)


class Ranking:
    """Weights, cut and scale of worths; made from rows in memory and drawn pairs, or (`of`) from what `fit` found on all rows."""

    @classmethod
    def of(cls, middle, spread, weights, cut: float) -> Ranking:
        made = cls.__new__(cls)
        made.middle, made.spread, made.weights, made.cut = middle, spread, weights, cut
        return made

    def __init__(self, x: np.ndarray, label: np.ndarray, bad_share: float):
        self.middle, self.spread = (x.mean(0), x.std(0) + 1e-9) if len(x) else (0.0, 1.0)
        self.weights, self.cut = None, 0.0
        good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
        if not len(good) or not len(bad):
            return
        z = np.clip((x - self.middle) / self.spread, -8, 8)
        random = np.random.default_rng(1)
        n = min(PAIRS, len(good) * len(bad))
        d = z[random.choice(good, n)] - z[random.choice(bad, n)]
        w = np.zeros(d.shape[1])
        for _ in range(12):
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance of the worse being preferred
            gradient = d.T @ p / n - RIDGE * w
            hessian = (d * (p * (1 - p))[:, None]).T @ d / n + RIDGE * np.eye(len(w))
            w = w + np.linalg.solve(hessian, gradient)
        self.weights = w
        worth = z @ w
        weight = np.where(label == 1, (1 - bad_share) / len(good), bad_share / len(bad))
        order = np.argsort(worth)
        below = np.cumsum(weight[order])
        k = int(np.searchsorted(below, bad_share - 1e-12))
        k = min(k, len(order) - 2)
        self.cut = float((worth[order[k]] + worth[order[k + 1]]) / 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        worth = np.clip((x - self.middle) / self.spread, -8, 8) @ self.weights - self.cut
        return 1 / (1 + np.exp(-np.clip(worth + math.log(CUT / (1 - CUT)), -500, 500)))


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every text."""

    def make():
        def call(batch: pa.RecordBatch):
            x = _scored(batch, lambda x: x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

        return call

    return map_arrow(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x binary")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float64).reshape(batch.num_rows, -1)


def training_vectors(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, x) of every doc_id with a label that counts: one vector each, the least."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
    known = known.filter((F.col("label") == F.col("other")) & ~held_out()).select("doc_id", F.col("label").cast("int").alias("label"))
    least = found.filter(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("x").alias("x"))
    return least.join(known, "doc_id").sortWithinPartitions("doc_id").select("label", "x")


def _summed(training: DataFrame, rows, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, sums): rows(label, x) gives keys and a matrix of this width for each batch; rows of one key are added up."""

    def run(batches):
        key, value = np.zeros(0, np.int64), np.zeros((0, width))
        for batch in batches:
            k, v = rows(batch.column("label").to_numpy(), _matrix(batch))
            key, value = _by_key(np.concatenate([key, k]), np.concatenate([value, v]))
        yield pa.RecordBatch.from_arrays([pa.array((key[:, None] * width + np.arange(width)).reshape(-1)), pa.array(value.reshape(-1))], names=["key", "value"])

    parts = training.mapInArrow(run, "key long, value double")
    table = parts.groupBy("key").agg(F.sum(F.col("value").cast("decimal(38,12)")).cast("double").alias("value")).toArrow().sort_by("key")
    return table.column("key").to_numpy()[::width] // width, table.column("value").to_numpy().reshape(-1, width)


def _by_key(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(value[order], first, axis=0) if len(key) else value


class Grid:
    """Training rows by the points beside their worths: for each class the points, how many rows are there, and the sums of their vectors."""

    def __init__(self, training: DataFrame, scaled, weights: np.ndarray):
        def rows(label, x):
            z = scaled(x)
            place, part = _place(z @ weights)
            one = np.concatenate([np.ones((len(z), 1)), z], 1)
            return np.concatenate([2 * place + label, 2 * place + 2 + label]), np.concatenate([one * (1 - part)[:, None], one * part[:, None]])

        key, sums = _summed(training, rows, len(weights) + 1)
        (self.bad, self.n_bad, self.z_bad), (self.good, self.n_good, self.z_good) = ((key[key % 2 == y] >> 1, sums[key % 2 == y, 0], sums[key % 2 == y, 1:]) for y in (0, 1))
        self.pairs = self.n_good.sum() * self.n_bad.sum()
        # over all pairs of points, some rows of the good ones at a time
        self.loss, self.cross = 0.0, np.zeros((len(weights), len(weights)))
        self.against_good, self.curve_good = np.zeros(len(self.good)), np.zeros(len(self.good))
        self.against_bad, self.curve_bad = np.zeros(len(self.bad)), np.zeros(len(self.bad))
        for i in range(0, len(self.good), 256):
            some = slice(i, i + 256)
            apart = STEP * (self.good[some, None] - self.bad[None, :])
            chance = 1 / (1 + np.exp(np.clip(apart, -500, 500)))  # of the worse being preferred
            curve = chance * (1 - chance)
            self.loss += float(self.n_good[some] @ np.logaddexp(0, -apart) @ self.n_bad) / self.pairs
            self.cross += self.z_good[some].T @ (curve @ self.z_bad)
            self.against_good[some], self.curve_good[some] = chance @ self.n_bad, curve @ self.n_bad
            self.against_bad += self.n_good[some] @ chance
            self.curve_bad += self.n_good[some] @ curve

    def gradient(self) -> np.ndarray:
        return (self.against_good @ self.z_good - self.against_bad @ self.z_bad) / self.pairs

    def hessian(self, training: DataFrame, scaled, weights: np.ndarray) -> np.ndarray:
        points = self.bad, self.good
        curves = self.curve_bad / self.n_good.sum(), self.curve_good / self.n_bad.sum()

        def rows(label, x):
            z = scaled(x)
            place, part = _place(z @ weights)
            curve = np.zeros(len(z))
            for y in (0, 1):
                of = label == y
                low, high = (np.minimum(np.searchsorted(points[y], place[of] + k), len(points[y]) - 1) for k in (0, 1))
                curve[of] = (1 - part[of]) * curves[y][low] + part[of] * curves[y][high]
            # rows 0, 1, ... of the bad ones' matrix, then of the good ones'
            square = [(z[label == y] * curve[label == y, None]).T @ z[label == y] for y in (0, 1)]
            return np.arange(2 * len(weights)), np.concatenate(square)

        _, sums = _summed(training, rows, len(weights))
        bad, good = sums[: len(weights)], sums[len(weights) :]
        return bad / self.n_bad.sum() + good / self.n_good.sum() - (self.cross + self.cross.T) / self.pairs


def _place(worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grid's point below each worth, and how far it is to the next one (0 to 1)."""
    place = np.floor(worth / STEP)
    return place.astype(np.int64), worth / STEP - place


def fit(found: DataFrame, labels: DataFrame) -> Ranking:
    """The ranking that all labelled rows of (doc_id, x) teach."""
    training = materialise(training_vectors(found, labels), "quality-training")
    width = statistics(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    label, sums = _summed(training, lambda label, x: (label.astype(np.int64), np.concatenate([np.ones((len(x), 1)), x], 1)), width + 1)
    if len(label) < 2:
        return Ranking.of(0.0, 1.0, None, 0.0)
    n, n_bad = sums[:, 0].sum(), int(sums[0, 0])
    middle = sums[:, 1:].sum(0) / n
    spread = np.sqrt(_summed(training, lambda label, x: (np.zeros(len(x), np.int64), (x - middle) ** 2), width)[1][0] / n) + 1e-9

    def scaled(x):
        return np.clip((x - middle) / spread, -8, 8)

    weights = last = np.zeros(width)
    least, step = math.inf, np.zeros(width)
    for _ in range(STEPS):
        grid = Grid(training, scaled, weights)
        loss = grid.loss + RIDGE / 2 * float(weights @ weights)
        if loss > least + 1e-4:  # too far
            step = step / 2
        else:
            last, least = weights, loss
            step = np.linalg.solve(grid.hessian(training, scaled, weights) + RIDGE * np.eye(width), grid.gradient() - RIDGE * weights)
        weights = last + step
        if np.abs(step).max() < 1e-5:
            break

    def worths(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(scaled(_matrix(batch)) @ weights)], names=["worth"])

    # between the n_bad-th worth and the next, of all
    counts = training.mapInArrow(worths, "worth double").groupBy("worth").agg(F.count("*").alias("n"))
    counts = running_sum(counts.withColumns({"_all": F.lit(0), "_bucket": F.floor(F.col("worth") * 1024)}), "_all", ["worth"], "n", "_bucket", "before")
    near = counts.filter((F.col("before") <= n_bad) & (F.col("before") + F.col("n") >= n_bad)).select("worth").toArrow().column("worth").to_numpy()  # two rows, or one
    return Ranking.of(middle, spread, weights, float((near.min() + near.max()) / 2))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    found = materialise(vectors(docs), "quality-vectors")
    ranking = fit(found, labels)

    def make():
        def call(batch: pa.RecordBatch):
            s = ranking.score(_matrix(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

        return call

    return map_arrow(found.select("doc_id", "x", held_out().alias("held_out")), make, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, with all columns, without those that are predicted bad."""
    ranking = fit(vectors(docs.filter(F.col("doc_id").isNotNull() & ~held_out())), labels)

    def make():
        def call(batch: pa.RecordBatch):
            yield batch.filter(pa.array(_scored(batch, ranking.score) >= CUT, pa.bool_()))

        return call

    # names with dots don't pass through Arrow functions
    plain = docs.toDF(*(f"_column{i}" if "." in x or "`" in x else x for i, x in enumerate(docs.columns)))
    return map_arrow(plain, make, plain.schema).toDF(*docs.columns)
