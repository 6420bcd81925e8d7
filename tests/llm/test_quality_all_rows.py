"""Every labelled row teaches, in every pair: the fit by Spark against one over all pairs in memory."""

import zlib

import numpy as np

from lexgrove.llm import quality


def fitted_by_all_pairs(x, label):
    middle, spread = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - middle) / spread, -8, 8)
    d = (z[label == 1][:, None] - z[label == 0][None]).reshape(-1, x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(d @ w))
        w = w + np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + quality.RIDGE * np.eye(len(w)), d.T @ p / len(d) - quality.RIDGE * w)
    worth = np.sort(z @ w)
    n_bad = int((label == 0).sum())
    return w, z @ w, (worth[n_bad - 1] + worth[n_bad]) / 2


def test_all_rows_and_pairs_teach(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 20)
    r = np.random.default_rng(3)
    rows = []
    for i in range(500):
        words = ["".join(r.choice(list("abcdefgh"), r.integers(2, 7))) for _ in range(r.integers(5, 60))]
        loud = r.random() < (0.25 if i % 4 else 0.7)
        rows.append((i, " ".join(w.upper() + "!" if loud and r.random() < 0.4 else w for w in words), int(i % 4 > 0)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    taught = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    raw = [t.encode() for _, t, _ in taught]
    x = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]))
    _, worth, cut = fitted_by_all_pairs(x, np.array([y for _, _, y in taught]))
    want = dict(zip([i for i, _, _ in taught], 1 / (1 + np.exp(-(worth - cut + np.log(0.3 / 0.7)))), strict=True))
    got = {x["doc_id"]: x["score"] for x in quality.score(docs, labels).collect()}
    assert max(abs(got[i] - s) for i, s in want.items()) < 1e-3
