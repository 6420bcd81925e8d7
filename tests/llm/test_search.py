import time

import numpy as np
import pyarrow as pa

from lexgrove.llm import va_file

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, dim, top=10):
    ints = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in {i: x for i, x in ints if i % 100 == 0}.items():
        best = sorted((-int(x @ y), j) for j, y in ints if j != q)[:top]
        out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_exact_search_with_odd_rows(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=8).tolist()) for i in range(400)]
    same = rows[0][1]
    rows += [(1000 + i, same) for i in range(120)] + [(2000 + i, [0.0] * 8) for i in range(30)]
    rows += [(3000, None), (3001, [None] * 8), (3002, [float("nan")] * 8), (3003, [float("inf")] + [0.0] * 7), (3004, [1.0]), (3005, []), (None, same)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5)
    assert sorted(map(tuple, va_file.search(df).collect())) == brute(rows, 8)


def test_repeated_ids_and_clashing_names(spark):
    r = np.random.default_rng(7)
    rows = [(i, r.integers(-3, 4, 4).astype(float).tolist()) for i in range(60)]
    rows += [(5, rows[5][1])] * 30 + [(6, rows[5][1]), (6, [9.0, 9.0, 9.0, 9.0]), (100, rows[0][1]), (100, rows[0][1])]
    names = ("vec", "qid", "cid", "upper", "part", "r", "dim", "other")
    df = spark.createDataFrame([(i, v, 0, *range(len(names))) for i, v in rows], SCHEMA + "".join(f", {x} long" for x in names)).repartition(3)
    once = sorted({(i, tuple(v)) for i, v in rows})
    assert sorted(map(tuple, va_file.search(df).collect())) == brute(once, 4)


def test_few_or_no_rows(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0], 0)], SCHEMA)
    assert va_file.search(one).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0], 0), (7, [1.0, -1.0], 0)], SCHEMA)
    assert list(map(tuple, va_file.search(two).collect())) == [(0, 1, 7, -1024 * 1024)]
    assert va_file.search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(va_file, "BLOCK", 2)
    r = np.random.default_rng(5)
    rows = [(i * 10, r.integers(-2, 3, 4).astype(float).tolist()) for i in range(90)]  # many ties
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, va_file.search(df).collect())) == brute(rows, 4)


def test_a_query_with_very_many_candidates_and_loose_bounds(spark):
    """Bounds that rule nothing out: all candidates of a query are read, in a time that grows with their number."""
    r = np.random.default_rng(3)
    x = r.integers(-50, 50, (100_000, 4))
    rows = spark.createDataFrame(pa.table({"qid": np.zeros(len(x), np.int64), "cid": np.arange(len(x)), "upper": 1e9 - np.arange(len(x)), "qvec": [np.array([3, -1, 2, 5], "<i8").tobytes()] * len(x), "vec": [v.astype("<i8").tobytes() for v in x]}).to_pandas())
    began = time.time()
    got = sorted((-s, c) for _, c, s in va_file.read(rows, 11).collect())[:11]
    score = x @ [3, -1, 2, 5]
    assert got == sorted(zip((-score).tolist(), range(len(x)), strict=True))[:11] and time.time() - began < 120
