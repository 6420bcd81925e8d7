"""One text with many edits that are near it and not near each other, in parts far larger than a node."""

import random

from lexgrove.llm import chosen_path


def test_a_star_larger_than_a_node(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "NODE", 16)
    monkeypatch.setattr(chosen_path, "LEAF", 8)
    r, base = random.Random(3), [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(base))]
    for i in range(2, 252):
        words = [*base]
        for j in range(5):  # 0.90 of the base, 0.82 of each other
            words[3 * (r.randrange(19) + 20 * j) + 1] = f"x{i}_{j}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["component_id"] for x in chosen_path.near_duplicates(docs).collect()}
    assert got == dict.fromkeys(range(1, 252), 1)


def test_a_group_is_never_parted():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([n] * 5)], names=["node"]) for n in (1, 1, 1, 2, 2, 3)]
    parts = [x for table in chosen_path.runs(batches) for x in set(table.column("node").to_pylist())]
    assert sorted(parts) == [1, 2, 3]
