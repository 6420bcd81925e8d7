"""Near copies around one common core, in parts that the patched trees can't tell apart, against brute force; texts that hashes could take for one another."""

import itertools
import random

import numpy as np
import pytest

from lexgrove.llm import chosen_path, shingles


def brute(rows, k=3, percent=85):
    def shingled(text):
        w = text.lower().split(" ")
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if text else set())

    sets, up = {i: shingled(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: root(i) for i in up}


@pytest.mark.parametrize("most", [1 << 21, 2_000])
def test_pairs_of_near_copies_on_a_common_core(spark, monkeypatch, most):
    for name, value in (("NODE", 8), ("LEAF", 4), ("DEPTH", 2), ("TREES", 3), ("SHINGLES", most)):
        monkeypatch.setattr(chosen_path, name, value)
    r, core, rows = random.Random(9), [f"core{i}" for i in range(240)], []
    for i in range(150):
        own = [f"own{i}_{j}" for j in range(60)]
        rows.append((2 * i, " ".join(core + own)))
        own[r.randrange(60)] = "edit"
        rows.append((2 * i + 1, " ".join(core + own)))
    r.shuffle(rows)
    got = {x["doc_id"]: x["component_id"] for x in chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows) and len(set(got.values())) == 150


def test_texts_that_polynomial_hashes_take_for_one_another(spark):
    word = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    rows = [(1, word), (2, word.translate({97: "b", 98: "a"})), (3, word)]
    got = {x["doc_id"]: (x["component_id"], x["kept"]) for x in chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False)}


def test_shingles_are_numbered_by_their_words():
    r = random.Random(4)
    texts = [" ".join(r.choice("abCc") for _ in range(r.randrange(9))) for _ in range(200)]
    values, at = shingles.exact([x.encode() for x in texts], 3)
    name: dict = {}
    for i, text in enumerate(texts):
        w = text.lower().split()
        want = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} or ({tuple(w)} if w else set())
        got = values[at[i] : at[i + 1]].tolist()
        assert len(got) == len(set(got)) == len(want)
        for x in want:
            name.setdefault(x, set(got)).intersection_update(got)
    assert all(len(x) >= 1 for x in name.values()) and len(set(values.tolist())) == len(name)


def test_recall_beyond_a_node(spark):
    """Small edits of one text, more of them than a node holds, at the parameters of production."""
    r, base = random.Random(2), [f"w{i}" for i in range(120)]
    rows = []
    for i in range(chosen_path.NODE + 500):
        words = [*base]
        words[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {x["component_id"] for x in got} == {0}


def test_rows_of_equal_doc_id_keep_their_own_texts(spark):
    r = random.Random(1)
    text = lambda: " ".join(f"w{r.randrange(999)}" for _ in range(50))
    a, b, c = text(), text(), text()
    rows = [(1, a, 0), (1, a, 1), (1, b, 2), (2, b, 3), (3, c + " more", 4), (None, c, 5), (4, None, 6), (4, "", 7), (5, c, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h long")
    left = sorted(chosen_path.representatives(docs).collect(), key=str)
    assert sorted((x["doc_id"] or 0, x["text"] or "") for x in left) == sorted([(1, a), (1, b), (3, c + " more"), (0, c), (4, ""), (4, "")])
    assert left == sorted(chosen_path.representatives(docs.repartition(3)).collect(), key=str)
    assert np.isin([x["h"] for x in left], range(9)).all()
