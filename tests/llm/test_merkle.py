import hashlib
import random
import zlib

import pytest

from lexgrove.llm import merkle
from tests.llm.conftest import DOCS, make

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(i, text, lang, source, n):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][a : a + 8]) for a in range(0, len(levels[-1]), 8)])
    return levels


def proof_of(levels, place):
    """(left, right) at each level."""
    way = []
    for level in levels[:-1]:
        a = place // 8 * 8
        way.append(("".join(level[a:place]), "".join(level[place + 1 : a + 8])))
        place //= 8
    return way


def plain(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(*row), row))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: levels_of([y[2] for y in sorted(trees[x], key=lambda y: y[:3])]) for x in order}
    top = levels_of([built[x][-1][0] for x in order])
    out = []
    for number, lang in enumerate(order):
        for place, (_, _, leaf, (i, text, _, source, n)) in enumerate(sorted(trees[lang], key=lambda y: y[:3])):
            way = proof_of(built[lang], place) + proof_of(top, number)
            changed = i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and text is not None
            folded = leaf_of(i, text.translate(UPPER), lang, source, n) if changed else leaf
            for left, right in way:
                folded = H(left, folded, right)
            root = top[-1][0]
            out.append((i, leaf, built[lang][-1][0], root, H(*(x + y for x, y in way)), folded, folded == root))
    return out


def found(df):
    return [tuple(x) for x in merkle.verify(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def test_odd_rows(odd, odd_rows):
    assert sorted(found(odd), key=str) == sorted(plain([x[:5] for x in make(odd_rows)]), key=str)


def test_deep_trees_many_trees_and_sole_leaves(spark):
    r = random.Random(3)
    rows = [(i, f"Text {r.random()}", "en" if i % 3 else f"l{i % 90}", "s", i) for i in range(1400)] + [(5000 + i, "Sole", f"z{i}é", None, None) for i in range(20)]
    assert sorted(found(spark.createDataFrame(rows, DOCS).repartition(7)), key=str) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("rows", [[(3, "One Leaf", "en", "s", 8)], [(3, "A", None, None, 1), (4, "B", None, None, 1)], [(1, "X", "a", "s", 1), (2, "Y", "b", "s", 1)]])
def test_small_manifests(spark, rows):
    assert sorted(found(spark.createDataFrame(rows, DOCS)), key=str) == sorted(plain(rows), key=str)


def test_no_rows(nothing):
    assert found(nothing) == []


def test_a_proof_fails_elsewhere(spark):
    """A proof holds for its own leaf and place alone."""
    rows = [(i, f"t{i}", "en", "s", 2) for i in range(70)]
    manifest = merkle.Manifest(spark.createDataFrame(rows, DOCS))
    proofs = manifest.proofs().collect()
    from pyspark.sql import functions as F

    one, other = proofs[0], proofs[9]
    frame = spark.createDataFrame([(one["leaf"], one["path"]), (other["leaf"], one["path"])], "leaf string, path array<struct<left: string, right: string>>")
    assert [x[0] == manifest.root for x in frame.select(merkle.fold(F.col("leaf"), F.col("path"))).collect()] == [True, False]


def test_levels_are_tables(spark):
    rows = [(i, f"t{i}", "en", "s", 2) for i in range(70)]
    manifest = merkle.Manifest(spark.createDataFrame(rows, DOCS))
    assert [manifest.trees.level(k).count() for k in range(manifest.trees.levels)] == [70, 9, 2, 1]
