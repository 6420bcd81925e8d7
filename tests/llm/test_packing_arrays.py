"""What packing does by whole arrays: pairs of documents and terms, the weightiest terms, and the words that the model is asked for together."""

import itertools
import random

import numpy as np
import pytest

from lexgrove.llm import encoders, packing
from lexgrove.llm.encoders import tokenizer_path


def shard(n, most, terms, seed=1):
    """(ids, offsets) of n documents of up to `most` ids, low ids the commonest."""
    r = np.random.default_rng(seed)
    at = np.concatenate([[0], np.cumsum(r.integers(1, most + 1, n))])
    return (terms * r.random(at[-1]) ** 3).astype("<u2"), at


def by_sorting(doc, weight, n):
    """For each of n ranks the place of each document's term of that rank, where it has one."""
    order = np.lexsort((-weight, doc))
    found = [list(g) for _, g in itertools.groupby(order.tolist(), lambda i: doc[i])]
    return [[x[i] for x in found if len(x) > i] for i in range(n)]


@pytest.mark.parametrize("kind", ["<u2", "<u4", np.int64])
@pytest.mark.parametrize("by_term", [False, True])
def test_counted(kind, by_term):
    ids, at = shard(300, 40, 65536)
    ids[:2] = 65535, 0
    want = {}
    for d, (a, b) in enumerate(itertools.pairwise(at)):
        for x in ids[a:b].tolist():
            want[d, x] = want.get((d, x), 0) + 1
    doc, term, times = packing.counted(ids.astype(kind), at, by_term)
    got = list(zip(doc.tolist(), term.tolist(), strict=True))
    assert got == sorted(want, key=lambda x: x[:: -1 if by_term else 1]) and times.tolist() == [want[x] for x in got]
    assert [len(x) for x in packing.counted(ids[:0].astype(kind), at[:1], by_term)] == [0, 0, 0]


def test_more_documents_than_two_bytes_number():
    at = np.arange(70_001)
    doc, term, times = packing.counted((at[:-1] % 7).astype("<u2"), at)
    assert np.array_equal(doc, at[:-1]) and np.array_equal(term, at[:-1] % 7) and (times == 1).all()


def test_weightiest_terms_are_those_of_a_sort():
    r = np.random.default_rng(5)
    doc = np.sort(r.integers(0, 400, 1500))
    weight = r.integers(1, 6, 1500) / 4  # with ties
    for got, want in zip(packing.weightiest(doc, weight, 3), by_sorting(doc, weight, 3), strict=True):
        assert got.tolist() == want
    assert [len(x) for x in packing.weightiest(doc[:0], weight[:0], 2)] == [0, 0]


@pytest.mark.parametrize(("n", "most"), [(60, 2000), (500, 8)])
def test_queries_hold_the_weightiest_terms(n, most):
    ids, at = shard(n, most, 3000)
    df = np.bincount(packing.counted(ids, at)[1], minlength=3000)
    index = packing.Index(ids, at, packing.Corpus(n, len(ids), df))
    place = np.repeat(np.arange(len(index.start)), index.end - index.start)
    shared = np.flatnonzero((index.end - index.start)[place] > 1)
    narrowed = packing.likely(index.doc[shared], index.weight[shared], n, packing.TERMS)
    assert narrowed.all() == (most == 8)  # the long documents' terms are narrowed before they are sorted
    order = shared[np.lexsort((-index.weight[shared], index.doc[shared]))]
    for d in range(n):
        want = place[order[index.doc[order] == d][: packing.TERMS]]
        assert index.terms[index.first[d] : index.first[d + 1]].tolist() == want.tolist()


def test_the_model_is_asked_for_many_words_at_once(monkeypatch):
    coder = encoders.Encoder(tokenizer_path("word_bpe_49k.json"))
    r = random.Random(2)
    words = ["".join(r.choice("abcdehinorstABÉéßÿþx") for _ in range(r.randint(1, 30))) for _ in range(1000)] + ["a", "I", "ß", "the", "The"]
    asked = []

    class Counting:
        def tokenize(self, text, whole=coder.spelt):
            asked.append(text)
            return whole.tokenize(text)

    monkeypatch.setattr(coder, "spelt", Counting())
    count, ids = coder.learn([x.encode() for x in words])
    assert len(asked) == -(-len(words) // encoders.GROUP)
    want = [x.ids for x in coder.library.encode_batch(words, add_special_tokens=False)]
    assert count.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_a_shard_of_nothing_has_no_windows():
    ids, at = np.zeros(0, "<u2"), np.zeros(1, np.int64)
    assert list(packing.windows(ids, at, packing.Corpus(0, 0, np.zeros(1, np.int64)))) == []
