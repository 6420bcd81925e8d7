"""What a shard's grammar and a worker's encoder do no more than they must."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexgrove.llm import chunks, encoders, repair
from lexgrove.llm.encoders import tokenizer_path

BYTE = "byte_bpe_50k.json"


def library(coder, texts):
    return [x.ids for x in coder.library.encode_batch(texts, add_special_tokens=False)]


def test_marks_and_lines_about_a_word_are_left_to_the_model(monkeypatch):
    coder = encoders.Encoder(tokenizer_path(BYTE))
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdehinorstABÉéßÿþx") for _ in range(r.randint(1, 12)))
    texts = [r.choice(" \n") + word() + r.choice(("", "#", "$$", "%&*", "***")) for _ in range(2000)]
    others = ["\n\nover", " ***", "\n***", "\n", "over##", " a#b", " over# ", " over×", "\t over", " <|endoftext|>", " 's#", ""]
    asked = []

    class Library:
        model = coder.library.model

        def encode_batch_fast(self, some, whole=coder.library, **options):
            asked.extend(some)
            return whole.encode_batch_fast(some, **options)

    want = library(coder, texts + others)
    monkeypatch.setattr(coder, "library", Library())
    count, ids = coder.learn([x.encode() for x in texts + others])
    assert asked == others
    assert count.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(" \n\n\t#$%&*aétTé×7'.<|\xa0 \x0b\x85", max_size=30), max_size=6))
def test_texts_of_marks_and_lines_have_the_librarys_ids(texts):
    coder = encoders.encoder(tokenizer_path(BYTE))
    ids, at = coder.encode(*chunks.utf8(pa.array(texts, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == library(coder, texts)


def test_a_small_shards_grammar_takes_little_memory():
    ids = np.random.default_rng(2).integers(0, 30, 1000).astype(np.int32)
    tracemalloc.start()
    repair.compress(ids, np.array([0, 1000]), 400)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1_000_000


@pytest.mark.parametrize("kinds", [1, 2, 5, 1000])
def test_replaced_pairs_dont_overlap_and_none_is_left_alone(kinds):
    r = np.random.default_rng(kinds)
    for _ in range(200):
        at = np.flatnonzero(r.random(60) < r.choice([0.3, 0.8, 1.0]))
        rank = r.integers(0, kinds, len(at)).astype(np.int32)
        before = rank.copy()
        found, number = repair._replaced(rank, at)
        assert np.array_equal(rank, before) and (np.diff(found) > 1).all()
        assert np.array_equal(number, rank[np.searchsorted(at, found)])
        if len(at):  # of the best pair at least half of its places go, as rounds need
            best = at[rank == rank.min()]
            assert 2 * np.isin(best, found).sum() >= len(best)
