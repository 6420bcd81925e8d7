"""What a worker learns of chunks, and when it forgets it."""

import numpy as np
import pyarrow as pa
import pytest

from lexgrove.llm import chunks, encoders, packing
from lexgrove.llm.encoders import tokenizer_path


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_that_are_learnt_together_have_the_librarys_ids(name):
    coder = encoders.encoder(tokenizer_path(name))
    assert coder.direct and coder.apart == coder.plain
    words = [f"{a}{b}" for a in ("Überß", "over", "ÿ", "ÀÖØ", "it", "x×y", "a÷", "Q", "qzxj") for b in ("", "ing", "Þé", "7", "'s", "tion" * 20)] * 3
    raw = [(" " * coder.plain + x).encode() for x in words] + [b" "] * coder.plain + [b".", b"\n\nend"]
    count, ids = coder.learn(raw)
    want = [coder.library.encode(x.decode(), add_special_tokens=False).ids for x in raw]
    assert count.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    count, ids = coder.learn([])
    assert not len(count) and not len(ids)


def test_packing_forgets_chunks_once_texts_are_encoded():
    coder = encoders.encoder(tokenizer_path("word_bpe_49k.json"))
    coder.encode(*chunks.utf8(pa.array(["some words of a text"])))
    assert coder.memo.size
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([np.array([5, 1], "<u2").tobytes()])], names=["doc_id", "n", "ids"])
    (_, ids, at), = packing._parts(batch)
    assert ids.tolist() == [5, 1] and at.tolist() == [0, 2] and not coder.memo.size and chunks.Memo.latest is None
    assert coder.encode(*chunks.utf8(pa.array(["some words"])))[0].tolist() == coder.library.encode("some words", add_special_tokens=False).ids
