import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexgrove.llm import bpe_count, chunks, encoders, packing, repair
from lexgrove.llm.encoders import tokenizer_path

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
ALPHABET = " \n\t'.,|<>abcXYéÉß ́ 　\u0085\x0b\x1cΣσİ1½中😀\x00"


def library(path, text):
    return encoders.encoder(tokenizer_path(path)).library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.text(ALPHABET, max_size=40), st.sampled_from(["<|endoftext|> a  <|endoftext|>", "it's 's ''ll don't", "a  b \n\n c  "])), max_size=6))
def test_ids_and_counts_are_the_librarys(name, texts):
    data, at = chunks.utf8(pa.array(texts, pa.string()))
    ids, off = encoders.encoder(tokenizer_path(name)).encode(data, at)
    want = [library(name, x) for x in texts]
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == want
    assert bpe_count.counter(tokenizer_path(name)).counts(data, at).tolist() == [len(x) for x in want]


def test_a_full_memo_starts_afresh():
    made = []
    memo = chunks.Memo(lambda raw: made.extend(raw) or [(len(x),) for x in raw], chunks.bare, most=8)
    for n in range(30):
        data, at = chunks.utf8(pa.array([f"w{n} same", " ".join(f"k{n}_{i}" for i in range(12))]))
        assert memo.sums(data, at).tolist() == [len(f"w{n}same"), sum(len(f"k{n}_{i}") for i in range(12))]


@pytest.mark.parametrize("name", [BYTE, WORD])
@pytest.mark.parametrize("length", [1024, 4096])
def test_thue_morse_words_are_told_apart(name, length):
    """Polynomial hashes modulo 2**64 agree on these two words whatever their base."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(length))
    texts = [word, word.translate({97: "b", 98: "a"}), word]
    data, at = chunks.utf8(pa.array(texts))
    ids, off = encoders.encoder(tokenizer_path(name)).encode(data, at)
    want = [library(name, x) for x in texts]
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == want
    assert bpe_count.counter(tokenizer_path(name)).counts(data, at).tolist() == [len(x) for x in want]


def test_a_text_of_more_chunks_than_a_memo_holds():
    memo = chunks.Memo(lambda raw: [(len(x),) for x in raw], chunks.spaced)
    text = " ".join(map(str, range(2_200_000)))
    data, at = chunks.utf8(pa.array([text, "a few more words", text]))
    for _ in range(2):
        assert memo.sums(data, at).tolist() == [len(text), 16, len(text)]
        assert memo.sums(*chunks.utf8(pa.array(["a few more"]))).tolist() == [10]


def test_chunks_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(chunks.Spans, "hashes", lambda self: np.minimum(self.length, 3).astype(np.uint64) + np.uint64(1))
    memo = chunks.Memo(lambda raw: [(int(x.strip() or b"0"),) for x in raw], chunks.bare, most=40)
    for n in range(3):
        numbers = [*range(n * 10, n * 10 + 60), 10**300 + n, 10**300 + n + 1]
        got, _ = chunks.Memo(lambda raw: [list(x) for x in raw], chunks.bare, most=40).values(*chunks.utf8(pa.array([" ".join(map(str, numbers))])))
        assert bytes(got.tolist()).decode() == "".join(map(str, numbers))
        assert memo.sums(*chunks.utf8(pa.array([" ".join(map(str, numbers[:60]))]))).tolist() == [sum(numbers[:60])]


def test_token_counts(odd, nothing, odd_rows):
    got = sorted(bpe_count.token_counts(odd, tokenizer_path(BYTE)).collect(), key=str)
    want = sorted(((i, len((t or "").encode()), n := len(library(BYTE, t or "")), n > 512) for i, t, _, _ in odd_rows), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert bpe_count.token_counts(nothing, tokenizer_path(BYTE)).count() == 0


def test_token_files(odd, nothing, odd_rows):
    got = repair.digest(odd, tokenizer_path(BYTE)).orderBy("start").collect()
    ids = {}
    for i, t, _, _ in odd_rows:
        ids.setdefault(i, []).append(np.array([*library(BYTE, t or ""), 2], "<u4"))
    start, seen = 0, {}
    assert [x["doc_id"] for x in got] == sorted((i for i, *_ in odd_rows if i is not None)) + [None, None]
    for x in got:
        assert x["start"] == start
        start += x["n_tokens"]
        seen.setdefault(x["doc_id"], []).append((x["n_tokens"], x["ids_crc32"]))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted((len(y), zlib.crc32(y.tobytes())) for y in v) for k, v in ids.items()}
    assert repair.digest(nothing, tokenizer_path(BYTE)).count() == 0


@settings(max_examples=60, deadline=None)
@given(docs=st.lists(st.lists(st.integers(0, 5), max_size=60), max_size=8), unit=st.lists(st.integers(0, 300), min_size=1, max_size=9))
def test_a_shard_gives_back_its_ids_and_any_document(docs, unit):
    docs = [unit * 20 + x for x in docs]
    ids = np.array([y for x in docs for y in x], np.int32)
    at = np.concatenate([[0], np.cumsum([len(x) for x in docs])]).astype(np.int64)
    shard = repair.Shard(repair.pack(ids, at, list(range(len(docs))), 400))
    assert shard.ids().tolist() == ids.tolist()
    assert all(shard.ids(i, i + 1).tolist() == x for i, x in enumerate(docs))
    if sum(map(len, docs)) > 400:
        assert len(shard.symbols) < len(ids)


@settings(max_examples=60, deadline=None)
@given(docs=st.lists(st.lists(st.integers(0, 3), max_size=80), max_size=8))
def test_no_pair_stays_frequent(docs):
    ids, at = flat(docs)
    seq, firsts, rules, _ = repair.compress(ids, at, 400)
    count = collections.Counter()
    for a, b in zip(firsts[:-1], firsts[1:]):
        doc, i = seq[a:b].tolist(), 0
        while i + 1 < len(doc):  # of a run of one symbol every other pair
            count[doc[i], doc[i + 1]] += 1
            i += 2 if i + 2 < len(doc) and doc[i] == doc[i + 1] == doc[i + 2] else 1
    assert all(n < repair.LEAST for n in count.values()), count


def test_a_damaged_shard_is_refused():
    blob = bytearray(repair.pack(np.arange(50), np.array([0, 50]), [1], 400))
    blob[-20] ^= 1
    with pytest.raises(ValueError):
        repair.Shard(bytes(blob))


def check_packing(rows, docs, window=2048):
    pieces, sequences = {}, {}
    for x in rows:
        pieces.setdefault((x["doc_id"], x["doc_tokens"]), []).append(x)
        sequences.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= window and end & (end - 1) == 0
    return pieces


def test_packing(odd, nothing, odd_rows):
    rows = packing.digest(odd, tokenizer_path(WORD)).collect()
    check_packing(rows, odd_rows)
    want = {}
    for i, t, _, _ in odd_rows:
        want.setdefault(i, []).append(np.array([*library(WORD, t or ""), 1], "<u4"))
    assert sum(x["length"] for x in rows) == sum(len(y) for v in want.values() for y in v)
    single = {k: v[0] for k, v in want.items() if len(v) == 1}
    for k, y in single.items():
        end = 0
        for x in sorted((x for x in rows if x["doc_id"] == k), key=lambda x: x["start"]):
            assert x["start"] == end and x["doc_tokens"] == len(y) and x["ids_crc32"] == zlib.crc32(y[end : end + x["length"]].tobytes())
            end += x["length"]
        assert end == len(y)
    assert packing.digest(nothing, tokenizer_path(WORD)).count() == 0


def flat(docs):
    return np.array([y for x in docs for y in x], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in docs])]).astype(np.int64)


def corpus(docs):
    df = np.bincount([y for x in docs for y in set(x)], minlength=400)
    return packing.Corpus(len(docs), sum(map(len, docs)), df)


@settings(max_examples=60, deadline=None)
@given(docs=st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=12), min_size=2, max_size=12), seed=st.integers(0, 11))
def test_neighbours_are_in_the_order_of_bm25(docs, seed):
    seed %= len(docs)
    n, mean = len(docs), max(sum(map(len, docs)) / len(docs), 1)
    df = collections.Counter(y for x in docs for y in set(x))

    def score(doc):
        total = 0.0
        for t in set(docs[seed]) & set(doc):
            tf = doc.count(t)
            total += np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / mean))
        return total

    unused = np.arange(n) != seed
    got = packing.Index(*flat(docs), corpus(docs)).neighbours(seed, unused).tolist()
    want = {i: score(x) for i, x in enumerate(docs) if i != seed and set(x) & set(docs[seed])}
    assert set(got) == set(want)
    assert all(want[a] >= want[b] - 1e-9 for a, b in zip(got, got[1:]))


def test_statistics_cover_all_documents_and_related_ones_meet(spark, odd, odd_rows):
    tokens = packing.encoded(odd, tokenizer_path(WORD), 1)
    found = packing.corpus_of(tokens)
    want = [[*library(WORD, t or ""), 1] for _, t, _, _ in odd_rows]
    df = collections.Counter(y for x in want for y in set(x))
    assert found.n == len(want) and abs(found.mean * found.n - sum(map(len, want))) < 1e-6
    assert {i: int(x) for i, x in enumerate(found.df) if x} == df
    # two kinds of documents in turn: nearly all windows hold one kind
    r = np.random.default_rng(3)
    kinds = ["alpha beta gamma delta".split(), "one two three four".split()]
    docs = [(i, " ".join(r.choice(kinds[i % 2], 300))) for i in range(400)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), tokenizer_path(WORD)).collect()
    held = {}
    for x in rows:
        held.setdefault(x["sequence_id"], set()).add(x["doc_id"] % 2)
    assert sum(len(x) == 1 for x in held.values()) > 0.8 * len(held)


@settings(max_examples=80, deadline=None)
@given(sizes=st.lists(st.integers(1, 70), max_size=20))
def test_windows_hold_every_id_once(sizes):
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    ids = np.arange(at[-1]) % 11
    seen = np.zeros(at[-1], int)
    for pieces in packing.windows(ids, at, packing.Corpus(len(sizes), int(at[-1]), np.ones(11, np.int64)), 32):
        n = sum(x[2] for x in pieces)
        assert n <= 32 and n & (n - 1) == 0
        for doc, start, length in pieces:
            seen[at[doc] + start : at[doc] + start + length] += 1
    assert (seen == 1).all()


def test_a_memo_is_bounded_in_bytes(monkeypatch):
    """Chunks of unspaced text are right, within a batch and over batches, and none of them stays."""
    monkeypatch.setattr(chunks, "BYTES", 1 << 20)
    memo = chunks.Memo(lambda raw: [list(x) for x in raw], chunks.spaced)
    r = random.Random(9)
    line = lambda: "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(r.choice((5, 21, 22, 300))))
    again = [line() for _ in range(50)]
    for n in range(60):
        texts = [" ".join([line() for _ in range(40)] + again) + f" word{n}" for _ in range(3)]
        values, at = memo.values(*chunks.utf8(pa.array(texts)))
        assert [bytes(values[a:b].tolist()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)] == [x.encode() for x in texts]
        assert memo.named <= 1 << 20 and len(memo.pool) * 4 <= 4 << 20
    assert memo.size < 60 * 3 * 90
    before = memo.size, memo.named
    memo.values(*chunks.utf8(pa.array(["x" * 5_000_000])))
    memo.values(*chunks.utf8(pa.array(["word1"])))
    assert memo.size <= before[0] + 1 and len(memo.pool) * 4 <= 4 << 20
