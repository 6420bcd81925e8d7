"""Sets of word shingles, their names and their minwise signatures.

A word's name is a 128-bit cryptographic digest of its lower-cased bytes, kept in a memo; what sketches and candidates rest on
is the first half of it. Links between two texts are confirmed by `exact`, which names words and shingles by themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np

from lexgrove.llm import chunks

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_FACTORS = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): the words, and for each row the index of its first word, with their number at the end."""
    gap = _GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at[:-1]] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:] = gap[:-1]
    after[:-1] = gap[1:] | edge[1:-1]
    start = np.flatnonzero(~gap & (before | edge[:-1]))
    return start, np.flatnonzero(~gap & after) + 1, np.searchsorted(start, at)


def _learn(names: list[bytes]) -> list:
    whole = b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in names)
    return np.frombuffer(whole, "<u8").reshape(-1, 2).tolist()


_MEMO = chunks.Memo(_learn, bounds, 1 << 19, np.uint64)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, first): two 64-bit halves of each lower-cased word's name, (words, 2)."""
    rows, first = _MEMO.look(_LOWER[data], at)
    start = _MEMO.start[rows]
    return np.stack([_MEMO.pool[start], _MEMO.pool[start + 1]], 1), first


def sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """(shingles, offsets, names): 64-bit hashes of each row's distinct shingles of k words in order (fewer words are one shingle, none is no
    shingle), and a 128-bit digest of the whole set, None for the empty one."""
    w, first = words(data, at)
    n = max(len(w) - k + 1, 0)
    whole, second = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for i in range(k):
        whole += w[i : i + n, 0] * _FACTORS[i]
        second += w[i : i + n, 1] * _FACTORS[i + 16]
    whole, second = chunks.mixed(whole), chunks.mixed(second)
    out, names, begin = [], [], first.tolist()
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        if b - a >= k:
            found, place = np.unique(whole[a : b - k + 1], return_index=True)
            other = second[a : b - k + 1][place]
        elif b > a:
            short = w[a:b] * _FACTORS[k + 32 : k + 32 + b - a, None]
            found, other = chunks.mixed(short.sum(0, dtype=np.uint64) + np.uint64(b - a)).reshape(2, 1)
        else:
            found = other = np.zeros(0, np.uint64)
        out.append(found)
        names.append(hashlib.blake2b(found.tobytes() + other.tobytes(), digest_size=16).digest() if len(found) else None)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in out], dtype=np.int64)]), names


def exact(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, offsets): each text's distinct shingles, numbered so that equal numbers are equal words in sequence and nothing else."""
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])
    data = _LOWER[data]
    start, end, first = bounds(data, at)
    word, names = chunks.distinct(data, start, end)
    size = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), size)
    n = max(len(word) - k + 1, 0)
    code = word[:n]
    for i in range(1, k):
        _, code = np.unique(code * (len(names) + 1) + word[i : i + n], return_inverse=True)
    inside = owner[:n] == owner[k - 1 : k - 1 + n]
    code, rows = code[inside], owner[:n][inside]
    known: dict[bytes, int] = {}
    few = [i for i in np.flatnonzero((size > 0) & (size < k)).tolist()]
    short = [known.setdefault(word[first[i] : first[i + 1]].tobytes(), len(known)) for i in few]
    code = np.concatenate([code, np.array(short, np.int64) + (int(code.max()) + 1 if len(code) else 0)])
    key = np.unique(np.concatenate([rows, np.array(few, np.int64)]) * (int(code.max()) + 1 if len(code) else 1) + code)
    most = int(code.max()) + 1 if len(code) else 1
    return key % most, np.concatenate([[0], np.cumsum(np.bincount(key // most, minlength=len(texts)))])


def minwise(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) least 32-bit hashes of each set under n hash functions; rows of empty sets are all ones."""
    out = np.full((len(at) - 1, n), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        random = np.random.default_rng(11)
        for i in range(n):
            a, c = random.integers(1, 2**63, 2, dtype=np.uint64)
            hashed = ((values ^ c) * (a * np.uint64(2) + np.uint64(1))) >> np.uint64(32)
            out[full, i] = np.minimum.reduceat(hashed.astype(np.uint32), at[full])
    return out
