"""Texts as numpy arrays, and a memo of what each distinct chunk of a text becomes.

A chunk is a run of ASCII white space with the run of other bytes after it, or a mark of punctuation with what follows it up
to white space. No token of the public vocabularies reaches over the start of a chunk, so a text's tokens are its chunks'
tokens in turn. The memo finds a chunk by a hash of its bytes and then compares the bytes, so no two chunks are ever taken for
one another. It holds at most `most` chunks and BYTES bytes of names and values and starts afresh beyond that; chunks of more than LONG
bytes (texts without spaces, encoded data) are known for the texts at hand alone. So a worker's memory is bounded by that and by the texts at hand.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that are looked at together; a longer text is looked at alone.
STEP = 1 << 20
#: Bytes of names and values that a memo keeps, and bytes of a chunk beyond which it isn't kept.
BYTES = 64 << 20
LONG = 64
#: Words of eight bytes that are hashed and compared by whole arrays; what is beyond, chunk by chunk.
WIDE = 32

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
#: Other bytes that end, or may end, a white-space character: before these, a run of ASCII white space starts no chunk.
_RARE = np.zeros(256, bool)
_RARE[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0xA8, 0xA9, 0xAF, 0x9F, *range(0x80, 0x8B)]] = True
#: Marks that no token has in common with the letter before them ("|", of special tokens, and "'" are not among them).
_MARK = np.zeros(256, bool)
_MARK[list(b",.;:!?)")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings; a null is an empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)), at - at[0]


def steps(at: np.ndarray, most: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes together, or one longer row."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def spaced(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): chunks with the white space before them, and for each row the index of its first chunk, with their number at the end."""
    n = len(data)
    space, before, begins = _edges(data, at)
    start = np.flatnonzero(begins | (space & ~before))
    odd = start[(start > 0) & _RARE[data[start - 1]] & ~begins[start]]
    if len(odd):
        a, b, c = data[odd - 1], data[np.maximum(odd - 2, 0)], data[np.maximum(odd - 3, 0)]
        wide = (a < 0x20) | ((b == 0xC2) & ((a == 0x85) | (a == 0xA0))) | ((c == 0xE1) & (b == 0x9A)) | ((c == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((c == 0xE3) & (b == 0x80))
        start = np.setdiff1d(start, odd[wide], assume_unique=True)
    return start, np.append(start[1:], n)[: len(start)], np.searchsorted(start, at)


def bare(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): chunks without white space."""
    space, before, begins = _edges(data, at)
    start = np.flatnonzero(~space & (before | begins))
    stop = np.ones(len(data), bool)
    stop[:-1] = space[1:] | begins[1:]
    return start, np.flatnonzero(~space & stop) + 1, np.searchsorted(start, at)


def _edges(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte: whether it is white space, follows white space, and begins a row or is a mark after a letter."""
    space = _SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[at[:-1]] = True
    begins = begins[:-1]
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    mark = np.flatnonzero(_MARK[data[1:]]) + 1
    last, second = data[mark - 1], data[np.maximum(mark - 2, 0)]
    begins[mark[_LETTER[last] | ((second == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))]] = True
    return space, before, begins


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number, names): the different spans among data[start:end], and which of them each span is."""
    if not len(start):
        return np.zeros(0, np.int64), []
    edges = np.empty(2 * len(start), np.int64)
    edges[::2], edges[1::2] = start, end
    apart = bool((edges[1:-1:2] != edges[2::2]).any())
    offsets = edges if apart else np.append(start, end[-1])
    spans = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data))])
    if apart:  # every second one is what lies between two spans
        spans = spans.take(pa.array(np.arange(0, len(spans), 2)))
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def joined(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of names."""
    return np.frombuffer(b"".join(names), np.uint8), np.fromiter(map(len, names), np.int64, len(names))


def parted(raw: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Names given as (bytes, lengths)."""
    whole, ends = raw.tobytes(), np.cumsum(size)
    return [whole[a:b] for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]


_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Spans:
    """Runs of bytes, read eight bytes at a time."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.data, self.start, self.length = data, start, length  # data has eight bytes to spare at its end
        self.words = np.ndarray(max(len(data) - 7, 0), "<u8", data, strides=(1,))

    def word(self, some: np.ndarray, n: int) -> np.ndarray:
        """The n-th eight bytes of some spans, zeros after the end."""
        return self.words[self.start[some] + 8 * n] & _MASK[np.minimum(self.length[some] - 8 * n, 8)]

    def tail(self, i: int) -> bytes:
        """What is after the first WIDE words."""
        return self.data[self.start[i] + 8 * WIDE : self.start[i] + self.length[i]].tobytes()

    def hashes(self) -> np.ndarray:
        """Hashes other than 0."""
        h = self.length.astype(np.uint64) * _ODD
        some, n = np.flatnonzero(self.length > 0), 0
        while len(some) and n < WIDE:
            x = (h[some] ^ self.word(some, n)) * _ODD
            h[some] = x ^ (x >> np.uint64(32))
            n += 1
            some = some[self.length[some] > 8 * n]
        for i in some.tolist():
            h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(self.tail(i)))
        return np.maximum(mixed(h), np.uint64(1))

    def same(self, mine: np.ndarray, other: Spans, theirs: np.ndarray) -> np.ndarray:
        """Whether spans hold the same bytes as others."""
        ok = self.length[mine] == other.length[theirs]
        left, n = np.flatnonzero(ok & (self.length[mine] > 0)), 0
        while len(left) and n < WIDE:
            equal = self.word(mine[left], n) == other.word(theirs[left], n)
            ok[left[~equal]] = False
            n += 1
            left = left[equal]
            left = left[self.length[mine[left]] > 8 * n]
        for i in left.tolist():
            ok[i] = self.tail(mine[i]) == other.tail(theirs[i])
        return ok


class Memo:
    """Runs of integers in a pool, one run for each chunk that was met, learnt many at a time; arrays: learn takes them as (bytes, lengths). A table of hashes, a power of two and at most half
    full, leads to the chunks' rows. A worker holds one full memo at a time: the one that it used before is emptied when it turns to another."""

    latest: Memo | None = None

    def __init__(self, learn: Callable[..., list | tuple[np.ndarray, np.ndarray]], bounds: Callable, most: int = 1 << 20, kind=np.int32, arrays: bool = False):
        self.learn, self.bounds, self.most, self.kind = learn if arrays else lambda raw, size: learn(parted(raw, size)), bounds, most, kind
        self.clear()

    def clear(self) -> None:
        self.size = self.used = 0
        self.kept: tuple[int, int] | None = None
        self.start, self.count, self.hash = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(1024, np.uint64)
        self.pool = np.zeros(4096, self.kind)
        self.names = Spans(np.zeros(4096, np.uint8), np.zeros(1024, np.int32), np.zeros(1024, np.int32))
        self.named = 0
        self.table(self.most)

    def table(self, most: int) -> None:
        """An empty table for so many chunks, with those that there are."""
        slots = 1 << (2 * max(most, 1) - 1).bit_length()
        self.mask, self.keys, self.row = slots - 1, np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.place(np.arange(self.size))

    def place(self, rows: np.ndarray) -> None:
        """Enter rows that the table doesn't hold."""
        h = self.hash[rows]
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        left = np.arange(len(rows))
        while len(left):
            at = slot[left]
            free = self.keys[at] == 0
            self.keys[at[free]], self.row[at[free]] = h[left[free]], rows[left[free]]
            left = left[~(free & (self.row[at] == rows[left]))]
            slot[left] = (slot[left] + 1) & self.mask

    def find(self, spans: Spans, h: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Rows of some spans, -1 for those that aren't known."""
        out = np.full(len(some), -1, np.int64)
        slot = (h[some] & np.uint64(self.mask)).astype(np.int64)
        left = np.arange(len(some))
        while len(left):
            key = self.keys[slot[left]]
            hit = left[key == h[some[left]]]
            rows = self.row[slot[hit]]
            same = spans.same(some[hit], self.names, rows)
            out[hit[same]] = rows[same]
            left = left[(key != 0) & (out[left] < 0)]
            slot[left] = (slot[left] + 1) & self.mask
        return out

    def append(self, values: list | tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Rows that hold integers (lists of them, or their counts and all of them), with no names yet."""
        if isinstance(values, tuple):
            count, flat = values
        else:
            count = np.fromiter(map(len, values), np.int32, len(values))
            flat = np.fromiter(itertools.chain.from_iterable(values), self.kind, int(count.sum()))
        rows, end = np.arange(self.size, self.size + len(count)), self.size + len(count)
        self.pool = _grown(self.pool, self.used + len(flat))
        self.start, self.count, self.hash = (_grown(x, end) for x in (self.start, self.count, self.hash))
        self.pool[self.used : self.used + len(flat)] = flat
        self.start[rows], self.count[rows] = self.used + np.cumsum(count) - count, count
        self.used += len(flat)
        self.size = end
        return rows

    def put(self, raw: np.ndarray, length: np.ndarray, h: np.ndarray, values: list | tuple[np.ndarray, np.ndarray]) -> None:
        """Add new names (bytes, lengths), each with its integers."""
        rows = self.append(values)
        end = self.size
        self.hash[rows] = h
        kept = Spans(_grown(self.names.data, self.named + len(raw) + 8), _grown(self.names.start, end), _grown(self.names.length, end))
        kept.data[self.named : self.named + len(raw)] = raw
        kept.start[rows], kept.length[rows] = self.named + np.cumsum(length) - length, length
        self.names = kept
        self.named += len(raw)
        if 2 * end > self.mask + 1:
            self.table(2 * end)
        else:
            self.place(rows)

    def look(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, first): the row of each chunk, and for each text the index of its first chunk."""
        if Memo.latest is not self:
            if Memo.latest is not None:
                Memo.latest.clear()
            Memo.latest = self
        if self.kept is not None:  # what the last texts alone needed goes
            self.size, self.used = self.kept
            self.kept = None
            self.pool = _trimmed(self.pool, max(self.used, BYTES // self.pool.itemsize))
        start, end, first = self.bounds(data, at)
        length = end - start
        brief = np.flatnonzero(length <= LONG)
        spans = Spans(np.concatenate([data, np.zeros(8, np.uint8)]), start, length)
        rows = np.full(len(start), -1, np.int64)
        self.find_or_learn(spans, spans.hashes(), brief, rows, data, start, end)
        if len(brief) < len(start):
            long, known = np.flatnonzero(length > LONG), {}
            which = [known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
            self.kept = self.size, self.used
            rows[long] = self.append(self.learn(*joined(list(known))))[which]
        return rows, first

    def find_or_learn(self, spans: Spans, h: np.ndarray, left: np.ndarray, rows: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Enter the rows of chunks that may be kept; h holds hashes of all chunks."""
        every, afresh = left, False
        while True:
            rows[left] = self.find(spans, h, left)
            left = left[rows[left] < 0]
            if not len(left):
                return
            # one of each hash; different chunks of one hash come in the next round
            new = left[np.unique(h[left], return_index=True)[1]]
            size = self.named + self.used * self.pool.itemsize + int(spans.length[new].sum()) * (1 + self.pool.itemsize)
            if (self.size + len(new) > self.most or size > BYTES) and self.size and not afresh:
                self.clear()
                left, afresh = every, True
                rows[every] = -1
                continue
            length = (end - start)[new]
            ends = np.cumsum(length)
            raw = data[np.repeat(start[new] - ends + length, length) + np.arange(int(ends[-1]))]
            self.put(raw, length, h[new], self.learn(raw, length))

    def values(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, offsets): each text's values, one chunk's after the other's."""
        rows, first = self.look(data, at)
        start, count = self.start[rows], self.count[rows]
        ends = np.cumsum(count, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(start - (ends - count), count) + np.arange(total)
        return self.pool[where], np.concatenate([[0], ends])[first]

    def sums(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each text the sum over its chunks of a chunk's only value."""
        rows, first = self.look(data, at)
        return np.diff(np.concatenate([[0], np.cumsum(self.pool[self.start[rows]], dtype=np.int64)])[first])


def forget() -> None:
    """Empty the memo that this worker holds, for steps that look at no texts: workers stay, and their memory counts beside what a step needs."""
    if Memo.latest is not None:
        Memo.latest.clear()
        Memo.latest = None


def _trimmed(x: np.ndarray, n: int) -> np.ndarray:
    return x if len(x) <= 2 * n else x[:n].copy()


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])
