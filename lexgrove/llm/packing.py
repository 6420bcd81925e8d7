"""Packing documents into windows of related documents by a sharded BM25 inverted index.

Documents' frequencies and the mean length are counted over all documents. A document's weightiest terms then place it: documents are
dealt to ranges of (weightiest term that GROUP documents have, weightiest terms of all), so shards hold documents that share rare terms,
wherever they came from, and a group of any size is split over as many shards as it needs. A shard of about SHARD_IDS ids has an
inverted index of token ids. A seed document opens a window; the postings of its TERMS weightiest terms (the length of a BM25 query) score
the shard's other documents, and unused neighbours fill the window greedily, best first. The best neighbour that doesn't fit is cut at
the window's end and its rest is the next seed, so windows are full. What is left at a shard's end is cut into sequences whose lengths
are powers of two: nothing is padded.

Defined results: null and empty texts are the end id alone; rows of equal or null doc_id are separate documents; long
documents run over as many windows as they need; an empty table has no pieces; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrove.llm import chunks, encoders
from lexgrove.llm.common import give_back, map_arrow, materialise

WINDOW = 2048
SHARD_IDS = 1 << 20
#: Terms of a BM25 query, and BM25's parameters.
TERMS = 24
K1, B = 1.2, 0.75
#: The documents that have a term at least, for it to be the first to place a document by; and the terms that place it after that.
GROUP = 256
PLACES = 3
#: Levels of weights that are told apart before terms are sorted by weight.
LEVELS = 64


class Corpus:
    """How many documents there are, how many hold each term, and their mean length."""

    def __init__(self, n: int, ids: int, df: np.ndarray):
        self.n, self.mean, self.df = n, max(ids / max(n, 1), 1.0), df
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))

    def weight(self, term: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        """BM25 weights of terms that documents of these sizes hold tf times."""
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean))


def counted(ids: np.ndarray, at: np.ndarray, by_term: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times): the distinct terms of each document, by document and term, or by term and document."""
    size = np.diff(at)
    # a pair is half as wide, and sorted in half the time, where both of its parts have two bytes
    bits, kind = (16, np.uint32) if ids.dtype.itemsize <= 2 and len(size) <= 1 << 16 else (32, np.int64)
    doc = np.repeat(np.arange(len(size), dtype=kind), size)
    key = ids.astype(kind) << bits | doc if by_term else doc << bits | ids
    key.sort()
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    first = key[edge]
    high, low = (first >> bits).astype(np.int64), (first & ((1 << bits) - 1)).astype(np.int64)
    return (low, high, np.diff(np.append(edge, len(key)))) if by_term else (high, low, np.diff(np.append(edge, len(key))))


def weightiest(doc: np.ndarray, weight: np.ndarray, n: int) -> list[np.ndarray]:
    """For each of n ranks the places of the documents' terms of that rank by weight, ties by place; doc ascends, documents of fewer terms are left out."""
    out = []
    start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    weight, times = weight.copy(), np.diff(np.append(start, len(doc)))
    for _ in range(n):
        if not len(start):
            out.append(start)
            continue
        most = np.maximum.reduceat(weight, start)
        equal = np.flatnonzero(weight == np.repeat(most, times))
        first = equal[np.searchsorted(equal, start)]
        out.append(first[most > -np.inf])
        weight[first] = -np.inf
    return out


def likely(doc: np.ndarray, weight: np.ndarray, n: int, terms: int) -> np.ndarray:
    """Which terms may be among the weightiest of the n documents, all that are included: those from the level of weights on that so many reach."""
    if LEVELS * n >= len(doc):  # few terms a document, or none
        return np.ones(len(doc), bool)
    level = (weight * ((LEVELS - 1) / weight.max())).astype(np.int64)
    reach = np.bincount(doc * LEVELS + level, minlength=n * LEVELS).reshape(n, LEVELS)[:, ::-1].cumsum(1)[:, ::-1]
    return level >= np.maximum((reach >= terms).sum(1) - 1, 0)[doc]


class Index:
    """Postings of a shard: for each term the documents that hold it, with BM25 weights."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, corpus: Corpus):
        self.n = n = len(at) - 1
        size = np.diff(at)
        self.doc, term, tf = counted(ids, at, by_term=True)
        self.start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        self.end = np.append(self.start[1:], len(term))
        here = self.end - self.start
        self.weight = corpus.weight(term, tf, size[self.doc])
        # each document's weightiest terms that some other document of the shard has too
        shared = np.flatnonzero(np.repeat(here > 1, here))
        shared = shared[likely(self.doc[shared], self.weight[shared], n, TERMS)]
        order = shared[np.lexsort((-self.weight[shared], self.doc[shared]))]
        first = np.searchsorted(self.doc[order], np.arange(n + 1))
        rank = np.arange(len(order)) - first[self.doc[order]]
        order = order[rank < TERMS]
        self.first = np.searchsorted(self.doc[order], np.arange(n + 1))
        self.terms = np.repeat(np.arange(len(here)), here)[order]

    def neighbours(self, doc: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with this one, best first, ties by place."""
        terms = self.terms[self.first[doc] : self.first[doc + 1]]
        if not len(terms):
            return np.zeros(0, np.int64)
        runs = [slice(a, b) for a, b in zip(self.start[terms].tolist(), self.end[terms].tolist(), strict=True)]
        score = np.bincount(np.concatenate([self.doc[x] for x in runs]), np.concatenate([self.weight[x] for x in runs]), self.n)
        some = np.flatnonzero((score > 0) & unused)
        return some[np.argsort(-score[some], kind="stable")]


def windows(ids: np.ndarray, at: np.ndarray, corpus: Corpus, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Full windows and power-of-two tails of a shard, as lists of pieces (document, start, length)."""
    index, size = Index(ids, at, corpus), np.diff(at).tolist()
    unused = np.ones(len(size), bool)
    seed, begun, following = -1, 0, 0
    held: list[tuple[int, int, int]] = []
    while True:
        if seed < 0:
            while following < len(size) and not unused[following]:
                following += 1
            if following == len(size):
                break
            seed, begun = following, 0
            unused[seed] = False
        while size[seed] - begun >= window:
            yield [(seed, begun, window)]
            begun += window
        if begun == size[seed]:
            seed = -1
            continue
        held = [(seed, begun, size[seed] - begun)]
        room = window - held[0][2]
        source, seed, cut = seed, -1, -1
        while room:
            found = index.neighbours(source, unused)
            if not len(found):
                while following < len(size) and not unused[following]:
                    following += 1
                if following == len(size):
                    break
                found = np.array([following])
            cut = -1
            for doc in found.tolist():
                if size[doc] <= room:
                    held.append((doc, 0, size[doc]))
                    unused[doc] = False
                    room -= size[doc]
                    source = doc
                    if not room:
                        break
                elif cut < 0:
                    cut = doc
            if room and cut >= 0:
                held.append((cut, 0, room))
                unused[cut] = False
                seed, begun, room = cut, room, 0
        if room:
            break
        yield held
        held = []
    # the tail: sequences of the powers of two that make up its length
    left = sum(x[2] for x in held)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            doc, start, length = held.pop(0)
            part = min(room, length)
            out.append((doc, start, part))
            if part < length:
                held.insert(0, (doc, start + part, length - part))
            room -= part
        yield out


def encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, n, ids): every whole text's ids and the end id, two bytes each where the vocabulary lets them."""

    def make():
        coder = encoders.encoder(path)
        kind = "<u2" if max(coder.library.get_vocab_size(with_added_tokens=True), end + 1) <= 1 << 16 else "<u4"

        def call(batch: pa.RecordBatch):
            data, at = chunks.utf8(batch.column("text"))
            for i, j in chunks.steps(at):
                got, off = coder.encode(data[at[i] : at[j]], at[i : j + 1] - at[i])
                whole, ends = np.insert(got, off[1:], end).astype(kind), off + np.arange(len(off))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(ends)), pa.array([whole[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["doc_id", "n", "ids"])

        return call

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, n long, ids binary")


#: Ids that are counted together; a longer document alone.
STEP = 1 << 19


def _parts(batch: pa.RecordBatch, most: int = STEP) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, offsets) of slices of a batch that hold about so many ids. The texts are encoded by then, so their memo goes."""
    chunks.forget()
    at = np.concatenate([[0], np.cumsum(batch.column("n").to_numpy())])
    for i, j in chunks.steps(at, most):
        part = batch.slice(i, j - i)
        column = part.column("ids").cast(pa.large_binary())
        _, offsets, data = column.buffers()
        a, b = np.frombuffer(offsets, np.int64)[[column.offset, column.offset + len(column)]]
        raw = np.frombuffer(data, np.uint8)[a:b]
        yield part, raw.view("<u2" if len(raw) == 2 * (at[j] - at[i]) else "<u4"), at[i : j + 1] - at[i]


def corpus_of(tokens: DataFrame) -> Corpus:
    """Counts over all documents; what comes to the driver is a row for each id of the vocabulary."""

    def count(batches):
        n = total = 0
        df = np.zeros(1, np.int64)
        for batch in batches:
            for part, ids, at in _parts(batch):
                more = np.bincount(counted(ids, at)[1], minlength=len(df))
                more[: len(df)] += df
                df, n, total = more, n + part.num_rows, total + int(at[-1])
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], term])), pa.array(np.concatenate([[n, total], df[term]]))], names=["term", "df"])

    found = tokens.select("n", "ids").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    term, df = found.column("term").to_numpy(), found.column("df").to_numpy()
    whole = np.zeros(int(term.max(initial=0)) + 1, np.int64)
    whole[term[term >= 0]] = df[term >= 0]
    return Corpus(int(df[term == -1].sum()), int(df[term == -2].sum()), whole)


def placed(tokens: DataFrame, corpus: Corpus) -> DataFrame:
    """tokens with place_0, ..., the terms that place each document (-1: none), and tie."""

    def make():
        def call(batch: pa.RecordBatch):
            for part, ids, at in _parts(batch):
                doc, term, tf = counted(ids, at)
                weight = corpus.weight(term, tf, np.diff(at)[doc])
                places = np.full((PLACES, part.num_rows), -1, np.int64)
                for least, ranks in ((GROUP, range(1)), (2, range(1, PLACES))):
                    some = np.flatnonzero(corpus.df[term] >= least)
                    for i, found in zip(ranks, weightiest(doc[some], weight[some], len(ranks)), strict=True):
                        places[i, doc[some[found]]] = term[some[found]]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x) for x in places)], names=[*part.schema.names, *(f"place_{i}" for i in range(PLACES))])

        return call

    schema = T.StructType([*tokens.schema, *(T.StructField(f"place_{i}", T.LongType()) for i in range(PLACES))])
    return map_arrow(tokens, make, schema).withColumn("tie", F.monotonically_increasing_id())


def pack(docs: DataFrame, path: str, end: int = 1, window: int = WINDOW, shard_ids: int = SHARD_IDS) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): a row for each piece; ids are little-endian unsigned 32-bit."""
    tokens = materialise(encoded(docs, path, end), "packing-ids")
    corpus = corpus_of(tokens)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(corpus.n * corpus.mean / shard_ids))
    keys = [*(f"place_{i}" for i in range(PLACES)), "tie"]
    dealt = placed(tokens, corpus).repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "n", "ids")
    names = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(x, T.BinaryType() if x == "ids" else T.LongType()) for x in names)])

    def run(batches):
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            nonlocal sequence
            flat = np.concatenate([x for _, x, _ in held])
            at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x) for _, _, x in held]))])
            whole, rows, pieces_ids = flat.astype("<u4"), [], []
            for pieces in windows(flat, at, corpus, window):
                offset = 0
                for doc, start, length in pieces:
                    a = int(at[doc]) + start
                    rows.append((doc, start, length, int(at[doc + 1] - at[doc]), sequence, offset))
                    pieces_ids.append(whole[a : a + length].tobytes())
                    offset += length
                sequence += 1
            table = np.array(rows, np.int64).reshape(-1, 6)
            who = pa.chunked_array([x.column("doc_id") for x, _, _ in held]).combine_chunks().take(pa.array(table[:, 0]))
            column = [pa.array(np.ascontiguousarray(table[:, i])) for i in range(6)]
            yield pa.RecordBatch.from_arrays([who, column[1], column[2], pa.array(pieces_ids, pa.binary()), *column[3:]], names=schema.names)
            held.clear()

        for batch in batches:
            for part in _parts(batch, max(shard_ids // 4, 1)):
                held.append(part)
                size += len(part[1])
                if size >= shard_ids:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()
        give_back()

    return dealt.mapInArrow(run, schema)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The contract's rows."""
    return pack(docs, path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
