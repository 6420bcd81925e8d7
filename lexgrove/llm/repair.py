"""Token-id files compressed by Re-Pair grammars.

Documents are put in ascending doc_id order into shards. In a shard, rounds replace frequent pairs of neighbouring ids by
nonterminals until no pair stands LEAST times (fewer don't pay for a rule's twelve bytes); no pair reaches over a document's end.
A shard's file holds the rules with their expansion lengths, the symbols (three bytes each) and where each document's symbols and
ids begin, so one document is decoded without the others.

File: a header of eight little-endian unsigned 64-bit numbers (magic, vocabulary, rules, symbols, documents, ids, CRC-32 of what
follows, 0), then rules (2 x u4), expansion lengths (u4), symbols (their low u2, then their high u1), doc_id (i8), doc_id known (u1),
first symbol (u8) and first id (u8) of each document and of the end. Files are rows of a Parquet table, whose writer's commits survive lost executors.

Defined results: null and empty texts are the end id alone; rows with null doc_id come last; rows of equal doc_id are separate
documents, ordered by a hash of their text; an empty table makes no shard and no rows; very long texts are
encoded whole; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrove.llm import chunks, encoders
from lexgrove.llm.common import give_back, map_arrow, running_sum, shared_dir, with_small

MAGIC = 0x3252_5041_4952_584C
#: Symbols take three bytes. Ids of a shard, least count of a replaced pair, and most buckets (a power of two) that chosen pairs are found by.
SYMBOLS = 1 << 24
SHARD_IDS = 1 << 21
LEAST = 4
BUCKET_BITS = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _won(rank: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Which places have a lower rank than both of their neighbours; near: whether a place and the next one are neighbours."""
    won = np.ones(len(rank), bool)
    won[1:] &= ~near | (rank[1:] < rank[:-1])
    won[:-1] &= ~near | (rank[:-1] < rank[1:])
    return won


def _replaced(rank: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the places `at` (sorted) of chosen pairs with their ranks, those replaced and their ranks: no two are neighbours; of
    a run of one pair every other place is, else lower ranks win."""
    near, none = at[1:] == at[:-1] + 1, np.int32(1 << 30)
    joins = np.flatnonzero(near & (rank[1:] == rank[:-1])) + 1
    if len(joins):
        head = np.maximum.accumulate(np.where(np.diff(joins, prepend=-1) > 1, np.arange(len(joins)), 0))
        rank = rank.copy()
        rank[joins[(np.arange(len(joins)) - head) % 2 == 0]] = none
    won = _won(rank, near)
    # a place between a better loser and no winner still fits
    fits = ~won & (rank < none)
    fits[1:] &= ~(near & won[:-1])
    fits[:-1] &= ~(near & won[1:])
    fits = np.flatnonzero(fits)
    won[fits[_won(rank[fits], np.diff(at[fits]) == 1)]] = True
    won = np.flatnonzero(won)
    return at[won], rank[won]


def _bucket(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key * _ODD) >> np.uint64(64 - bits)).astype(np.int64)


def compress(ids: np.ndarray, at: np.ndarray, vocabulary: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first symbol of each document and of the end, rules, expansion lengths)."""
    if len(ids) and int(ids.max()) >= vocabulary or vocabulary + len(ids) // 2 > SYMBOLS:
        raise ValueError(f"symbols of {SYMBOLS} can't hold a vocabulary of {vocabulary} and the rules of {len(ids)} ids")
    seq = ids.astype("<u4")
    last = np.zeros(len(seq), bool)
    last[at[1:][np.diff(at) > 0] - 1] = True
    rules, length = [np.zeros((0, 2), np.uint32)], [np.ones(vocabulary, np.int64)]
    made = vocabulary
    # places where a pair may be frequent: all at first, then those of new symbols and of frequent pairs that had to wait; other pairs only get fewer
    places = np.flatnonzero(~last[:-1]) if len(seq) > 1 else np.zeros(0, np.int64)
    while len(places):
        key = np.ndarray(len(seq) - 1, "<u8", seq, strides=(4,))[places]  # a symbol and, in the high half, the next one
        pairs, times = np.unique(key, return_counts=True)
        pairs, times = pairs[times >= least], times[times >= least]
        if not len(pairs):
            break
        pairs = pairs[np.argsort(-times, kind="stable")]
        # of chosen pairs in one bucket the most frequent stays; the others have their turn in a later round
        bits = min(BUCKET_BITS, (16 * len(pairs)).bit_length())
        at_bucket = _bucket(pairs, bits)
        ranks = np.full(1 << bits, -1, np.int32)
        ranks[at_bucket[::-1]] = np.arange(len(pairs), dtype=np.int32)[::-1]
        rank = ranks[_bucket(key, bits)]
        some = np.flatnonzero(rank >= 0)
        places, rank = places[some], rank[some]
        same = np.flatnonzero(pairs[rank] == key[some])
        found, number = _replaced(rank[same], places[same])
        # a pair that better ones left in one place waits; the best pair keeps half of its places at least, so rounds go on
        enough = np.bincount(number, minlength=len(pairs)) > 1
        held = np.flatnonzero(enough[number])
        found, symbol = found[held], (made + np.cumsum(enough, dtype=np.uint32) - 1)[number[held]]
        rule = pairs[enough]
        rule = np.stack([rule & np.uint64(0xFFFFFFFF), rule >> np.uint64(32)], 1).astype(np.uint32)
        known = np.concatenate(length)
        rules.append(rule)
        length = [known, known[rule[:, 0]] + known[rule[:, 1]]]
        seq[found] = symbol
        last[found] = last[found + 1]
        stays = np.ones(len(seq), bool)
        stays[found + 1] = False
        again = np.zeros(len(seq), bool)
        again[places] = again[found] = True
        again[found[found > 0] - 1] = True  # the symbol before a new one, or the one that went, whose place is before it now
        gone = found[(found > 1)] - 1
        again[gone[~stays[gone]] - 1] = True
        stays = np.flatnonzero(stays)
        seq, last, again = seq[stays], last[stays], again[stays]
        places = np.flatnonzero(again & ~last)
        places = places[places < len(seq) - 1]
        made += len(rule)
    firsts = np.zeros(len(at), np.int64)
    firsts[1:][np.diff(at) > 0] = np.flatnonzero(last) + 1
    return seq, np.maximum.accumulate(firsts), np.concatenate(rules), np.concatenate(length)[vocabulary:]


def pack(ids: np.ndarray, at: np.ndarray, doc_ids: list, vocabulary: int) -> bytes:
    seq, firsts, rules, length = compress(ids, at, vocabulary)
    body = b"".join([
        rules.astype("<u4").tobytes(), length.astype("<u4").tobytes(), (seq & np.uint32(0xFFFF)).astype("<u2").tobytes(), (seq >> np.uint32(16)).astype("u1").tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is not None for x in doc_ids], "u1").tobytes(),
        firsts.astype("<u8").tobytes(), at.astype("<u8").tobytes(),
    ])
    return np.array([MAGIC, vocabulary, len(rules), len(seq), len(doc_ids), len(ids), zlib.crc32(body), 0], "<u8").tobytes() + body


class Shard:
    """A shard's file, read."""

    def __init__(self, blob: bytes):
        magic, self.vocabulary, rules, symbols, docs, self.n_ids, crc, _ = map(int, np.frombuffer(blob, "<u8", 8))
        if magic != MAGIC or zlib.crc32(memoryview(blob)[64:]) != crc:
            raise ValueError("not a whole token-id shard")
        place = 64

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal place
            x = np.frombuffer(blob, kind, n, place)
            place += x.nbytes
            return x

        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.length = take("<u4", rules)
        self.symbols = take("<u2", symbols).astype(np.int64)
        self.symbols |= take("u1", symbols).astype(np.int64) << 16
        ids, known = take("<i8", docs), take("u1", docs)
        self.doc_ids = pa.array(ids, mask=known == 0)
        self.first, self.at = take("<u8", docs + 1).astype(np.int64), take("<u8", docs + 1).astype(np.int64)
        # expansions, one after the other: rules are opened until only ids are left
        flat = self.rules.reshape(-1).astype(np.int64)
        while len(flat) and (big := flat >= self.vocabulary).any():
            n = np.where(big, 2, 1)
            begin = np.cumsum(n) - n
            out = np.empty(n.sum(), np.int64)
            out[begin[~big]] = flat[~big]
            pair = self.rules[flat[big] - self.vocabulary]
            out[begin[big]], out[begin[big] + 1] = pair[:, 0], pair[:, 1]
            flat = out
        self.flat = np.concatenate([np.arange(self.vocabulary), flat]).astype("<u4")
        self.begin = np.concatenate([np.arange(self.vocabulary), self.vocabulary + np.cumsum(self.length, dtype=np.int64) - self.length])
        self.size = np.concatenate([np.ones(self.vocabulary, np.int64), self.length])

    def ids(self, i: int = 0, j: int | None = None) -> np.ndarray:
        """Ids of documents i to j."""
        seq = self.symbols[self.first[i] : self.first[len(self.first) - 1 if j is None else j]]
        size = self.size[seq]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.begin[seq] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def write_shards(docs: DataFrame, path: str, end: int, target: str, shard_ids: int = SHARD_IDS) -> None:
    """Encode, compress and write all documents; a row of target is a shard's file."""
    schema = "shard long, part long, n_docs long, n_ids long, file binary"
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    keys = [F.col("doc_id").asc_nulls_last(), F.col("_tie"), F.col("_row")]  # the last parts rows that are the same
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"), F.monotonically_increasing_id().alias("_row")).repartitionByRange(n, *keys).sortWithinPartitions(*keys)

    def run(batches):
        coder = encoders.encoder(path)
        vocabulary = coder.library.get_vocab_size(with_added_tokens=True)
        part, number = TaskContext.get().partitionId(), 0
        ids, sizes, names = [], [], []

        def flush():
            nonlocal number
            if names:
                at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                file = pack(np.concatenate(ids), at, names, vocabulary)
                yield pa.RecordBatch.from_arrays([pa.array([part << 24 | number]), pa.array([part]), pa.array([len(names)]), pa.array([int(at[-1])]), pa.array([file], pa.binary())], names=["shard", "part", "n_docs", "n_ids", "file"])
                number += 1
                for x in (ids, sizes, names):
                    x.clear()

        held = 0
        for batch in batches:
            data, at = chunks.utf8(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            for i, j in chunks.steps(at):
                got, off = coder.encode(data[at[i] : at[j]], at[i : j + 1] - at[i])
                ids.append(np.insert(got, off[1:], end))
                sizes.append(np.diff(off) + 1)
                names += doc_ids[i:j]
                held += len(ids[-1])
                if held >= shard_ids:
                    yield from flush()
                    held = 0
        yield from flush()
        give_back()

    ordered.mapInArrow(run, schema).write.parquet(target)


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, shard, _in, n_tokens, ids_crc32) of every document in the files."""

    def make():
        def call(batch: pa.RecordBatch):
            for shard, file in zip(batch.column("shard").to_pylist(), batch.column("file"), strict=True):
                x = Shard(file.as_py())
                at, whole = x.at, memoryview(x.ids().tobytes())
                crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([x.doc_ids, pa.array(np.full(len(crc), shard)), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "shard", "_in", "n_tokens", "ids_crc32"])

        return call

    return map_arrow(shards.select("shard", "file"), make, "doc_id long, shard long, _in long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    """Write the files and read them back: (doc_id, start, n_tokens, ids_crc32, shard)."""
    spark = docs.sparkSession
    target = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_shards(docs, path, end, target)
    shards = spark.read.schema("shard long, part long, n_docs long, n_ids long, file binary").parquet(target)
    bases = running_sum(shards.select("shard", "part", "n_ids", F.lit(0).alias("_all")), "_all", ["shard"], "n_ids", "part", "_base").select("shard", "_base")
    return with_small(read_documents(shards), bases, "shard").select("doc_id", (F.col("_base") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32", "shard")
