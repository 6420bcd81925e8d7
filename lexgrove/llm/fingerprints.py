"""Document fingerprints by locally consistent parsing.

A text's code points are parsed level by level: runs of one symbol become a symbol, deterministic coin tossing labels each symbol
by the lowest bit in which it differs from the one before it (three rounds leave few labels), phrases begin where labels have
local minima, and a phrase's name is a hash of its symbols. A phrase border depends on a few neighbours alone, so equal substrings
get equal interior names at any offset. A fingerprint is the KEPT least 32-bit hashes of the names from level FROM up and of the
top, in base64; likeness is Dice's, 2 J / (1 + J), of the Jaccard similarity J that two such samples show.

Documents are ordered by falling doc_id and dealt to ranges of it; a range's last document gets the next range's first one.

Defined results: null text is empty; empty texts have the empty fingerprint, like one another (1) and unlike all else (0); rows
with null doc_id come last; rows of equal doc_id are ordered by a hash of their text; a sole document is its own next; an empty
table gives no rows; very long texts are parsed whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.chunks import mixed

KEPT = 128
FROM = 2
#: Code points parsed together, and ranges of doc_id for each shuffle partition.
STEP = 400_000
RANGES = 4


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were needed so far. Phrases are of a few symbols."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 21)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 2**64))):
                x = np.full(n, base & (2**64 - 1), np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))


POWERS = Powers()


def _coin(a: int, b: int) -> int:
    """The label of symbol a after symbol b, both small."""
    d = a ^ b
    low = (d & -d).bit_length() - 1 if d else 6
    return 2 * low + (a >> low & 1)


_SMALL = np.array([_coin(a, b) for a in range(128) for b in range(128)], np.uint8)


def _labels(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Three rounds of deterministic coin tossing; first: the places without a symbol before them."""
    d = np.empty_like(s)
    d[0] = 0
    np.bitwise_xor(s[1:], s[:-1], out=d[1:])
    d[first] = 1
    low = d & (~d + np.uint64(1))
    place = (low.astype(np.float64).view(np.int64) >> 52) - 1023
    np.maximum(place, 0, out=place)
    label = (2 * place).astype(np.uint16) + ((s >> place.astype(np.uint64)) & np.uint64(1)).astype(np.uint16)
    for _ in range(2):
        pair = label << 7
        pair[1:] |= label[:-1]
        pair[first] = label[first] << 7 | label[first] ^ 1
        label = _SMALL[pair].astype(np.uint16)
    return label


def parse(s: np.ndarray, at: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, offsets): the next level of each row's symbols; no row is empty."""
    first = np.zeros(len(s), bool)
    first[at[:-1]] = True
    new = first.copy()
    new[1:] |= s[1:] != s[:-1]
    start = np.flatnonzero(new)
    if len(start) < len(s):
        run = np.diff(np.append(start, len(s)))
        s = s[start]
        s[run > 1] = mixed(s[run > 1] + run[run > 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = np.searchsorted(start, at)
    begin = at[:-1]
    label = _labels(s, begin)
    right = np.full(len(s), 255, np.uint16)
    right[:-1] = label[1:]
    right[at[1:] - 1] = 255
    cut = np.zeros(len(s), bool)
    cut[1:] = (label[1:] < label[:-1]) & (label[1:] <= right[1:])
    second = begin + 1
    cut[second[second < len(s)]] = False
    cut[begin] = True
    border = np.flatnonzero(cut)
    end = np.append(border[1:], len(s))
    POWERS.need(len(s) + 1)
    sums = np.empty(len(s) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(mixed(s) * POWERS.up[: len(s)], out=sums[1:])
    names = mixed((sums[end] - sums[border]) * POWERS.down[border] + (end - border).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(level))
    return names, np.searchsorted(border, at)


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The fingerprint of each text: its least hashes in order."""
    out = [np.zeros(0, np.uint32)] * len(texts)
    rows = np.array([i for i, x in enumerate(texts) if x], np.int64)
    if not len(rows):
        return out
    s = np.frombuffer("".join(texts[i] for i in rows).encode("utf-32-le"), np.uint32).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum([len(texts[i]) for i in rows])])
    found_rows, found, level = [], [], 0
    while len(rows):
        level += 1
        s, at = parse(s, at, level)
        size = np.diff(at)
        if level >= FROM:
            found.append((s >> np.uint64(32)).astype(np.uint32))
            found_rows.append(np.repeat(rows, size))
        else:
            found.append((s[at[:-1][size == 1]] >> np.uint64(32)).astype(np.uint32))
            found_rows.append(rows[size == 1])
        more = size > 1
        s = s[np.repeat(more, size)]
        rows, at = rows[more], np.concatenate([[0], np.cumsum(size[more])])
    row, name = np.concatenate(found_rows), np.concatenate(found)
    key = np.sort(row.astype(np.uint64) << np.uint64(32) | name)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    edge = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    low = key.astype(np.uint32)
    return [low[a : min(b, a + KEPT)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def text_of(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice's likeness of the sets that two fingerprints sample."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    distinct = both[np.concatenate([[True], ~twice])]
    if len(a) == KEPT or len(b) == KEPT:
        distinct = distinct[:KEPT]
    j = np.count_nonzero(both[1:][twice] <= distinct[-1]) / len(distinct)
    return 2 * j / (1 + j)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(docs: DataFrame, n: int) -> tuple[list[int], dict[int, list[int]]]:
    """Lower bounds of ranges of falling doc_id, and for the first doc_id of each range that has any the ranges it follows."""
    shares = [i / n for i in range(1, n)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 10 * n).alias("q")).first()["q"] if n > 1 else []
    bounds = sorted(set(found or []))
    # range r holds bounds[-1 - r] <= doc_id < bounds[-r]; null and the least come last

    def greatest(batches):
        best: dict = {}
        edges = np.array(bounds, np.int64)
        for batch in batches:
            ids = batch.column("doc_id")
            if ids.null_count:
                best.setdefault(len(bounds), None)
            known = ids.drop_null().to_numpy(zero_copy_only=False)
            part = len(bounds) - np.searchsorted(edges, known, "right")
            for p in np.unique(part).tolist():
                top = int(known[part == p].max())
                best[p] = top if best.get(p) is None else max(top, best[p])
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.int64())], names=["part", "head"])

    heads = docs.select("doc_id").mapInArrow(greatest, "part int, head long").groupBy("part").agg(F.max("head").alias("head")).orderBy("part").collect()  # a row for each range
    after: dict = {}
    for i, x in enumerate(heads):
        after.setdefault(x["head"], []).append(heads[i - 1]["part"])
    return bounds, after


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds, after = _ranges(docs.select("doc_id"), n * RANGES)

    def deal(batches):
        import zstandard

        small = zstandard.ZstdCompressor(level=1)
        edges = np.array(bounds, np.int64)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = []
            for doc_id, text in zip(ids, batch.column("text").cast(pa.large_binary()), strict=True):
                held = small.compress(text.as_buffer() if text.is_valid else b"")
                part = len(edges) - (0 if doc_id is None else int(np.searchsorted(edges, doc_id, "right")))
                out.append((part, True, doc_id, held))
                out += [(p, False, doc_id, held) for p in after.get(doc_id, ())]
            kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=["part", "home", "doc_id", "held"])

    def run(batches):
        import zstandard

        large = zstandard.ZstdDecompressor()
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        rows: list[tuple] = []  # (doc_id, text); the last waits for its next
        size, part, closed = 0, None, False

        def close():
            """Rows of all but the last of `rows`, each with its next."""
            texts = [x for _, x in rows]
            changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
            made = sketches(texts + changed)
            mine, theirs = made[: len(texts)], made[len(texts) :]
            out = [
                (rows[i][0], len(texts[i]), hashlib.sha256(x.encode()).hexdigest(), text_of(mine[i]), text_of(theirs[i]), likeness(mine[i], theirs[i]), likeness(mine[i], mine[i + 1]))
                for i, x in enumerate(changed)
            ]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=names)

        for batch in batches:
            for p, home, doc_id, held in zip(*(batch.column(x).to_pylist() for x in ("part", "home", "doc_id", "held")), strict=True):
                if p != part:
                    rows, size, part, closed = [], 0, p, False
                if closed:
                    continue
                text = large.decompress(held).decode()
                rows.append((doc_id, text))
                size += len(text)
                if not home:
                    closed = True
                if len(rows) > 1 and (closed or size >= STEP):
                    yield close()
                    rows, size = rows[-1:], len(text)

    dealt = docs.select("doc_id", "text").mapInArrow(deal, "part int, home boolean, doc_id long, held binary")
    ordered = dealt.withColumn("tie", F.xxhash64("held")).repartition(n, "part").sortWithinPartitions("part", F.desc("home"), F.desc_nulls_last("doc_id"), "tie")
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
