"""Token counts by byte-pair merging with a heap of adjacent pairs and a linked list of symbols; no identifiers are made.

Each distinct chunk of text is merged once by a worker: the lowest-rank pair is popped (ties to the left), its two symbols
become one, and its new neighbours' pairs are pushed. The count is the initial symbols less the merges.

Defined results: null and empty texts have 0 bytes and 0 tokens; null or repeated doc_id values are passed through, a row each;
an empty table gives no rows; very long texts are counted whole, and a single chunk without spaces in n log n; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexgrove.llm import chunks, encoders
from lexgrove.llm.common import map_arrow

LIMIT = 512
_MADE: dict[str, Counter] = {}


class Counter:
    """Counts for the byte-pair vocabulary in a tokenizers .json file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.symbols: dict[str, int] = {}
        number = lambda x: self.symbols.setdefault(x, len(self.symbols))
        #: left << 20 | right -> rank << 20 | merged
        self.pairs = {number(a) << 20 | number(b): rank << 20 | number(a + b) for rank, (a, b) in enumerate(model["merges"])}
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.split = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        self.normalizer, self.pieces = self.library.normalizer, self.library.pre_tokenizer.pre_tokenize_str
        self.memo = chunks.Memo(self.learn, chunks.spaced if self.normalizer is None else chunks.bare)

    def merged(self, word: str) -> int:
        """Symbols of a piece after all merges."""
        n = left = len(word)
        parts = list(word)
        if self.end:
            parts[-1] += self.end
        known = self.symbols.get
        sym = [known(x, -1) for x in parts]
        after, ahead = list(range(1, n + 1)), list(range(-1, n))
        find = self.pairs.get
        heap = [found >> 20 << 32 | i for i in range(n - 1) if (found := find(sym[i] << 20 | sym[i + 1])) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if sym[i] < 0 or j >= n:
                continue
            found = find(sym[i] << 20 | sym[j])
            if found is None or found >> 20 != top >> 32:  # one of the two has been merged since
                continue
            left -= 1
            sym[i], sym[j] = found & 0xFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                ahead[k] = i
                if (found := find(sym[i] << 20 | sym[k])) is not None:
                    heappush(heap, found >> 20 << 32 | i)
            if (h := ahead[i]) >= 0 and (found := find(sym[h] << 20 | sym[i])) is not None:
                heappush(heap, found >> 20 << 32 | h)
        return left

    def count(self, text: str) -> int:
        total = 0
        for part in self.split.split(text):
            if part in self.added:
                total += 1
            elif part:
                whole = self.normalizer.normalize_str(part) if self.normalizer else part
                total += sum(self.merged(piece) for piece, _ in self.pieces(whole))
        return total

    def learn(self, raw: list[bytes]) -> list:
        out = []
        for x in raw:
            text = x.decode("utf-8", "replace")
            if self.normalizer is None and encoders.WORD.fullmatch(text):
                if not text.isascii():
                    text = text.encode().decode("latin-1").translate(encoders.ALPHABET)
                out.append((self.merged("Ġ" + text[1:] if text[0] == " " else text),))
            else:
                out.append((self.count(text),))
        return out

    def counts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.memo.sums(data, at)


def counter(path: str) -> Counter:
    """The worker's counter of this file; it stays for the next tasks."""
    if path not in _MADE:
        _MADE[path] = Counter(path)
    return _MADE[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def make():
        count = counter(path)

        def call(batch: pa.RecordBatch):
            data, at = chunks.utf8(batch.column("text"))
            n = np.concatenate([np.zeros(0, np.int64), *(count.counts(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in chunks.steps(at))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], names=schema.names)

        return call

    return map_arrow(docs.select("doc_id", "text"), make, schema)
