"""Token ids of whole texts by the tokenizers library, which is asked once for each distinct chunk that a worker meets."""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np

from lexgrove.llm.chunks import Memo, bare, joined, spaced

#: Letters of one piece in every public pattern; composed already, and lower-cased one by one.
WORD = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: The byte-level alphabet: the n-th byte that is no visible Latin-1 character stands as code point 256 + n.
ALPHABET = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}

#: A space in that alphabet, and all other bytes of WORD's words.
SPACE = chr(ALPHABET[0x20])
SPELT = "".join(chr(ALPHABET.get(b, b)) for b in (*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)))
#: Marks that may follow a word within its chunk, and a line's end, in that alphabet.
MARKS = "#$%&*"
LINE = chr(ALPHABET[0x0A])
#: Words that the model is asked for at once.
GROUP = 32
#: What spells the end of a word for a model whose tokens mark it; the byte-level alphabet lacks it.
END = "\n"
_POINT = np.array([ALPHABET.get(b, b) for b in range(256)], np.uint32)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: What follows 0xC3 in WORD's other letters: all of U+00C0 to U+00FF but the signs of times and division.
_SECOND = np.zeros(256, bool)
_SECOND[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True

_MADE: dict[str, Encoder] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_MARK = np.zeros(256, bool)
_MARK[list(MARKS.encode())] = True


def marked(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the chunks in raw are a space or a line's end, a word of WORD's letters and any number of MARKS."""
    ends = np.cumsum(size)
    mark = _MARK[raw]
    # marks at a chunk's end go: those after which only marks are left
    other = np.flatnonzero(~mark)
    last = np.concatenate([[-1], other])[np.searchsorted(other, ends)]
    short = np.clip(last + 1 - (ends - size), 0, None)
    kept = raw[np.repeat(ends - size - np.cumsum(short) + short, short) + np.arange(int(short.sum()))]
    first = (np.cumsum(short) - short)[short > 0]
    kept[first[kept[first] == 0x0A]] = 0x20
    return words(kept, short, True)


def words(raw: np.ndarray, size: np.ndarray, spaced: bool) -> np.ndarray:
    """Which of the chunks in raw, one after the other, WORD matches; spaced: those with a space before them, else those without."""
    if not len(raw):
        return np.zeros(len(size), bool)
    start = np.cumsum(size) - size
    second = np.zeros(len(raw), bool)
    second[1:] = (raw[:-1] == 0xC3) & _SECOND[raw[1:]]
    good = _LETTER[raw] | second
    good[:-1] |= second[1:]
    if spaced:
        first = start[size > 0]
        good[first] = raw[first] == 0x20
    bad = np.concatenate([[0], np.cumsum(~good)])
    return (bad[start + size] == bad[start]) & (size > int(spaced))


def lowered(raw: np.ndarray) -> np.ndarray:
    """WORD's letters in lower case."""
    out = raw + np.uint8(0x20) * ((raw >= 0x41) & (raw <= 0x5A))
    out[1:] += np.uint8(0x20) * ((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97))
    return out


def spelt(library):
    """The library's own model with its merges, but with END for the mark that tokens at a word's end have, so that it can be asked for many words at once.
    None where that isn't known to give the same ids.

    A letter and the END after it merge before all else. So each word becomes the symbols that the model begins with when it is asked for the word
    alone, and as tokens hold END at their end only, nothing merges over it.
    """
    from tokenizers.models import BPE

    model = json.loads(library.to_str())["model"]
    mark, vocab = model.get("end_of_word_suffix"), model["vocab"]
    if model.get("type") != "BPE" or not mark or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    if not all(x in vocab and x + mark in vocab for x in SPELT) or any(END in x or mark in x.removesuffix(mark) for x in vocab):
        return None

    def name(token: str) -> str:
        return token.removesuffix(mark) + END if token.endswith(mark) else token

    merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    ends = [(x, END) for x in vocab if len(x) == 1 and x + mark in vocab]
    # no cache: groups of words hardly come again
    return BPE({name(x): i for x, i in vocab.items()} | {END: max(vocab.values()) + 1}, [*ends, *((name(a), name(b)) for a, b in merges)], cache_capacity=0)


class Encoder:
    """Ids of the tokenizer in a .json file, without added special tokens.

    Without a normaliser chunks keep the white space before them; with one (which makes it a separator) they leave it out.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.plain = self.library.normalizer is None
        tokens = self.library.get_vocab(with_added_tokens=False)
        #: Whether no token of words' bytes holds a space after another byte.
        across = re.compile(f"[{SPELT}]+{SPACE}[{SPELT}{SPACE}]*")
        self.apart = self.plain and not any(SPACE in x and across.fullmatch(x.lstrip(SPACE)) for x in tokens)
        #: Whether no token reaches over the end of a word, a run of marks or a line, so that a chunk of these is their tokens in turn.
        over, theirs = re.compile(f"[{SPELT}][{SPACE}{LINE}{MARKS}]|[{MARKS}][{SPACE}{LINE}{SPELT}]|{LINE}[{SPELT}]"), re.compile(f"[{SPELT}{SPACE}{LINE}{MARKS}]+")
        self.marks = self.apart and not any(over.search(x) and theirs.fullmatch(x) for x in tokens)
        #: The model to ask where words' ends are spelt, and the mark that its tokens have there instead.
        self.spelt = None if self.plain else spelt(self.library)
        mark = self.library.model.end_of_word_suffix if self.spelt else ""
        #: Bytes that each id stands for.
        self.bytes = np.zeros(max(tokens.values(), default=0) + 1, np.int64)
        self.bytes[list(tokens.values())] = [len(x.removesuffix(mark)) for x in tokens]
        #: Whether the model, asked for a word alone, agrees with the whole way.
        tried = ["over", " over", "Été", " Çaß"] if self.plain else ["over", "Été", "çaß"]
        self.direct = False
        tried += ["\nover", "\nÉté##", " over&", " over*$%"] if self.marks else []
        whole = self.learn([x.encode() for x in tried])
        self.direct = True
        self.direct = all(map(np.array_equal, whole, self.learn([x.encode() for x in tried])))
        self.memo = Memo(self.learn_joined, spaced if self.plain else bare, arrays=True)

    def learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of the chunks."""
        return self.learn_joined(*joined(chunks))

    def learn_joined(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of chunks given as (bytes, lengths). A word of plain letters is one piece for the model, with what may stand about it
        where no token reaches over a piece; all else goes the library's whole way."""
        word = np.zeros(len(size), bool)
        if self.direct:
            word = marked(raw, size) if self.marks else words(raw, size, self.plain)
        rest, whole, ends = np.flatnonzero(~word), raw.tobytes(), np.cumsum(size)
        texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip((ends - size)[rest].tolist(), ends[rest].tolist(), strict=True)]
        others = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.zeros(len(size), np.int32)
        count[rest] = np.fromiter(map(len, others), np.int32, len(others))
        ids, count[word] = self.of_words(raw[np.repeat(word, size)], np.cumsum(size[word]))
        of_word = np.repeat(word, count)
        out = np.zeros(len(of_word), np.int32)
        out[of_word] = ids
        out[~of_word] = np.fromiter(itertools.chain.from_iterable(others), np.int32, len(out) - len(ids))
        return count, out

    def of_words(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words that end at these bytes. Where no token of the vocabulary reaches over a word's first space, or words' ends can be
        spelt, the model is asked for GROUP words at once, and the ids fall to the words by their bytes."""
        # the words' bytes in the byte-level alphabet, one code point each
        points, tokenize, marks = _POINT[raw if self.plain else lowered(raw)], self.library.model.tokenize, 0
        if self.spelt:
            points, tokenize, marks = np.insert(points, ends, ord(END)), self.spelt.tokenize, np.arange(1, len(ends) + 1)
        text, stops, many = points.astype("<u4").tobytes().decode("utf-32-le"), ends + marks, self.apart or self.spelt
        cut = [0, *(np.append(stops[GROUP - 1 : -1 : GROUP], stops[-1:]) if many else stops).tolist()]
        ids: list[int] = []
        stop = []
        for a, b in itertools.pairwise(cut):
            ids += [t.id for t in tokenize(text[a:b])]
            stop.append(len(ids))
        found = np.array(ids, np.int32)
        if many:
            over = np.cumsum(self.bytes[found])
            last = np.searchsorted(over, ends)
            if len(ends) and not np.array_equal(over[np.minimum(last, len(over) - 1)], ends):
                raise ValueError("a token reaches over a word's end")
            stop = last + 1
        return found, np.diff(stop, prepend=0).astype(np.int32)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts given as (bytes, offsets)."""
        return self.memo.values(data, at)


def encoder(path: str) -> Encoder:
    """The worker's encoder of this file; it stays for the next tasks."""
    if path not in _MADE:
        _MADE[path] = Encoder(path)
    return _MADE[path]
