"""Secret scans: patterns, and password guess cost by dynamic programming.

Patterns find assignments, access keys and long hexadecimal runs. Beside them every value in a credential's context (after a
word such as password or token and a sign of assignment, after "Bearer", or before the @ of an address with a user) is judged by how
many guesses it would take: the least total over all ways to cut it into words, dates, repeats, keyboard walks, sequences and
brute-force characters. A value of at least 10**GUESSES guesses is a span of its own, kind "guess".

Words cost what their share of the corpus says: all words of all texts are counted, less what they stand in such values themselves, and
a word that is one in N costs log10 N. Only words that can be part of a value are kept, and they meet the values by a join.

Defined results: null and empty texts have no spans; code points count; rows of equal doc_id are scanned each; a null doc_id is
kept; very long texts and values are read whole, in linear time; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import map_arrow, materialise, with_small

#: Decimal digits of the guesses from which on a value is a secret.
GUESSES = 10.0
#: Letters of a word, longest period of a repeat.
SHORTEST, LONGEST = 3, 16
PERIODS = 12

#: The patterns' forms and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "guess")

#: Words that announce a credential, and part of each of them that a text with one must hold.
_ANNOUNCED = re.compile(
    r"""(?:pass(?:word|wd|phrase|code|wort)|pwd|kennwort|contrase[ñn]a|mot\x20de\x20passe|secret|token|credentials?|(?:api|access|private|account|client|signing|encryption)[_\x20-]?key)"""
    r"""["'`\])]{0,2}[\x20\t]*(?:=>|->|[:=]{1,2})[\x20\t]*(?:"([^"\r\n]*)"|'([^'\r\n]*)'|`([^`\r\n]*)`|([^\s"'`]\S*))""",
    re.I,
)
_WORDS = ("passw", "passp", "passc", "pwd", "kennwort", "contrase", "mot de passe", "secret", "token", "credential", "key")
_BEARER = re.compile(r"\bbearer[\x20\t]+([A-Za-z0-9._~+/=-]+)", re.I | re.A)
_USER = re.compile(r"://[^\s/:@]*:([^\s/@]+)@")
#: What ends an unquoted value without being part of it, and what stands for a value without being one.
_TAIL = ".,;:!?)]}>\"'`"
_NO_VALUE = re.compile(r"[<{$%\[(*]|\w+://|(?:none|null|true|false|undefined)$", re.I)

#: Common passwords, the most common first.
COMMON = (
    "123456 password 12345678 qwerty 123456789 12345 1234 111111 1234567 dragon 123123 baseball abc123 football monkey letmein 696969 shadow master 666666 qwertyuiop 123321 mustang "
    "1234567890 michael 654321 superman 1qaz2wsx 7777777 121212 000000 qazwsx 123qwe killer trustno1 jordan jennifer zxcvbnm asdfgh hunter buster soccer harley batman andrew tigger "
    "sunshine iloveyou 2000 charlie robert thomas hockey ranger daniel starwars klaster 112233 george computer michelle jessica pepper 1111 zxcvbn 555555 11111111 131313 freedom "
    "777777 pass maggie 159753 aaaaaa ginger princess joshua cheese amanda summer love ashley nicole chelsea biteme matthew access yankees 987654321 dallas austin thunder taylor "
    "matrix admin welcome login secret changeme passw0rd root test guest default"
).split()
#: Keys of a keyboard by row, without and with shift; letters that other characters stand for.
ROWS = (("`1234567890-=", "~!@#$%^&*()_+"), (" qwertyuiop[]\\", " QWERTYUIOP{}|"), (" asdfghjkl;'", ' ASDFGHJKL:"'), (" zxcvbnm,./", " ZXCVBNM<>?"))
LEET = str.maketrans("013457@$!", "oleastasi")

_KEYS = {c: (row, col, shift) for row, pair in enumerate(ROWS) for shift, keys in enumerate(pair) for col, c in enumerate(keys) if c != " "}
_TURN, _KEY, _TWO = math.log10(6), math.log10(47), math.log10(2)
_SIZES = {"digit": math.log10(10), "letter": math.log10(26), "mark": math.log10(33), "wide": 2.0}
_DAY, _YEAR = math.log10(365 * 150), math.log10(150)
_DATE = re.compile(r"(?=(\d{1,2}([-/._ ])\d{1,2}\2(?:\d{4}|\d{2})|\d{4}([-/._ ])\d{1,2}\3\d{1,2}))", re.A)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the values in a credential's context, in order and apart from each other."""
    low = text.lower()
    found = []
    if any(x in low for x in _WORDS):
        found += [m.span(m.lastindex) for m in _ANNOUNCED.finditer(text) if m.lastindex]
    if "bearer" in low:
        found += [m.span(1) for m in _BEARER.finditer(text)]
    if "://" in low:
        found += [m.span(1) for m in _USER.finditer(text)]
    out, at = [], 0
    for start, end in sorted(found):
        if text[start - 1] not in "\"'`":  # not quoted
            while end > start and text[end - 1] in _TAIL:
                end -= 1
        if start >= at and end > start and not _NO_VALUE.match(text, start, end):
            out.append((start, end))
            at = end
    return out


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' spans in order."""
    low = text.lower()
    out = []
    if any(x in low for x in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def plain_form(value: str) -> str:
    """value in lower case, with letters for the characters that stand for them, one for one."""
    return "".join(y if len(y := x.lower()) == 1 else x for x in value).translate(LEET)


def words_of(value: str) -> set[str]:
    """All words that can be part of a value."""
    out = set()
    for run in re.findall("[a-z]+", plain_form(value)):
        for n in range(SHORTEST, min(LONGEST, len(run)) + 1):
            out.update(run[a : a + n] for a in range(len(run) - n + 1))
    return out


def _brute(c: str) -> float:
    return _SIZES["digit" if c in "0123456789" else "letter" if c.isascii() and c.isalpha() else "mark" if c.isascii() else "wide"]


def _dates(value: str) -> dict[int, list[tuple[int, float]]]:
    """By end: (start, cost) of the dates and years in value."""
    out: dict[int, list[tuple[int, float]]] = {}

    def day(a: str, b: str) -> bool:
        return 1 <= int(a) <= 31 and 1 <= int(b) <= 12 or 1 <= int(a) <= 12 and 1 <= int(b) <= 31

    def put(start: int, text: str, cost: float) -> None:
        out.setdefault(start + len(text), []).append((start, cost))

    for m in _DATE.finditer(value):
        parts = re.split(r"[-/._ ]", m[1])
        if day(*(parts[:2] if len(parts[0]) < 3 else parts[1:])):
            put(m.start(), m[1], _DAY + math.log10(5))
    for a in range(len(value) - 3):
        if value[a : a + 4].isdecimal() and value[a : a + 4].isascii():
            if 1900 <= int(value[a : a + 4]) <= 2049:
                put(a, value[a : a + 4], _YEAR)
            for n in (6, 8):
                d = value[a : a + n]
                if len(d) == n and d.isascii() and d.isdecimal():
                    year = n - 4
                    if day(d[:2], d[2:4]) and (n == 6 or d[4:6] in ("19", "20")) or day(d[year : year + 2], d[year + 2 :]) and (n == 6 or d[:2] in ("19", "20")):
                        put(a, d, _DAY)
    return out


def cost(value: str, words: dict[str, float]) -> float:
    """The least log10 of the guesses for value, given those of words; each further piece of a cut doubles them. Linear in the value's length.

    best[j] is the cost of the first j characters. Walks, sequences and repeats are states that go on from character to character: a walk costs
    its first key, each turn and each shift; a sequence its first character; a repeat its first copy and the logarithm of how often it may go on.
    """
    n = len(value)
    best = [0.0] + [math.inf] * n
    form, dates = plain_form(value), _dates(value)
    how_long = math.log10(n) if n else 0.0
    walks: dict = {}
    chains: dict = {}
    same = [0] * (PERIODS + 1)
    again: list[list[float]] = [[math.inf] * p for p in range(PERIODS + 1)]
    block = functools.lru_cache(None)(lambda x: cost(x, words))
    single = functools.lru_cache(None)(_brute)
    run, brute = 0, math.inf  # letters at the end so far; the cost if the last piece is brute force
    for j in range(1, n + 1):
        c = value[j - 1]
        before = best[j - 1] + (_TWO if j > 1 else 0.0)
        brute = min(brute, before) + single(c)
        least = brute
        # words: those of the corpus and the common passwords
        run = run + 1 if "a" <= form[j - 1] <= "z" else 0
        for size in range(1, min(j, LONGEST) + 1):
            known = words.get(form[j - size : j]) if SHORTEST <= size <= run else None
            common = _COMMON.get(value[j - size : j].lower())
            common = _COMMON.get(form[j - size : j]) if common is None and size <= run else common
            here = min(x for x in (known, common, math.inf) if x is not None)
            if here < math.inf:
                a = j - size
                piece = value[a:j]
                upper = sum(map(str.isupper, piece))
                turned = sum(x != y for x, y in zip(piece.lower(), form[a:j], strict=False)) if known is not None and here == known else 0
                capital = _TWO * (0 if not upper else 1 if upper == size or (upper == 1 and piece[0].isupper()) else upper)
                least = min(least, best[a] + (_TWO if a else 0.0) + here + capital + turned * _TWO)
        for a, date in dates.get(j, ()):
            least = min(least, best[a] + (_TWO if a else 0.0) + date)
        # walks over keys
        key, last = _KEYS.get(c), _KEYS.get(value[j - 2]) if j > 1 else None
        now: dict = {}
        if key:
            shift = _TWO * key[2]
            now[None] = before + _KEY + how_long + shift
            if last:
                way = (key[0] - last[0], key[1] - last[1])
                if way in _WAYS and walks:
                    now[way] = min(x + (0.0 if w == way or w is None and way == (0, 1) else _TURN) for w, x in walks.items()) + shift
        walks = now
        # sequences of neighbouring code points of one kind
        step = ord(c) - ord(value[j - 2]) if j > 1 and c.isalnum() and value[j - 2].isalnum() and _kind(c) == _kind(value[j - 2]) else 0
        chains = {0: before + single(c) + how_long + _TWO} | ({step: min(chains.get(0, math.inf), chains.get(step, math.inf))} if step in (-1, 1) else {})
        least = min(least, *walks.values(), *chains.values())
        # repeats: again[p] holds the costs at the last p ends
        for p in range(1, min(PERIODS, j - 1) + 1):
            same[p] = same[p] + 1 if c == value[j - 1 - p] else 0
            here = math.inf
            if same[p] >= p:
                a = j - 2 * p
                first = single(value[a]) if p == 1 else block(value[a : a + p])
                here = min(again[p][j % p], best[a] + (_TWO if a else 0.0) + first + how_long)
            again[p][j % p] = here
            least = min(least, here)
        best[j] = least
    return best[n]


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2


_COMMON = {x: math.log10(i + 1) for i, x in enumerate(COMMON)}
#: Directions of a step on the keyboard.
_WAYS = frozenset(((0, 1), (0, -1), (1, 0), (-1, 0), (1, -1), (-1, 1)))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, found): for each row the patterns' spans (start, kind, end) and the values in a credential's context (start, end, value)."""

    def make():
        def call(batch: pa.RecordBatch):
            base, found = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in patterns(text)])
                found.append([{"start": a, "end": b, "value": text[a:b]} for a, b in candidates(text)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, _BASE), pa.array(found, _FOUND)], names=["doc_id", "base", "found"])

        return call

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, base array<struct<start: long, kind: int, end: long>>, found array<struct<start: long, end: long, value: string>>")


_BASE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))


def word_costs(docs: DataFrame, found: DataFrame, needed: DataFrame) -> DataFrame:
    """(word, cost) of needed words (word) that the texts hold outside of the found values."""
    split = lambda x: F.explode(F.split(F.lower(x), "[^a-z]+"))
    fits = F.length("word").between(SHORTEST, LONGEST)
    # each task counts its words before any is shuffled; what isn't needed is counted under one name, as it is part of the whole
    said = docs.select(split(F.col("text")).alias("word")).filter(fits).groupBy("word").agg(F.count("*").alias("n")).join(needed.withColumn("wanted", F.lit(True)), "word", "left")
    counts = materialise(said.groupBy(F.when(F.col("wanted"), F.col("word")).alias("word")).agg(F.sum("n").alias("n")), "secret-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    inside = found.select(split(F.col("value")).alias("word")).filter(fits).groupBy("word").agg(F.count("*").alias("within"))
    left = counts.filter("word is not null").join(inside, "word", "left").withColumn("n", F.col("n") - F.coalesce("within", F.lit(0)))
    return left.filter("n > 0").select("word", (F.log10(F.lit(float(max(total, 1)))) - F.log10("n")).alias("cost"))


def costs(values: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(value, guesses): log10 of the guesses of each value, by the words that are part of it; pairs are (value, word)."""
    known = pairs.join(words, "word").groupBy("value").agg(F.collect_list("word").alias("words"), F.collect_list("cost").alias("costs"))

    def make():
        def call(batch: pa.RecordBatch):
            value = batch.column("value").to_pylist()
            rows = zip(value, batch.column("words").to_pylist(), batch.column("costs").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(value, pa.string()), pa.array([cost(v, dict(zip(w or (), c or (), strict=True))) for v, w, c in rows], pa.float64())], names=["value", "guesses"])

        return call

    return map_arrow(values.join(known, "value", "left"), make, "value string, guesses double")


def parts(values: DataFrame) -> DataFrame:
    """(value, word): the words that can be part of each value."""

    def make():
        def call(batch: pa.RecordBatch):
            for value in batch.column("value").to_pylist():
                words = sorted(words_of(value))
                for a in range(0, len(words), 10_000):
                    some = words[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([value] * len(some), pa.string()), pa.array(some, pa.string())], names=["value", "word"])

        return call

    return map_arrow(values, make, "value string, word string")


def _joined(spans):
    """kind:start:end of each span, by start and kind, with commas."""
    one = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def spans(docs: DataFrame, guesses: float = GUESSES) -> DataFrame:
    """(doc_id, base, found): the patterns' spans and those that the guesses add, each (start, kind, end)."""
    rows = materialise(scan(docs).withColumn("row", F.monotonically_increasing_id()), "secret-spans")
    found = rows.select("row", F.explode("found").alias("x")).select("row", "x.*")
    values = materialise(found.select("value").distinct(), "secret-values")
    pairs = materialise(parts(values), "secret-parts")
    words = materialise(word_costs(docs, found, pairs.select("word").distinct()), "secret-costs")
    judged = materialise(costs(values, words, pairs), "secret-guesses").filter(F.col("guesses") >= guesses)
    kind = F.lit(KINDS.index("guess")).alias("kind")
    added = with_small(found, judged, "value").groupBy("row").agg(F.collect_list(F.struct("start", kind, "end")).alias("guessed"), F.max("guesses").alias("guesses"))
    nothing = F.expr("cast(array() as array<struct<start: long, kind: int, end: long>>)")
    return rows.drop("found").join(added, "row", "left").select("doc_id", "base", F.coalesce("guessed", nothing).alias("found"), "guesses")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, guesses): what is found in each row; guesses: log10 of the most guesses of one of its values that
    is a secret."""
    found = spans(docs)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id", count(0), count(1), count(2), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "found")).alias("spans"),
        F.size("found").cast("long").alias("n_guess"), "guesses",
    )
