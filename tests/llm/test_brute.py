"""Operators that SQL can't express, against plain code: the fit of the ranking, fused posteriors, and phrase parsing."""

import collections
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexgrove.llm import chunks, fingerprints, language, quality


def test_the_ranking_is_at_the_least_loss():
    r = np.random.default_rng(4)
    label = (r.random(300) < 0.8).astype(int)
    x = r.normal(size=(300, 6)) + label[:, None] * np.array([0.7, 0, -0.5, 0, 0, 0.2])
    ranking = quality.Ranking(x, label, 0.25)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -8, 8)
    random_pairs = np.random.default_rng(1)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    n = min(quality.PAIRS, len(good) * len(bad))
    d = z[random_pairs.choice(good, n)] - z[random_pairs.choice(bad, n)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + quality.RIDGE / 2 * w @ w
    gradient = -(d / (1 + np.exp(d @ ranking.weights))[:, None]).mean(0) + quality.RIDGE * ranking.weights
    assert np.abs(gradient).max() < 1e-9
    for _ in range(20):
        assert loss(ranking.weights) <= loss(ranking.weights + r.normal(size=6) * 0.05)
    # the cut leaves the bad share, by weight, below it
    weight = np.where(label == 1, 0.75 / len(good), 0.25 / len(bad))
    assert abs(weight[ranking.score(x) < quality.CUT].sum() - 0.25) <= weight.max()


def naive_trigrams(text):
    folded = []
    raw = text.encode()
    for i, b in enumerate(raw):
        letter = chr(b).lower() if b < 128 and chr(b).isalpha() else " " if b < 128 else None
        x = b if letter is None else ord(letter)
        if letter is None and i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97:
            x += 0x20
        folded.append(x)
    found = collections.Counter()
    for a, b, c in zip(folded, folded[1:], folded[2:]):
        if not (a == 0x20 and b == 0x20):
            found[((a << 16 | b << 8 | c) * 2654435769 % 2**32) >> 20] += 1
    return found


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abÀéZ .9中", max_size=30), min_size=1, max_size=5))
def test_trigrams(texts):
    raw = [x.encode() for x in texts]
    got = language.trigrams(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert [{i: int(n) for i, n in enumerate(row) if n} for row in got] == [dict(naive_trigrams(x)) for x in texts]


def test_posteriors(spark):
    """Likelihood, declaration, and the two smoothed priors less the row's own share, by loops over the rows."""
    r = random.Random(6)
    words = {"en": "the ring of thing and other with hand".split(), "fr": "le mont de la eau que les dans".split(), "de": "der berg und das wasser mit von".split()}
    rows = []
    for i in range(240):
        lang = r.choice(("en", "en", "fr", "de"))
        said = r.choice((lang, lang, lang, "en", None, "xx"))
        host = r.choice(("a", "b")) + "." + ("com" if lang == "en" else "eu")
        rows.append((i, " ".join(r.choices(words[lang], k=r.choice((0, 2, 5, 60)))), said, host, host[2:]))
    rows.append((240, None, "fr", None, None))
    frame = spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string")
    got = {x["id"]: x for x in language.identify(frame.repartition(3)).collect()}
    counts = [naive_trigrams(t or "") for _, t, *_ in rows]
    sums, whole = collections.defaultdict(collections.Counter), collections.Counter()
    for (_, _, said, *_), n in zip(rows, counts):
        if said is not None:
            sums[said].update(n)
            whole.update(n)
    names = sorted(x for x, n in sums.items() if sum(n.values()) >= language.ENOUGH)
    total, size = sum(whole.values()), language.BUCKETS
    logs = []
    for name in names:
        cell = [sums[name][i] + 0.5 + language.WHOLE * whole[i] / total for i in range(size)]
        logs.append([math.log((1 - language.NOISE) * x / sum(cell) + language.NOISE / size) for x in cell])
    logs.append([-math.log(size)] * size)
    k = len(logs)
    text = [[language.TEMPER * sum(n * logs[c][i] for i, n in found.items()) for c in range(k)] for found in counts]
    best = [max(range(k), key=lambda c: t[c]) if counts[i] else None for i, t in enumerate(text)]
    by_host, by_suffix, overall = collections.Counter(), collections.Counter(), collections.Counter(x for x in best if x is not None)
    for (_, _, _, host, suffix), b in zip(rows, best):
        if b is not None:
            by_host[host or "", suffix or "", b] += 1
            by_suffix[suffix or "", b] += 1
    everything = sum(overall.values())
    for j, (i, _, said, host, suffix) in enumerate(rows):
        host, suffix, own = host or "", suffix or "", best[j]
        score = []
        for c in range(k):
            mine = int(own == c)
            prior = (overall[c] + 1) / (everything + k) if c < k - 1 else language.STRANGE
            for table, group in ((by_suffix, (suffix,)), (by_host, (host, suffix))):
                n = sum(v for x, v in table.items() if x[:-1] == group) - (own is not None)
                prior = (max(table[(*group, c)] - mine, 0) + language.SMOOTH * prior) / (max(n, 0) + language.SMOOTH)
            s = text[j][c] + math.log(prior)
            if said in names:
                s += math.log(1 - language.LIES) if names.index(said) == c else math.log(language.LIES / (k - 1))
            score.append(s)
        top = max(range(k), key=lambda c: score[c])
        posterior = 1 / sum(math.exp(x - score[top]) for x in score)
        assert got[i]["language"] == [*names, "und"][top] and abs(got[i]["posterior"] - posterior) < 1e-9
        assert got[i]["kept"] == (top < k - 1 and posterior >= language.SURE)


def mix(h):
    return int(chunks.mixed(np.array([h % 2**64], np.uint64))[0])


def naive_names(text):
    """Names of all levels, symbol by symbol."""
    odd, out, level = 0x9E3779B97F4A7C15, set(), 0
    s = [ord(x) for x in text]
    while s:
        level += 1
        runs = []
        for x in s:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        s = [x if n == 1 else mix(x + n * odd) for x, n in runs]

        def toss(a, b):
            d = a ^ b
            low = (d & -d).bit_length() - 1
            return 2 * low + (a >> low & 1)

        def small(a, b):
            return 12 + (a >> 6 & 1) if a == b else toss(a, b)

        label = [toss(s[0], s[0] ^ 1)] + [toss(a, b) for b, a in zip(s, s[1:])]
        for _ in range(2):
            label = [small(label[0], label[0] ^ 1)] + [small(a, b) for b, a in zip(label, label[1:])]
        cuts = [0] + [i for i in range(2, len(s)) if label[i] < label[i - 1] and (i + 1 == len(s) or label[i] <= label[i + 1])]
        names = []
        for a, b in zip(cuts, [*cuts[1:], len(s)]):
            total = sum(mix(x) * pow(odd, i, 2**64) for i, x in enumerate(s[a:b]))
            names.append(mix(total + (b - a) * 0x632BE59BD9B4E019 + level))
        if level >= fingerprints.FROM or len(names) == 1:
            out |= {x >> 32 for x in names}
        if len(names) == 1:
            break
        s = names
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aabc é中\U0001f600", max_size=70), min_size=1, max_size=5))
def test_parsing_is_that_of_symbols_one_by_one(texts):
    for text, sketch in zip(texts, fingerprints.sketches(texts)):
        want = naive_names(text) if text else set()
        assert sketch.tolist() == sorted(want)[: fingerprints.KEPT]
