"""Phrase mining against counting every n-gram in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from turnstile.llm import collocations as c


def by_hand(rows, min_count, first):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        inside = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * counts[p[i : i + k]]}
        best = []
        for p, a in found.items():
            if p not in inside:
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(best)[:first])]
    return sorted(out)


def corpus(seed, n=250):
    rng = random.Random(seed)
    words = ["the", "The", "mill", "river", "é", "a\x01", "a", "日本", "x" * 40, "of", "\u00a0", "-"]
    phrase = "an old mill by the river bank"
    text = lambda: "".join(rng.choice([*words, phrase, phrase]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", ", "\r", ";"]) for _ in range(rng.randint(0, 40)))
    rows = [(rng.choice(["en", "fr", None]), rng.choice([None, "", text(), text(), text()])) for _ in range(n)]
    return rows + rows[:20]


@pytest.mark.parametrize(("block_bytes", "range_grams"), [(200, 50), (3000, 400), (8_000_000, 1_000_000)])
def test_against_every_ngram(spark, shared, block_bytes, range_grams):
    rows = corpus(block_bytes)
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "lang string, text string, phrase string, words string, number int")
    got = sorted(tuple(r) for r in c.mined(df, min_count=4, first=40, block_bytes=block_bytes, range_grams=range_grams).collect())
    assert got == by_hand(rows, 4, 40)


def test_one_hot_phrase_and_long_texts(spark, shared):
    rows = [("en", "alpha beta gamma delta epsilon zeta " * 2000), ("en", "alpha beta " * 300 + "\n" + "one two"), ("en", "solo")]
    got = sorted(tuple(r) for r in c.mined(spark.createDataFrame(rows, "lang string, text string"), min_count=100, block_bytes=500, range_grams=100).collect())
    assert got == by_hand(rows, 100, 2000)


def test_nothing_to_find(odd, none):
    assert c.mined(none).count() == 0
    assert c.mined(odd.limit(3), min_count=10**6).count() == 0


def test_automata():
    rng = random.Random(2)
    labels = np.array(sorted(rng.sample(range(10**12), 9)))
    shards, total = [], Counter()
    for _ in range(5):
        paths = Counter(tuple(rng.randrange(9) for _ in range(rng.randint(1, 5))) for _ in range(300))
        total.update(paths)
        rows = sorted(tuple(k + 1 for k in p) + (0,) * (5 - len(p)) for p in paths)
        weights = np.array([paths[tuple(k - 1 for k in r if k)] for r in rows])
        built = c.Automaton.from_bytes(c.Automaton.build(labels, np.array(rows, np.uint32), weights).to_bytes())
        words, found = built.paths()
        assert {tuple(int(np.searchsorted(labels, w)) for w in r if w >= 0): int(n) for r, n in zip(words, found, strict=True)} == dict(paths)
        assert sum(len(level[0]) for level in built.levels) == len({p[:k] for p in paths for k in range(1, len(p) + 1)})
        shards.append(built)
    known, rows, weights = c.united(shards)
    whole = c.Automaton.build(known, rows, weights)
    asked = [tuple(rng.randrange(9) for _ in range(rng.randint(1, 5))) for _ in range(2000)]
    queries = np.array([[labels[k] for k in p] + [-1] * (5 - len(p)) for p in asked])
    assert whole.compose(queries).tolist() == [total[p] for p in asked]
    assert whole.compose(np.array([[7, -1, -1, -1, -1]])).tolist() == [0]
