"""Lines of all lengths and scripts against brute force."""

import random
import re

from turnstile.llm import line_dedup

HAN = [chr(0x4E00 + i) for i in range(12)]


def _levenshtein_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def _units(line):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]
    if len(words) == 1 and any(ord(c) > 127 for c in line):
        return "chars", list(words[0]), 20
    return "words", words, 5


def _near(x, y):
    if x == y:
        return True
    (kind, a, least), (other, b, _) = _units(x), _units(y)
    return kind == other and min(len(a), len(b)) >= least and _levenshtein_at_most_one(a, b)


def test_mixed_lines_against_brute_force(spark, shared):
    rng = random.Random(9)
    bank = ["Read more", "}", "All rights reserved.", "https://example.org/a/very/long/address/1", "https://example.org/a/very/long/address/2", "été", "", " \t"]
    bank += ["".join(rng.choice(HAN) for _ in range(rng.randint(18, 26))) for _ in range(12)]
    bank += [" ".join(rng.choice(["the", "sea", "müde", HAN[0], "was"]) for _ in range(rng.randint(4, 7))) for _ in range(12)]

    def edited(line):
        if rng.random() < 0.4:
            return line
        kind, units, _ = _units(line)
        k = rng.randrange(len(units) + 1)
        x = rng.choice(HAN if kind == "chars" else ["x", "yy"])
        units = rng.choice([units[:k] + units[k + 1 :], units[:k] + [x] + units[k:], units[:k] + [x] + units[k + 1 :]])
        return ("" if kind == "chars" else rng.choice([" ", " ", "  ", "\t"])).join(units) + rng.choice(["", "", " ", "\r"])

    rows = [(i, "\n".join(edited(rng.choice(bank)) for _ in range(7))) for i in range(70)]
    lines = [(i, k, x) for i, t in rows for k, x in enumerate(t.split("\n"))]
    gone = {(i, k) for n, (i, k, x) in enumerate(lines) if _units(x)[1] and any(_near(x, y) for _, _, y in lines[:n])}
    want = {i: ("\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone), sum(j == i for j, _ in gone)) for i, t in rows}
    out = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["row"]["doc_id"]: (r["kept_text"], r["n_removed"]) for r in out.collect()} == want
    assert any(len(_units(x)[1]) >= 20 and not any(x == y for _, _, y in lines[:n]) for n, (i, k, x) in enumerate(lines) if (i, k) in gone)


def test_short_and_undivided_lines(spark, shared):
    line = "".join(HAN) * 2
    rows = [(1, f"Read more\n{line}\n\nhttps://example.org/one/two/three"), (2, f"Read more\n{line}\n\nhttps://example.org/one/two/threE"), (3, line.replace(HAN[3], "x", 1)), (4, " \n"), (5, None)]
    got = {r["row"]["doc_id"]: (r["kept_text"], r["n_removed"]) for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\nhttps://example.org/one/two/threE", 2), 3: ("", 1), 4: (" \n", 0), 5: (None, 0)}
