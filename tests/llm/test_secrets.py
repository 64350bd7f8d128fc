"""Spans of texts with many matches, against re."""

import re
import time

from turnstile.llm import secrets


def _spans(text):
    found = sorted((m.start(), k, m.end()) for k, rule in enumerate(secrets.BASE) for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least)
    return [f"{secrets.BASE[k].kind}:{a}:{b}" for a, k, b in found]


def _scanned(spark, texts):
    rows = secrets.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rules=secrets.BASE)
    return {r["doc_id"]: r["spans"].split(",") if r["spans"] else [] for r in rows.collect()}


def test_every_number_of_matches(spark, shared):
    """One match to some powers of two, with matches that are too short and code points of two units in between."""
    texts = ["".join(f"é😀 token = {'abcdefgh' if i % 3 else 'abc'}{i} " for i in range(n)) for n in (0, 1, 2, 3, 4, 5, 7, 8, 9, 31, 32, 33, 200)]
    assert _scanned(spark, texts) == {k: _spans(t) for k, t in enumerate(texts)}


def test_a_text_of_many_matches_takes_no_squared_time(spark, shared):
    text = lambda n: "".join(f"secret={i:08d};" for i in range(n))
    _scanned(spark, [text(100)])
    began = time.monotonic()
    assert _scanned(spark, [text(5_000)])[0] == _spans(text(5_000))
    few = time.monotonic() - began
    began = time.monotonic()
    assert _scanned(spark, [text(80_000)])[0] == _spans(text(80_000))
    assert time.monotonic() - began < 8 * few + 10
