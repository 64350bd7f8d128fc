"""Token counts against the library on whole texts."""

import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from turnstile.llm import queries, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def by_library(texts):
    tokenizer = Tokenizer.from_file(BYTES)
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def made(rng):
    signs = ["the", "mill", "'s", "don't", "'", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u3000", "\u2028", "\x85", "<|endoftext|>", "<|endof", "12", "é", "日本語", "😀", "\x00", "!!", "...", "can'thave", "e\u0301"]
    return "".join(rng.choice(signs) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 60)))


@pytest.mark.parametrize("block_bytes", [300, 8_000_000])
def test_counts_are_the_library_s(spark, shared, block_bytes):
    rng = random.Random(1)
    texts = [made(rng) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["row"]["doc_id"]: r for r in token_counts.counted(df, BYTES, ["doc_id"], block_bytes=block_bytes, limit=40).collect()}
    for k, (text, n) in enumerate(zip(texts, by_library(texts), strict=True)):
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len(text.encode()), n, n > 40), repr(text)


def test_awkward_rows(spark, odd, none):
    """Nulls, empty and very long texts, repeated rows, and columns with the operator's own names."""
    named = odd.withColumnsRenamed({"words": "block", "at": "tokens", "row": "places", "base": "n", "kept": "n_tokens"})
    out = token_counts.counted(named, BYTES, named.columns).collect()
    rows = named.collect()
    want = Counter((r, len((r["text"] or "").encode()), n) for r, n in zip(rows, by_library([r["text"] or "" for r in rows]), strict=True))
    assert Counter((r["row"], r["n_bytes"], r["n_tokens"]) for r in out) == want
    assert token_counts.counted(none, BYTES, ["doc_id"]).count() == 0


def test_other_tokenizers_are_refused(odd):
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.counted(odd, WORDS, ["doc_id"])


def test_query_over_the_whole_table(spark, shared, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op13(spark, sf).collect()}
    want = {k: (len(t.encode()), n, n > 1024) for (k, t), n in zip(docs.items(), by_library(list(docs.values())), strict=True)}
    assert got == want
