"""Pieces of texts whose ids are looked up: equal to the library's, each encoded once."""

import random

import numpy as np
from public_tokenizers import path
from tokenizers import Tokenizer

from turnstile.llm import token_files


class _Counting:
    """Passes texts on and keeps them."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def get_vocab(self):
        return self.tokenizer.get_vocab()

    def encode_batch_fast(self, texts, add_special_tokens):
        self.asked += texts
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    def encode(self, text, add_special_tokens):
        return self.encode_batch_fast([text], add_special_tokens)[0]


def _tokenizer():
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_a_word_is_encoded_once_whatever_punctuation_follows():
    counting = _Counting(_tokenizer())
    texts = ["a zubrowka zubrowka. zubrowka, zubrowka!", "so zubrowka?! zubrowka; zubrowka:"]
    got = token_files._Pieces().encode(counting, texts)
    assert sum(t.count("zubrowka") for t in counting.asked) == 1
    assert got == [np.array(_tokenizer().encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_pieces_make_whole_texts():
    rng = random.Random(8)
    parts = ["a", "The", "été", "×", "Ж", "中", "12", "½", "'s", "'", ".", ",", "?!", "-", "。", "\U0001f600", "\x1c", " ", " ", " ", "\n", "\t", "  ", "\n\n", "<|endoftext|>"]
    texts = ["", " ", "\n", "a\n", "\na", " a", "a ", "a.", "\n."] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(4000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in _tokenizer().encode_batch(texts, add_special_tokens=False)]
    pieces = token_files._Pieces()
    assert pieces.encode(_tokenizer(), texts) == want
    full = token_files._Pieces()
    full.MOST = 50
    assert [raw for i in range(0, len(texts), 100) for raw in full.encode(_tokenizer(), texts[i : i + 100])] == want
    assert pieces.encode(_tokenizer(), texts) == want
