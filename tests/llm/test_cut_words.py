"""Words cut into parts and encoded many at once have the ids of one plain call for each whole text."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from sonoweft.llm import queries, tokens

_BITS = ["a", "B", "H̱", "é", "é", "İ", "ß", "Σ", "ﬁ", "ŉ", "≠", "<", "{", "_", ".", "'s", "'LL", "1", "²", "中", "\U0001f600"]
_SPACE = [" ", " ", " ", "\n", "\t", "\x85", "\x01", "\x02", "\0", "<|endoftext|>", "<|ENDOFTEXT|>", "endoftext|>"]


def _unlike(texts: list[str | None]) -> list[str | None]:
    path = queries.vocabulary("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    flat, starts = tokens.UnitEncoder(path, "word", 1000).encode(pa.array(texts, pa.string()))
    return [t for i, t in enumerate(texts) if not np.array_equal(flat[starts[i] : starts[i + 1]], whole.encode(t or "", add_special_tokens=False).ids)]


def test_a_capital_whose_small_letters_end_in_a_combining_mark():
    assert _unlike(["İ.", "aİ, b", "İstanbul!", "abc.", None, ""]) == []


def test_odd_characters():
    deal = random.Random(3)
    assert _unlike(["".join(deal.choice(_BITS + _SPACE) for _ in range(deal.randrange(14))) for _ in range(5000)]) == []


def test_new_words_take_few_calls():
    encoder = tokens.UnitEncoder(queries.vocabulary("word_bpe_49k.json"), "word")
    calls = []

    class Counting:
        def encode_batch_fast(self, texts, **kw):
            calls.extend(texts)
            return tokenizer.encode_batch_fast(texts, **kw)

    tokenizer, encoder.tokenizer = encoder.tokenizer, Counting()
    flat, _ = encoder.encode(pa.array([" ".join(f"Word{chr(97 + k % 26)}{chr(97 + k // 26)}, " for k in range(600))]))
    assert len(flat) > 1200 and len(calls) <= 4
