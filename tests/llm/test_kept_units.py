"""What a worker keeps between texts that it packs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from sonoweft.llm import packing, queries, tokens


def test_packing_keeps_few_units_and_the_same_ids():
    path = queries.vocabulary("word_bpe_49k.json")
    kept = tokens.encoder(path, "word", 500)
    assert packing.GENERATION < tokens.GENERATION and tokens.encoder(path, "word") is not kept
    whole = Tokenizer.from_file(path)
    for part in range(20):
        texts = [" ".join(f"q{part * 300 + k}x{k % 7}" for k in range(i, i + 60)) for i in range(0, 300, 50)]
        flat, starts = kept.encode(pa.array(texts))
        for i, text in enumerate(texts):
            assert np.array_equal(flat[starts[i] : starts[i + 1]], whole.encode(text, add_special_tokens=False).ids)
        assert len(kept.cache) + len(kept.past) < 2 * (500 + 2 * 360)
