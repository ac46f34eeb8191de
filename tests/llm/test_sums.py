"""Counts that op13's tasks hand over."""

from __future__ import annotations

from collections import Counter

import numpy as np

from sonoweft.llm import collocation


def test_pairs_are_counted_without_empty_columns():
    rng = np.random.default_rng(1)
    x = rng.integers(1, 1 << 64, 40, dtype=np.uint64)[rng.integers(0, 40, 5000)]
    sums = collocation._Sums(2, 2)
    assert not sums.add(x, np.arange(2999)) and not sums.add(x, np.arange(2999, 4999))
    got = sums.take()
    assert got.schema.names == ["a", "b", "f"]
    assert {(r["a"], r["b"]): r["f"] for r in got.to_pylist()} == Counter(zip(x[:-1].view(np.int64).tolist(), x[1:].view(np.int64).tolist()))
    assert sums.take().num_rows == 0 and collocation._Sums(3).take().schema.names == ["a", "b", "c", "d", "f"]


def test_keys_that_share_high_bits_are_added_up_right():
    keys = np.array([3, 1, 3, 2, 1, 3] * 50 + [1 << 63, (1 << 63) + 1], np.uint64)
    total = Counter()
    for at, n in zip(*collocation._grouped(keys), strict=True):
        total[int(keys[at])] += int(n)
    assert total == Counter(keys.tolist())
