"""Toxicity scores and shards of the queries against plain versions, step by step and item by item."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from sonoweft.llm import queries, sharding, toxicity


def plain_vector(w: dict, word: bytes) -> np.ndarray:
    """A word's inputs: its own vector, and the greatest of each dimension over its character n-grams."""
    marked = b"\x02" + word + b"\x03"
    grams = []
    for n in (3, 4, 5):
        for i in range(len(marked) - n + 1):
            h = 0
            for c in marked[i : i + n]:
                h = ((h ^ c) * 16777619 + n) % 2**32
            grams.append(w["char"][(h ^ h >> 15) % toxicity.BUCKETS])
    return np.concatenate([w["word"][zlib.crc32(word) % toxicity.BUCKETS], np.max(grams, axis=0)]).astype(float)


def plain_states(w: dict, side: str, line: list[np.ndarray]) -> list[np.ndarray]:
    s = lambda v: 1 / (1 + np.exp(-v))
    n, h, out = toxicity.HIDDEN, np.zeros(toxicity.HIDDEN), []
    for x in line:
        a, b = x @ w[side + "x"].astype(float) + w[side + "b"], h @ w[side + "u"].astype(float)
        update, reset = s(a[:n] + b[:n]), s(a[n : 2 * n] + b[n : 2 * n])
        h = update * h + (1 - update) * np.tanh(a[2 * n :] + reset * b[2 * n :])
        out.append(h)
    return out


def plain_logit(net: toxicity.Network, text: str | None) -> float:
    """The highest of all overlapping windows of a text, each read forwards and backwards and pooled by attention."""
    w, words = net.w, toxicity.words_of(text)
    best, at = -math.inf, 0
    while True:
        line = [plain_vector(w, x) for x in words[at : at + 48]]
        pooled = np.zeros(2 * toxicity.HIDDEN)
        if line:
            states = np.concatenate([plain_states(w, "f_", line), plain_states(w, "b_", line[::-1])[::-1]], 1)
            e = np.array([np.tanh(s @ w["att"]) @ w["query"] for s in states])
            a = np.exp(e - e.max())
            pooled = (a / a.sum()) @ states
        best = max(best, float(np.squeeze(pooled @ w["out"] + w["bias"])))
        if at + 48 >= len(words):
            return net.scale * best + net.shift
        at += 32


def test_toxicity_scores(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    net = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    got = Counter((r.doc_id, r.held_out, round(r.score, 3), r.predicted) for r in queries.op5_toxicity(spark, data).collect())
    rows = docs.collect()
    assert sum(got.values()) == len(rows) and any(len(toxicity.words_of(r.text)) > 80 for r in rows)
    scores: dict[int, list] = {}
    for doc_id, held, score, predicted in got.elements():
        scores.setdefault(doc_id, []).append(score)
        assert held == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        assert predicted == (score >= 0.3) or abs(score - 0.3) < 2e-3
    for r in rows:
        want = 1 / (1 + math.exp(-plain_logit(net, r.text)))
        assert min(abs(s - want) for s in scores[r.doc_id]) < 2e-3, r.doc_id


def plain_place(items: list[tuple[int, ...]], shards: int) -> list[int]:
    """Largest first (greatest share, then the sum of shares), each where it fits and the dot product with what is free is highest."""
    total = [max(1, sum(x[d] for x in items)) for d in range(3)]
    share = [tuple(Fraction(v, t) for v, t in zip(x, total, strict=True)) for x in items]
    free = [[Fraction(1, shards)] * 3 for _ in range(shards)]
    chosen = [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-max(share[i]), -sum(share[i]), i)):
        x = share[i]
        fit = [s for s in range(shards) if all(f >= v for f, v in zip(free[s], x, strict=True))]
        if fit:
            best = max(fit, key=lambda s: (sum(f * v for f, v in zip(free[s], x, strict=True)), -s))
        else:
            best = max(range(shards), key=lambda s: (min(f - v for f, v in zip(free[s], x, strict=True)), -s))
        free[best] = [f - v for f, v in zip(free[best], x, strict=True)]
        chosen[i] = best
    return chosen


@pytest.mark.parametrize("seed", range(6))
def test_items_are_placed_by_the_dot_product(seed):
    rng = np.random.default_rng(seed)
    shards = int(2 ** rng.integers(1, 4))
    rest = rng.integers(1, 60, (40, 3))
    fill = np.array([256, 1024, 4096]) * shards - rest.sum(0)  # totals that are powers of two keep shares exact
    items = np.vstack([rest, fill // 2, fill - fill // 2]) if (fill > 1).all() else rest
    sizes = items / items.sum(0)
    assert sharding.place(sizes, shards).tolist() == plain_place([tuple(map(int, x)) for x in items], shards)


def test_shards_of_the_query(spark, data):
    rows = [(r.doc_id, (r.text or "").encode("utf-8", "surrogatepass")) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op7_vector_sharding(spark, data).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len(t) + 1, zlib.crc32(t)) for i, t in rows)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and {r.shard for r in got} == set(range(16))
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    text, total = dict(rows), sum(len(t) + 1 for _, t in rows)
    of: dict[bytes, set[int]] = {}
    weight: Counter = Counter()
    for r in got:
        of.setdefault(text[r.doc_id], set()).add(r.shard)
        weight[text[r.doc_id]] += r["size"]
    half = total / 32
    words = {t: len(re.findall(rb"[^\x20\x09-\x0D]+", t)) for t in of}
    counts = Counter(t for _, t in rows)
    most_words = sum(words[t] * counts[t] for t in of) / 32
    for t, shards in of.items():
        if weight[t] <= half and counts[t] <= len(rows) / 32 and words[t] * counts[t] <= most_words:
            assert len(shards) == 1
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= max(weight.values())
