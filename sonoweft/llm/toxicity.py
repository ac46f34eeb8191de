"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is lower-cased and cut into words; windows of ``WINDOW`` words start at
every ``STRIDE``-th word, so that neighbours overlap, and together cover the
whole text. A word enters as a hashed word vector and the elementwise maximum of
the hashed vectors of its character n-grams. Two gated recurrent layers read a
window forwards and backwards, attention pools their states, and a text's score
is that of its highest window.

Labels say only that a text is toxic, not where. So training takes from each
toxic text the window that scores highest so far, and from each clean text its
highest and a random one; the first choice is by log-odds of words and n-grams,
which also start one column of the vectors.

Training uses a sample of at most ``sample`` labelled texts of each class (one of
each doc_id, none above ``longest`` characters), chosen by a hash of doc_id, and a
fixed number of steps. Scoring covers all rows.

Defined results: null and empty texts have one window of padding and so the
same score; a row with a null doc_id is scored and not held out; repeated rows
get equal scores; an empty table gives no rows; a repeated label counts once
(toxic if any says so); without two classes among the labels every score is 0.
Extra columns are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh
from .tokens import chunks, rows_of

WINDOW, STRIDE = 48, 32
BUCKETS, WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 1 << 16, 4, 6, 8, 8
CACHED_WORDS = 120_000
GRAMS = (3, 4, 5)
_SPACE = bytes(c if chr(c).isalnum() or c > 127 or chr(c) in "@*$" else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACE).split() if text else []


def word_buckets(words: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % BUCKETS for w in words), np.int64, len(words))


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words' character n-grams (with edge marks), word after word, and where each word's begin."""
    line = b"".join([b"\x02" + w + b"\x03" for w in words])
    chars = np.frombuffer(line, np.uint8).astype(np.uint32)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(chars))
    found, where = [], []
    for n in GRAMS:
        h = np.zeros(max(0, len(chars) - n + 1), np.uint32)
        for k in range(n):
            h = (h ^ chars[k : k + len(h)]) * np.uint32(16777619) + np.uint32(n)
        inside = np.flatnonzero(at[: len(h)] + n <= ends[: len(h)])
        h = h[inside]
        found.append((h ^ h >> np.uint32(15)) % np.uint32(BUCKETS))
        where.append(inside)
    order = np.argsort(np.concatenate(where), kind="stable")
    owner = np.repeat(np.arange(len(words)), sizes)[np.concatenate(where)[order]]
    starts = np.searchsorted(owner, np.arange(len(words)))
    return np.concatenate(found)[order].astype(np.int64), starts


def windows_of(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each window (within its text) and its text; every text has one at least."""
    count = np.maximum(0, -(-(n_words - WINDOW) // STRIDE)) + 1
    text = np.repeat(np.arange(len(n_words)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return nth * STRIDE, text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights by name: word and char vectors, f_/b_ recurrent layers, attention and output."""

    w: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0

    def inputs(self, words: list[bytes]) -> np.ndarray:
        out = np.empty((len(words), WORD_DIM + CHAR_DIM), np.float32)
        for i in range(0, len(words), 1 << 13):
            part = words[i : i + (1 << 13)]
            grams, starts = gram_buckets(part)
            out[i : i + len(part), :WORD_DIM] = self.w["word"][word_buckets(part)]
            out[i : i + len(part), WORD_DIM:] = np.maximum.reduceat(self.w["char"][grams], starts, axis=0)
        return out

    def layer(self, side: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (time, window, hidden) over projected inputs (time, window, 3 * hidden), in reading order."""
        u, h = self.w[side + "u"], np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((len(x), *h.shape), np.float32)
        for t in range(len(x)):
            hu = h @ u
            zr = _sigmoid(x[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            m = mask[t]
            new = h + m * (1 - z) * (n - h)
            if keep is not None:
                keep.append((h, z, r, n, hu[:, 2 * HIDDEN :], m))
            h = out[t] = new
        return out

    def logits(self, ids: np.ndarray, project: dict[str, np.ndarray]) -> np.ndarray:
        """Of windows (window, time) of indices into ``project``; -1 is padding."""
        mask = (ids.T >= 0).astype(np.float32)[:, :, None]
        f = self.layer("f_", project["f_"][ids.T], mask)
        b = self.layer("b_", project["b_"][ids.T[::-1]], mask[::-1])[::-1]
        states = np.concatenate([f, b], 2)
        return self.pool(states, mask)[0]

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        t = np.tanh(states @ self.w["att"])
        e = np.where(mask[:, :, 0] > 0, t @ self.w["query"], -1e9)
        a = np.exp(e - e.max(0)) * mask[:, :, 0]
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", a, states)
        return pooled @ self.w["out"] + self.w["bias"], pooled, a, t

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {s: np.concatenate([x @ self.w[s + "x"] + self.w[s + "b"], np.zeros((1, 3 * HIDDEN), np.float32)]).astype(np.float32) for s in ("f_", "b_")}


class Scorer:
    """A network with the projections of the words that a worker has met."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.room = {s: np.zeros((1 << 15, 3 * HIDDEN), np.float32) for s in ("f_", "b_")}

    def index(self, texts: list[list[bytes]]) -> np.ndarray:
        if len(self.ids) > CACHED_WORDS:
            self.clear()
        ids = self.ids
        new = list({w for t in texts for w in t if w not in ids})
        for i in range(0, len(new), 1 << 14):
            part = new[i : i + (1 << 14)]
            first = len(ids)
            made = self.net.project(self.net.inputs(part))
            while first + len(part) + 1 > len(self.room["f_"]):
                self.room = {s: np.concatenate([x, np.zeros_like(x)]) for s, x in self.room.items()}
            for s, x in self.room.items():
                x[first : first + len(part)] = made[s][:-1]
            ids.update(zip(part, range(first, first + len(part)), strict=True))
        return np.fromiter(map(ids.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))

    def window_ids(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(window, time) word indices with -1 for padding, and the text of each window."""
        flat = np.append(self.index(texts), -1)
        n = np.array([len(t) for t in texts], np.int64)
        start, text = windows_of(n)
        at = start[:, None] + np.arange(WINDOW)
        ends = np.cumsum(n)
        return np.where(at < n[text, None], flat[np.minimum(at + (ends - n)[text, None], len(flat) - 1)], -1), text

    def window_logits(self, ids: np.ndarray, batch: int = 1024) -> np.ndarray:
        return np.concatenate([self.net.logits(ids[i : i + batch], self.room) for i in range(0, len(ids), batch)])

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """The logit of each text: that of its highest window, calibrated."""
        ids, text = self.window_ids([words_of(t) for t in texts])
        first = np.searchsorted(text, np.arange(len(texts)))
        return self.net.scale * np.maximum.reduceat(self.window_logits(ids), first) + self.net.shift


def _log_odds(buckets: Iterable[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Of each bucket: how much more often toxic texts have it, 0 where few texts do."""
    count = np.zeros((2, BUCKETS))
    for b, y in zip(buckets, label, strict=True):
        count[int(y)][b] += 1
    n = np.bincount(label, minlength=2)
    odds = np.log((count[1] + 2) / (n[1] + 4)) - np.log((count[0] + 2) / (n[0] + 4))
    return np.where(count.sum(0) >= 3, np.clip(odds, -4, 4), 0).astype(np.float32)


def _backward(net: Network, x: np.ndarray, ids: np.ndarray, label: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the mean cross-entropy: of the dense weights, and of the input vector of each word."""
    w, h2 = net.w, HIDDEN
    mask = (ids.T >= 0).astype(np.float32)[:, :, None]
    project, keep, states = net.project(x), {"f_": [], "b_": []}, {}
    order = {"f_": ids.T, "b_": ids.T[::-1]}
    for s, m in (("f_", mask), ("b_", mask[::-1])):
        states[s] = net.layer(s, project[s][order[s]], m, keep[s])
    both = np.concatenate([states["f_"], states["b_"][::-1]], 2)
    logit, pooled, a, t = net.pool(both, mask)
    g = {k: np.zeros_like(v) for k, v in w.items() if k not in ("word", "char")}
    d = ((_sigmoid(logit) - label) / len(label)).astype(np.float32)
    g["out"], g["bias"] = pooled.T @ d, np.array([d.sum()], np.float32)
    dpool = d[:, None] * w["out"]
    dboth = a[:, :, None] * dpool
    da = np.einsum("tnh,nh->tn", both, dpool)
    de = a * (da - (a * da).sum(0))
    g["query"] = np.einsum("tn,tna->a", de, t)
    dt = de[:, :, None] * w["query"] * (1 - t * t)
    g["att"] = np.einsum("tnh,tna->ha", both, dt)
    dboth += dt @ w["att"].T
    dx = np.zeros((len(x) + 1, x.shape[1]), np.float32)
    for s, dout in (("f_", dboth[:, :, :h2]), ("b_", dboth[::-1, :, h2:])):
        dh, u = np.zeros_like(dout[0]), w[s + "u"]
        dp = np.zeros((len(dout), dout.shape[1], 3 * h2), np.float32)
        for k in range(len(dout) - 1, -1, -1):
            h, z, r, n, hn, m = keep[s][k]
            dh = dh + dout[k]
            dn = dh * m * (1 - z) * (1 - n * n)
            dz = dh * m * (h - n) * z * (1 - z)
            dr = dn * hn * r * (1 - r)
            dp[k] = np.concatenate([dz, dr, dn], 1)
            dhu = np.concatenate([dz, dr, dn * r], 1)
            g[s + "u"] += h.T @ dhu
            dh = dh * (1 - m * (1 - z)) + dhu @ u.T
        per_word = np.zeros((len(x) + 1, 3 * h2), np.float32)
        np.add.at(per_word, order[s].ravel(), dp.reshape(-1, 3 * h2))
        g[s + "x"], g[s + "b"] = x.T @ per_word[:-1], per_word[:-1].sum(0)
        dx[:-1] += per_word[:-1] @ w[s + "x"].T
    return g, dx[:-1]


def train(texts: list[str | None], labels: list[int], rounds: int = 3, steps: int = 80, batch: int = 128, seed: int = 7) -> Network:
    """Fits a network in ``rounds * steps`` steps, whatever the number of texts."""
    rng, label = np.random.default_rng(seed), np.array(labels, np.int64)
    draw = lambda *shape, by=0.3: rng.normal(0, by, shape).astype(np.float32)
    dim = WORD_DIM + CHAR_DIM
    w = {"word": draw(BUCKETS, WORD_DIM, by=0.05), "char": draw(BUCKETS, CHAR_DIM, by=0.05), "att": draw(2 * HIDDEN, ATTEND), "query": draw(ATTEND), "out": draw(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
    for s in ("f_", "b_"):
        w |= {s + "x": draw(dim, 3 * HIDDEN), s + "u": draw(HIDDEN, 3 * HIDDEN), s + "b": np.zeros(3 * HIDDEN, np.float32)}
    net = Network(w, 1.0, -30.0)
    if len(set(labels)) < 2:
        net.scale = 0.0
        return net
    ids_of: dict[bytes, int] = {}
    cut = [np.fromiter((ids_of.setdefault(w, len(ids_of)) for w in words_of(t)), np.int32) for t in texts]
    vocabulary = list(ids_of)
    del ids_of
    kinds = lambda: ([vocabulary[i] for i in np.unique(t)] for t in cut)
    w["word"][:, 0] += _log_odds((np.unique(word_buckets(t)) for t in kinds()), label)
    w["char"][:, 0] += _log_odds((np.unique(gram_buckets(t)[0]) if t else np.zeros(0, int) for t in kinds()), label)
    scorer = Scorer(net)
    n = np.array([len(t) for t in cut])
    flat = np.append(np.concatenate(cut), np.int32(-1))
    del cut
    start, text = windows_of(n)
    at = (start[:, None] + np.arange(WINDOW)).astype(np.int32)
    windows = np.where(at < n[text, None], flat[np.minimum(at + (np.cumsum(n) - n)[text, None].astype(np.int32), len(flat) - 1)], -1).astype(np.int32)
    del at
    first = np.searchsorted(text, np.arange(len(n)))
    x = net.inputs(vocabulary)
    score = np.append(x[:, 0] + 2 * x[:, WORD_DIM], -9).astype(np.float32)[windows].max(1)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items() if k not in ("word", "char")}
    past = {k: np.full_like(w[k], 1e-3) for k in ("word", "char")}
    tick = 0

    def highest(score: np.ndarray) -> np.ndarray:
        most = np.maximum.reduceat(score, first)
        hit = np.flatnonzero(score == most[text])
        return hit[np.searchsorted(text[hit], np.arange(len(first)))]

    for _ in range(rounds):
        top = highest(score)
        toxic, clean = top[label == 1], top[label == 0]
        rest = np.flatnonzero(label[text] == 0)
        for _ in range(steps):
            tick += 1
            pick = np.concatenate([rng.choice(toxic, batch // 2), rng.choice(clean, batch // 4), rng.choice(rest, batch // 4)])
            y = label[text[pick]].astype(np.float32)
            used, ids = np.unique(windows[pick], return_inverse=True)
            ids = ids.reshape(-1, WINDOW)
            if used[0] < 0:
                ids, used = ids - 1, used[1:]
            some = [vocabulary[i] for i in used]
            bw, (bc, starts) = word_buckets(some), gram_buckets(some)
            values = w["char"][bc]
            inputs = net.inputs(some)
            g, dx = _backward(net, inputs, ids, y)
            for k, v in g.items():
                a, b = moment[k]
                a += 0.1 * (v - a)
                b += 0.01 * (v * v - b)
                w[k] -= 0.01 * (a / (1 - 0.9**tick)) / (np.sqrt(b / (1 - 0.99**tick)) + 1e-6)
            sparse = {"word": np.zeros_like(w["word"]), "char": np.zeros_like(w["char"])}
            np.add.at(sparse["word"], bw, dx[:, :WORD_DIM])
            owner = np.repeat(np.arange(len(some)), np.diff(np.append(starts, len(bc))))
            for k in range(CHAR_DIM):
                most = np.flatnonzero(values[:, k] == inputs[owner, WORD_DIM + k])
                sparse["char"][:, k] = np.bincount(bc[most], dx[owner[most], WORD_DIM + k], BUCKETS)
            for k, v in sparse.items():
                past[k] += v * v
                w[k] -= 0.02 * v / np.sqrt(past[k]) * (v != 0)
        scorer.clear()
        project = net.project(net.inputs(vocabulary))
        score = np.concatenate([net.logits(windows[i : i + 2048], project) for i in range(0, len(windows), 2048)])
    net.scale, net.shift = _calibrate(score[highest(score)], label)
    return net


def _calibrate(score: np.ndarray, label: np.ndarray, prior: float = 0.1) -> tuple[float, float]:
    """Scale and shift of a logistic curve over the texts' scores, with classes weighted to the prior."""
    weight = np.where(label == 1, prior / label.mean(), (1 - prior) / (1 - label.mean()))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * score + b)
        g = np.array([(weight * (p - label) * score).sum() + 1e-2 * (a - 1), (weight * (p - label)).sum()])
        c = weight * p * (1 - p) + 1e-6
        hessian = np.array([[(c * score * score).sum() + 1e-2, (c * score).sum()], [(c * score).sum(), c.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hessian, g), -2, 2)
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.05)), float(b)


def remainder(doc_id: str | Column, of: int) -> Column:
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % of


def fit(docs: DataFrame, labels: DataFrame, held: int = 2, folds: int = 4, sample: int = 1500, longest: int = 200_000) -> Network:
    """Learns ``labels.toxic`` from rows of ``docs`` outside the held-out fold.

    The driver gets at most ``sample`` texts of each class, one a doc_id, of at
    most ``longest`` characters each.
    """
    known = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.col("toxic").isin(0, 1) & (remainder("doc_id", folds) != held))
    first = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = F.broadcast(first(0).union(first(1)))
    one = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= longest).join(chosen, "doc_id")
    rows = sorted(one.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect(), key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


_scorers: dict[int, Scorer] = {}


def score(docs: DataFrame, net: Network, column: str = "score") -> DataFrame:
    """``docs`` with a column that holds the probability that the text is toxic.

    A column of that name that docs has already is replaced; ``shared.fresh`` finds a name that is free.
    """
    send = docs.sparkSession.sparkContext.broadcast(net)
    at, made_name = docs.columns.index("text"), fresh(docs.columns, "_score")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if id(send.value) not in _scorers:
            _scorers.clear()
            _scorers[id(send.value)] = Scorer(send.value)
        scorer = _scorers[id(send.value)]
        for b in batches:
            made = [1 / (1 + np.exp(-scorer.texts([t for (t,) in chunk]).astype(np.float64))) for chunk in chunks(rows_of([b.select([at])]), 0, 1 << 19)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([*made, np.zeros(0)]), pa.float64())], names=[*b.schema.names, made_name])

    out = docs.mapInArrow(task, docs.select("*").schema.add(made_name, "double"))
    return out.drop(*[c for c in docs.columns if c.lower() == column.lower()]).withColumnRenamed(made_name, column)
