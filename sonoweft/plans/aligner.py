"""Training a monophone model and aligning with it, as Spark jobs over utterance rows.

An utterance row has utt, feats (array of frames) and words (array of words,
each an array of pronunciations, each an array of phones). Each pass sends the
model (a fixed number of states) to all tasks; a task aligns its utterances and
returns sums per state, which are added in the shuffle. The driver holds one row
per state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import estimation
from ..operators.features import Mfcc, frames_of, mfcc, nested, pack, vectors

STATES = 3
SILENCE = "sil"
INTERVALS = "utt string, tier string, idx int, label string, word int, start_frame int, end_frame int, loglike double"
STATS = "pdf int, n double, sx array<double>, sxx array<double>, like double, frames long"


#: Boundary refinement: how far a boundary may move, and the step, in milliseconds.
REACH, STEP = 30, 1


@dataclass(frozen=True)
class Model:
    """One Gaussian per state of each phone; phones by name, the first is silence."""

    phones: tuple[str, ...]
    mean: np.ndarray
    var: np.ndarray

    def costs(self, x: np.ndarray) -> np.ndarray:
        constant = np.log(2 * np.pi * self.var).sum(1) + (self.mean**2 / self.var).sum(1)
        return 0.5 * (constant + (x * x) @ (1 / self.var).T) - x @ (self.mean / self.var).T


class Graph:
    """States and arcs of an utterance: optional silence around words, alternatives for pronunciations."""

    def __init__(self, words: list[list[list[str]]], index: dict[str, int]):
        self.pdf: list[int] = []
        self.unit: list[tuple[int, str, int]] = []  # phone occurrence, phone and word of each state
        self.arcs: list[tuple[int, int, float]] = []
        self.units = 0
        ends = self._optional([(-1, 0.0)], index)
        for w, prons in enumerate(words):
            out = []
            for pron in prons:
                at = ends
                for phone in pron:
                    at = self._phone(at, phone, w, index)
                out += at
            ends = self._optional(out, index) if out else ends
        self.final = ends

    def _phone(self, ends: list[tuple[int, float]], phone: str, word: int, index: dict[str, int]) -> list[tuple[int, float]]:
        first, half = len(self.pdf), float(np.log(2))
        for k in range(STATES):
            self.pdf.append(index[phone] * STATES + k)
            self.unit.append((self.units, phone, word))
            self.arcs.append((first + k, first + k, half))
            if k:
                self.arcs.append((first + k - 1, first + k, half))
        self.units += 1
        self.arcs += [(end, first, cost) for end, cost in ends]
        return [(first + STATES - 1, half)]

    def _optional(self, ends: list[tuple[int, float]], index: dict[str, int]) -> list[tuple[int, float]]:
        half = float(np.log(2))
        ends = [(e, c + half) for e, c in ends]
        return ends + self._phone(ends, SILENCE, -1, index)

    def best_path(self, costs: np.ndarray) -> tuple[float, np.ndarray] | None:
        """Least cost and the states of all frames; none if the frames are too few."""
        starts = [(d, c) for s, d, c in self.arcs if s < 0]
        arcs = sorted((d, s, c) for s, d, c in self.arcs if s >= 0)
        dst, src, weight = (np.array(v) for v in zip(*arcs, strict=True))
        n, first = len(self.pdf), np.searchsorted(dst, np.arange(len(self.pdf)))
        emit = costs[:, self.pdf]
        now = np.full(n, np.inf)
        for d, c in starts:
            now[d] = min(now[d], c)
        now = now + emit[0]
        back = np.zeros((len(emit), n), np.int32)
        place = np.arange(len(dst))
        for t in range(1, len(emit)):
            reach = now[src] + weight
            least = np.minimum.reduceat(reach, first)
            hit = np.where(reach == least[dst], place, len(dst))
            back[t] = src[np.minimum(np.minimum.reduceat(hit, first), len(dst) - 1)]
            now = least + emit[t]
        end, cost = min(self.final, key=lambda f: (now[f[0]] + f[1]) if f[0] >= 0 else np.inf)
        if end < 0 or not np.isfinite(now[end] + cost):
            return None
        states = np.empty(len(emit), np.int32)
        states[-1] = end
        for t in range(len(emit) - 1, 0, -1):
            states[t - 1] = back[t][states[t]]
        return float(now[end] + cost), states


@dataclass(frozen=True)
class Piece:
    """The states of a word and the silence after it (or of the silence before all words, or of a whole graph) with the arcs that lead to them.

    States count from the piece's first; arcs are sorted by dst and src, those from the piece
    before have a negative src. ``word`` is 0 in the word's states and -1 in silence; in a
    whole graph the word's number. ``start`` has (dst, cost) from the start, ``final`` (state, cost) of the ends.
    """

    pdf: np.ndarray
    unit: np.ndarray
    word: np.ndarray
    arcs: tuple[np.ndarray, np.ndarray, np.ndarray]
    start: list[tuple[int, float]]
    final: list[tuple[int, float]]


class Pieces:
    """Pieces for the words that a task meets, each made once for each word before it; forgotten when they are many."""

    def __init__(self, phones: tuple[str, ...], most: int = 20_000):
        self.index, self.most = {p: i for i, p in enumerate(phones)}, most
        self.held: dict[tuple, Piece] = {}

    def of(self, words: list[list[list[str]]]) -> list[tuple[int, Piece]]:
        """(first word, piece) along an utterance."""
        if len(self.held) > self.most:
            self.held.clear()
        keys = [(w, tuple(map(tuple, prons))) for w, prons in enumerate(words) if prons]
        if not all(all(key) for _, key in keys):  # an empty pronunciation lets what is before it pass on
            return [(0, self._made(Graph(words, self.index), 0))]
        out, before = [], ()
        for w, key in [(0, ()), *keys]:
            if (piece := self.held.get((before, key))) is None:
                graph = Graph([k for k in (before, key) if k], self.index)
                piece = self._made(graph, len(Graph([before] if before else [], self.index).pdf) if key else 0)
                if key:
                    piece = replace(piece, word=np.minimum(piece.word, 0))
                self.held[before, key] = piece
            out.append((w, piece))
            before = key
        return out

    def _made(self, graph: Graph, first: int) -> Piece:
        arcs = sorted((d - first, s - first, c) for s, d, c in graph.arcs if d >= first and s >= 0)
        dst, src, cost = (np.array(v) for v in zip(*arcs, strict=True))
        unit, word = (np.array([u[k] for u in graph.unit[first:]]) for k in (0, 2))
        start = [(d - first, c) for s, d, c in graph.arcs if d >= first and s < 0]
        return Piece(np.array(graph.pdf[first:]), unit - unit[0], word, (src, dst, cost), start, [(e - first if e >= 0 else -1, c) for e, c in graph.final])


#: Utterances that are searched together, and the states times frames that these may have (one utterance may have more).
TOGETHER, CELLS = 128, 1 << 24
Path = tuple[int, float, np.ndarray, np.ndarray, np.ndarray]


def best_paths(texts: list, frames: list[np.ndarray], model: Model, pieces: Pieces) -> Iterator[Path]:
    """(place in the lists, least cost, pdf, unit and word of each frame) of each utterance that has a path, as ``Graph.best_path`` finds them.

    Many utterances go through their frames side by side, the longest first.
    """
    made = sorted(((k, pieces.of(t)) for k, t in enumerate(texts) if len(frames[k])), key=lambda m: -len(frames[m[0]]))
    sizes = [sum(len(p.pdf) for _, p in parts) for _, parts in made]
    at = 0
    while at < len(made):
        end, room = at + 1, CELLS // len(frames[made[at][0]]) - sizes[at]
        while end < len(made) and end < at + TOGETHER and room >= sizes[end]:
            room -= sizes[end]
            end += 1
        yield from _together(made[at:end], sizes[at:end], [frames[k] for k, _ in made[at:end]], model)
        at = end


def _together(made: list[tuple[int, list[tuple[int, Piece]]]], sizes: list[int], frames: list[np.ndarray], model: Model) -> Iterator[Path]:
    parts = [(w, p) for _, own in made for w, p in own]
    base = np.concatenate([[0], np.cumsum([len(p.pdf) for _, p in parts])])
    join = lambda arrays, counts, add: np.concatenate(arrays) + np.repeat(add, counts)
    arcs = [len(p.arcs[0]) for _, p in parts]
    src, dst = (join([p.arcs[k] for _, p in parts], arcs, base[:-1]) for k in (0, 1))
    weight, pdf = np.concatenate([p.arcs[2] for _, p in parts]), np.concatenate([p.pdf for _, p in parts])
    states, lengths = int(base[-1]), np.array(list(map(len, frames)))
    ends = np.cumsum(sizes)
    # the arcs to each state in their order, as rows of a table
    into = np.bincount(dst, minlength=states)
    nth = np.arange(len(dst)) - np.repeat(np.cumsum(into) - into, into)
    come, cost = np.zeros((into.max(), states), np.int64), np.full((into.max(), states), np.inf)
    come[nth, dst], cost[nth, dst] = src, weight
    now = np.full(states, np.inf)
    for b, (_, p) in zip(base.tolist(), parts, strict=False):
        for d, c in p.start:
            now[b + d] = min(now[b + d], c)
    scores = model.costs(np.concatenate(frames))
    width = scores.shape[1]
    scores = scores.ravel()
    emit = np.repeat((np.cumsum(lengths) - lengths) * width, sizes) + pdf
    now += scores[emit]
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]))  # utterances with a frame of that number
    back = np.zeros((lengths[0], states), np.uint8 if len(come) < 256 else np.int32)
    many, narrow = len(come), back.dtype
    for t in range(1, lengths[0]):
        m = ends[alive[t] - 1]
        held, places, which = now[:m], emit[:m], back[t, :m]
        least = held.take(come[0, :m])
        least += cost[0, :m]
        for k in range(1, many):
            reach = held.take(come[k, :m])
            reach += cost[k, :m]
            less = (reach < least).view(np.uint8)  # a later arc must be less
            np.maximum(which, less if k == 1 else less * narrow.type(k), out=which)
            np.minimum(least, reach, out=least)
        places += width
        least += scores.take(places)
        now[:m] = least
    last, total = np.zeros(len(made), np.int64), np.full(len(made), np.inf)
    k = 0
    for u, (_, own) in enumerate(made):
        k += len(own)
        b, final = int(base[k - 1]), own[-1][1].final
        end, c = min(final, key=lambda f: now[b + f[0]] + f[1] if f[0] >= 0 else np.inf)
        if end >= 0:
            last[u], total[u] = b + end, now[b + end] + c
    path = np.empty((lengths[0], len(made)), np.int64)
    for t in range(lengths[0] - 1, -1, -1):
        a = alive[t]
        path[t, :a] = last[:a]
        if t:
            last[:a] = come[back[t, last[:a]], last[:a]]
    unit = join([p.unit for _, p in parts], [len(p.unit) for _, p in parts], np.cumsum([0, *[p.unit[-1] + 1 for _, p in parts]])[:-1])
    word = np.concatenate([np.where(p.word >= 0, p.word + w, -1) for w, p in parts])
    for u, (place, _) in enumerate(made):
        if np.isfinite(total[u]):
            at = path[: lengths[u], u]
            yield place, float(total[u]), pdf[at], unit[at], word[at]


#: Rows of a batch whose frames are opened at once.
OPENED = 1024


def _opened(batches: Iterator[pa.RecordBatch], feats: int, words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list]]:
    """Parts of batches, with the frames and the words of their rows."""
    for b in batches:
        for i in range(0, b.num_rows, OPENED):
            part = b.slice(i, OPENED)
            yield part, frames_of(part.column(feats)), part.column(words).to_pylist()


def _first_chain(words: list[list[list[str]]], index: dict[str, int], frames: int) -> np.ndarray | None:
    """The states of a flat start: silence, first pronunciations, silence, frames dealt evenly."""
    chain = [SILENCE, *[p for w in words if w for p in w[0]], SILENCE]
    pdfs = np.array([index[p] * STATES + k for p in chain for k in range(STATES)])
    return pdfs[np.arange(frames) * len(pdfs) // frames] if frames >= len(pdfs) else None


def _added(held: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds ``values`` to the given rows of ``held``, in which a row may come many times."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    held[rows[first]] += np.add.reduceat(values[order], first, axis=0)


def _stats(utts: DataFrame, phones: tuple[str, ...], model: Model | None, dim: int) -> DataFrame:
    send = utts.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, model = Pieces(phones), send.value
        held = np.zeros((len(phones) * STATES, 1 + 2 * dim))
        like, seen = 0.0, 0
        for _, frames, texts in _opened(batches, 0, 1):
            if model is None:
                found = ((k, 0.0, _first_chain(t, pieces.index, len(x))) for k, (t, x) in enumerate(zip(texts, frames, strict=True)) if len(x))
            else:
                found = (p[:3] for p in best_paths(texts, frames, model, pieces))
            some = [p for p in found if p[2] is not None]
            like -= sum(p[1] for p in some)
            for a in range(0, len(some), 128):
                x = np.concatenate([frames[p[0]] for p in some[a : a + 128]])
                seen += len(x)
                _added(held, np.concatenate([p[2] for p in some[a : a + 128]]), np.hstack([np.ones((len(x), 1)), x, x * x]))
        used = np.flatnonzero(held[:, 0])
        if len(used):
            lists, n = pa.list_(pa.float64()), len(used)
            columns = [pa.array(used, pa.int32()), pa.array(held[used, 0]), pa.array(list(held[used, 1 : dim + 1]), lists), pa.array(list(held[used, dim + 1 :]), lists), pa.array([like] + [0.0] * (n - 1)), pa.array([seen] + [0] * (n - 1), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["pdf", "n", "sx", "sxx", "like", "frames"])

    sent = utts.select("feats", "words").mapInArrow(task, STATS)
    each = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(dim)]).alias(c)
    return sent.groupBy("pdf").agg(F.sum("n").alias("n"), each("sx"), each("sxx"), F.sum("like").alias("like"), F.sum("frames").alias("frames"))


def _dimension(utts: DataFrame) -> int:
    """Of the first utterance with a frame."""
    if dict(utts.dtypes)["feats"] == "binary":
        row = utts.select("feats").where(F.length("feats") > 4).first()
        return int.from_bytes(row.feats[:4], "little") if row else 0
    row = utts.select(F.col("feats")[0].alias("x")).where("x IS NOT NULL").first()
    return len(row.x) if row else 0


def _updated(rows: list, phones: tuple[str, ...], old: Model | None, floor: float = 1e-2, least: float = 3.0) -> Model:
    dim = len(rows[0]["sx"])
    n = np.zeros(len(phones) * STATES)
    sx, sxx = np.zeros((len(n), dim)), np.zeros((len(n), dim))
    for r in rows:
        n[r["pdf"]], sx[r["pdf"]], sxx[r["pdf"]] = r["n"], r["sx"], r["sxx"]
    whole = sx.sum(0) / n.sum()
    spread = sxx.sum(0) / n.sum() - whole**2
    mean = np.where(n[:, None] >= least, sx / np.maximum(n, 1)[:, None], whole if old is None else old.mean)
    var = np.where(n[:, None] >= least, sxx / np.maximum(n, 1)[:, None] - mean**2, spread if old is None else old.var)
    return Model(phones, mean, np.maximum(var, floor * spread + 1e-6))


def trained(utts: DataFrame, iterations: int = 8) -> tuple[Model, list[float]]:
    """A monophone model and the log-likelihood per frame of each iteration; ``utts`` is read once per iteration."""
    phones = utts.select(F.explode(F.flatten(F.flatten("words"))).alias("p")).distinct().orderBy("p")
    phones = (SILENCE, *[r.p for r in phones.collect() if r.p != SILENCE])
    model, likes, dim = None, [], _dimension(utts)
    for _ in range(iterations + 1):
        rows = _stats(utts, phones, model, dim).collect()
        if not rows:
            raise ValueError("no utterance has enough frames for its words")
        if model is not None:
            likes.append(sum(r["like"] for r in rows) / sum(r["frames"] for r in rows))
        model = _updated(rows, phones, model)
    return model, likes


def _spans(found: list[Path], frames: list[np.ndarray], names: list[str]) -> list[pa.Array]:
    """The columns of ``INTERVALS`` for paths: rows where the phone's occurrence, or the word, changes."""
    lengths = np.array([len(frames[p[0]]) for p in found])
    first = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(found)), lengths)
    pdf, unit, word = (np.concatenate([p[k] for p in found]) for k in (2, 3, 4))
    like = np.array([-p[1] for p in found]) / lengths
    out: list[list] = [[] for _ in range(8)]
    for tier, key in (("phones", unit), ("words", word)):
        cut = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (key[1:] != key[:-1])))
        end = np.append(cut[1:], len(of))
        if tier == "words":
            cut, end = cut[word[cut] >= 0], end[word[cut] >= 0]
        u = of[cut]
        idx = np.arange(len(u)) - np.searchsorted(u, u)
        label = [names[p] for p in (pdf[cut] // STATES).tolist()] if tier == "phones" else list(map(str, word[cut].tolist()))
        values = (np.array([p[0] for p in found])[u], [tier] * len(u), idx, label, word[cut], cut - first[u], end - first[u], like[u])
        for held, v in zip(out, values, strict=True):
            held.append(v)
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
    return [pa.concat_arrays([pa.array(v, k) for v in held]) for held, k in zip(out, kinds, strict=True)]


def aligned(utts: DataFrame, model: Model) -> DataFrame:
    """Phone and word intervals of each utterance, in frames; one that can't be aligned has no rows."""
    send = utts.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(send.value.phones)
        for part, frames, texts in _opened(batches, 1, 2):
            if found := list(best_paths(texts, frames, send.value, pieces)):
                place, *columns = _spans(found, frames, list(send.value.phones))
                yield pa.RecordBatch.from_arrays([part.column(0).take(place), *columns], names=[f.split()[0] for f in INTERVALS.split(", ")])

    return utts.select(F.col("utt").cast("string"), "feats", "words").mapInArrow(task, INTERVALS)


def aligned_frames(utts: DataFrame, model: Model) -> DataFrame:
    """speaker, pdf and x of every frame of the utterances that can be aligned."""
    send = utts.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(send.value.phones)
        for part, frames, texts in _opened(batches, 1, 2):
            for k, _, pdfs, *_ in best_paths(texts, frames, send.value, pieces):
                x = pa.FixedSizeListArray.from_arrays(pa.array(frames[k].ravel()), frames[k].shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([k] * len(pdfs))), pa.array(pdfs, pa.int32()), x], names=["speaker", "pdf", "x"])

    return utts.select(F.col("speaker").cast("string"), "feats", "words").mapInArrow(task, "speaker string, pdf int, x array<double>")


#: Sums of speakers that a task holds before it sends them on, in numbers.
HELD_SUMS = 8 << 20
SPEAKER_SUMS = "speaker string, sums binary"


class _SpeakerSums:
    """beta, k (dim rows of dim + 1) and G (dim matrices) of each speaker as one row of numbers, from frames without silence."""

    def __init__(self, model: Model):
        self.mean, self.var, self.dim = model.mean, model.var, model.mean.shape[1]
        self.held: dict[str | None, np.ndarray] = {}

    def add(self, speaker: str | None, pdfs: np.ndarray, x: np.ndarray) -> None:
        d, spoken = self.dim, pdfs >= STATES
        if not spoken.any():
            return
        pdfs, x = pdfs[spoken], np.hstack([x[spoken], np.ones((np.count_nonzero(spoken), 1))])
        weight = 1 / self.var[pdfs]
        sums = self.held.setdefault(speaker, np.zeros(1 + d * (d + 1) * (d + 2)))
        sums[0] += len(x)
        sums[1 : 1 + d * (d + 1)] += ((self.mean[pdfs] * weight).T @ x).ravel()
        both = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
        sums[1 + d * (d + 1) :] += (weight.T @ both).ravel()

    def sent(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        """All that is held, if it has ``least`` numbers or more; then nothing is held."""
        if self.held and len(self.held) * (1 + self.dim * (self.dim + 1) * (self.dim + 2)) >= least:
            rows = list(self.held.items())
            self.held.clear()
            for a in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[a : a + 256]], pa.string()), pa.array([v.tobytes() for _, v in rows[a : a + 256]], pa.binary())], names=["speaker", "sums"])


def _transforms(sums: DataFrame, dim: int, min_count: float) -> DataFrame:
    """speaker, row, w, gain from rows of ``SPEAKER_SUMS``."""

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v) for v in rows["sums"]], axis=0)
        beta, k, g = total[0], total[1 : 1 + dim * (dim + 1)].reshape(dim, dim + 1), total[1 + dim * (dim + 1) :].reshape(dim, dim + 1, dim + 1)
        w, gain = estimation.fmllr_solved(beta, k, g, min_count)
        return pd.DataFrame({"speaker": key[0], "row": np.arange(dim), "w": list(w), "gain": gain})

    return sums.groupBy("speaker").applyInPandas(solve, "speaker string, row int, w array<double>, gain double")


def speaker_transforms(frames: DataFrame, model: Model, min_count: float = 500.0) -> DataFrame:
    """speaker, row, w, gain: an affine transform of each speaker's features, from aligned frames without silence.

    Frames are first added up per speaker; the solutions are made per
    speaker from these sums.
    """
    send = frames.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _SpeakerSums(send.value)
        for b in batches:
            code = b.column(0).dictionary_encode()
            at, pdfs, x = code.indices.to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), np.array(b.column(2).to_pylist(), float)
            for k, speaker in enumerate(code.dictionary.to_pylist()):
                sums.add(speaker, pdfs[at == k], x[at == k])
            yield from sums.sent(HELD_SUMS)
        yield from sums.sent()

    sums = frames.where(F.col("speaker").isNotNull()).select("speaker", "pdf", "x").mapInArrow(task, SPEAKER_SUMS)
    return _transforms(sums, model.mean.shape[1], min_count)


def adapted(utts: DataFrame, transforms: DataFrame) -> DataFrame:
    """Utterances with their speaker's transform applied; speakers without one stay as they are."""
    rows = transforms.groupBy("speaker").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "w"))), lambda r: r["w"]).alias("_w"))
    joined = utts.join(rows, "speaker", "left").select(*[c for c in utts.columns if c != "feats"], "feats", "_w")
    binary = dict(utts.dtypes)["feats"] == "binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, OPENED):
                part = b.slice(i, OPENED)
                made = []
                for x, w in zip(frames_of(part.column(part.num_columns - 2)), part.column(part.num_columns - 1), strict=True):
                    w = np.array(w.as_py()) if w.is_valid else None
                    made.append(x if w is None or not len(x) else x @ w[:, :-1].T + w[:, -1])
                feats = pack(made) if binary else nested(made)
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], feats], names=part.schema.names[:-1])

    schema = ", ".join(f"`{k}` {t}" for k, t in joined.drop("_w").dtypes)
    return joined.mapInArrow(task, schema)


def aligned_twice(utts: DataFrame, model: Model, min_count: float = 500.0) -> DataFrame:
    """Intervals of a second pass, over features adapted to each speaker by the first; of the first, tasks send sums only."""
    send = utts.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, sums = Pieces(send.value.phones), _SpeakerSums(send.value)
        for part, frames, texts in _opened(batches, 1, 2):
            speakers = part.column(0).to_pylist()
            for k, _, pdfs, *_ in best_paths(texts, frames, send.value, pieces):
                sums.add(speakers[k], pdfs, frames[k])
            yield from sums.sent(HELD_SUMS)
        yield from sums.sent()

    rows = utts.where(F.col("speaker").isNotNull()).select(F.col("speaker").cast("string").alias("speaker"), "feats", "words").mapInArrow(task, SPEAKER_SUMS)
    return aligned(adapted(utts, _transforms(rows, model.mean.shape[1], min_count)), model)


def refined_times(samples: np.ndarray, spans: list[tuple[int, int, str]], model: Model, options: Mfcc = Mfcc()) -> list[float]:
    """The boundary before each span but the first, in seconds.

    It is where the energy rises steeply, or else the best split of 1 ms frames between
    the two phones' middle states, at a level that the energy moves (not before silence).
    A boundary stays within REACH and within half of each neighbouring span.
    """
    index = {p: i for i, p in enumerate(model.phones)}
    fine = Mfcc(**{**options.__dict__, "shift": options.rate * STEP // 1000})
    tick, last = options.shift * 1000 // options.rate, (len(samples) + fine.shift // 2) // fine.shift
    reach = []  # the first frame and the number of frames that each boundary is sought in
    for (a, b, left), (_, e, right) in zip(spans, spans[1:], strict=False):
        back, on = min(REACH, (b - a) * tick // 2), min(REACH, ((e - b) * tick - 1) // 2)
        lo = b * tick - back
        reach.append((lo, max(0, min(back + on, last - lo)) if left != right else 0))
    numbers = [np.arange(lo, lo + n) for lo, n in reach]
    scores = model.costs(mfcc(samples, fine, np.concatenate(numbers))) if numbers else np.zeros((0, 0))
    out, at = [], 0
    for (_, b, left), (_, _, right), (lo, n) in zip(spans, spans[1:], reach, strict=False):
        costs, centre = scores[at : at + n], b * tick
        at += n
        if left == right:  # nothing tells the two apart
            out.append(centre / 1000)
            continue
        middle = STATES // 2  # the outer states have learned frames that hold both phones
        curve = costs[:, index[right] * STATES + middle] - costs[:, index[left] * STATES + middle]
        if len(curve) < 2:
            out.append(centre / 1000)
            continue
        energy = estimation.energies(samples, lo - estimation.ONSET_MS, len(curve) + 2 * estimation.ONSET_MS, options.rate // 1000)
        split = estimation.energy_onset(energy)
        if split is None:
            split = estimation.split_at_level(curve, 0.5 if right == SILENCE else estimation.crossing_level(energy))
        out.append((centre if split is None else lo + split) / 1000)
    return out


def phone_spans(spans: DataFrame) -> DataFrame:
    """utt and its phones in order: idx, start_frame, end_frame, label."""
    return spans.where("tier = 'phones'").groupBy("utt").agg(F.sort_array(F.collect_list(F.struct("idx", "start_frame", "end_frame", "label"))).alias("spans"))


def refined_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """utt, idx, label, begin of batches with utt, samples and spans (as of ``phone_spans``)."""
    for b in batches:
        for utt, samples, found in zip(b.column("utt").to_pylist(), vectors(b.column("samples")), b.column("spans"), strict=True):
            cuts = [(s["start_frame"], s["end_frame"], s["label"]) for s in found.as_py()]
            begin = [cuts[0][0] / 100, *refined_times(samples.astype(float), cuts, model)]
            yield pa.RecordBatch.from_arrays([pa.array([utt] * len(cuts)), pa.array([s["idx"].as_py() for s in found], pa.int32()), pa.array([c[2] for c in cuts]), pa.array(begin)], names=["utt", "idx", "label", "begin"])


REFINED = "utt string, idx int, label string, begin double"


def refined(audio: DataFrame, spans: DataFrame, model: Model) -> DataFrame:
    """utt, idx, label, begin: the refined beginning of each phone (of the first: as it was), from audio rows (utt, samples)."""
    send = spans.sparkSession.sparkContext.broadcast(model)
    rows = audio.select(F.col("utt").cast("string").alias("utt"), "samples").join(phone_spans(spans), "utt")
    return rows.select("utt", "samples", "spans").mapInArrow(lambda batches: refined_batches(batches, send.value), REFINED)
