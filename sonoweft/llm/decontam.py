"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared in a normal form: lower case, each run of other characters
than letters and digits one space. A passage of m characters that occurs with at
most k edits shares at least m - q + 1 - k q of its q-grams with the text, on
diagonals (place in the text minus place in the passage) within k of each other.
The most common q-grams of a passage are left out as far as the bound stays
positive: of n kept q-grams at least n - k q are shared.

The budget is a tenth of the passage's characters at every length. Where that
leaves no q-gram of the asked length that must be shared (below 40 characters),
shorter ones are counted: of m // (k + 1) characters at most, so that the bound
is at least 1.

Shared q-grams are counted in bands of 2 (k + 1) diagonals, each band overlapping
the next by half, so that one band holds all of an occurrence. Bands that reach
the bound are verified by banded alignment of the whole passage, so every reported
passage does occur within the edit budget, and no occurrence is missed. Passages
above ``LONG`` characters are first aligned by furthest reaching points, which
ends at once where the edits are few; the cells of the band decide the rest.

The benchmark is taken in blocks of a bounded size, each sent to all tasks; a
benchmark of n blocks costs n passes over the documents.

Defined results: null and empty texts have no hits; passages without a letter or
digit (null ones too) aren't searched; overlapping occurrences of a passage in a
text are one row, the best of them, and other occurrences a row each; equal
passages are reported under each of their ids; repeated rows are reported as
often as they occur; empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import chunks, rows_of

HITS = "doc_id long, item_id long, start long, end long, edits int"
#: Passages above so many characters are aligned by furthest reaching points first; postings that are counted at once.
LONG, POSTINGS = 512, 1 << 22
_PLANE = 1 << 16
_tables: list[np.ndarray] = []


def _folding() -> np.ndarray:
    """Of each code point of the first plane: its lower case, or a space if it is no letter or digit."""
    if not _tables:
        low = np.full(_PLANE, 32, "<u4")
        for i in range(_PLANE):
            if (c := chr(i)).isalnum():
                low[i] = ord(c.lower()) if len(c.lower()) == 1 else i
        _tables.append(low)
    return _tables[0]


def normal_form(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in normal form, and the place in the text of each. Code point 0 stays as it is."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = np.where(codes < _PLANE, _folding()[np.minimum(codes, _PLANE - 1)], codes)
    low[codes == 0] = 0
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    return low[keep], np.flatnonzero(keep)


def _trimmed(form: np.ndarray) -> np.ndarray:
    """Without spaces at either end."""
    inside = np.flatnonzero(form != 32)
    return form[inside[0] : inside[-1] + 1] if len(inside) else form[:0]


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q-gram; equal q-grams have equal ones."""
    small = (codes ^ codes >> 8).astype(np.uint64)
    out = np.zeros(max(0, len(codes) - q + 1), np.uint64)
    for k in range(q):
        out = out * np.uint64(0x100000001B3) + small[k : k + len(out)]
    return (out ^ out >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)


class _Index:
    """The q-grams of some passages: which have them where, and how many must be shared."""

    def __init__(self, names: np.ndarray, forms: list[np.ndarray], edits: np.ndarray, q: int):
        self.names, self.q, self.edits = names, q, edits
        size = np.array([len(f) for f in forms], np.int64)
        self.shift = 2 * int(size.max()) + 2  # makes every diagonal's band positive
        grams = [_grams(f, q) for f in forms]
        every = np.concatenate(grams)
        kinds, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        spare = (size - q + 1 - edits * q - 1) * 2 // 3
        order = np.lexsort((-count[inverse], owner))
        rank = np.arange(len(order)) - np.searchsorted(owner, owner[order])
        kept = np.sort(order[rank >= spare[owner[order]]])
        self.bound = np.bincount(owner[kept], minlength=len(grams)) - edits * q
        order = kept[np.argsort(every[kept], kind="stable")]
        self.grams, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(order))
        self.owner, self.place = owner[order], place[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.grams >> np.uint64(42)] = True

    def candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, first diagonal) of the bands that reach the bound."""
        grams = _grams(codes, self.q)
        at = np.flatnonzero(self.seen[grams >> np.uint64(42)])
        j = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        same = self.grams[j] == grams[at]
        at, j = at[same], j[same]
        times = self.first[j + 1] - self.first[j]
        kinds, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends, begin = np.cumsum(times), 0
        while begin < len(at):  # a bounded number of postings at a time, however often a q-gram is repeated
            done = ends[begin] - times[begin]
            stop = max(begin + 1, int(np.searchsorted(ends, done + POSTINGS, "right")))
            part = slice(begin, stop)
            posting = np.repeat(self.first[j[part]] - (ends[part] - times[part] - done), times[part]) + np.arange(int(ends[stop - 1] - done))
            owner = self.owner[posting]
            band = (np.repeat(at[part], times[part]) - self.place[posting] + self.shift) // (self.edits[owner] + 1)
            some, n = np.unique(np.concatenate([owner << 40 | band, owner << 40 | band - 1]), return_counts=True)  # band b holds [b * half, (b + 2) * half)
            kinds, inverse = np.unique(np.concatenate([kinds, some]), return_inverse=True)
            count = np.bincount(inverse, np.concatenate([count, n]), len(kinds)).astype(np.int64)
            begin = stop
        owner = kinds >> 40
        full = count >= self.bound[owner]
        owner, band = owner[full], (kinds & (1 << 40) - 1)[full]
        return self.names[owner], band * (self.edits[owner] + 1) - self.shift


class Passages:
    """Passages with their budgets, and an index for each length of q-gram that they need."""

    def __init__(self, items: list[tuple[int, str]], q: int = 8, rate: float = 0.1):
        self.items = [(i, f) for i, t in items if t and len(f := _trimmed(normal_form(t)[0]))]
        self.size = np.array([len(f) for _, f in self.items], np.int64)
        self.edits = (rate * self.size).astype(np.int64)
        # the bound m - g + 1 - k g of all q-grams is at least 1
        lengths = np.minimum(q, self.size // (self.edits + 1))
        self.indexes = []
        for g in np.unique(lengths).tolist():
            names = np.flatnonzero(lengths == g)
            self.indexes.append(_Index(names, [self.items[i][1] for i in names], self.edits[names], g))

    def candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, first diagonal) of the bands that reach the bound."""
        found = [x.candidates(codes) for x in self.indexes]
        return tuple(np.concatenate([f[i] for f in found]) for i in (0, 1))

    def verify(self, codes: np.ndarray, owner: np.ndarray, diagonal: np.ndarray, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """The fewest edits of each candidate within its band, and where that alignment ends; candidates of like size together."""
        best, end = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
        todo = np.ones(len(owner), bool)
        for c in np.flatnonzero(self.size[owner] > LONG):
            near = self._near(codes, owner[c], int(diagonal[c]))
            if near:
                best[c], end[c] = near
                todo[c] = False
        order = np.flatnonzero(todo)
        order = order[np.argsort(self.size[owner[order]], kind="stable")]
        widths = 4 * self.edits[owner[order]] + 3
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j - i) * widths[j] < cells and self.size[owner[order[j]]] <= 2 * self.size[owner[order[i]]]:
                j += 1
            some = order[i:j]
            best[some], end[some] = self._aligned(codes, owner[some], diagonal[some])
            i = j
        return best, end

    def _near(self, codes: np.ndarray, i: int, diagonal: int) -> tuple[int, int] | None:
        """What ``_aligned`` gives for one candidate where that is at most an eighth of its budget.

        After each edit, every diagonal of the band knows how far into the passage it can reach.
        """
        k, m = int(self.edits[i]), int(self.size[i])
        start, width = diagonal - k, 4 * k + 3
        pattern = np.append(self.items[i][1], np.uint32(0xFFFFFFFF))
        low = max(0, -start)
        line = np.concatenate([np.zeros(low, codes.dtype), codes[max(0, start) : start + width + m], np.zeros(max(0, start + width + m - len(codes)) + 1, codes.dtype)])
        reach = np.zeros(width, np.int64)
        for e in range(k // 8 + 1):
            going, step = np.flatnonzero((reach >= 0) & (reach < m)), 4
            while len(going):
                at = reach[going, None] + np.arange(step)
                differ = pattern[np.minimum(at, m)] != line[np.minimum(at + going[:, None], len(line) - 1)]
                run = np.where(differ.any(1), differ.argmax(1), step)
                reach[going] += run
                going, step = going[run == step], min(2 * step, 1024)
            if (reach == m).any():
                return e, start + m + int((reach == m).argmax())
            longer = reach + 1
            longer[1:] = np.maximum(longer[1:], reach[:-1])
            longer[:-1] = np.maximum(longer[:-1], reach[1:] + 1)
            reach = np.minimum(longer, m)
        return None

    def _aligned(self, codes: np.ndarray, owner: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edits, size = self.edits[owner], self.size[owner]
        k = int(edits.max())
        width = 2 * (k + 1) + 2 * k + 1
        line = np.concatenate([codes, np.zeros(int(size.max()) + width, codes.dtype)])
        pattern = np.zeros((len(owner), int(size.max())), codes.dtype)
        for c, i in enumerate(owner):
            pattern[c, : size[c]] = self.items[i][1]
        start = diagonal - edits
        column = np.arange(width)
        cost = np.zeros((len(owner), width), np.int32)
        best, end = np.full(len(owner), 1 << 20), np.zeros(len(owner), np.int64)
        for i in range(pattern.shape[1]):
            if i % 64 == 63 and ((cost.min(1) > edits) | (size <= i)).all():
                break  # none can come back into its budget
            at = start[:, None] + i + column
            text = np.where((at >= 0) & (at < len(line)), line[np.clip(at, 0, len(line) - 1)], 0)
            step = cost + (text != pattern[:, i : i + 1])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(step - column, axis=1) + column
            done = np.flatnonzero(size == i + 1)
            if len(done):
                least = cost[done].argmin(1)
                best[done], end[done] = cost[done, least], start[done] + i + least + 1
        return best, end


def _hits(texts: list[str | None], passages: Passages) -> list[tuple[int, int, int, int, int]]:
    """(text, item id, start, end, edits) in places of the texts; the best of overlapping occurrences."""
    line = "\0".join((t or "").replace("\0", " ") for t in texts)
    codes, where = normal_form(line)
    if not len(codes) or not passages.items:
        return []
    owner, diagonal = passages.candidates(codes)
    if not len(owner):
        return []
    best, end = passages.verify(codes, owner, diagonal)
    good = best <= passages.edits[owner]
    owner, diagonal, best, end = owner[good], diagonal[good], best[good], end[good]
    breaks = np.flatnonzero(codes == 0)
    bounds = np.concatenate([[-1], breaks, [len(codes)]])
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, d, e, x in zip(owner.tolist(), diagonal.tolist(), best.tolist(), end.tolist(), strict=True):
        # where the band cuts an alignment off, its end can lie past the text's; its middle can't
        text = int(np.searchsorted(breaks, max(0, x - 1 - int(passages.size[i]) // 2)))
        low, high = int(bounds[text]) + 1, int(bounds[text + 1])
        if x - int(passages.size[i]) - e < low or x > high:  # it may use the text before or after: align with this one alone
            (e,), (x,) = passages.verify(codes[low:high], np.array([i]), np.array([d - low]))
            e, x = int(e), int(x) + low
            if e > passages.edits[i]:
                continue
        out.setdefault((text, i), []).append((e, min(x, high)))
    rows = []
    text_at = np.append(-1, where[breaks])
    for (text, i), found in out.items():
        taken: list[int] = []
        for e, x in sorted(found):
            if all(abs(x - y) >= passages.size[i] for y in taken):
                taken.append(x)
                start = max(x - int(passages.size[i]), int(breaks[text - 1]) + 1 if text else 0)
                base = int(text_at[text]) + 1
                rows.append((text, passages.items[i][0], int(where[start]) - base, int(where[x - 1]) + 1 - base, e))
    return rows


_built: dict[tuple[str, tuple], Passages] = {}


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[str, list[tuple[int, str]]]]:
    """The benchmark in lists of about ``block_bytes`` of text, each with a name of its own."""
    known = benchmark.select("item_id", "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    n = -(-(known.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    for k in range(n):
        yield uuid.uuid4().hex, sorted((r["item_id"], r["text"]) for r in known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect())


def _passages(block: tuple[str, list[tuple[int, str]]], options: tuple) -> Passages:
    """The worker's index of a block; its tasks share it."""
    name, items = block
    if (name, options) not in _built:
        _built.clear()
        _built[name, options] = Passages(items, *options)
    return _built[name, options]


def hits(docs: DataFrame, benchmark: DataFrame, q: int = 8, rate: float = 0.1, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, item_id, start, end, edits: each benchmark passage that a text holds within the edit budget.

    start and end are code-point places in the text (start as if no character
    were inserted or left out); edits is the edit distance in normal form.
    """
    spark, out = docs.sparkSession, None
    for block in _blocks(benchmark, block_bytes):
        send = spark.sparkContext.broadcast(block)

        def task(batches: Iterator[pa.RecordBatch], send=send) -> Iterator[pa.RecordBatch]:
            passages = _passages(send.value, (q, rate))
            rows = rows_of(batches)
            for chunk in chunks(rows, 1, 1 << 19):
                found = _hits([t for _, t in chunk], passages)
                if found:
                    columns = list(zip(*[(chunk[i][0], *rest) for i, *rest in found], strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in HITS.split(", ")])

        one = docs.select("doc_id", "text").mapInArrow(task, HITS)
        out = one if out is None else out.union(one)
    return spark.createDataFrame([], HITS) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, q: int = 8, rate: float = 0.1, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows whose text holds no passage, with all their columns; nothing is shuffled."""
    at = docs.columns.index("text")
    for block in _blocks(benchmark, block_bytes):
        send = docs.sparkSession.sparkContext.broadcast(block)

        def task(batches: Iterator[pa.RecordBatch], send=send) -> Iterator[pa.RecordBatch]:
            passages = _passages(send.value, (q, rate))
            for b in batches:
                rows = ((i, t) for i, (t,) in enumerate(rows_of([b.select([at])])))
                bad = {chunk[i][0] for chunk in chunks(rows, 1, 1 << 19) for i, *_ in _hits([t for _, t in chunk], passages)}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(task, docs.schema)
    return docs
