"""Periodic runs of words in a text, and texts with the repeats taken out.

A run is a maximal stretch with smallest period q (words q apart are identical)
and a length of at least max(``LEAST``, ``TIMES`` * q). Texts are independent, so
Spark deals them to tasks; a task handles a chunk of texts at once with numpy.

The method is the branching-tandem test on an enhanced suffix array. Suffixes of
words are ranked by prefix doubling (only those not yet told apart are sorted
again); the ranks of every doubling are kept and give the longest common prefix of
any two suffixes. For each boundary of the suffix array with common prefix d > 0,
that is for each split of an LCP interval into two parts, the suffixes i of the
smaller part are tested: if suffix i + d or i - d is in the other part, by its
place in the inverse array, two equal stretches of d words stand side by side and
the next word differs. No tree is built. A run of period d has exactly one such
square, its last; rotating it to the left while the words agree gives the run. Of
equal stretches the least period counts.

Texts where no five words in a row come twice can have no run (a run shares at
least five words with itself one period on); they are told apart by hashes of five
words first, where a collision only costs time.

Defined results: a text without words (null, empty, white space) has no runs and
an empty collapsed text; rows with null or repeated doc_id are handled each on
their own; an empty table gives no rows; extra columns are ignored. A task holds 4
bytes a word for each doubling of the longest repeat of the texts in its chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh
from .tokens import chunks, rows_of

#: A run has at least so many words, and at least so many periods.
LEAST, TIMES = 6, 4
SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
#: Tests of suffixes that are done at once.
_STEP = 1 << 21
_K = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """Numbers keys in the order in which they are first met."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def _may_repeat(line: np.ndarray, of: np.ndarray, width: int) -> np.ndarray:
    """The texts in which some ``width`` words in a row come twice (and a few others)."""
    n = len(line) - width + 1
    if n < 2:
        return np.zeros(0, np.int64)
    key = of[:n].astype(np.uint64)
    for i in range(width):
        key = (key ^ line[i : i + n].astype(np.uint64)) * _K
        key ^= key >> np.uint64(31)
    at = np.flatnonzero(of[:n] == of[width - 1 :])
    at = at[np.argsort(key[at])]
    return np.unique(of[at[1:][key[at[1:]] == key[at[:-1]]]])


def suffix_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of the prefixes of 1, 2, 4, ... symbols of all suffixes, until no two are equal.

    Every text in ``symbols`` must end with a symbol that comes once.
    """
    order = np.argsort(symbols, kind="stable")
    keys = symbols[order].astype(np.int64)
    rank, levels, h = np.zeros(len(symbols), np.int32), [], 1
    old = np.zeros(len(symbols), np.int64)
    while True:
        at = np.arange(len(order))
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        begins = np.concatenate([[True], old[1:] != old[:-1]])
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[order] = old + start - np.maximum.accumulate(np.where(begins, at, 0))
        levels.append(rank)
        order = order[~(new & np.append(new[1:], True))]
        if not len(order):
            return levels
        keys = rank[order].astype(np.int64) << 32 | rank[order + h]
        by = np.argsort(keys, kind="stable")
        order, keys = order[by], keys[by]
        old, h = keys >> 32, 2 * h


def common_prefixes(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of symbols that suffixes i and j begin with in common."""
    i, j = i.copy(), j.copy()
    begin = i.copy()
    for k in reversed(range(len(levels))):
        step = (levels[k][i] == levels[k][j]).astype(i.dtype) << k
        i += step
        j += step
    return i - begin


def _bounds(lcp: np.ndarray, at: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """For each boundary: the last one before it with a smaller value, the first after it with no greater one."""
    table = [lcp]
    while 1 << len(table) <= longest:
        t, half = table[-1], 1 << len(table) - 1
        table.append(np.minimum(t[:-half], t[half:]))
    value, left, right = lcp[at], at.copy(), at + 1
    for k in reversed(range(len(table))):
        t, size = table[k], 1 << k
        low = np.maximum(left - size, 0)
        left = np.where((left >= size) & (t[np.minimum(low, len(t) - 1)] >= value), low, left)
        fits = right < len(t)
        right = np.where(fits & (t[np.minimum(right, len(t) - 1)] > value), right + size, right)
    return left - 1, right


def branching_squares(levels: list[np.ndarray], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half lengths d of all squares whose next word differs from the one d before it."""
    rank = levels[-1].astype(np.int64)
    sa = np.empty(len(rank), np.int64)
    sa[rank] = np.arange(len(rank))
    lcp = np.full(len(rank) + 1, -1, np.int32)
    lcp[1:-1] = common_prefixes(levels, sa[:-1], sa[1:])
    at = np.flatnonzero(lcp > 0)
    before, after = _bounds(lcp, at, longest)
    left = at - before <= after - at
    first, many = np.where(left, before, at), np.where(left, at - before, after - at)
    low, high = np.where(left, at, before), np.where(left, after, at)
    total = np.cumsum(many)
    starts, halves, a = [], [], 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + _STEP, "right")))
        n = many[a:b]
        of = np.repeat(np.arange(a, b), n)
        i = sa[first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)]
        d = lcp[at[of]].astype(np.int64)
        for begin, other in ((i, i + d), (i - d, i - d)):
            place = rank[np.maximum(other, 0)]
            hit = (other >= 0) & (place >= low[of]) & (place < high[of])
            starts.append(begin[hit])
            halves.append(d[hit])
        a = b
    return np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate([np.zeros(0, np.int64), *halves])


def _runs(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period."""
    levels = suffix_ranks(symbols)
    start, period = branching_squares(levels, longest)
    end, ahead = start + 2 * period, start + period
    for k in reversed(range(len(levels))):
        size = 1 << k
        same = (start >= size) & (levels[k][np.maximum(start - size, 0)] == levels[k][np.maximum(ahead - size, 0)])
        start = start - size * same
        ahead = ahead - size * same
    length = end - start
    found = np.stack([start, length, period], 1)[length >= np.maximum(LEAST, TIMES * period)]
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    again = (found[1:, :2] == found[:-1, :2]).all(1)
    found = found[np.concatenate([[True], ~again])[: len(found)]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def find(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each text, given as words: rows (start, length, period) by start, then period."""
    ids, sizes = _Ids(), np.array([len(t) for t in texts], np.int64)
    line = np.fromiter(chain.from_iterable(map(ids.__getitem__, t) for t in texts), np.int64, int(sizes.sum()))
    begins = np.cumsum(sizes) - sizes
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    some = _may_repeat(line, np.repeat(np.arange(len(texts)), sizes), LEAST - 1)
    if not len(some):
        return out
    # each text has symbols of its own, so that no interval spans two texts, and ends with one that comes once
    parts = [np.append(line[begins[t] : begins[t] + sizes[t]], len(ids)) + k * (len(ids) + 1) for k, t in enumerate(some)]
    places = np.cumsum([0, *map(len, parts)])
    found = _runs(np.concatenate(parts), max(map(len, parts)))
    of = np.searchsorted(places, found[:, 0], "right") - 1
    for k, t in enumerate(some):
        mine = found[of == k]
        out[t] = mine - [places[k], 0, 0]
    return out


def _collapsed(words: list[bytes], runs: np.ndarray) -> str:
    if len(runs):
        keep = np.zeros(len(words) + 1, np.int64)
        np.add.at(keep, runs[:, 0] + runs[:, 2], 1)
        np.add.at(keep, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(keep[:-1]) == 0)]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, its ``runs`` by start and period, and its words without repeats (``collapsed``), for each row.

    Of a run the words after its first period are dropped.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(rows_of(batches), 1, 1 << 21):
            texts = [r[1].encode("utf-8", "surrogatepass").split() if r[1] else [] for r in chunk]
            found = find(texts)
            rows = np.concatenate(found)
            struct = pa.StructArray.from_arrays([pa.array(rows[:, k], pa.int64()) for k in range(3)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), struct)
            collapsed = pa.array([_collapsed(t, f) for t, f in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in chunk], pa.int64()), lists, collapsed], names=["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(task, SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """Texts with every tenth one (by h = crc32(doc_id)) made periodic from word a on.

    With g = h // 10, a = g mod n and p = 1 + (n - a) // (3 + g mod 8), word i >= a
    becomes the original word a + (i - a) mod p. A row without a doc_id stays.
    """
    names = ["doc_id", "text"]
    words, h = fresh(names, "words"), fresh(names, "h")
    docs = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias(h))
    some, rest = docs.where(f"{h} % 10 = 0"), docs.where(f"{h} IS NULL OR {h} % 10 <> 0").select(*names)
    listed = some.select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias(words), F.expr(f"{h} div 10").alias("g"))
    listed = listed.withColumn("n", F.size(words).cast("long")).withColumn("a", F.expr("g % greatest(n, 1)"))
    listed = listed.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = f"slice(flatten(array_repeat(slice({words}, CAST(a AS INT) + 1, CAST(p AS INT)), CAST((n - a + p - 1) div p AS INT))), 1, CAST(n - a AS INT))"
    made = listed.select("doc_id", F.expr(f"array_join(concat(slice({words}, 1, CAST(a AS INT)), {tail}), ' ')").alias("text"))
    return rest.union(made)


def digests(found: DataFrame) -> DataFrame:
    """What ``op12`` returns of ``periodic_runs``: counts, the run with the greatest length / period, and digests."""
    empty = "CAST(NULL AS struct<start: long, length: long, period: long>)"
    best = F.expr(f"aggregate(runs, {empty}, (m, x) -> CASE WHEN m IS NULL OR x.length * m.period > m.length * x.period THEN x ELSE m END)")
    lines = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{k}").alias(k) for k in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
