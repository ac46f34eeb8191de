"""Phrases of two to four words that occur together, by best-first branch and bound.

Per language, f(phrase) counts all contiguous occurrences inside pieces of text
(between marks and line ends). A phrase with f >= ``least`` is a candidate; each cut
into two parts with counts l and r gives floor(2000000 f / (l + r)), and the
lowest-scoring cut counts. A candidate inside a longer one with at least 80 % of its
occurrences is dropped. Wanted are the ``limit`` first of each language.

Nodes of the search are frequent pairs and triples. A descendant of a node (a phrase
that begins with it) occurs at most as often as the node, so with f for its count and
the known counts of the node's prefixes the score of every descendant is at most
floor(2000000 f / (f(prefix) + f)): an admissible bound, and one that the node's own
score doesn't exceed. To expand a node is to count its extensions by one word on the
right (its children) and on the left (they can only drop it: a longer candidate with
80 % of the occurrences implies one that is one word longer). Each round expands the
best nodes of each language, ``2 * limit`` at first and four times as many each time, all
of them in one pass over the corpus. A language is settled when no unexpanded node's
bound reaches its ``limit``-th best surviving score; ties in score are expanded too.
A four-word phrase needs the count of its last three words, which is known once the
pair in its middle is expanded; where it could matter, that pair is.

What grows with the corpus stays in tables: words, pairs and extensions are counted
by Spark after partial sums in each task. Two filters of a fixed size (2^26 bits each)
tell tasks which words and pairs can be frequent; a false hit costs only time, since
frequent ones are chosen by exact counts. The corpus is written once, cut to stretches
of at least two such pairs; the rounds read only that. A round sends at most ``BATCH``
nodes to the tasks; more go in further rounds.

Words are told apart by XXH64 hashes of 64 bits, seeded by their language; for 10^7
frequent words the chance that any two collide is 3e-6.

Defined results: a null lang is ``und``, together with texts of that lang; a null text
is empty; repeated rows count each; doc_id isn't used; a language without candidates has
no rows, and an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import grown, materialize, new_path
from .tokens import chunks, rows_of

LIMIT, LEAST, SCALE = 2000, 30, 2_000_000
#: Nodes that one round sends to the tasks at most (8 bytes each).
BATCH = 200_000
#: Parts in which the first of each language are found before they meet.
SALTS = 64
_FILTER_BITS, _PAGE_BITS = 26, 15
#: Words of a task whose hashes are kept, and n-grams that it adds up before it passes them on.
_VOCABULARY, _HELD = 1_000_000, 1 << 21
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 10 + b" ")
_KEY = ["a", "b", "c", "d"]


class _Hashes(dict):
    """The hash of each word of a language as it is met; 0 stands for the end of a piece and for no word."""

    def __init__(self, lang: str):
        self.seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
        self |= {b"": 0, b"\n": 0}

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed) or 1
        return h


class _Reader:
    """Chunks of (lang, text) as words and their hashes, one language at a time."""

    def __init__(self) -> None:
        self.known: dict[str, _Hashes] = {}

    def read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        for chunk in chunks(rows_of(batches), 1, 1 << 21):
            if sum(map(len, self.known.values())) > _VOCABULARY:
                self.known.clear()
            by_lang: dict[str, list[str]] = {}
            for lang, text in chunk:
                if text:
                    by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                line = "\n".join([*texts, ""]).encode("utf-8", "surrogatepass").translate(_FOLD)
                words = line.replace(b"\n", b" \n ").split(b" ")
                words = [w for w in words if w]
                if lang not in self.known:
                    self.known[lang] = _Hashes(lang)
                hashes = self.known[lang]
                yield lang, words, np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def _folded(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit number for the hashes of a phrase."""
    key = columns[0]
    for c in columns[1:]:
        key = (key << np.uint64(1) | key >> np.uint64(63)) ^ c
    return key


def _bucket(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def _bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _filter_of(table: DataFrame, columns: list[str]) -> bytes:
    """2^26 bits, set where a row's folded hash falls: a fixed 8 MB whatever the table."""
    key = F.col(columns[0])
    for c in columns[1:]:
        key = F.shiftleft(key, 1).bitwiseOR(F.shiftrightunsigned(key, 63)).bitwiseXOR(F.col(c))
    bucket = F.shiftrightunsigned(key, 64 - _FILTER_BITS)
    pages = table.select(F.shiftright(bucket, _PAGE_BITS).alias("page"), bucket.bitwiseAND((1 << _PAGE_BITS) - 1).alias("bit"))
    bits = np.zeros(1 << _FILTER_BITS - 3, np.uint8)
    for r in pages.groupBy("page").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).toLocalIterator():
        at = r["page"] << _PAGE_BITS - 3
        bits[at : at + (1 << _PAGE_BITS - 3)] = np.frombuffer(r["bits"], np.uint8)
    return bits.tobytes()


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each run of equal keys and the run's length, keys in the order of their high bits.

    The low bits carry the places, so plain numbers are sorted, which is several times faster
    than a sort of places. Keys that differ in their low bits only may alternate and so make
    several runs each; these are partial counts, which Spark adds up.
    """
    places = np.uint64((1 << max(1, len(keys)).bit_length()) - 1)
    order = (np.sort(keys & ~places | np.arange(len(keys), dtype=np.uint64)) & places).astype(np.int64)
    line = keys[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(line)), bool), line[1:] != line[:-1]]))
    return order[starts], np.diff(np.append(starts, len(line)))


class _Sums:
    """Counts of n-grams, added up until there are many; they are handed over with ``columns`` hashes, those past ``width`` 0."""

    def __init__(self, width: int, columns: int = 4):
        self.width, self.columns, self.held, self.n = width, columns, [], 0

    def add(self, x: np.ndarray, starts: np.ndarray) -> bool:
        self.held.append([x[starts + i] for i in range(self.width)])
        self.n += len(starts)
        return self.n >= _HELD

    def take(self) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)] if self.held else [np.zeros(0, np.uint64)] * self.width
        first, n = _grouped(_folded(columns))
        self.held, self.n = [], 0
        zero = np.zeros(len(first), np.int64)
        out = [c[first].view(np.int64) for c in columns] + [zero] * (self.columns - self.width)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in [*out, n]], names=[*_KEY[: self.columns], "f"])


_COUNTS = "a long, b long, c long, d long, f long"


def _word_counts(texts: DataFrame) -> DataFrame:
    """(h, lang, word, f) of all words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, hashes in _Reader().read(batches):
            first, n = _grouped(hashes)
            real = hashes[first] != 0
            first, n = first[real], n[real]
            named = pa.array([words[i].decode("utf-8", "surrogatepass") for i in first], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array([lang] * len(first), pa.string()), named, pa.array(n, pa.int64())], names=["h", "lang", "word", "f"])

    return texts.mapInArrow(task, "h long, lang string, word string, f long").groupBy("h", "lang", "word").agg(F.sum("f").alias("f"))


def _pair_counts(texts: DataFrame, words: bytes, least: int) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(words)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sums = np.frombuffer(sent.value, np.uint8), _Sums(2, 2)
        for _, _, x in _Reader().read(batches):
            fits = (x != 0) & _bit(bits, _bucket(x))
            if sums.add(x, np.flatnonzero(fits[:-1] & fits[1:])):
                yield sums.take()
        yield sums.take()

    counted = texts.mapInArrow(task, "a long, b long, f long")
    return counted.groupBy("a", "b").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _stretches(texts: DataFrame, pairs: bytes) -> DataFrame:
    """The corpus cut to stretches of three words or more whose neighbours can be frequent pairs; 0 ends a stretch."""
    sent = texts.sparkSession.sparkContext.broadcast(pairs)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for _, _, x in _Reader().read(batches):
            x = np.concatenate([x, np.zeros(2, np.uint64)])
            ok = (x[:-1] != 0) & (x[1:] != 0) & _bit(bits, _bucket(_folded([x[:-1], x[1:]])))
            third = ok[:-1] & ok[1:]
            third = np.concatenate([[False, False], third, [False, False]])
            joined = third[2:] | third[1:-1]  # word i and the next are in one triple
            joined = joined[: len(x)]
            kept = joined | np.concatenate([[False], joined[:-1]])
            at = np.flatnonzero(kept)
            ends = ~joined[at]
            line = np.zeros(len(at) + int(ends.sum()), np.uint64)
            line[np.arange(len(at)) + np.cumsum(ends) - ends] = x[at]
            if not len(line):
                continue
            cuts = np.flatnonzero(line == 0) + 1
            cuts = cuts[np.append(np.diff(cuts >> 10) > 0, True)]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.append(0, cuts), pa.int32()), pa.array(line.view(np.int64)))], names=["line"])

    return texts.mapInArrow(task, "line array<long>")


def _extension_counts(stretches: DataFrame, pairs: np.ndarray, triples: np.ndarray, least: int) -> DataFrame:
    """Counts of the phrases that are one word longer than a pair or triple (given by folded hashes, sorted)."""
    sent = stretches.sparkSession.sparkContext.broadcast((pairs, triples))

    def met(x: np.ndarray, width: int, nodes: np.ndarray) -> np.ndarray:
        """Where phrases of ``width + 1`` words begin that begin or end with a node."""
        key = _folded([x[i : len(x) - width + 1 + i] for i in range(width)])
        hit = nodes[np.minimum(np.searchsorted(nodes, key), len(nodes) - 1)] == key
        both = hit[:-1] | hit[1:]
        for i in range(width + 1):
            both &= x[i : len(both) + i] != 0
        return np.flatnonzero(both)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [(width, nodes, _Sums(width + 1)) for width, nodes in zip((2, 3), sent.value, strict=True) if len(nodes)]
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(x), _HELD):
                # a stretch that this cuts apart is read on by three words
                part = x[i : i + _HELD + 3]
                for width, nodes, sums in wanted:
                    if len(part) > width:
                        starts = met(part, width, nodes)
                        if sums.add(part, starts[starts < _HELD]):
                            yield sums.take()
        for _, _, sums in wanted:
            yield sums.take()

    return stretches.mapInArrow(task, _COUNTS).groupBy(*_KEY).agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _score(f: str, parts: str) -> str:
    """floor(2000000 f / parts), in decimals since the product may pass 64 bits."""
    return f"CAST({SCALE} * CAST({f} AS DECIMAL(20, 0)) div ({parts}) AS LONG)"


def _lowest(f: str, cuts: list[tuple[str, str]]) -> Column:
    """(score, k, l, r) of the lowest-scoring cut, of equal ones that with the least k."""
    return F.expr(f"array_min(array({', '.join(f'struct({_score(f, f"{l} + {r}")} AS score, {k} AS k, {l} AS l, {r} AS r)' for k, (l, r) in enumerate(cuts, 1))}))")


def first_of_each(rows: DataFrame, group: str, order: list[Column], limit: int, salt: Column) -> DataFrame:
    """The first ``limit`` rows of each group with their ``rank``: first of each part of a group, then of the parts together."""
    part = Window.partitionBy(group, "_salt").orderBy(*order)
    rows = rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= limit)
    return rows.drop("_salt").withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= limit)


_NODE = ["lang", *_KEY, "f", "score", "l", "r", "bound"]


def _pair_nodes(pairs: DataFrame, words: DataFrame) -> DataFrame:
    one = words.select(F.col("h").alias("a"), F.col("f").alias("fa"), "lang")
    two = words.select(F.col("h").alias("b"), F.col("f").alias("fb"))
    rows = pairs.join(one, "a").join(two, "b").withColumn("cut", _lowest("f", [("fa", "fb")]))
    zero = F.lit(0).cast("long")
    return rows.select("lang", "a", "b", zero.alias("c"), zero.alias("d"), "f", "cut.score", "cut.l", "cut.r", F.expr(_score("f", "fa + f")).alias("bound"), "fa", "fb")


def _triple_nodes(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    head = pairs.select("lang", "a", "b", "fa", F.col("f").alias("fab"))
    tail = pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("fbc"), F.col("fb").alias("fc"))
    rows = counts.join(head, ["a", "b"]).join(tail, ["b", "c"]).withColumn("cut", _lowest("f", [("fa", "fbc"), ("fab", "fc")]))
    bound = f"least({_score('f', 'fa + f')}, {_score('f', 'fab + f')})"
    return rows.select("lang", *_KEY, "f", "cut.score", "cut.l", "cut.r", F.expr(bound).alias("bound"), "fa", "fab", "fbc", "fc")


def _quads(counts: DataFrame, triples: DataFrame) -> DataFrame:
    """Four-word phrases whose first three words are known; ``score`` is null while their last three aren't."""
    head = triples.select("lang", "a", "b", "c", "fa", "fab", F.col("f").alias("fabc"))
    tail = triples.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("c").alias("d"), F.col("f").alias("fbcd"), F.col("fbc").alias("fcd"), F.col("fc").alias("fd"))
    rows = counts.join(head, ["a", "b", "c"]).join(tail, ["b", "c", "d"], "left")
    rows = rows.withColumn("cut", F.when(F.col("fbcd").isNotNull(), _lowest("f", [("fa", "fbcd"), ("fab", "fcd"), ("fabc", "fd")])))
    bound = f"least({_score('f', 'fa + f')}, {_score('f', 'fab + f')}, {_score('f', 'fabc + f')})"
    return rows.select("lang", *_KEY, "f", "cut.score", "cut.l", "cut.r", F.expr(bound).alias("bound"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _survivors(nodes: DataFrame, quads: DataFrame, triples: DataFrame, fours: DataFrame) -> DataFrame:
    """Expanded pairs and triples that no longer candidate drops, and all four-word phrases that have a score."""
    zero = F.lit(0).cast("long").alias("c")
    longer = _all([triples.select("a", "b", zero, "f"), triples.select(F.col("b").alias("a"), F.col("c").alias("b"), zero, "f"), fours.select("a", "b", "c", "f"), fours.select(F.col("b").alias("a"), F.col("c").alias("b"), F.col("d").alias("c"), "f")])
    longer = longer.groupBy("a", "b", "c").agg(F.max("f").alias("longer"))
    stay = nodes.where("expanded").join(longer, ["a", "b", "c"], "left").where("longer IS NULL OR 100 * CAST(longer AS DECIMAL(20, 0)) < 80 * CAST(f AS DECIMAL(20, 0))")
    return stay.select(*_NODE).union(quads.where("score IS NOT NULL").select(*_NODE))


def collocations(docs: DataFrame, limit: int = LIMIT, least: int = LEAST, batch: int = BATCH) -> DataFrame:
    """lang, rank, phrase, a (its count), l, r, n (words of the language) and score of each language's first phrases."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counted = materialize(_word_counts(texts), "phrase-words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words = counted.where(F.col("f") >= least)
    pairs = materialize(_pair_counts(texts, _filter_of(words, ["h"]), least), "phrase-pairs")
    pairs = materialize(_pair_nodes(pairs, words), "phrase-pair-nodes")
    stretches = materialize(_stretches(texts, _filter_of(pairs, ["a", "b"])), "phrase-stretches")
    nothing = docs.sparkSession.createDataFrame([], _COUNTS)
    folders = [new_path(docs.sparkSession, f"phrase-{k}") for k in ("triples", "quads-counted", "done")]
    first = [_triple_nodes(nothing, pairs), nothing, nothing.select("a", "b", "c")]
    triples, quads_counted, done = map(grown, first, folders)
    want = 2 * limit
    while True:
        nodes = _all([pairs.select(*_NODE), triples.select(*_NODE)]).join(done.withColumn("seen", F.lit(True)), ["a", "b", "c"], "left").withColumn("expanded", F.col("seen").isNotNull())
        quads = materialize(_quads(quads_counted, triples), "phrase-quads")
        best = materialize(_survivors(nodes, quads, triples, quads_counted), "phrase-survivors")
        order = [F.col("score").desc()]
        last = first_of_each(best.select("lang", "score", "a"), "lang", order, limit, F.col("a")).where(F.col("rank") == limit).select("lang", F.col("score").alias("settled"))
        last = materialize(last, "phrase-settled")
        asked = quads.where("score IS NULL").join(last, "lang", "left").where("settled IS NULL OR bound >= settled").groupBy(F.col("b").alias("a"), F.col("c").alias("b"), F.lit(0).cast("long").alias("c")).agg(F.max("bound").alias("asked"))
        open_nodes = nodes.where("NOT expanded").join(asked, ["a", "b", "c"], "left").withColumn("bound", F.greatest("bound", F.coalesce("asked", F.lit(0)))).join(last, "lang", "left")
        open_nodes = open_nodes.where("settled IS NULL OR bound >= settled").select("lang", "a", "b", "c", "bound")
        chosen = first_of_each(open_nodes, "lang", [F.col("bound").desc()], want, F.col("b")).orderBy(F.col("bound").desc()).limit(batch)
        chosen = materialize(chosen.select("a", "b", "c"), "phrase-frontier")
        frontier = chosen.toArrow()
        if not frontier.num_rows:
            return _named(best, last, words, totals, limit)
        a, b, c = (frontier.column(k).to_numpy().astype(np.int64).view(np.uint64) for k in range(3))
        send = np.sort(_folded([a[c == 0], b[c == 0]])), np.sort(_folded([a[c != 0], b[c != 0], c[c != 0]]))
        known = triples.select(*_KEY).union(quads_counted.select(*_KEY))
        new = materialize(_extension_counts(stretches, *send, least).join(known, _KEY, "left_anti"), "phrase-new")
        more = [_triple_nodes(new.where("d = 0"), pairs), new.where("d <> 0"), chosen]
        triples, quads_counted, done = map(grown, more, folders)
        want *= 4


def _named(best: DataFrame, last: DataFrame, words: DataFrame, totals: DataFrame, limit: int) -> DataFrame:
    """The survivors that can be among the first, with their words, ranked."""
    rows = best.join(last, "lang", "left").where("settled IS NULL OR score >= settled").select("lang", *_KEY, "f", "l", "r", "score")
    for k in _KEY:
        rows = rows.join(words.select(F.col("h").alias(k), F.col("word").alias(f"word_{k}")), k, "left")
    rows = rows.select("lang", F.concat_ws(" ", *[f"word_{k}" for k in _KEY]).alias("phrase"), F.col("f").alias("a"), "l", "r", "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = first_of_each(rows, "lang", order, limit, F.xxhash64("phrase"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
