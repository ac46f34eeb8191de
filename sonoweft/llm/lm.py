"""Language-model scores by a weighted backoff automaton.

An n-gram is a state; its arcs are the words seen after it, and its failure arc
leads to the n-gram without its first word. With Dirichlet smoothing

    P(w | c) = (count(c w) + k * P(w | suffix of c)) / (count(c) + k)

the arc of a seen n-gram weighs log10 P and a failure arc log10 k / (count(c) + k);
a walk that fails along the suffixes until an arc fits sums up to exactly P, and
P sums to one over all words. Words have P(w) = (c + a) / (N + a * (V + 1)).

Counts come from all training rows. The documents are cut into blocks of a
bounded size, kept as hashed tokens in files of the shared folder. A block sends
its distinct words and 2-grams (hashed to 64 bits) with their training counts to
the partition that owns the hash; that partition adds up and sends the totals
back. Longer n-grams follow, a round for each order, and only those whose first
and last words but one occur in other blocks too: all others occur in their own
block alone, so their totals are known there. So a block has just the part of the
automaton that its own documents can reach, all of it, and no task holds the
whole model. Each n-gram leaves a block once, however frequent it is. Hashes of
different words are equal with a chance of about V * V / 2^65.

A block makes one message a round for each partition that owns any of its
n-grams. Partitions and blocks both grow with the data, so the messages of a
block grow and get shorter, up to one n-gram each: their number never exceeds
that of the n-grams that are sent.

Defined results: a null or empty text has one token, the end; a row with a null
doc_id trains and is not held out; repeated rows count as often as they occur;
an empty table gives no rows; without training rows every word has the
probability 1 (a / a). Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, new_path
from .tokens import rows_of

#: Hashes that stand for the start and the end of a text.
START, END = np.uint64(1), np.uint64(2)
BLOCKS = "block string, path string, offset long, length long, n_keys long, n_tokens long"
SENT = "part int, block string, first long, keys binary, counts binary"
REPLY = "block string, part int, first long, totals binary, known long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed; small ones and small steps become short."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def _sums(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64)


def _mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = context * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


class Grams:
    """A block's distinct n-grams of each order, sorted by hash, and where they occur.

    ``at[k]`` has the place in ``keys[k]`` of the (k + 1)-gram that ends at each
    token, -1 where the text has begun too late for it. Each text is preceded by
    a start token, which is itself a 1-gram but no word.
    """

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, order: int):
        self.first = np.cumsum(sizes + 1) - (sizes + 1)
        line = np.empty(len(tokens) + len(sizes), np.uint64)
        inside = np.ones(len(line), bool)
        inside[self.first] = False
        line[self.first], line[inside] = START, tokens
        self.is_token = inside
        self.depth = np.arange(len(line)) - np.repeat(self.first, sizes + 1)
        self.keys, self.at = [], []
        h = line
        for k in range(order):
            if k:
                h = np.concatenate([np.zeros(1, np.uint64), _mix(h[:-1], line[1:])])
            known = self.depth >= k
            keys, at = np.unique(h[known], return_inverse=True)
            place = np.full(len(line), -1, np.int64)
            place[known] = at
            self.keys.append(keys)
            self.at.append(place)

    def counts(self, weight: np.ndarray) -> list[np.ndarray]:
        """How often each n-gram occurs in the texts with weight 1."""
        w = np.repeat(weight, np.diff(np.append(self.first, len(self.is_token))))
        return [np.bincount(a[a >= 0], w[a >= 0], len(k)).astype(np.int64) for k, a in zip(self.keys, self.at, strict=True)]


class Automaton:
    """The states and arcs that a block needs; ``totals`` are those of its n-grams in all training rows."""

    def __init__(self, grams: Grams, totals: list[np.ndarray], n: int, v: int, add: float, strength: float):
        self.keys, self.totals = grams.keys, totals
        self.arc: list[np.ndarray] = []  # log10 P of an n-gram's last word
        self.fail: list[np.ndarray] = []  # log10 weight of its failure arc
        self.suffix: list[np.ndarray] = []
        p = (totals[0] + add) / (n + add * (v + 1))
        for k, (keys, total) in enumerate(zip(self.keys, totals, strict=True)):
            if k:
                at = grams.at[k]
                where = np.flatnonzero(at >= 0)
                one = np.empty(len(keys), np.int64)
                one[at[where]] = where  # a place where each n-gram occurs
                before, suffix = grams.at[k - 1][one - 1], grams.at[k - 1][one]
                p = (total + strength * p[suffix]) / (totals[k - 1][before] + strength)
            else:
                suffix = np.zeros(len(keys), np.int64)
            self.suffix.append(suffix)
            self.arc.append(np.log10(p))
            self.fail.append(np.log10(strength / (total + strength)))

    def walk(self, tokens: np.ndarray, sizes: np.ndarray, piece: int = 512) -> np.ndarray:
        """log10 probabilities: one pass from left to right over all texts side by side.

        A long text is walked in pieces. A later piece begins as many tokens
        early as a state can hold, which brings it into the state of that place.
        """
        top = len(self.keys) - 1
        many = -(-sizes // piece)
        text = np.repeat(np.arange(len(sizes)), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        early = np.where(nth > 0, top, 0)
        first = np.repeat(np.cumsum(sizes) - sizes, many) + nth * piece - early
        length = np.minimum(piece, sizes[text] - nth * piece) + early
        order = np.argsort(-length, kind="stable")
        first, length, later = first[order], length[order], early[order] > 0
        score, state, level = np.zeros(len(first)), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        state[~later], level[~later] = np.searchsorted(self.keys[0], START), min(1, top)  # each text starts in the state of its start
        active = len(first) - np.searchsorted(length[::-1], np.arange(1, int(length.max(initial=0)) + 1))
        for t, n in enumerate(active):
            if t == top:
                score[later] = 0
            word = tokens[first[:n] + t]
            left = np.arange(n)
            for m in range(min(top, t + 1), 0, -1):
                here, left = left[level[left] == m], left[level[left] < m]
                key = _mix(self.keys[m - 1][state[here]], word[here])
                j = np.minimum(np.searchsorted(self.keys[m], key), len(self.keys[m]) - 1)
                hit = (self.keys[m][j] == key) & (self.totals[m][j] > 0)
                miss = here[~hit]
                score[miss] += self.fail[m - 1][state[miss]]
                state[miss] = self.suffix[m - 1][state[miss]]
                level[miss] = m - 1
                here, j = here[hit], j[hit]
                score[here] += self.arc[m][j]
                state[here] = self.suffix[m][j] if m == top else j
                level[here] = min(m + 1, top)
                left = np.concatenate([left, miss])
            j = np.searchsorted(self.keys[0], word[left])
            score[left] += self.arc[0][j]
            state[left], level[left] = j, min(1, top)
        return np.bincount(text[order], score, len(sizes))


def _frame(arrays: list[np.ndarray]) -> bytes:
    parts = [_packed(x) for x in arrays]
    return np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def _unframed(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.append(0, np.frombuffer(data, "<i8", n, 8)))
    return [_unpacked(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


def blocks(docs: DataFrame, held: Column, folder: str, size: int = 1 << 24) -> DataFrame:
    """Writes documents as hashed tokens below ``folder``, in blocks of about ``size`` characters of text; returns where each block is.

    Only blocks that the returned table names count: a task that is repeated writes under a new name.
    """

    def block(rows: list[tuple]) -> tuple[bytes, int, int]:
        cut = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for _, _, t in rows]
        words = list(set().union(*cut))
        hashes = np.fromiter((max(h, 3) for h in map(xxhash.xxh64_intdigest, words)), np.uint64, len(words))
        keys = np.append(END, np.sort(hashes))
        ids = dict(zip(words, np.searchsorted(keys, hashes).tolist(), strict=True))
        sizes = np.array([len(c) + 1 for c in cut], np.int64)
        tokens = np.zeros(int(sizes.sum()), np.int64)
        inside = np.ones(len(tokens), bool)
        inside[np.cumsum(sizes) - 1] = False
        tokens[inside] = np.fromiter(map(ids.__getitem__, chain.from_iterable(cut)), np.int64, len(tokens) - len(cut))
        known = np.array([d is not None for d, _, _ in rows], np.int64)
        doc_ids = np.array([d or 0 for d, _, _ in rows], np.int64)
        held_out = np.array([bool(h) for _, h, _ in rows], np.int64)
        return _frame([doc_ids, known, held_out, sizes, _steps(keys), tokens]), len(keys) + len(tokens), int(sizes[held_out == 0].sum())

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        rows, n = [], 0
        for row in rows_of(batches):
            rows.append(row)
            n += len(row[2] or "")
            if n >= size:
                yield rows
                rows, n = [], 0
        if rows:
            yield rows

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, path, at, done = None, uuid.uuid4().hex, 0, []
        for rows in cuts(batches):
            if stream is None:
                files, top = pafs.FileSystem.from_uri(folder)
                files.create_dir(top, recursive=True)
                stream = files.open_output_stream(f"{top}/{path}", compression=None)
            data, n_keys, n_tokens = block(rows)
            stream.write(data)
            done.append((uuid.uuid4().hex, path, at, len(data), n_keys, n_tokens))
            at += len(data)
        if stream is not None:
            stream.close()
        yield _batch(BLOCKS, done)

    return docs.select("doc_id", held.alias("held"), "text").mapInArrow(task, BLOCKS)


class Block:
    """A block that is opened: its documents, tokens and n-grams, and the training counts of these."""

    def __init__(self, folder: str, path: str, offset: int, length: int, order: int):
        files, top = pafs.FileSystem.from_uri(folder)
        with files.open_input_file(f"{top}/{path}") as file:
            doc_ids, known, held, sizes, keys, tokens = _unframed(file.read_at(length, offset))
        self.doc_ids, self.known, self.trains = doc_ids.view(np.int64), known == 1, held == 0
        self.sizes = sizes.astype(np.int64)
        self.tokens = _sums(keys)[tokens.astype(np.int64)]
        self.grams = Grams(self.tokens, self.sizes, order)
        self.own = self.grams.counts(self.trains)

    def shared(self, k: int, totals: list[np.ndarray]) -> np.ndarray:
        """Which n-grams of level k >= 2 other blocks may have: those whose two parts they have."""
        elsewhere = totals[k - 1] > self.own[k - 1]
        where = np.flatnonzero(self.grams.at[k] >= 0)
        one = np.empty(len(self.grams.keys[k]), np.int64)
        one[self.grams.at[k][where]] = where
        return elsewhere[self.grams.at[k - 1][one - 1]] & elsewhere[self.grams.at[k - 1][one]]

    def messages(self, levels: list[tuple[np.ndarray, np.ndarray]], parts: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(part, keys of the first level, keys, counts) for each partition that owns any of the (keys, counts)."""
        at = [_parts(keys, parts) for keys, _ in levels]
        for p in range(parts):
            some = [(keys[a[p] : a[p + 1]], counts[a[p] : a[p + 1]]) for a, (keys, counts) in zip(at, levels, strict=True)]
            if any(len(keys) for keys, _ in some):
                yield p, len(some[0][0]), _packed(np.concatenate([_steps(keys) for keys, _ in some])), _packed(np.concatenate([counts for _, counts in some]))

    def totals(self, rounds: list[list[dict]]) -> list[np.ndarray]:
        """The totals of every level from the replies of each round."""
        out: list[np.ndarray] = []
        for k, replies in enumerate(rounds):
            got = [(r["first"], _unpacked(r["totals"]).astype(np.int64)) for r in sorted(replies, key=lambda r: r["part"])]
            first = np.concatenate([x[:n] for n, x in got] or [np.zeros(0, np.int64)])
            if k == 0:
                out += [first, np.concatenate([x[n:] for n, x in got])][: len(self.grams.keys)]
            else:
                level = self.own[len(out)].copy()
                level[self.shared(len(out), out)] = first
                out.append(level)
        return out


def _parts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each partition's slice of sorted hashes begins and ends."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))


def _add_up(group: pa.Table) -> pa.Table:
    """The replies of one partition: the totals of each message's n-grams, and how many words are known."""
    rows = group.to_pylist()
    found, word = [], []
    for r in rows:
        steps = _unpacked(r["keys"])
        found += [_sums(steps[: r["first"]]), _sums(steps[r["first"] :])]
        word.append(np.arange(len(steps)) < r["first"])
    keys, at = np.unique(np.concatenate(found), return_inverse=True)
    del found
    totals = np.bincount(at, np.concatenate([_unpacked(r["counts"]) for r in rows])).astype(np.int64)
    is_word = np.zeros(len(keys), bool)
    is_word[at[np.concatenate(word)]] = True
    known = int((is_word & (totals > 0) & (keys != START)).sum())
    out, begin = [], 0
    for r, mine in zip(rows, word, strict=True):
        out.append((r["block"], r["part"], r["first"], _packed(totals[at[begin : begin + len(mine)]]), known))
        begin, known = begin + len(mine), 0
    return pa.Table.from_batches([_batch(REPLY, out)])


def score(docs: DataFrame, held: Column, order: int = 3, add: float = 0.1, strength: float = 4.0, block_size: int = 1 << 23) -> DataFrame:
    """Scores every text; rows where ``held`` is true do not train."""
    spark = docs.sparkSession
    held, folder = F.coalesce(held, F.lit(False)), new_path(spark, "lm-tokens")
    table = materialize(blocks(docs, held, folder, block_size), "lm-blocks")
    keys, n = table.agg(F.coalesce(F.sum("n_keys"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffles, keys // 2_000_000)
    opened = lambda row, k: Block(folder, row["path"], row["offset"], row["length"], k)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chain.from_iterable(b.to_pylist() for b in batches):
            block = opened(row, min(order, 2))
            yield _batch(SENT, [(p, row["block"], *rest) for p, *rest in block.messages(list(zip(block.grams.keys, block.own, strict=True)), parts)])

    def longer(k: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
        def send(_, block: pa.Table, replies: pa.Table) -> pa.Table:
            row = block.to_pylist()[0]
            block = opened(row, k + 1)
            some = block.shared(k, block.totals(_by_round(replies, k - 1)))
            sent = block.messages([(block.grams.keys[k][some], block.own[k][some])], parts)
            return pa.Table.from_batches([_batch(SENT, [(p, row["block"], *rest) for p, *rest in sent])])

        return send

    tasks = table.repartition(max(1, shuffles), "block")
    replies = materialize(tasks.mapInArrow(send, SENT).groupBy("part").applyInArrow(_add_up, REPLY), "lm-totals")
    v = replies.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    replies = replies.withColumn("round", F.lit(0))
    for k in range(2, order):
        sent = table.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(longer(k), SENT)
        back = materialize(sent.groupBy("part").applyInArrow(_add_up, REPLY), "lm-totals")
        replies = replies.union(back.withColumn("round", F.lit(k - 1)))

    def walk(_, block: pa.Table, replies: pa.Table) -> pa.Table:
        block = opened(block.to_pylist()[0], order)
        found = block.totals(_by_round(replies, max(1, order - 1)))
        states = Automaton(block.grams, found, n, v, add, strength)
        of_token = np.searchsorted(block.grams.keys[0], block.tokens)
        starts = np.cumsum(block.sizes) - block.sizes
        columns = [
            pa.array(block.doc_ids, pa.int64(), mask=~block.known),
            pa.array(~block.trains),
            pa.array(block.sizes, pa.int64()),
            pa.array(np.add.reduceat((found[0][of_token] > 0).astype(np.int64), starts), pa.int64()),
            pa.array(np.full(len(starts), n), pa.int64()),
            pa.array(np.add.reduceat(states.arc[0][of_token], starts), pa.float64()),
            pa.array(states.walk(block.tokens, block.sizes), pa.float64()),
        ]
        return pa.table(columns, names=[f.split()[0] for f in SCORED.split(", ")])

    return table.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(walk, SCORED)


def _by_round(replies: pa.Table, rounds: int) -> list[list[dict]]:
    """The replies of each round; one in which a block had nothing to ask has none."""
    rows = replies.to_pylist()
    return [[r for r in rows if r["round"] == k] for k in range(rounds)]
