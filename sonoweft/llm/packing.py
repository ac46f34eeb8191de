"""Best-two-fit packing of token pieces into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, so the counts of each length say
everything that a packing depends on. The driver packs these counts (at most
``capacity`` numbers, whatever the rows): it finds bins with their multiplicity
instead of single bins. Each piece then takes its place by its rank among the
pieces of its length.

A bin is filled greedily: the longest length left, then the longest that still
fits, and so on. Then its smallest document is taken out again if two unpacked
documents fill the gap it leaves more tightly; that is repeated while it helps.

Defined results: a null text is packed as an empty one (its end id only); ties
in doc_id are ordered by start and digest; repeated rows are packed as often as
they occur; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, tokens

#: Units of a generation of a worker's cache, and bytes of text that it encodes at once: a packing may follow
#: stages whose memory the executor still holds. Neither changes a result.
GENERATION, SLICE = 250_000, 1 << 21
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def cut(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 0, capacity: int = 2048, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document; only documents above the capacity are cut.

    ``ids`` are little-endian unsigned 32-bit integers, null without ``with_ids``.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, step = tokens.encoder(tokenizer, kind, GENERATION), struct.pack("<I", end_id), 4 * capacity
        for some in tokens.slices(batches, 1, SLICE):
            out: list[tuple] = []
            flat, starts = encoder.encode(some.column(1))
            for k, doc_id in enumerate(some.column(0).to_pylist()):
                ids = flat[starts[k] : starts[k + 1]].tobytes() + end
                for i in range(0, len(ids), step):
                    piece = ids[i : i + step]
                    out.append((doc_id, i // step, i // 4, len(piece) // 4, zlib.crc32(piece), piece if with_ids else None))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(task, PIECES)


def _largest_pair(lengths: list[int], left: Counter, room: int, above: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum in (above, room]."""
    best, found, j = above, None, len(lengths) - 1
    for i, a in enumerate(lengths):
        while j >= 0 and lengths[j] > room - a:
            j -= 1
        k = j
        if k < i:
            break
        if k == i and left[a] < 2:
            k = -1
        if k >= i and a + lengths[k] > best:
            best, found = a + lengths[k], (lengths[k], a)
    return found


def pack_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (how many, [(length, times)]), from the number of pieces of each length.

    Each step takes a bin as often as the counts allow, which leaves one of its
    lengths with fewer pieces than the bin holds; so the number of different
    bins depends on the capacity and not on the number of pieces.
    """
    left = Counter({k: int(v) for k, v in counts.items() if v > 0})
    lengths = sorted(left)
    bins = []

    def take(length: int, n: int) -> None:
        left[length] -= n
        if not left[length]:
            lengths.pop(bisect.bisect_left(lengths, length))

    def give(length: int) -> None:
        if not left[length]:
            bisect.insort(lengths, length)
        left[length] += 1

    while lengths:
        held: Counter = Counter()
        gap = capacity
        while (i := bisect.bisect_right(lengths, gap)) > 0:
            length = lengths[i - 1]
            n = min(left[length], gap // length)
            take(length, n)
            held[length] += n
            gap -= n * length
        while gap and len(held) + held.total() > 2 and lengths:
            smallest = min(held)
            pair = _largest_pair(lengths, left, gap + smallest, smallest)
            if pair is None:
                break
            give(smallest)
            held[smallest] -= 1
            held += Counter()
            for length in pair:
                take(length, 1)
                held[length] += 1
            gap += smallest - sum(pair)
        more = min(left[length] // n for length, n in held.items())
        for length, n in held.items():
            if more:
                take(length, more * n)
        bins.append((more + 1, sorted(held.items(), reverse=True)))
    return bins


def places(bins: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset, times) as intervals of ranks.

    The pieces of a length that one kind of bin holds have consecutive ranks;
    of these, ``times`` consecutive ones share a sequence, one after another.
    """
    used: Counter = Counter()
    rows, sequence = [], 0
    for n, held in bins:
        offset = 0
        for length, times in held:
            rows.append((length, used[length], n * times, sequence, offset, times))
            used[length] += n * times
            offset += length * times
        sequence += n
    return rows


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (as from ``cut``).

    The table of places is bounded by the capacity: a bin holds at most
    sqrt(2 * capacity) different lengths.
    """
    spark = pieces.sparkSession
    # dealing by ranges reads its input twice, so the token ids are made before
    ranked = shared.ranked(shared.materialize(pieces, "pieces"), ["length"], ["doc_id", "start", "ids_crc32"], "ranked-pieces", "_rank")
    counts = {r["length"]: r["count"] for r in ranked.groupBy("length").count().collect()}
    table = np.array(places(pack_counts(counts, capacity)) or np.zeros((0, 6)), np.int64)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    send = spark.sparkContext.broadcast(table)
    schema = ", ".join(f"{k} {t}" for k, t in pieces.dtypes) + ", sequence_id long, offset long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = send.value
        keys = rows[:, 0] << 48 | rows[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(zero_copy_only=False), b.column("_rank").to_numpy(zero_copy_only=False)
            at = rows[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            nth = rank - at[:, 1]
            made = [pa.array(at[:, 3] + nth // at[:, 5], pa.int64()), pa.array(at[:, 4] + nth % at[:, 5] * length, pa.int64())]
            names = [n for n in b.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + made, names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(task, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, doc_ids, ids (bytes, in order)."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("_in")).select(
        "sequence_id",
        F.aggregate("_in", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("n_tokens"),
        F.col("_in.doc_id").alias("doc_ids"),
        F.array_join(F.transform("_in.ids", lambda x: F.hex(x)), "").alias("_hex"),
    ).select("sequence_id", "n_tokens", "doc_ids", F.unhex("_hex").alias("ids"))
