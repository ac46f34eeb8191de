"""Ordered sequences of an utterance: numbering, filters, splicing, runs, context, chunks.

Every window is within one utterance, so utterances spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, utt: str, order: list[str], name: str = "t") -> DataFrame:
    """Frame numbers from 0 in each utterance."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(utt).orderBy(*order)) - 1)


def delta_taps(order: int = 2, window: int = 2) -> list[dict[int, float]]:
    """Filter weights by offset for each order; order k is the regression filter applied k times."""
    base = {j: j / (2 * sum(i * i for i in range(1, window + 1))) for j in range(-window, window + 1)}
    taps = [{0: 1.0}]
    for _ in range(order):
        taps.append(reduce(lambda out, ab: out | {ab[0]: out.get(ab[0], 0.0) + ab[1]}, ((i + j, a * b) for i, a in taps[-1].items() for j, b in base.items()), {}))
    return taps


def filtered(x: Column, taps: dict[int, float], utt: str, t: str) -> Column:
    """A weighted sum of neighbouring frames; beyond the ends the end frame is repeated."""
    w = Window.partitionBy(utt).orderBy(t)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    terms = []
    for j, weight in sorted(taps.items()):
        if weight:
            at = x if j == 0 else F.coalesce(F.lead(x, j).over(w), F.last(x).over(whole)) if j > 0 else F.coalesce(F.lag(x, -j).over(w), F.first(x).over(whole))
            terms.append(at * F.lit(weight))
    return reduce(lambda a, b: a + b, terms)


def deltas(frames: DataFrame, utt: str = "utt", t: str = "t", x: str = "x", order: int = 2, window: int = 2) -> DataFrame:
    """Adds delta1 .. delta<order>."""
    taps = delta_taps(order, window)
    return frames.withColumns({f"delta{k}": filtered(F.col(x), taps[k], utt, t) for k in range(1, order + 1)})


def spliced(frames: DataFrame, left: int = 3, right: int = 3, utt: str = "utt", t: str = "t", x: str = "x") -> DataFrame:
    """Adds ``spliced``: the frames from t - left to t + right, ends repeated."""
    return frames.withColumn("spliced", F.array(*[filtered(F.col(x), {j: 1.0}, utt, t) for j in range(-left, right + 1)]))


def runs(frames: DataFrame, label: str, utt: str = "utt", t: str = "t") -> DataFrame:
    """Runs of equal labels: utt, run (from 0), label, start, length."""
    w = Window.partitionBy(utt).orderBy(t)
    begins = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & F.lag(t).over(w).isNotNull(), 0).otherwise(1)
    run = frames.withColumn("_new", begins).withColumn("run", F.sum("_new").over(w) - 1)
    return run.groupBy(utt, "run", label).agg(F.min(t).alias("start"), F.count("*").alias("length"))


def context(frames: DataFrame, label: str, outside: str = "", utt: str = "utt", t: str = "t") -> DataFrame:
    """Adds the labels to the left and right; ``outside`` beyond the ends."""
    w = Window.partitionBy(utt).orderBy(t)
    return frames.withColumn("left", F.lag(label, 1, outside).over(w)).withColumn("right", F.lead(label, 1, outside).over(w))


def best_split(frames: DataFrame, x: str = "x", utt: str = "utt", t: str = "t") -> DataFrame:
    """The boundary with the highest sum of ``x`` before it, the first of equals: utt, split, gain."""
    sums = frames.withColumn("_gain", F.sum(x).over(Window.partitionBy(utt).orderBy(t)))
    best = sums.groupBy(utt).agg(F.max(F.struct(F.round("_gain", 6).alias("gain"), (-F.col(t)).alias("minus"))).alias("_best"))
    return best.select(utt, (1 - F.col("_best.minus")).alias("split"), F.col("_best.gain").alias("gain"))


def shortest(utts: DataFrame, size: str, key: str, n: int) -> DataFrame:
    """The n shortest utterances (ties by key): each task keeps its n, and only these meet."""
    return utts.orderBy(size, key).limit(n)


def greedy_chunks(utts: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """Chunk numbers within each group: a chunk ends before the utterance that would exceed the limit.

    Each cut depends on the one before it, so the rows of a group pass through
    one task in order; of a group only the running chunk is held.
    """
    rows = utts.select(group, order, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n")).repartition(group).sortWithinPartitions(group, order)
    schema = rows.select(group, order).schema.add("chunk", "integer")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, held = object(), 0, 0
        for b in batches:
            chunks = []
            for name, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if name != now:
                    now, chunk, held = name, 0, 0
                elif held > 0 and held + n > limit:
                    chunk, held = chunk + 1, 0
                held += n
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(chunks, pa.int32())], names=[group, order, "chunk"])

    return rows.mapInArrow(fold, schema)
