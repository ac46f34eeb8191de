"""Vector bin packing of documents into shards by bytes, tokens and rows.

Documents with equal texts form a group. Items are placed largest first, each
into the shard whose residual capacity has the highest dot product with the
item's size (both as shares of the totals), among the shards where it fits.

What the driver places is bounded by parameters, not by the rows:

- a group above 1 / ``fine`` of a shard in some dimension is an item of its own
  (at most 3 * shards * fine of these exist);
- a group above ``whole`` shards in some dimension is cut into parts by a hash
  of doc_id, so that no shard has to take a third of all rows (at most
  3 * shards / whole of these exist, each with ``parts`` parts);
- all other groups are gathered into ``bundles`` bundles by a hash of their text.

Defined results: a null text has size 1 and is the same group as an empty one;
a null doc_id is kept and sorts first within its shard; repeated rows count and
are placed as often as they occur; ties keep the lowest shard; an empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, ranked

DIMENSIONS = ["size", "tokens", "one"]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, group (digest of the text), size (bytes and one), tokens (words), one, text_crc32."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        F.md5(text).alias("group"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.lit(1).cast("long").alias("one"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def place(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows of ``sizes``, as shares of the totals)."""
    residual = np.full((shards, sizes.shape[1]), 1.0 / shards)
    chosen = np.zeros(len(sizes), np.int64)
    for i in np.lexsort((np.arange(len(sizes)), -sizes.sum(1), -sizes.max(1))):
        item = sizes[i]
        fits = (residual >= item).all(1)
        score = residual @ item
        # where it fits nowhere, the shard that ends least full takes it
        best = np.where(fits, score, -np.inf).argmax() if fits.any() else (residual - item).min(1).argmax()
        residual[best] -= item
        chosen[i] = best
    return chosen


def _sums() -> list[Column]:
    return [F.sum(d).alias(d) for d in DIMENSIONS]


def shard(docs: DataFrame, shards: int = 16, fine: int = 64, whole: float = 0.5, bundles: int = 4096, parts: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    rows = materialize(measured(docs), "shard-rows")
    groups = materialize(rows.groupBy("group").agg(*_sums()), "shard-groups")
    total = groups.agg(*_sums()).first()
    total = np.array([total[d] or 0 for d in DIMENSIONS], float)
    above = lambda share: F.greatest(*[F.col(d) / F.lit(max(t, 1.0)) for d, t in zip(DIMENSIONS, total, strict=True)]) > share / shards

    large = [(r["group"],) for r in groups.where(above(whole)).select("group").collect()]
    cut = F.broadcast(spark.createDataFrame(large, "group string"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    parted = rows.join(cut, "group", "left_semi").groupBy("group", part.alias("part")).agg(*_sums()) if large else None
    medium = groups.where(above(1 / fine) & ~above(whole)).withColumn("part", F.lit(0))
    bundle = F.pmod(F.hash("group"), F.lit(bundles)).cast("int")
    small = groups.where(~above(1 / fine)).groupBy(bundle.alias("part")).agg(*_sums()).withColumn("group", F.lit(None).cast("string"))
    columns = ["group", "part", *DIMENSIONS]
    items = medium.select(columns).unionByName(small.select(columns))
    items = (items.unionByName(parted.select(columns)) if parted is not None else items).collect()

    items.sort(key=lambda r: (r["group"] or "", r["part"]))
    sizes = np.array([[r[d] for d in DIMENSIONS] for r in items], float).reshape(-1, 3) / np.maximum(total, 1)
    named = [(r["group"], r["part"], int(s)) for r, s in zip(items, place(sizes, shards), strict=True)]
    of_bundle = [0] * bundles
    for group, k, s in named:
        if group is None:
            of_bundle[k] = s
    alone = F.broadcast(spark.createDataFrame([x for x in named if x[0] is not None], "group string, _part int, _shard int"))
    is_large = F.broadcast(spark.createDataFrame([(*g, True) for g in large], "group string, _large boolean"))
    rows = rows.join(is_large, "group", "left").withColumn("_part", F.when(F.col("_large"), part).otherwise(0))
    rows = rows.join(alone, ["group", "_part"], "left")
    lookup = F.element_at(F.array(*map(F.lit, of_bundle)), bundle + 1)
    rows = rows.select("doc_id", "size", "text_crc32", F.coalesce("_shard", lookup).alias("shard"))
    return ranked(rows, ["shard"], ["doc_id", "text_crc32"], "shard-slots", "slot")
