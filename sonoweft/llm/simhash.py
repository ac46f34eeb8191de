"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has one bit for each of 64 positions: 1 if more than half of the
shingle hashes have it. For radius r, each bit position i gets a nonzero vector
m(i) of r + 1 bits, and each nonzero vector v of r + 1 bits makes a table whose
key keeps the positions with an odd <v, m(i)>. At most r differing positions
span at most r dimensions, so some v is orthogonal to all of them and the key
of that table is equal: no pair within the radius is missed.

Two fingerprints that share a key are compared. Of more, each is compared with
the least of them; if all are within the radius of it, they are connected. Of
keys where some are not, all fingerprints are candidates: two of them differ in
at most r bits just if some value is within r / 2 bits of both; so each
candidate is joined to the values around it, and those that meet at a value
are linked to the smallest of them. The work is linear in the candidates,
however many share a key, and no pair needs to be listed.

Defined results: a text without words (null, empty or white space) has
fingerprint zero and is linked like any other; repeated rows and equal texts
share a fingerprint and so a component; rows with a null doc_id take part, and
component_id is null only where no doc_id of the component is known. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .shared import fresh, materialize
from .tokens import chunks, rows_of

BITS = 64


#: The bits of each byte value, least significant first.
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_digests(text: str | None, width: int, seed: int) -> bytes:
    """The XXH64 digests (8 bytes, big-endian) of a text's word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    line = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        return digest(line, seed) if words else b""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - width].tolist()]
    return b"".join([digest(line[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)])


def _majority(digests: np.ndarray, place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ones = np.empty((len(sizes), BITS), np.int64)
    for k in range(8):  # byte 0 has the lowest bits
        held = np.bincount(place + digests[:, k], minlength=len(sizes) << 8).reshape(-1, 256)
        ones[:, 8 * k : 8 * k + 8] = held @ _BITS_OF_BYTE
    return np.packbits(ones * 2 > sizes[:, None], axis=1, bitorder="little").view("<i8").reshape(-1)


def fingerprints_of(digests: list[bytes], replicas: int = 1) -> np.ndarray:
    """A row of fingerprints for the shingle digests of each text; all but the first are of remixed hashes."""
    sizes = np.array([len(d) // 8 for d in digests], np.int64)
    place = np.repeat(np.arange(len(digests)) << 8, sizes)
    hashes = np.frombuffer(b"".join(digests), ">u8").astype("<u8")
    out = np.empty((len(digests), replicas), np.int64)
    for k in range(replicas):
        out[:, k] = _majority(hashes.view(np.uint8).reshape(-1, 8), place, sizes)
        hashes = (hashes ^ hashes >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(29)
    return out


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, replicas: int = 1) -> DataFrame:
    """doc_id, the 64-bit fingerprint ``fp`` (signed long) of each whole text, its ``others``, and ``text_hash``."""
    others = pa.list_(pa.int64())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(rows_of(batches), 1):
            fp = fingerprints_of([shingle_digests(r[1], width, seed) for r in chunk], replicas)
            columns = [pa.array([r[0] for r in chunk], pa.int64()), pa.array(fp[:, 0], pa.int64()), pa.array(list(fp[:, 1:]), others), pa.array([r[2] for r in chunk], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "others", "text_hash"])

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(task, "doc_id long, fp long, others array<long>, text_hash long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The bits that each table keeps, as signed 64-bit integers."""
    vectors = range(1, 1 << radius + 1)
    m = [1 + i % len(vectors) for i in range(bits)]
    masks = (sum((v & m[i]).bit_count() % 2 << i for i in range(bits)) for v in vectors)
    return [x - (x >> bits - 1 << bits) for x in masks]


def _around(fp: Column, flips: int) -> Column:
    """All values within ``flips`` bits of a fingerprint."""
    values = [sum(1 << i for i in at) for n in range(flips + 1) for at in combinations(range(BITS), n)]
    signed = [x - (x >> BITS - 1 << BITS) for x in values]
    return F.transform(F.array(*map(F.lit, signed)), lambda x: fp.bitwiseXOR(x))


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """(fp, least): links that connect just the fingerprints within the radius."""
    if radius not in (2, 4):
        raise ValueError("the radius must be 2 or 4 (an even number, so that the values between are exact)")
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(covering_masks(radius))])
    keys = distinct.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    met = keys.groupBy("t", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    met = materialize(met, "simhash-keys")
    pairs = met.where(f"n = 2 AND bit_count(a ^ b) <= {radius}").select(F.col("b").alias("fp"), F.col("a").alias("least"))
    # of larger ones, those whose members are all near the least are connected by that; the others are open
    members = keys.join(met.where("n > 2").select("t", "key", "a"), ["t", "key"]).withColumn("near", F.expr(f"bit_count(fp ^ a) <= {radius}"))
    members = materialize(members, "simhash-members")
    to_least = members.where("near AND fp > a").select("fp", F.col("a").alias("least")).distinct()
    still_open = members.where("NOT near").select("t", "key").distinct()
    candidates = members.join(still_open, ["t", "key"], "left_semi").select("fp").distinct()
    near = materialize(candidates, "simhash-candidates").select("fp", F.explode(_around(F.col("fp"), radius // 2)).alias("value"))
    shared = near.groupBy("value").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    return pairs.union(to_least).union(near.join(shared, "value").where("fp > least").select("fp", "least"))


def _own(rows: DataFrame, near: DataFrame) -> DataFrame:
    """Links between the fingerprints of one text, as far as another text is linked to them."""
    own = rows.select("fp", F.explode("others").alias("other")).distinct()
    many = own.groupBy("other").agg(F.count("*").alias("n")).where("n > 1").select("other")
    linked = near.select(F.explode(F.array("fp", "least")).alias("other")).union(many).distinct()
    return own.join(linked, "other", "left_semi")


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, seed: int = 42, replicas: int = 1) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links), root and text_hash for every row.

    With replicas, texts are also linked if a further fingerprint, of remixed
    shingle hashes, is within the radius.
    """
    rows = materialize(fingerprints(docs, width, seed, replicas), "simhash-rows")
    values = rows.select("doc_id", F.explode(F.concat(F.array("fp"), "others")).alias("fp")) if replicas > 1 else rows
    distinct = materialize(values.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    near = links(distinct, radius)
    if replicas > 1:
        near = materialize(near, "simhash-near")
        near = near.union(_own(rows, near))
    parts = connected_components(near, "simhash-links")
    parts = materialize(parts.join(distinct, parts.node == distinct.fp).select("fp", "root", "first"), "simhash-parts")
    least = parts.groupBy("root").agg(F.min("first").alias("least"))
    named = parts.join(least, "root").select(F.col("fp").alias("_fp"), "root", "least")
    classes = distinct.join(named, distinct.fp == named._fp, "left")
    classes = classes.select("fp", F.coalesce("least", "first").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    classes = materialize(classes, "simhash-classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id", "root", "text_hash")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, that with the least doc_id, with all its columns.

    Of rows with that doc_id and different texts the one with the least text hash
    stays. Rows without a doc_id can't be named as a component's row and stay.
    """
    return keep_one(docs, near_duplicates(docs, **options))


def keep_one(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``one_of_each`` keeps, by their doc_id, component_id, root and text_hash."""
    rows = rows.where("doc_id = component_id")
    digest, nth = fresh(docs.columns, "_hash"), fresh(docs.columns, "_nth")
    stay = rows.groupBy("doc_id", "root").agg(F.min("text_hash").alias(digest)).select("doc_id", digest)
    stay = materialize(stay.distinct(), "simhash-stay")
    hashed = docs.where("doc_id IS NOT NULL").withColumn(digest, F.xxhash64("text"))
    same = Window.partitionBy("doc_id", digest).orderBy("doc_id")
    once = hashed.join(stay, ["doc_id", digest], "left_semi").withColumn(nth, F.row_number().over(same)).where(F.col(nth) == 1)
    return once.select(docs.columns).union(docs.where("doc_id IS NULL"))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
