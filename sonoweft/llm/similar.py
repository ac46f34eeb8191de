"""Near-duplicates by the Jaccard similarity of word shingles.

Two texts are linked if their sets of five-word shingles (XXH64 digests, lower
case) have a similarity of at least 0.8. Every link is checked on the whole
sets.

The first candidates are those of covering SimHash: texts whose fingerprints (of
the same shingles) differ in at most ``RADIUS`` bits, as ``simhash.links`` finds
them in its tables of covering masks, all of them. Two texts at 0.8 differ in
about 10 of 64 bits, so similar texts with farther fingerprints are found by
MinHash: further candidates share the least shingle under each of ``ROWS``
orders, in one of ``BANDS`` such tables: a pair at similarity s meets with
1 - (1 - s^5)^32, which is 1 - 3e-6 at 0.8.

Before texts are compared, their parities are: a bit of ``PARITY`` is set where
an odd number of a text's shingles fall. Each shingle that only one of two texts
has changes one bit, so they differ in at least as many shingles as bits; and
texts at 0.8 differ in at most a ninth of all their shingles. So no similar pair
is dropped, and few others are left.

Equal texts are one class from the start. In each table the members of a key
are compared with the least of them. Of keys whose members aren't all in one
component after that, all pairs of different components are compared where a key
has at most ``ALL_PAIRS`` members. The members of larger keys go through an exact
join instead, which finds every similar pair among them:

- the shingles of a text are put in one order for all texts, rare ones first, by
  counts in ``CELLS`` cells (any such order is right; this one makes few pairs);
- where the first common shingle of two texts has i shingles before it in one and
  j in the other, they have at most min(n - i, m - j) in common, and a similarity
  of 0.8 needs 4/9 (n + m). So it is in the first ninth of the smaller text and
  in the first fifth of the larger, and only such pairs that meet this bound and
  are allowed by their parities are compared;
- a shingle whose texts are all in one component joins nothing, and a frequent
  one is dealt over several tasks.

So ``ALL_PAIRS`` decides what a pair costs, never whether it is found.

Defined results: a text without words is linked to the others without words, one
of fewer than five words to those with the same words; rows with a null doc_id
take part; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import connected_components
from .shared import materialize
from .tokens import chunks, rows_of

WIDTH, SEED, RADIUS = 5, 42, 2
BANDS, ROWS, ALL_PAIRS = 32, 5, 16
#: Bits of the parities of a text, kept in so many longs.
PARITY = 512
_WORDS = [f"p{i}" for i in range(PARITY // 64)]
#: Cells in which shingles are counted, and rows of a shingle that one task joins.
CELLS, JOINED = 1 << 20, 2048
#: Shingles that a task keeps between pairs.
HELD = 4_000_000
_ORDERS = np.random.default_rng(5).integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Stands for a doc_id of null where one is compared.
_NO_ID = -(2**63)


def _distinct(digests: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(digests or bytes(8), ">u8").astype("<u8"))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes; a text without words has one of its own kind."""
    return _distinct(simhash.shingle_digests(text, WIDTH, SEED))


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    """The key of each set in each table."""
    line = np.concatenate(sets)
    first = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), BANDS), np.uint64)
    for band, orders in enumerate(_ORDERS):
        key = np.full(len(sets), band + 1, np.uint64)
        for order in orders:
            key = (key ^ np.minimum.reduceat(line * order, first)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out.view(np.int64)


def _parities(sets: list[np.ndarray]) -> np.ndarray:
    """The parities of each set: in each bit whether an odd number of its hashes fall there."""
    cell = np.concatenate(sets) >> np.uint64(64 - PARITY.bit_length() + 1)
    of = np.repeat(np.arange(len(sets)) * PARITY, [len(s) for s in sets])
    odd = np.bincount(of + cell.astype(np.int64), minlength=len(sets) * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").reshape(len(sets), -1)


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, the number of shingles, the fingerprint, the keys and the parities of each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(rows_of(batches), 1):
            digests = [simhash.shingle_digests(r[1], WIDTH, SEED) for r in chunk]
            sets = [_distinct(d) for d in digests]
            columns = [pa.array([r[0] for r in chunk], pa.int64()), pa.array([r[2] for r in chunk], pa.int64()), pa.array([len(s) for s in sets], pa.int32())]
            columns += [pa.array(simhash.fingerprints_of(digests)[:, 0], pa.int64()), pa.array(list(_keys(sets)), pa.list_(pa.int64()))]
            columns += [pa.array(c, pa.int64()) for c in _parities(sets).T.copy()]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n", "fp", "keys", *_WORDS])

    kinds = ", ".join(f"{c} long" for c in _WORDS)
    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(task, f"doc_id long, text_hash long, n int, fp long, keys array<long>, {kinds}")


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _parities_allow(n: str, n2: str, second: str) -> str:
    """Whether texts of n and n2 shingles can be similar by their parities (the columns ``_WORDS``, and those with ``second`` at the end)."""
    return f"9L * ({' + '.join(f'bit_count({c} ^ {c}{second})' for c in _WORDS)}) <= {n} + {n2}"


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose texts are similar: those that parities allow are compared."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def of(name: int, text: str | None) -> np.ndarray:
            if name not in held:
                held[name] = shingles(text)
            return held[name]

        for chunk in chunks(rows_of(batches), 2):
            found = [(a, b) for a, b, of_a, of_b in chunk if _similar(of(a, of_a), of(b, of_b))]
            if sum(map(len, held.values())) > HELD:
                held.clear()
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    sketch = lambda c, end: texts.select(F.col("t").alias(c), F.col("n").alias(f"n_{c}"), *[F.col(p).alias(p + end) for p in _WORDS])
    pairs = pairs.join(sketch("a", ""), "a").join(sketch("b", "_b"), "b").where(_parities_allow("n_a", "n_b", "_b")).select("a", "b")
    pairs = materialize(pairs, "similar-allowed")
    of = lambda c: texts.select(F.col("t").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(task, "a long, b long")


def _texts(docs: DataFrame, first: DataFrame) -> DataFrame:
    """t, text, n and parities of the classes in ``first`` (t, first and these): the text is from one row of each."""
    named = docs.select(F.xxhash64("text").alias("t"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("first"), "text")
    return named.join(first, ["t", "first"]).select("t", "text", "n", *_WORDS).dropDuplicates(["t"])


def _covering_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that connect just those whose fingerprints differ in at most ``RADIUS`` bits."""
    heads = materialize(classes.groupBy("fp").agg(F.min("t").alias("head")), "similar-heads")
    same = classes.select("fp", "t").join(heads, "fp").where("t <> head").select("t", F.col("head").alias("b"))
    near = simhash.links(heads.select("fp"), RADIUS).distinct()
    near = near.join(heads, "fp").select("least", F.col("head").alias("t")).join(heads.select(F.col("fp").alias("least"), F.col("head").alias("b")), "least").select("t", "b")
    return same.union(near).select(F.greatest("t", "b").alias("a"), F.least("t", "b").alias("b")).distinct()


_SIZES = "5 * least({0}, {1}) >= 4 * greatest({0}, {1})"


def _rarity(texts: DataFrame) -> np.ndarray:
    """How many texts have a shingle of each cell; the driver gets at most ``CELLS`` counts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(CELLS, np.int64)
        for chunk in chunks(rows_of(batches), 0):
            line = np.concatenate([shingles(text) for (text,) in chunk])
            count += np.bincount((line % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["cell", "n"])

    counts = texts.select("text").mapInArrow(task, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    return out


def _prefixes(texts: DataFrame) -> DataFrame:
    """shingle, t, n, place: the rarest fifth of the shingles of each text, with how many are rarer."""
    send = texts.sparkSession.sparkContext.broadcast(_rarity(texts))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(rows_of(batches), 1):
            made = []
            for t, text in chunk:
                every = shingles(text)
                n = len(every)
                first = every[np.lexsort((every, send.value[(every % np.uint64(CELLS)).astype(np.int64)]))][: n // 5 + 1]
                made.append((first.view(np.int64), np.full(len(first), t), np.full(len(first), n, np.int32), np.arange(len(first), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], names=["shingle", "t", "n", "place"])

    return texts.select("t", "text").mapInArrow(task, "shingle long, t long, n int, place int")


def _prefix_pairs(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that can be similar; no pair that is similar is missing."""
    rows = _prefixes(texts).join(parts, F.col("t") == F.col("node"), "left").select("shingle", "t", "n", "place", F.coalesce("root", "t").alias("root"))
    rows = materialize(rows, "similar-prefixes")
    state = rows.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("many")).where("low <> high")
    rows = rows.join(state.select("shingle", F.expr(f"1 + many div {JOINED}").alias("lots")), "shingle").join(texts.select("t", *_WORDS), "t")
    rows = materialize(rows, "similar-open")
    small = rows.where("9L * place <= n").withColumn("lot", F.pmod(F.xxhash64("t"), F.col("lots")))
    large = rows.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1))).select("shingle", "lot", F.col("t").alias("t2"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("root").alias("root2"), *[F.col(p).alias(p + "_2") for p in _WORDS])
    met = small.join(large, ["shingle", "lot"]).where("root <> root2 AND (n < n2 OR (n = n2 AND t < t2)) AND 9L * least(n - place, n2 - place2) >= 4L * (n + n2) AND " + _parities_allow("n", "n2", "_2"))
    return met.select(F.greatest("t", "t2").alias("a"), F.least("t", "t2").alias("b")).distinct()


def _open_pairs(keys: DataFrame, parts: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a key and are in different components."""
    members = keys.join(parts, keys.t == parts.node, "left").select("key", "t", "n", F.coalesce("root", "t").alias("root"))
    members = materialize(members, "similar-members")
    state = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("many")).where("low <> high")
    members = materialize(members.join(state.select("key", "many"), "key"), "similar-open")
    few = members.where(f"many <= {ALL_PAIRS}")
    other = few.select("key", F.col("t").alias("t2"), F.col("n").alias("n2"), F.col("root").alias("root2"))
    met = few.join(other, "key").where("root <> root2 AND t > t2 AND " + _SIZES.format("n", "n2")).select(F.col("t").alias("a"), F.col("t2").alias("b"))
    most = members.where(f"many > {ALL_PAIRS}").select("t").distinct()
    if not most.isEmpty():
        met = met.union(_prefix_pairs(materialize(texts.join(most, "t", "left_semi"), "similar-most"), parts))
    return met.distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable over links), root and text_hash for every row."""
    rows = materialize(_sketches(docs), "similar-rows")
    classes = rows.groupBy(F.col("text_hash").alias("t")).agg(F.min("doc_id").alias("first"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("keys").alias("keys"), *[F.min(p).alias(p) for p in _WORDS])
    classes = materialize(classes, "similar-classes")
    covering = materialize(_covering_pairs(classes), "similar-covering")
    keys = classes.select("t", "n", F.explode("keys").alias("key"))
    met = keys.groupBy("key").agg(F.min(F.struct("t", "n")).alias("hub"), F.count("*").alias("many")).where("many > 1")
    met = materialize(met.select("key", F.col("hub.t").alias("b"), F.col("hub.n").alias("hub_n"), "many"), "similar-keys")
    met_keys = materialize(keys.join(met, "key").select("key", "t", "n", "b", "hub_n", "many"), "similar-met")
    pairs = materialize(met_keys.where("t <> b AND " + _SIZES.format("n", "hub_n")).select(F.col("t").alias("a"), "b").distinct(), "similar-pairs")
    keys = met_keys.where("many > 2").select("key", "t", "n")
    tried = covering.union(pairs.join(covering, ["a", "b"], "left_anti"))
    candidates = met_keys.where("many > 2").select("t").union(tried.select("a")).union(tried.select("b")).distinct()
    first = candidates.join(classes, "t").select("t", F.coalesce("first", F.lit(_NO_ID)).alias("first"), "n", *_WORDS)
    texts = materialize(_texts(docs, first), "similar-texts")
    links = materialize(_checked(tried, texts), "similar-links")
    parts = connected_components(links, "similar-components")
    more = materialize(_open_pairs(keys, parts, texts).join(tried, ["a", "b"], "left_anti"), "similar-pairs")
    links = links.union(materialize(_checked(more, texts), "similar-links"))
    parts = connected_components(links, "similar-components")
    named = classes.select("t", "first").join(parts, classes.t == parts.node, "left").select("t", "first", F.coalesce("root", "t").alias("root"))
    named = materialize(named, "similar-roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(named.join(least, "root").select(F.col("t").alias("text_hash"), "root", "component_id"), "similar-named")
    return rows.select("doc_id", "text_hash").join(named, "text_hash").select("doc_id", "component_id", "root", "text_hash")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the least doc_id, with all its columns."""
    return simhash.keep_one(docs, near_duplicates(docs))
