"""Exact copies by distributed MSD radix partitioning of the texts' bytes.

All rows begin in one group. A round splits each group by the next block of
bytes: rows with equal (group, block, whether the text ends in it) form the next
groups. A group of one row is finished, and so is a group whose texts all end;
the others go on with what is left of their texts and a block ``GROWTH`` times as
long. So the number of rounds grows with the logarithm of the longest text that
has a copy, and equality is that of the bytes themselves; no digest is compared.

Only texts of unfinished groups are carried into the next round. The groups of a
round are counted before any shuffle of rows (partial sums of a count and a
maximum), and only groups of two rows or more are joined back; both sides of that
join are shuffled whatever their size, so a group with a third of all rows is split
by Spark's skew join.

Defined results: a null text counts as empty; a row with a null doc_id takes part,
and keep_id is null only where a group has no doc_id; of rows that share the
largest doc_id of a group exactly one is kept; repeated rows count each; an empty
table gives no rows. Columns beyond doc_id and text are ignored, or carried
along whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Bytes of the first block, and how many times longer each further one is.
FIRST, GROWTH = 64, 8
_KEYS = ["group", "block", "ended"]


def _split(live: DataFrame, size: int) -> DataFrame:
    """One round: each row with the size, largest doc_id and number of its next group, and whether that is finished."""
    keyed = live.select(
        "doc_id",
        "carried",
        "group",
        F.substring("rest", 1, size).alias("block"),
        F.expr(f"substring(rest, {size + 1})").alias("rest"),
        (F.length("rest") <= size).alias("ended"),
    )
    groups = keyed.groupBy(*_KEYS).agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")).where("group_size > 1")
    groups = materialize(groups.withColumn("next", F.monotonically_increasing_id()), "radix-groups")
    finished = F.col("ended") | F.col("next").isNull()
    rows = keyed.join(groups.hint("merge"), _KEYS, "left").select(
        "doc_id",
        "carried",
        F.col("next").alias("group"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.when(F.col("next").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        finished.alias("finished"),
        F.when(~finished, F.col("rest")).alias("rest"),
    )
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "radix-rows")


def _with_kept(done: DataFrame) -> DataFrame:
    """Finished rows with ``kept``: one of each group, of those that have its largest doc_id."""
    alone, many = done.where("group IS NULL"), done.where("group IS NOT NULL")
    first = many.where("doc_id <=> keep_id").groupBy("group").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("kept"))
    out = ["doc_id", "carried", "keep_id", "group_size"]
    return alone.select(*out, F.lit(True).alias("kept")).union(many.join(first, "row", "left").select(*out, F.coalesce("kept", F.lit(False))))


def classes(docs: DataFrame, carried: dict[str, str | Column] | None = None, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept and the struct ``carried`` for every row of ``docs``.

    Texts are equal when their bytes are. ``carried`` names further values of a
    row, as columns of ``docs`` or expressions over them.
    """
    kept_along = [F.lit(None).cast("int").alias("nothing")] if not carried else [(docs[c] if isinstance(c, str) else c).alias(k) for k, c in carried.items()]
    live = docs.select(
        docs["doc_id"].alias("doc_id"), F.struct(*kept_along).alias("carried"), F.lit(0).cast("long").alias("group"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("rest")
    )
    parts, size = [], first
    while True:
        rows = _split(live, size)
        parts.append(_with_kept(rows.where("finished")))
        live = rows.where("NOT finished").select("doc_id", "carried", "group", "rest")
        if live.isEmpty():
            return reduce(DataFrame.union, parts)
        size *= growth


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    names = docs.columns
    kept = classes(docs, {f"c{i}": name for i, name in enumerate(names)}).where("kept")
    return kept.select(*[F.col("carried")[f"c{i}"].alias(name) for i, name in enumerate(names)])
