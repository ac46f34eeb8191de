"""Which rounds of a training schedule a corpus of a given size goes through."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def effective_rounds(sizes: DataFrame, rounds: Sequence[tuple[str, int, bool]], disabled: Collection[str] = (), utts: str = "utts") -> DataFrame:
    """The rounds (kind, subset, optional) that are run for each row of ``sizes``: its columns, nth, kind, subset, optional.

    Rounds of a disabled kind are left out. An optional round whose subset is larger than
    the corpus ends training: it and all rounds after it are left out. A subset that isn't smaller
    than the corpus is 0, the whole corpus. ``nth`` is the round's place in the schedule. The schedule
    is a literal of the plan, so the table of sizes is neither joined nor shuffled.
    A corpus of unknown (null) size counts as empty; an empty schedule gives no rows.
    """
    kept = [(n, *r) for n, r in enumerate(rounds) if r[0] not in disabled]
    fields = lambda r: [F.lit(v).cast(t).alias(k) for v, t, k in zip(r, ("int", "string", "long", "boolean"), ("nth", "kind", "subset", "optional"), strict=True)]
    if not kept:
        empty = [F.lit(None).cast(t).alias(k) for k, t in (("nth", "int"), ("kind", "string"), ("subset", "long"), ("optional", "boolean"))]
        return sizes.select("*", *empty).where(F.lit(False))
    n = F.coalesce(F.col(utts), F.lit(0))
    schedule = F.array(*[F.struct(*fields(r)) for r in kept])
    ends = F.array_position(F.transform(schedule, lambda r: r["optional"] & (r["subset"] > n)), True)
    run = F.when(ends > 0, F.slice(schedule, 1, (ends - 1).cast("int"))).otherwise(schedule)
    each = sizes.select("*", F.explode(run).alias("_round"))
    subset = F.when(F.col("_round.subset") < n, F.col("_round.subset")).otherwise(F.lit(0))
    return each.select(*sizes.columns, "_round.nth", "_round.kind", subset.cast("long").alias("subset"), "_round.optional")
